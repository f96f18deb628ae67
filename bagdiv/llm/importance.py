"""Importance resampling towards a target distribution, in DataFrame operations alone.

Words become rows with their position (posexplode); a window by document looks ahead with lead(), so that
each position holds the runs of words that begin there, one of each order, as hashed buckets. That position
table is written once. Its buckets are counted, a gain for each bucket compares them with the target's, and the
gains are joined back to the positions and summed by document. The documents are then drawn by a global sort of
weight and Gumbel noise, numbered by offsets of its ranges and not in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: What stands between words: all of ASCII but letters, of both cases here, and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of gains that are broadcast at most; a row is 12 bytes.
BROADCAST_BUCKETS = 1 << 20


def lowered(word: Column) -> Column:
    """A-Z alone in lower case; lower() does the same where all is ASCII, and faster, and most other words have nothing to do."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).when(~word.rlike("[A-Z]"), word).otherwise(F.translate(word, UPPER, LOWER))


def positions(table: DataFrame, orders: int, buckets: int, keep: list[str] = []) -> DataFrame:
    """table (text, and the columns in keep) -> (key, keep…, b1, b2, …): a row for each word, with the buckets of the runs of
    1, 2, … words from it on, null where the text ends before. A text without words gives one row without buckets.

    key is the row's own, so rows that are alike or have no doc_id stay apart. The texts are dealt by it before they become
    words, which is what the window needs: the words themselves aren't shuffled.
    """
    dealt = table.select(*keep, "text", F.monotonically_increasing_id().alias("key")).repartition("key").sortWithinPartitions("key")
    words = dealt.select("key", *keep, F.posexplode_outer(F.split("text", BETWEEN)).alias("at", "raw"))
    # Empty parts are at the ends alone; that at the beginning stays, as the row of a text without words.
    words = words.where("at is null or at = 0 or raw <> ''").select("key", *keep, "at", F.when(F.col("raw") != "", lowered(F.col("raw"))).alias("word"))
    after = W.partitionBy("key").orderBy("at")
    ahead = words.select("key", *keep, "word", *(F.lead("word", i).over(after).alias(f"w{i}") for i in range(1, orders)))
    run = F.col("word")
    found = []
    for i in range(1, orders + 1):
        found.append((F.crc32(run.cast("binary")) % buckets).cast("int").alias(f"b{i}"))
        run = F.concat(run, F.lit(" "), F.col(f"w{i}")) if i < orders else run
    return ahead.select("key", *keep, *found)


def bucket_counts(places: DataFrame, orders: int, name: str) -> DataFrame:
    """(bucket, <name>): how many runs of any order fall in each bucket that has some."""
    each = places.select(F.explode(F.array(*(f"b{i}" for i in range(1, orders + 1)))).alias("bucket"))
    return each.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def gains(own: DataFrame, target: DataFrame, orders: int, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets with features on one side at least, `buckets` rows at most."""
    s, t = checkpointed(bucket_counts(own, orders, "s")), checkpointed(bucket_counts(target, orders, "t"))
    s_all, t_all = (x.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0] for x, n in ((s, "s"), (t, "t")))
    real = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1
    ratio = real("t") * F.lit(float(s_all + buckets)) / (real("s") * F.lit(float(t_all + buckets)))
    return s.join(t, "bucket", "full").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise), from the first 32 bits of sha256 over `<seed>:<doc_id>`; nothing behind the colon for null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, orders: int = 3, buckets: int = 10_000) -> DataFrame:
    """documents (doc_id, text), target (text); more columns are ignored -> (doc_id, n_features, weight, score, rank), a row for each row.

    Features are runs of 1 to `orders` words, repeats counted; null and empty texts have none and the weight 0.
    Of the documents with `least_words` words at least, percent of a hundred (rounded down) are drawn: those of the highest
    scores, ties to the smaller doc_id, a null one last. rank counts them from 1 and is null for all others.
    Repeated rows count as documents of their own, and those of one doc_id have the same noise. An empty table gives
    no rows; an empty target has no features, and the gains still compare with it.
    A text is split in one task, which holds its words (some 60 bytes each, beside the text) for a moment; behind it they are
    rows that Spark spills, so a text of 100 MB needs about 1.2 GB there.
    """
    own = checkpointed(positions(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), orders, buckets, ["doc_id"]))
    by_bucket = checkpointed(gains(own, positions(target.select("text"), orders, buckets), orders, buckets))
    met, total = own, F.lit(0)
    for i in range(1, orders + 1):
        side = by_bucket.select(F.col("bucket").alias(f"b{i}"), F.col("gain").alias(f"g{i}"))
        met = met.join(F.broadcast(side) if buckets <= BROADCAST_BUCKETS else side, f"b{i}", "left")
        total = total + F.coalesce(F.col(f"g{i}"), F.lit(0))
    n_features = sum((F.count(f"b{i}") for i in range(2, orders + 1)), F.count("b1"))
    summed = met.groupBy("key", "doc_id").agg(n_features.alias("n_features"), F.count("b1").alias("n_words"), F.sum(total).cast("long").alias("weight"))
    scored = summed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("late", F.col("n_words") < least_words)
    order = [F.col("late").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("key").asc()]
    # Range partitions in order; the number of a row has its partition in front and its place there behind.
    placed = checkpointed(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(~F.col("late")).alias("able"))
    # A row for each range partition, of which there are as many as Spark is told to make.
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("able").over(W.partitionBy()).alias("able"))
    rank = F.col("before") + within + 1
    drawn = F.floor(F.lit(percent) * F.col("able") / 100)
    ranked = placed.withColumn("part", part).join(F.broadcast(before), "part")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(~F.col("late") & (rank <= drawn), rank).cast("long").alias("rank"))


def _crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB by the column table_, a byte at a time, taken from the hex digits."""
    digits = f"hex(encode({text}))"
    byte = f"(('0x' || {digits}[2 * i + 1:2 * i + 2])::bigint)"
    bytes_ = f"list_transform(range(length({digits}) // 2), lambda i: {byte})"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda c, b: xor(c >> 8, table_[(xor(c & 255, b) + 1)::int])), 4294967295)"


def oracle(percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000) -> str:
    step = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    words = lambda t, keep: f"select {keep} list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as w from {t}"
    runs = "flatten([w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])"
    return f"""
with c0 as (select i, i::bigint as x from range(256) r(i)), {", ".join(f"c{n + 1} as (select i, {step} as x from c{n})" for n in range(8))},
crc as (select list(x order by i) as table_ from c8),
d as ({words("documents", "doc_id,")}), b as ({words("benchmark", "")}),
df as (select doc_id, unnest({runs}) as f from d), bf as (select unnest({runs}) as f from b),
dc as materialized (select doc_id, f, count(*) as n from df group by all), bc as materialized (select f, count(*) as n from bf group by f),
names as materialized (select f, ({_crc_sql("f")}) % {buckets} as k from (select f from dc union select f from bc), crc),
s as (select k, sum(n) as n from dc join names using (f) group by k), t as (select k, sum(n) as n from bc join names using (f) group by k),
g as (select k, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + {buckets})::double / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + {buckets})::double)))::bigint as gain from s full join t using (k)),
w as (select doc_id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from dc join names using (f) join g using (k) group by doc_id),
r as (select d.doc_id, len(d.w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{seed}:' || d.doc_id)[1:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as score from d left join w on d.doc_id = w.doc_id),
o as (select doc_id, row_number() over (order by score desc, doc_id) as rank from r where n_words >= {least_words})
select r.doc_id, n_features, weight, score, case when o.rank <= floor({percent} * (select count(*) from o) / 100) then o.rank end as rank from r left join o on r.doc_id = o.doc_id
"""

