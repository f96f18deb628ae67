"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Every copy of a document gets a virtual finish time: the words of its source up to and with it, in a
shuffled order, divided by the source's target. The copies of all sources are then sorted by it over the
whole and cut where the budget is spent. Both running sums go through sums of small ranges of the sort
key, so that no source and no table is summed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the shuffle key, and parts of a unit of virtual time, that make one range.
DIGITS, TICKS = 3, 2048


def source_targets(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """sized (source, size) -> (source, source_size, rank, target); a row for each source, null last.

    Targets share the total by weight; none is above `most` times its source's size, the excess being reshared.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name))
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("long"))
    own = own.withColumn("cap", F.lit(most) * F.col("source_size"))
    # With the sources by cap over weight, those at their cap come first; level is the share of a unit of weight if exactly the ones before are at it.
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy()
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    own = own.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    share = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(all_)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(share * F.col("weight"), F.col("cap").cast("double")))
    return own.select("source", "source_size", "rank", target.alias("target"))


def running(df: DataFrame, group: list[str], part: Column, order: list, size: str, name: str) -> DataFrame:
    """df with the sum of `size` up to and with each row, by group, in the order of part and then of `order`."""
    df = df.withColumn("_part", part)
    sums = df.groupBy(*group, "_part").agg(F.sum(size).alias("_sum"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(sums, [*group, "_part"]).withColumn(name, F.col("_before") + F.sum(size).over(within)).drop("_part", "_before")


def _times(documents: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(doc_id, source, size, alike, source_size, target, times): for rows alike in the first three, how many there are and how often the mix takes one of them."""
    sized = checkpointed(documents.select("doc_id", "source", word_count().alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("alike")))
    targets = checkpointed(source_targets(sized.select("source", (F.col("size") * F.col("alike")).alias("size")), weights, most))
    met = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select("doc_id", targets["source"], "size", "alike", "source_size", "rank", "target")
    rounds = F.least(F.lit(most), F.ceil(F.col("target") / F.col("source_size")).cast("int") + 1)
    copies = met.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), rounds * F.col("alike") - 1)))
    copies = copies.withColumn("round", (F.expr("copy div alike") + 1).cast("int"))
    name = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("round").cast("string"), F.when(F.col("copy") % F.col("alike") > 0, (F.col("copy") % F.col("alike")).cast("string")))
    copies = copies.withColumn("key", F.md5(name.cast("binary"))).select("doc_id", "rank", "size", "alike", "target", "round", "key")
    place = F.col("round") * F.lit(16**DIGITS) + F.conv(F.substring("key", 1, DIGITS), 16, 10).cast("long")
    copies = running(copies, ["rank"], place, ["round", "key", "doc_id", "size"], "size", "served")
    copies = copies.withColumn("finish", F.col("served") / F.col("target"))
    spot = F.least(F.floor(F.col("finish") * TICKS), F.lit(8 * TICKS))
    copies = running(copies.withColumn("whole", F.lit(0)), ["whole"], spot, ["finish", "rank", "round", "key", "doc_id", "size"], "size", "spent")
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    served = copies.groupBy("doc_id", "rank", "size", "alike").agg(F.count_if(F.col("spent") <= budget).alias("times"))
    rest = met.where("size = 0").select("doc_id", "rank", "size", "alike", F.lit(0).cast("long").alias("times"))
    by_rank = targets.select("rank", "source", "source_size", "target")
    return served.unionByName(rest).join(by_rank, "rank").select("doc_id", "source", "size", "alike", "source_size", "target", "times")


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _share(times: Column, alike: Column, nth: Column) -> Column:
    """Of `times` copies of `alike` rows those of the nth, from 1: as even as can be."""
    return F.floor(times / alike) + (nth <= times % alike).cast("long")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """documents (doc_id, text, source; more are ignored) -> (doc_id, size, source_size, target, taken), a row for each row.

    size: words of the text, null text has none. The budget is the total of all sizes. A document is
    taken as a whole, up to `most` times; the last copy that still fits ends the mix, so a source misses its
    target by about one document. The order is that of md5 over id and round: reruns agree, and ties go by id and size.
    Rows that are alike in doc_id, source and size share evenly what is taken of them, each at most `most` times;
    a null doc_id is a value as any other. Sources of no words have the target 0. An empty table gives no rows.
    """
    found = _times(documents, weights, most).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))))
    taken = F.col("size") * _share(F.col("times"), F.col("alike"), F.col("nth"))
    return found.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """The mix itself: each document as many times as `mix` takes it, its columns as they were, whatever their names."""
    # One key for what rows are told apart by, so that nulls meet.
    key = lambda size: F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), size.cast("string"), F.concat(F.lit("s"), "source"))
    counted = checkpointed(_times(documents, weights, most).where("times > 0").select(key(F.col("size")).alias("name"), "times", "alike"))
    rows = documents.select(F.struct("*").alias("row"), key(word_count()).alias("name")).join(counted, "name")
    if not counted.where("alike > 1").isEmpty():
        # Rows that are alike have an order among them by all that they hold.
        rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("name").orderBy(F.xxhash64("row"))))
        rows = rows.withColumn("times", _share(F.col("times"), F.col("alike"), F.col("nth"))).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


#: The same in DuckDB, over the whole table and without ranges.
ORACLE = r"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from {documents}),
s1 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank from sized group by source),
s2 as (select *, ([5, 2, 1])[((rank - 1) % 3 + 1)::int]::bigint as weight, 3 * source_size as cap from s1),
s3 as (select *, (sum(source_size) over () - coalesce(sum(cap) over o, 0))::double / (sum(weight) over () - coalesce(sum(weight) over o, 0))::double as level
       from s2 window o as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
share as (select arg_min(level, (cap / weight, rank)) as level from s3 where level * weight <= cap),
targets as (select source, source_size, rank, least(cap::double, coalesce((select level from share) * weight, cap::double)) as target from s3),
met as (select doc_id, size, source_size, rank, target from sized join targets on sized.source is not distinct from targets.source),
copies as (select *, md5(doc_id::varchar || '-' || round::varchar) as key from met, (select unnest([1, 2, 3]) as round) where size > 0),
served as (select *, (sum(size) over (partition by rank order by round, key, doc_id rows unbounded preceding))::double / target as finish from copies),
spent as (select *, sum(size) over (order by finish, rank, round, key, doc_id rows unbounded preceding) as spent from served),
taken as (select doc_id, sum(size)::bigint as taken from spent where spent <= (select sum(source_size) from targets) group by doc_id)
select met.doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from met left join taken on met.doc_id = taken.doc_id
"""
