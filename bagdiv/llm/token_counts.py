"""Token counts of documents, without token ids.

One pass over the texts finds the distinct pre-tokens, whose pieces are counted once each, and a second joins
them to the pre-token frequencies of each document. The most frequent pre-tokens, within a stated bound, are
joined from a broadcast table inside the task that splits the text; all others are joined by shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .frequent import above_cutoff

#: Fixed value: the split pattern of byte-level BPE vocabularies of this family, 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+,
#: for code points below U+02B0, where \w is a letter, a digit, one of six other numbers or _.
_LETTER, _NUMBER = r"[^\W\d_²³¹¼½¾]", r"[\d²³¹¼½¾]"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

_loaded: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """What a task needs of one tokenizer file: its pre-tokens, its special strings and pieces of a pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = re.compile(LATIN_PATTERN).findall
        self.plain = re.compile(r"[\x00-\x1b\x20-ʯ]*").fullmatch  # \x1c to \x1f are white space to this module alone

    @staticmethod
    def of(path: str) -> "PieceCounter":
        if path not in _loaded:
            _loaded[path] = PieceCounter(path)
        return _loaded[path]

    def split(self, text: str) -> list[str]:
        """Pre-tokens. Letters beyond the Latin blocks follow the library, whose Unicode tables may be of another age."""
        if self.plain(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """How many special strings a text has, and how often each pre-token."""
        if self.special is None or not (n := len(self.special.findall(text))):
            return 0, Counter(self.split(text))
        found: Counter = Counter()
        for part in self.special.split(text):
            found.update(self.split(part))
        return n, found

    def pieces(self, pre: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch(pre, add_special_tokens=False)]


def _summary(path: str):
    """Pre-tokens and how often the task met them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, all_of = PieceCounter.of(path), Counter()
        for batch in batches:
            for text in batch.column(0):
                if text := text.as_py():
                    for part in counter.special.split(text) if counter.special else [text]:
                        all_of.update(counter.split(part))
            if len(all_of) > 2_000_000:
                yield from out(all_of)
                all_of = Counter()
        yield from out(all_of)

    def out(found: Counter) -> Iterator[pa.RecordBatch]:
        names, times = [*found], [*found.values()]
        for i in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_pydict({"pre": pa.array(names[i : i + 100_000], pa.string()), "n": pa.array(times[i : i + 100_000], pa.int64())})

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counter = PieceCounter.of(path)
            for i in range(0, batch.num_rows, 20_000):
                pre = batch.column(0).slice(i, 20_000)
                yield pa.RecordBatch.from_pydict({"pre": pre, "n": batch.column(1).slice(i, 20_000), "pieces": pa.array(counter.pieces(pre.to_pylist()), pa.int64())})

    return run


def _frequencies(path: str, head):
    """(doc_id, one, two, text) -> a row for each document with its bytes, the tokens that the head gives, and no pre-token; and one for each other pre-token of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = PieceCounter.of(path), head.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                row, size, tokens, pre, times = [], [], [], [], []
                for at, text in enumerate(batch.column(3).slice(i, 500).to_pylist(), i):
                    special, found = counter.frequencies(text or "")
                    rest = [(k, n) for k, n in found.items() if k not in known]
                    row += [at] * (len(rest) + 1)
                    size += [len((text or "").encode()), *[None] * len(rest)]
                    tokens += [special + sum(known[k] * n for k, n in found.items() if k in known), *[0] * len(rest)]
                    pre += [None, *(k for k, _ in rest)]
                    times += [None, *(n for _, n in rest)]
                own = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(pre, pa.string()), pa.array(times, pa.int64())], ["doc_id", "one", "two", "size", "tokens", "pre", "times"])

    return run


def token_counts(documents: DataFrame, path: str, limit: int = 1024, head: int = 1 << 18) -> DataFrame:
    """documents (doc_id, text; more are ignored) -> (doc_id, n_bytes, n_tokens, over_limit), a row for each row.

    Counts equal the tokenizers library's with the file at path, no tokens added at the ends; special
    strings in a text are one token each. Null text counts as empty: 0 bytes, 0 tokens. Rows with a repeated or
    null doc_id are counted each by itself, told apart by 128 bits of hash of their texts; equal rows give equal rows. A very long
    text is split whole in one task, which holds its distinct pre-tokens besides. An empty table gives no rows. head: pre-tokens
    (of 64 characters at most) in the broadcast table, the most frequent of all texts; it changes no count.
    """
    spark = documents.sparkSession
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two"), "text")
    seen = own.select("text").mapInArrow(_summary(path), "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    pieces = checkpointed(seen.mapInArrow(_pieces(path), "pre string, n long, pieces long"))
    rows = above_cutoff(pieces.where(F.length("pre") <= 64), head).select("pre", "pieces").collect()
    table = spark.sparkContext.broadcast({r.pre: r.pieces for r in rows})
    # A document's own row has no pre-token; its key matches nothing and spreads over the partitions.
    spread = F.coalesce("pre", F.concat(F.lit("\x00doc "), F.coalesce(F.col("doc_id"), F.col("one")).cast("string")))
    found = own.mapInArrow(_frequencies(path, table), "doc_id long, one long, two long, size long, tokens long, pre string, times long")
    met = found.withColumn("key", spread).join(pieces.select(F.col("pre").alias("key"), "pieces"), "key", "left")
    total = F.sum(F.col("tokens") + F.when(F.col("pre").isNull(), F.lit(0)).otherwise(F.col("times") * F.col("pieces")))
    # Rows of one doc_id and one text come together here and are told apart again.
    counted = met.groupBy("doc_id", "one", "two").agg(F.max("size").alias("n_bytes"), total.alias("n_tokens"), F.count("size").alias("rows"))
    each = counted.select("doc_id", "n_bytes", F.expr("n_tokens div rows").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
