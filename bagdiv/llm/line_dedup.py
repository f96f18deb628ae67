"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

The exact side is a table of holders (key, doc_id): one row for each document that holds a line of the key;
its counts by key are the reference counts. A key held by two documents or more is shared. Each shard of the
key space has a cuckoo filter of its shared keys. Documents probe the filters, so that only lines that
may be shared are joined to the exact counts: in the task that reads them while all filters fit a broadcast,
and in the shard's own tasks beyond. Deleting documents lowers the counts and deletes from the filters the keys
that are no longer shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh

BLANKS = b" \t\n\v\f\r"
KEY = ["hi", "lo"]
#: Keys in one shard's filter, as planned for; and the filters' bytes that are broadcast at most.
SHARD_KEYS, FILTER_BYTES, BROADCAST_ROWS = 1 << 16, 1 << 26, 100_000
#: Lines of shared keys that one task probes where shards have tasks of their own.
TASK_LINES = 1 << 22
_STIR = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def line_key(line: bytes, least: int) -> tuple[int, int] | None:
    """128 bits of the line without blanks at its ends, A-Z in lower case; None if it has under `least` code points."""
    key = line.strip(BLANKS).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    d = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class CuckooFilter:
    """16-bit fingerprints, four to a bucket; either of two buckets holds a key's. Deletes what was inserted."""

    def __init__(self, capacity: int, table: bytes | None = None):
        self.buckets = 1 << max(2, int(capacity / 3.2)).bit_length()
        self.table = np.zeros((self.buckets, 4), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(-1, 4).copy()
        self.buckets = len(self.table)

    def places(self, hi: int, lo: int) -> tuple[int, int, int]:
        """Fingerprint and buckets, from bits of lo; the shard is a matter of hi alone."""
        mark = (lo & 0xFFFF) or 1
        one = (lo & _ALL) >> 16 & (self.buckets - 1)
        return mark, one, one ^ self.hop(mark)

    def hop(self, mark: int) -> int:
        return (mark * _STIR & _ALL) >> 20 & (self.buckets - 1)

    def __contains__(self, key: tuple[int, int]) -> bool:
        mark, one, two = self.places(*key)
        return mark in self.table[one] or mark in self.table[two]

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark = lo.astype(np.uint64) & np.uint64(0xFFFF)
        mark[mark == 0] = 1
        mask = np.uint64(self.buckets - 1)
        one = (lo.astype(np.uint64) >> np.uint64(16)) & mask
        with np.errstate(over="ignore"):
            two = one ^ ((mark * np.uint64(_STIR) >> np.uint64(20)) & mask)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def _put(self, mark: int, at: int) -> bool:
        free = np.flatnonzero(self.table[at] == 0)
        if len(free):
            self.table[at, free[0]] = mark
        return bool(len(free))

    def insert(self, hi: int, lo: int) -> bool:
        """False if no room was found, and then nothing is changed; the caller makes a larger one from the exact keys."""
        mark, one, two = self.places(hi, lo)
        if self._put(mark, one) or self._put(mark, two):
            return True
        at, path = two, []
        for turn in range(500):
            slot = (at + turn) & 3
            path.append((at, slot, int(self.table[at, slot])))
            mark, self.table[at, slot] = path[-1][2], mark
            at ^= self.hop(mark)
            if self._put(mark, at):
                return True
        for at, slot, mark in reversed(path):
            self.table[at, slot] = mark
        return False

    def delete(self, hi: int, lo: int) -> bool:
        mark, one, two = self.places(hi, lo)
        for at in (one, two):
            if len(found := np.flatnonzero(self.table[at] == mark)):
                self.table[at, found[0]] = 0
                return True
        return False


def filled(keys: list[tuple[int, int]]) -> CuckooFilter:
    size = len(keys)
    while True:
        out = CuckooFilter(size)
        if all(out.insert(*k) for k in keys):
            return out
        size = 2 * size + 8


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = [(*k, d) for d, t in zip(batch.column(0).slice(i, 1000).to_pylist(), batch.column(1).slice(i, 1000).to_pylist()) for k in dict.fromkeys(line_key(x, least) for x in (t or "").encode("utf-8", "replace").split(b"\n")) if k]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["hi", "lo", "doc_id"])

    return run


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, hi, lo) in order of shard -> (shard, filter)."""

    def out(shard: int, keys: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "filter": pa.array([filled(keys).table.tobytes()], pa.binary())})

    now, keys = None, []
    for batch in batches:
        for shard, hi, lo in zip(*(batch.column(k).to_pylist() for k in ("shard", "hi", "lo"))):
            if shard != now:
                if keys:
                    yield out(now, keys)
                now, keys = shard, []
            keys.append((hi, lo))
    if keys:
        yield out(now, keys)


def _changed(key: tuple, left, right):
    """Deletes and inserts the changed keys of one shard in its filter; makes it anew from all of them if it is too full."""
    import pandas as pd

    out = CuckooFilter(8, left["filter"].iloc[0]) if len(left) else CuckooFilter(len(right))
    for hi, lo, sign in right[["hi", "lo", "sign"]].sort_values("sign").itertuples(index=False):
        if not (out.insert(int(hi), int(lo)) if sign > 0 else out.delete(int(hi), int(lo))):
            return pd.DataFrame({"shard": [key[0]], "filter": [None]})
    return pd.DataFrame({"shard": [key[0]], "filter": [out.table.tobytes()]})


@dataclass(frozen=True)
class LineIndex:
    """holders (hi, lo, doc_id), filters (shard, filter) of the shared keys, how keys are made, and the shared keys' counts once written."""

    holders: DataFrame
    filters: DataFrame
    shards: int
    least: int = 10
    known: DataFrame | None = None

    @staticmethod
    def of(documents: DataFrame, least: int = 10) -> "LineIndex":
        """An index of documents (doc_id, text; more are ignored); null text is one empty line."""
        holders = documents.select("doc_id", "text").mapInArrow(_lines(least), "hi long, lo long, doc_id long")
        index = LineIndex(holders, holders, 1, least)
        return index._with_filters(checkpointed(index.shared()))

    def counts(self) -> DataFrame:
        """Reference counts: (hi, lo, refs, owner); the owner is the smallest doc_id that holds the key."""
        return self.holders.groupBy(*KEY).agg(F.count("*").alias("refs"), F.min("doc_id").alias("owner"))

    def shared(self) -> DataFrame:
        return self.counts().where("refs >= 2") if self.known is None else self.known

    def _shard(self, n: int):
        return F.pmod("hi", F.lit(n)).cast("int").alias("shard")

    def _with_filters(self, shared: DataFrame) -> "LineIndex":
        n = max(1, -(-shared.count() // SHARD_KEYS))
        rows = shared.select(self._shard(n), *KEY)
        return replace(self, shards=n, known=shared, filters=checkpointed(rows.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_filters, "shard int, filter binary")))

    def _moved(self, after: "LineIndex") -> "LineIndex":
        after = replace(after, known=checkpointed(after.shared()))
        was, now = self.shared().select(*KEY), after.shared().select(*KEY)
        change = now.join(was, KEY, "left_anti").withColumn("sign", F.lit(1)).union(was.join(now, KEY, "left_anti").withColumn("sign", F.lit(-1)))
        change = change.select(self._shard(self.shards), *KEY, "sign")
        new = self.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(_changed, "shard int, filter binary")
        new = checkpointed(new)
        return after._with_filters(after.shared()) if new.where("filter is null").limit(1).count() else replace(after, filters=new)

    def insert(self, documents: DataFrame) -> "LineIndex":
        """With further documents, whose doc_ids must be new."""
        more = documents.select("doc_id", "text").mapInArrow(_lines(self.least), "hi long, lo long, doc_id long")
        return self._moved(replace(self, holders=checkpointed(self.holders.union(more)), known=None))

    def delete(self, doc_ids: DataFrame) -> "LineIndex":
        """Without the documents of a table (doc_id)."""
        return self._moved(replace(self, holders=checkpointed(self.holders.join(doc_ids.select("doc_id"), "doc_id", "left_anti").select(*KEY, "doc_id")), known=None))

    def _hits(self, lines: DataFrame, filter_bytes: int) -> DataFrame:
        """(hi, lo, doc_id) of lines that the filters hold: all that are shared, and a few others."""
        n, least, kind = self.shards, self.least, "hi long, lo long, doc_id long"
        if self.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0] <= filter_bytes:
            held = lines.sparkSession.sparkContext.broadcast({r.shard: bytes(r.filter) for r in self.filters.collect()})

            def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                tables = {k: CuckooFilter(8, v) for k, v in held.value.items()}
                for batch in _lines(least)(batches):
                    hi, lo = batch.column("hi").to_numpy(), batch.column("lo").to_numpy()
                    shard, hit = np.mod(hi, n), np.zeros(len(hi), bool)
                    for s in np.unique(shard):
                        if s in tables:
                            hit[shard == s] = tables[s].contains(hi[shard == s], lo[shard == s])
                    yield batch.filter(pa.array(hit))

            return lines.mapInArrow(probed, kind)
        # A shard of very common lines has several tasks, each with a copy of its filter.
        tasks = checkpointed(self.shared().groupBy(self._shard(n)).agg((F.floor(F.sum("refs") / TASK_LINES) + 1).cast("int").alias("tasks")))
        few = tasks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        asked = lines.mapInArrow(_lines(least), kind).withColumn("shard", self._shard(n)).join(F.broadcast(tasks) if few else tasks, "shard")
        asked = asked.select("shard", F.pmod(F.xxhash64("doc_id"), "tasks").cast("int").alias("task"), *KEY, "doc_id", F.lit(None).cast("binary").alias("filter"))
        given = self.filters.join(tasks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), *(F.lit(None).cast("long").alias(c) for c in (*KEY, "doc_id")), "filter")
        rows = given.unionByName(asked).repartition("shard", "task").sortWithinPartitions("shard", "task", F.col("filter").isNull())
        return rows.mapInArrow(_probed_in_shards, kind)

    def dropped(self, documents: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """(doc_id, gone): keys that documents of the index lose, as an array of 16-byte strings; only documents that lose some.

        filter_bytes: of filters that are broadcast; larger ones stay with their shards, and the lines come to them.
        """
        maybe = self._hits(documents.select("doc_id", "text"), filter_bytes)
        shared = self.shared().select(*KEY, "owner")
        few = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        met = maybe.join(F.broadcast(shared) if few else shared, KEY).where("doc_id > owner").select("doc_id", *KEY).distinct()
        return met.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("gone"))

    def rewritten(self, documents: DataFrame, keep_text: bool = True, facts: bool = True, **how) -> DataFrame:
        """documents without the dropped lines in their text (if asked for), and with n_lines, n_dropped, kept_sha256 (if asked for)."""
        rest = [c for c in documents.columns if not facts or c.lower() not in FACTS]
        documents = documents.select(*rest) if keep_text else documents.select("doc_id", "text")
        gone = fresh(documents.columns, "gone")[0]
        rows = documents.join(self.dropped(documents, **how).withColumnRenamed("gone", gone), "doc_id", "left").select(*documents.columns, gone)
        names = [c for c in documents.columns if c != "text" or keep_text]
        schema = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names] + ["n_lines long", "n_dropped long", "kept_sha256 string"] * facts
        return rows.mapInArrow(_rewritten(self.least, names, gone, facts), ", ".join(schema))


def _probed_in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, task, hi, lo, doc_id, filter), in each shard and task the filter before the lines."""
    now, held = None, None
    for batch in batches:
        place = np.column_stack([batch.column(c).to_numpy() for c in ("shard", "task")])
        edges = np.flatnonzero(np.append(True, (place[1:] != place[:-1]).any(1))) if len(place) else []
        for lo, hi in zip(edges, [*edges[1:], len(place)]):
            part = batch.slice(lo, hi - lo)
            if tuple(place[lo]) != now:
                now, held = tuple(place[lo]), None
            if part.column("filter")[0].is_valid:
                held, part = CuckooFilter(8, part.column("filter")[0].as_py()), part.slice(1)
            if held is not None and part.num_rows:
                keys = part.select(["hi", "lo", "doc_id"])
                yield keys.filter(pa.array(held.contains(keys.column(0).to_numpy(), keys.column(1).to_numpy())))


#: Columns that are added to documents.
FACTS = ("n_lines", "n_dropped", "kept_sha256")


def _rewritten(least: int, names: list[str], lost_keys: str, facts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, dropped, sha = [], [], [], []
            for text, gone in zip(batch.column("text"), batch.column(lost_keys)):
                lines = (text.as_py() or "").encode("utf-8", "replace").split(b"\n")
                kept = lines
                if gone.is_valid:
                    lost = {(k["hi"], k["lo"]) for k in gone.as_py()}
                    kept = [x for x in lines if line_key(x, least) not in lost]
                left = b"\n".join(kept)
                texts.append(left.decode() if gone.is_valid and text.is_valid else text.as_py())
                if facts:
                    n.append(len(lines)), dropped.append(len(lines) - len(kept)), sha.append(hashlib.sha256(left).hexdigest())
            own = {c: pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names}
            if facts:
                own |= {"n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict(own)

    return run


def line_dedup(documents: DataFrame, least: int = 10, keep_text: bool = True, **how) -> DataFrame:
    """documents (doc_id, text, …) -> the same with n_lines, n_dropped, kept_sha256.

    A text is split at \\n. Lines whose key (blanks stripped at both ends, A-Z in lower case) has at least
    `least` code points and is held by two documents or more stay only in the one with the smallest doc_id,
    where they all stay. Null text is one empty line and stays null; empty and very long texts are as any other.
    Rows of one doc_id are parts of one document: a line that they share stays in all of them. Rows without a
    doc_id lose nothing. Columns of the names that this adds are replaced; an empty table gives no rows.
    """
    return LineIndex.of(documents, least).rewritten(documents, keep_text, **how)


def without_repeated_lines(documents: DataFrame, least: int = 10, **how) -> DataFrame:
    """documents without the lines that `line_dedup` drops, and with the columns that they had."""
    return LineIndex.of(documents, least).rewritten(documents, facts=False, **how)
