"""The approximate neighbour join: hashing by random projections in several tables, distances of the candidates being exact.

A table has some functions floor((a.x + b) / width) with normal a, so that near points often agree in all of them. Points that
share a bucket of a table are candidates of each other. What the tables find is united, the distances are exact, and the k
nearest of each bag stay. The width follows from distances within a bounded sample, and everything else from all points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import checkpointed
from .knn import Shape, distances, shape

#: Points of a bucket that one task compares with as many at once; a larger bucket is cut into parts that all meet.
PART = 2048
#: Points of the sample from which the width is made.
SAMPLE = 1000


@dataclass(frozen=True)
class Hashes:
    """The functions of all tables: table x function x dimension, and their shifts in parts of a width."""

    slope: np.ndarray
    shift: np.ndarray
    width: float

    @staticmethod
    def drawn(dim: int, tables: int, functions: int, width: float, seed: int) -> "Hashes":
        rng = np.random.default_rng(seed)
        return Hashes(rng.standard_normal((tables, functions, dim)), rng.random((tables, functions)), width)

    def buckets(self, x: np.ndarray, t: int) -> np.ndarray:
        """A 64-bit number for each point: of equal function values in table t."""
        at = np.floor((x @ self.slope[t].T) / self.width + self.shift[t]).astype(np.int64).astype(np.uint64)
        key = np.full(len(x), t + 1, np.uint64)
        with np.errstate(over="ignore"):
            for column in at.T:
                key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
        return key.view(np.int64)


def width_of(pts: DataFrame, k: int, share: float, smallest_bag: int) -> float:
    """share times the median k-th distance that points have to a bag of the smallest size, judged from a sample of SAMPLE points.

    In the dimension d in which the sample's k-th and 2k-th distances grow, distances among n times as many points are
    shorter by the d-th root of n.
    """
    rows = pts.orderBy(F.xxhash64("bag_id", "point_id")).select("features").limit(SAMPLE).collect()
    x = np.array([r.features for r in rows], float)
    if len(x) <= 2 * k:
        return math.inf
    d = np.sort(distances(x, x), axis=1)
    near, far = np.median(d[:, k]), np.median(d[:, 2 * k])
    if not near:
        return float(share * (np.median(d[d > 0]) if (d > 0).any() else 1.0))
    root = math.log2(far / near) if far > near else 1e-3
    return float(share * near * (len(x) / smallest_bag) ** root)


def _coded(hashes: Hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for t in range(len(hashes.slope)):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes.buckets(x, t))], [*batch.schema.names, "bucket"])

    return run


def _candidates(k: int):
    """Rows by (bucket, ask, part), those that are asked first -> the k nearest of each bag among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, asking = None, [], []

        def answered() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).combine_chunks() if held else None
            ask = pa.concat_tables(asking).combine_chunks() if asking else None
            if table is None or ask is None:
                return
            of = lambda t: t.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
            y, x = of(table), of(ask)
            ids, names = table.column("point_id").to_numpy(), ask.column("point_id").to_numpy()
            bags, own = (t.column("bag_id").combine_chunks().dictionary_encode() for t in (table, ask))
            code, here = bags.indices.to_numpy(zero_copy_only=False), own.indices.to_numpy(zero_copy_only=False)
            same = {b: i for i, b in enumerate(own.dictionary.to_pylist())}
            for q, bag in enumerate(bags.dictionary.to_pylist()):
                at = np.flatnonzero(code == q)
                at = at[np.argsort(ids[at], kind="stable")]
                for lo in range(0, len(x), 256):
                    d = distances(x[lo : lo + 256], y[at])
                    d[(names[lo : lo + 256, None] == ids[at][None]) & (here[lo : lo + 256] == same.get(bag, -1))[:, None]] = math.inf
                    order = np.argsort(d, axis=1, kind="stable")[:, :k]
                    d = np.take_along_axis(d, order, 1)
                    row, column = np.nonzero(np.isfinite(d))
                    if len(row):
                        asks = ask.slice(lo, 256)
                        yield pa.RecordBatch.from_arrays([asks.column("bag_id").combine_chunks().take(pa.array(row)), pa.array(names[lo + row]), bags.dictionary.take(pa.array(np.full(len(row), q))), pa.array(ids[at][order[row, column]]), pa.array(d[row, column])], ["p", "i", "q", "j", "dist"])

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "ask", "part", "side")])
            edges = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys))
            lo = 0
            for hi in edges:
                if tuple(keys[lo][:3]) != key:
                    yield from answered()
                    key, held, asking = tuple(keys[lo][:3]), [], []
                (asking if keys[lo][3] else held).append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
                lo = hi
        yield from answered()

    return run


def approximate_nearest(pts: DataFrame, k: int, queries: DataFrame | None = None, tables: int = 12, functions: int = 4, share: float = 4.0, seed: int = 0, of: Shape | None = None) -> DataFrame:
    """(p, i, q, j, rank, dist), as `knn.nearest` gives, of the candidates alone: the rank counts those that were found, ties by id.

    queries (bag_id, point_id): the points that ask; all, without it. More tables find more, more functions make buckets smaller, a
    larger share (of the usual k-th distance, as the width of a bucket) finds more in larger buckets. A point is sent once for
    each table. A bucket with very many points is cut into parts that all meet, so nothing is left out of it.
    """
    of = of or shape(pts)
    kind = pts.schema["bag_id"].dataType.simpleString()
    pts = pts.select("bag_id", "point_id", "features")
    hashes = Hashes.drawn(of.dim, tables, functions, width_of(pts, k, share, of.smallest), seed)
    ask = F.lit(1) if queries is None else F.coalesce("asks", F.lit(0))
    marked = pts if queries is None else pts.join(queries.select("bag_id", "point_id", F.lit(1).alias("asks")).distinct(), ["bag_id", "point_id"], "left")
    marked = marked.select("bag_id", "point_id", "features", ask.alias("asks"))
    coded = checkpointed(marked.mapInArrow(_coded(hashes), f"bag_id {kind}, point_id long, features array<double>, asks int, bucket long"))
    # Only buckets with a point that asks matter.
    sizes = coded.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.ceil(F.sum("asks") / PART).cast("int").alias("asking")).where("asking > 0")
    met = coded.join(sizes, "bucket")
    own = F.xxhash64("bag_id", "point_id")
    place = lambda side, ask, part: F.struct(F.lit(side).alias("side"), ask.alias("ask"), part.cast("int").alias("part"))
    held = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda a: place(0, a, F.pmod(own, F.col("parts"))))
    asks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda b: place(1, F.pmod(own, F.col("asking")).cast("int"), b))
    rows = met.select("bucket", "bag_id", "point_id", "features", F.explode(F.concat(held, F.when(F.col("asks") == 1, asks).otherwise(F.array().cast(asks_type())))).alias("place"))
    rows = rows.select("bucket", "place.ask", "place.part", "place.side", "bag_id", "point_id", "features")
    key = ["bucket", "ask", "part"]
    found = rows.repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(_candidates(k), f"p {kind}, i long, q {kind}, j long, dist double")
    once = found.groupBy("p", "i", "q", "j").agg(F.min("dist").alias("dist"))
    best = W.partitionBy("p", "i", "q").orderBy("dist", "j")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("p", "i", "q", "j", "rank", "dist")


def asks_type() -> str:
    return "array<struct<side:int,ask:int,part:int>>"


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the pairs (p, i, q, j) of exact that are among those found."""
    pair = ["p", "i", "q", "j"]
    return exact.join(found.select(*pair).withColumn("hit", F.lit(1)), pair, "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
