"""Exact nearest neighbours between bags, over a grid of groups of bags.

Every chunk of points goes to the cells of one line (as queries) and one column (as neighbours) of a grid, so
that a chunk is sent as often as the grid has lines and columns and not once per bag. A task holds the neighbours of
one cell, which bounds the columns, and streams its queries: candidates by products of matrices, then exact distances. What a chunk of queries found in several cells comes together in order
of the bag that it asked, its own bag first, so that one pass over it has all that divergences need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a chunk, bytes of neighbours that a cell is planned to hold, its products, and tasks that cells are dealt to at most.
CHUNK, CELL_BYTES, CELL_PRODUCTS, CELL_TASKS = 2048, 1 << 26, 1 << 33, 20_000


@dataclass(frozen=True)
class Shape:
    """Dimension, number of points, and points of the smallest and the largest bag."""

    dim: int
    points: int
    smallest: int
    largest: int


def shape(pts: DataFrame) -> Shape:
    """In one job. Features must have one length."""
    size = F.size("features")
    by_bag = pts.groupBy("bag_id").agg(F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high"))
    low, high, total, small, large = by_bag.agg(F.min("low"), F.max("high"), F.sum("n"), F.min("n"), F.max("n")).first()
    if low is None or low != high or low < 1:
        raise ValueError(f"features must have one length, not {low} to {high}")
    return Shape(low, total, small, large)


def chunks(pts: DataFrame, chunk: int = CHUNK, largest: int | None = None) -> DataFrame:
    """(bag_id, n, part, split, rows): chunks of about `chunk` points, packed. n is the bag's size; split is the bag's, null
    without such a column. largest: points of the largest bag, where it is known; bags of one chunk need no join."""
    split = (F.col("split").cast("string") if "split" in pts.columns else F.lit(None).cast("string")).alias("split")
    row = F.sort_array(F.collect_list(F.struct("point_id", "features"))).alias("rows")
    if largest is not None and largest <= chunk:
        whole = pts.select("bag_id", split, "point_id", "features").groupBy("bag_id").agg(F.min("split").alias("split"), row)
        return whole.select("bag_id", F.size("rows").cast("long").alias("n"), F.lit(0).alias("part"), "split", "rows")
    sized = pts.join(pts.groupBy("bag_id").agg(F.count("*").alias("n")), "bag_id")
    part = F.pmod(F.xxhash64("point_id"), F.ceil(F.col("n") / chunk)).cast("int").alias("part")
    return sized.select("bag_id", "n", part, split, "point_id", "features").groupBy("bag_id", "n", "part").agg(F.min("split").alias("split"), row).select("bag_id", "n", "part", "split", "rows")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean, by differences: near-duplicates keep their digits."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        out += (x[:, k, None] - y[None, :, k]) ** 2
    return np.sqrt(out)


def smallest(d: np.ndarray, k: int) -> np.ndarray:
    if d.shape[1] > k:
        d = np.partition(d, k - 1, axis=1)[:, :k]
    return np.sort(d, axis=1)


#: Products of points from which on single precision finds candidates, and neighbours of the first and of the further of its tiles.
MANY_PRODUCTS, FIRST, TILE = 1 << 14, 256, 1024


def exact_nearest(x: np.ndarray, names: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, own: bool, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(distances, ids) of the k nearest in y (fewer, if it has fewer) to each point of x, from all distances; ties by id if asked
    for. own: points of the same name are none."""
    d = distances(x, y)
    if own:
        d[names[:, None] == ids[None]] = math.inf
    if not with_ids:
        return smallest(d, k), None
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
    return np.take_along_axis(d, order, 1), ids[order]


class Bag:
    """The points of a bag in one cell: as they are, and moved and scaled into the unit ball in single precision."""

    def __init__(self, bag, n: int, split, ids: list[np.ndarray], points: list[np.ndarray]):
        self.bag, self.n, self.split = bag, n, split
        self.ids, self.x = (ids[0], points[0]) if len(ids) == 1 else (np.concatenate(ids), np.concatenate(points))
        self.middle, self.scale, self.ball = self.x.mean(0), 0.0, None
        with np.errstate(all="ignore"):
            z = self.x - self.middle
            far = math.sqrt((z**2).sum(1).max())
            if 1e-100 < far < 1e100:
                self.scale = 2.0 ** -math.ceil(math.log2(far))
                z *= self.scale
                self.ball, self.norms = z.astype(np.float32), (z**2).sum(1).astype(np.float32)

    def nearest(self, x: np.ndarray, names: np.ndarray, k: int, own: bool, with_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """What `exact_nearest` gives. Squared distances (less the point's own square) come from products in single precision, up to `slack`;
        what they don't rule out is measured in double precision. Points outside of a large ball, or not finite, take the plain way."""
        if len(x) * len(self.x) < MANY_PRODUCTS or self.ball is None:
            return exact_nearest(x, names, self.x, self.ids, k, own, with_ids)
        with np.errstate(all="ignore"):
            z = (x - self.middle) * self.scale
            away = np.sqrt((z**2).sum(1))
        if not (away < 1e4).all():
            return exact_nearest(x, names, self.x, self.ids, k, own, with_ids)
        n, m, dim = len(x), len(self.x), x.shape[1]
        slack = 2 * (dim + 32) * 2.0**-23 * (away + 1) ** 2
        turned, best, found, lo = (-2 * z).astype(np.float32), None, [], 0
        while lo < m:
            hi = min(m, lo + (FIRST if lo == 0 else TILE))
            d = turned @ self.ball[lo:hi].T
            d += self.norms[lo:hi]
            if own:
                d[names[:, None] == self.ids[None, lo:hi]] = math.inf
            if best is None:
                best = np.pad(smallest(d, k), ((0, 0), (0, max(0, k - (hi - lo)))), constant_values=math.inf)
            # A limit in single precision is rounded up.
            limit = np.nextafter((best[:, -1] + slack).astype(np.float32), np.float32(math.inf))
            at = np.flatnonzero(d <= limit[:, None])
            row, column = np.divmod(at, hi - lo)
            value = d.ravel()[at]
            found.append((row, column + lo, value))
            if lo:
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                few = rank < k
                more = np.full((n, k), np.float32(math.inf))
                more[row[few], rank[few]] = value[few]
                best = smallest(np.concatenate([best, more], axis=1), k)
            lo = hi
        row, column, value = (np.concatenate(c) for c in zip(*found))
        keep = np.flatnonzero((value <= best[row, -1] + slack[row]) & np.isfinite(value))
        row, column = row[keep], column[keep]
        width = min(k, m)
        near, ids = np.full((n, width), math.inf), np.zeros((n, width), np.int64)
        # Rows of equal distances can be many where bags hold copies.
        cut = np.arange(0, len(row), 1 << 16)
        d = np.concatenate([_gaps(x, self.x, row[c : c + (1 << 16)], column[c : c + (1 << 16)]) for c in cut]) if len(row) else np.zeros(0)
        name = self.ids[column]
        order = np.lexsort((name, d, row))
        row, d, name = row[order], d[order], name[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        few = rank < width
        near[row[few], rank[few]], ids[row[few], rank[few]] = d[few], name[few]
        return near, ids


def _gaps(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs of rows, as `distances` adds them up."""
    gap = (x[i] - y[j]).T
    out = np.zeros(len(i))
    for g in gap:
        out += g**2
    return np.sqrt(out)


def _chunk(row: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """(ids, points) of a packed chunk."""
    held = row.values
    x = held.field("features")
    return held.field("point_id").to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


FOUND = "p {0}, n long, part int, q {0}, m long, width int, near binary, own binary, ids binary"


def _near(k: int, with_ids: bool):
    """Rows (cell, side, bag_id, n, part, split, wanted, rows) by cell, neighbours first and by bag -> the k least distances of each query chunk to the points of each bag in the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, bags = None, [], None
        for batch in batches:
            kind = batch.schema.field("bag_id").type
            for i in range(batch.num_rows):
                now, side, bag, n, part, split, wanted = (batch.column(c)[i].as_py() for c in ("cell", "side", "bag_id", "n", "part", "split", "wanted"))
                ids, x = _chunk(batch.column("rows")[i])
                if now != cell:
                    cell, held, bags = now, [], None
                if side == 0:
                    if not held or held[-1][0] != bag:
                        held.append((bag, n, split, [], []))
                    held[-1][3].append(ids)
                    held[-1][4].append(x)
                    continue
                if bags is None:
                    bags, held = [Bag(*h) for h in held], []
                out, only = [], None if wanted is None else {*wanted, bag}
                for other in bags:
                    if (only is not None and other.bag not in only) or (other.bag != bag and split is not None and split == other.split):
                        continue
                    d, near = other.nearest(x, ids, k, other.bag == bag, with_ids)
                    names = (ids.astype("<i8").tobytes(), near.astype("<i8").tobytes()) if with_ids else (None, None)
                    out.append((bag, n, part, other.bag, other.n, d.shape[1], d.tobytes(), *names))
                if out:
                    types = (kind, pa.int64(), pa.int32(), kind, pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], ["p", "n", "part", "q", "m", "width", "near", "own", "ids"])

    return run


def merged(rows: list[tuple[int, bytes]], k: int, least: float) -> np.ndarray:
    """The k least of several chunks' distances, none below `least`; infinite where there are fewer."""
    d = np.concatenate([np.frombuffer(b).reshape(-1, w) for w, b in rows], axis=1)
    d = smallest(d, k)
    d = np.pad(d, ((0, 0), (0, k - d.shape[1])), constant_values=math.inf)
    return np.maximum(d, least)


def grid(of: Shape, tasks: int) -> tuple[int, int]:
    """Lines and columns: as many columns as bound the bytes of a cell's neighbours, as many lines at least as give `tasks` cells (256 at most)
    and bound a cell's products. A chunk is sent once for each line and column, so where products need more cells these are about equally many."""
    columns = max(math.ceil(of.points * of.dim * 8 / CELL_BYTES), min(16, math.isqrt(tasks)), math.ceil(of.points / math.sqrt(CELL_PRODUCTS)))
    return max(columns // 2, math.ceil(max(min(256, tasks), of.points**2 / CELL_PRODUCTS) / columns), 1), columns


#: Up to this dimension and from this many points on, the join with bounds takes the place of the grid.
FEW_DIMENSIONS, MANY_POINTS = 5, 1 << 15


def near(pts: DataFrame, k: int, of: Shape | None = None, pairs: DataFrame | None = None, with_ids: bool = False, how: str = "auto") -> DataFrame:
    """(p, n, part, q, m, width, near, own, ids): for a chunk of p's points and some of q's, a matrix of the distances to the
    nearest `width` (k at most), the point itself left out; own and ids are of the points and the neighbours, if asked for.
    n and m are the sizes of the bags. Rows come by p and part, in order of q with p itself first.

    With a column split, bags meet themselves and the bags of another split only. pairs (p, q): p meets itself
    and these alone, and bags in no pair aren't sent anywhere.

    how: grid, pruned (the join with bounds of `pruned`), or auto, which takes the one or the other by dimension and size. Both
    are exact.
    """
    spark, of = pts.sparkSession, of or shape(pts)
    if how not in ("auto", "grid", "pruned"):
        raise ValueError(f"unknown join {how!r}")
    if how == "pruned" or (how == "auto" and of.dim <= FEW_DIMENSIONS and of.points >= MANY_POINTS):
        from .pruned import pruned_near

        return pruned_near(pts, k, of, pairs, with_ids)
    kind = pts.schema["bag_id"].dataType.simpleString()
    packed = chunks(pts, CHUNK, of.largest)
    if pairs is None:
        packed = packed.withColumn("wanted", F.lit(None).cast(f"array<{kind}>"))
    else:
        # A bag that others ask only meets itself: its null is no member of the set.
        ends = pairs.select(F.col("p").alias("bag_id"), F.col("q").alias("other")).union(pairs.select("q", F.lit(None).cast(kind)))
        packed = packed.join(ends.groupBy("bag_id").agg(F.collect_set("other").alias("wanted")), "bag_id")
    lines, columns = grid(of, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "bag_id", "part"), F.lit(n)).cast("long")
    at = lambda side, n, cell: F.transform(whole(n), lambda i: F.struct(cell(i).alias("cell"), F.lit(side).alias("side")))
    line, column = own(1, lines), own(2, columns)
    places = F.explode(F.concat(at(1, columns, lambda j: line * columns + j), at(0, lines, lambda i: i * columns + column)))
    rows = packed.withColumn("place", places).select("place.cell", "place.side", "bag_id", "n", "part", "split", "wanted", "rows")
    cells = min(lines * columns, CELL_TASKS)
    dealt = rows.repartitionById(cells, F.pmod("cell", F.lit(cells)).cast("int"))
    found = dealt.sortWithinPartitions("cell", "side", "bag_id", "part").mapInArrow(_near(k, with_ids), FOUND.format(kind))
    return found.repartition("p", "part").sortWithinPartitions("p", "part", F.col("p") != F.col("q"), "q")


def by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of `near` -> (p, part, q) and its rows, one after another."""
    key, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            now = (r["p"], r["part"], r["q"])
            if now != key:
                if held:
                    yield key, held
                key, held = now, []
            held.append(r)
    if held:
        yield key, held


def nearest(pts: DataFrame, k: int, pairs: DataFrame | None = None, how: str = "auto") -> DataFrame:
    """(p, i, q, j, rank, dist): the k nearest of each bag to every point, or of the bags that pairs name; ties by id. how: see `near`."""
    kind = pts.schema["bag_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (p, _, q), rows in by_pair(batches):
            bag = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}.get(kind)
            i = np.frombuffer(rows[0]["own"], "<i8")
            d = np.concatenate([np.frombuffer(r["near"]).reshape(len(i), -1) for r in rows], axis=1)
            j = np.concatenate([np.frombuffer(r["ids"], "<i8").reshape(len(i), -1) for r in rows], axis=1)
            if len(rows) > 1:
                order = np.lexsort((j, d), axis=1)[:, :k]
                d, j = np.take_along_axis(d, order, 1), np.take_along_axis(j, order, 1)
            rank = np.broadcast_to(np.arange(1, d.shape[1] + 1, dtype=np.int32), d.shape)
            ok = np.isfinite(d).ravel()
            own = np.repeat(i, d.shape[1])[ok]
            of = lambda name: pa.repeat(pa.scalar(name, bag), len(own))
            yield pa.RecordBatch.from_arrays([of(p), pa.array(own), of(q), pa.array(j.ravel()[ok]), pa.array(rank.ravel()[ok]), pa.array(d.ravel()[ok])], ["p", "i", "q", "j", "rank", "dist"])

    return near(pts, k, pairs=pairs, with_ids=True, how=how).mapInArrow(run, f"p {kind}, i long, q {kind}, j long, rank int, dist double")
