"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors are rotated by one fixed orthogonal matrix and cut into low-dimensional blocks. If two
vectors are within squared distance D2 = 2 - 2t, then in at least one block their squared distance is
within that block's share of D2, in proportion to its dimensions. So each block is range-joined under
its own budget and the union of what the blocks find holds every link. A pair counts in the one block in
which its distance is the smallest share of the budget, which needs no pass to drop repeats, and it is
verified on the vectors as they came. Equal vectors of one label are one class, which takes part once, with its
number of copies. A task returns, for each class, a count and one edge of a local forest, never the list of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, long_array, mix64
from .components import connected_components

#: Rounding allowance in the search; the verification has none.
SLACK = 1e-9
CELL = "label long, dim int, block int, cell long"


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def added(rows: np.ndarray) -> np.ndarray:
    """The sum of the rows, one after another."""
    out = rows[0].copy()
    for row in rows[1:]:
        out += row
    return out


class Blocks:
    """The rotated coordinates of vectors of one length, and how the budget is shared among their blocks."""

    def __init__(self, dim: int, block_dim: int, threshold: float):
        self.turn = rotation(dim)
        self.starts = np.arange(0, dim, block_dim)
        self.sizes = np.diff(np.append(self.starts, dim))
        self.budget = (2 - 2 * threshold) * self.sizes / dim + SLACK

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates whose bits depend on the vector alone, not on its place among others as those of a matrix product:
        the tasks that meet a pair must agree on the block in which it counts."""
        out = np.empty(vectors.shape)
        for lo in range(0, len(vectors), 512):
            x = np.ascontiguousarray(vectors[lo : lo + 512].T)
            x = x / np.sqrt(added(x * x))
            turned = np.zeros(x.shape)
            for row, to in zip(x, self.turn):
                turned += to[:, None] * row
            out[lo : lo + 512] = turned.T
        return out

    def gaps(self, difference: np.ndarray) -> np.ndarray:
        """Shares of the budgets that differences of rotated coordinates take, by block; bits as in `turned`."""
        square = np.ascontiguousarray(difference.T) ** 2
        return np.stack([added(square[s : s + n]) / budget for s, n, budget in zip(self.starts, self.sizes, self.budget)], 1)

    def cells(self, x: np.ndarray, b: int, grid: int) -> np.ndarray:
        return np.floor(x / (2 * math.sqrt(self.budget[b]))).astype(np.int64)

    def span(self, b: int, grid: int) -> slice:
        return slice(self.starts[b], self.starts[b] + min(grid, self.sizes[b]))


def cell_key(cells: np.ndarray) -> np.ndarray:
    key = np.zeros(len(cells), np.uint64)
    with np.errstate(over="ignore"):
        for c in cells.T:
            key = mix64(key * np.uint64(31) + c.astype(np.uint64) + np.uint64(1))
    return key


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors, copies) by length of the vector, without those that link with nothing."""
    ids, vectors, labels = (batch.column(i) for i in range(3))
    lengths = np.array([-1 if n is None else n for n in pa.compute.list_value_length(vectors).to_pylist()], np.int64)
    known = ~labels.is_null().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[known]):
        if dim < 1:
            continue
        rows = np.flatnonzero(known & (lengths == dim))
        flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(math.nan)
        x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
        largest = np.abs(x).max(1)
        good = np.isfinite(largest) & (largest > 0)
        rows, x = rows[good], x[good]
        # By a power of two, which costs no digit, so that no square is too large or too small.
        x = np.ldexp(x, -np.frexp(largest[good])[1][:, None])
        yield ids.take(pa.array(rows)).to_numpy(), labels.take(pa.array(rows)).to_numpy().astype(np.int64), x, batch.column(3).take(pa.array(rows)).to_numpy()


def _coded(block_dim: int, threshold: float, grid: int, kind: str, probes: bool):
    """Rows of each block: the vector in its own cell, and as probe in every cell that its budget reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, x, copies in _usable(batch):
                dim = x.shape[1]
                at = Blocks(dim, block_dim, threshold)
                turned = at.turned(x)
                raw = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()) if probes else None
                for b in range(len(at.starts)):
                    part, r = turned[:, at.span(b, grid)], math.sqrt(at.budget[b])
                    home = at.cells(part, b, grid)
                    rows, cells, roles = [np.arange(len(ids))], [home], [np.zeros(len(ids), np.int8)]
                    if probes:
                        low, high = at.cells(part - r, b, grid), at.cells(part + r, b, grid)
                        todo = [(np.arange(len(ids)), np.zeros((len(ids), 0), np.int64))]
                        for k in range(part.shape[1]):
                            todo = [(who[ok], np.column_stack([c[ok], low[who[ok], k] + step])) for who, c in todo for step in range(int((high - low)[:, k].max(initial=0)) + 1) if (ok := low[who, k] + step <= high[who, k]).any()]
                        for who, c in todo:
                            rows.append(who), cells.append(c), roles.append(np.ones(len(who), np.int8))
                    row = np.concatenate(rows)
                    out = {"label": pa.array(labels[row]), "dim": pa.array(np.full(len(row), dim, np.int32)), "block": pa.array(np.full(len(row), b, np.int32)), "cell": long_array(cell_key(np.concatenate(cells)))}
                    if probes:
                        out |= {"probe": pa.array(np.concatenate(roles)), "vec_id": pa.array(ids[row]), "copies": pa.array(copies[row]), "raw": raw.take(pa.array(row))}
                    yield pa.RecordBatch.from_pydict(out)

    return run


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n, by links i, j."""
    root = np.arange(n)
    while True:
        was = root.copy()
        np.minimum.at(root, i, was[j])
        np.minimum.at(root, j, was[i])
        root = root[root]
        if np.array_equal(root, was):
            return root


def _linked(block_dim: int, threshold: float, kind: str):
    """Counts and forest edges; rows come sorted by cell, the vectors at home before the probes."""

    def pairs(at: Blocks, b: int, home: tuple, probe: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (hid, hx, ht, _), (pid, px, pt, _) = home, probe
        own = slice(at.starts[b], at.starts[b] + at.sizes[b])
        hb, hn = ht[:, own], np.linalg.norm(hx, axis=1)
        for lo in range(0, len(pid), 512):
            p = slice(lo, lo + 512)
            pb = pt[p, own]
            near = (pb * pb).sum(1)[:, None] + (hb * hb).sum(1)[None] - 2 * (pb @ hb.T) <= at.budget[b] + SLACK
            near &= pid[p, None] < hid[None]
            found = np.argwhere(near)
            for s in range(0, len(found), 1 << 15):
                i, j = found[s : s + (1 << 15)].T
                i = i + lo
                mine = at.gaps(pt[i] - ht[j]).argmin(1) == b
                i, j = i[mine], j[mine]
                cosine = np.einsum("ij,ij->i", px[i], hx[j]) / (np.linalg.norm(px[i], axis=1) * hn[j])
                yield i[cosine >= threshold], j[cosine >= threshold]

    def counted(at: Blocks, b: int, home: tuple, probe: tuple) -> pa.RecordBatch | None:
        found = list(pairs(at, b, home, probe))
        i, j = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        if not len(i):
            return None
        names, where = np.unique(np.concatenate([probe[0][i], home[0][j]]), return_inverse=True)
        root = local_roots(len(names), where[: len(i)], where[len(i) :])
        met = np.bincount(where, np.concatenate([home[3][j], probe[3][i]]), len(names))
        return pa.RecordBatch.from_pydict({"vec_id": pa.array(names), "links": pa.array(met.astype(np.int64)), "root": pa.array(names[root])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, home = None, None, []
        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy() for k in ("label", "dim", "block", "cell", "tile")])
            probes = batch.column("probe").to_numpy()
            marks = np.column_stack([keys, probes])
            edges = np.append(np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(1))), len(marks))
            for lo, hi in zip(edges, edges[1:]):
                if tuple(keys[lo]) != key:
                    key, home = tuple(keys[lo]), []
                    at = Blocks(int(key[1]), block_dim, threshold)
                raw = batch.column("raw").slice(lo, hi - lo).to_pylist()
                x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
                here = (batch.column("vec_id").slice(lo, hi - lo).to_numpy(), x, at.turned(x), batch.column("copies").slice(lo, hi - lo).to_numpy())
                if not probes[lo]:
                    home = [here if not home else tuple(np.concatenate(z) for z in zip(home[0], here))]
                elif home and (out := counted(at, int(key[2]), home[0], here)) is not None:
                    yield out

    return run


def near_duplicate_links(vectors: DataFrame, threshold: float = 0.98, block_dim: int = 8, tile: int = 4096, broadcast_cells: int = 100_000) -> DataFrame:
    """vectors (vec_id, embedding, label, copies) -> (vec_id, links, root): partial counts and forest edges, of linked vectors
    only. copies: as how many links a link to the vector counts.

    tile: vectors at home in one task; a cell with more is split and its probes go to each part. The
    grid over a block has more axes the more vectors the largest label has. The table of such cells
    is broadcast up to broadcast_cells rows and joined by shuffle beyond.
    """
    kind = "<f4" if "float" in dict(vectors.dtypes)["embedding"] else "<f8"
    own = vectors.select("vec_id", "embedding", "label", "copies")
    most = own.where("label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    grid = max(1, min(block_dim, math.ceil(math.log(max(most, 1) / (8 * tile), 4))))
    crowd = own.mapInArrow(_coded(block_dim, threshold, grid, kind, False), CELL).groupBy("label", "dim", "block", "cell").count().where(F.col("count") > tile)
    cells = crowd.select("label", "dim", "block", "cell", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    few = cells.limit(broadcast_cells + 1).count() <= broadcast_cells
    rows = own.mapInArrow(_coded(block_dim, threshold, grid, kind, True), f"{CELL}, probe tinyint, vec_id long, copies long, raw binary")
    rows = rows.join(F.broadcast(cells) if few else cells, ["label", "dim", "block", "cell"], "left")
    tiles = F.coalesce("tiles", F.lit(1))
    at = F.when(F.col("probe") == 1, F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(F.pmod(F.xxhash64("vec_id"), tiles).cast("int")))
    rows = rows.select("label", "dim", "block", "cell", F.explode(at).alias("tile"), "probe", "vec_id", "copies", "raw")
    key = ["label", "dim", "block", "cell", "tile"]
    return rows.repartition(*key).sortWithinPartitions(*key, "probe").mapInArrow(_linked(block_dim, threshold, kind), "vec_id long, links long, root long")


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (vec_id, label, one, two), classes (vec_id, embedding, label, copies, one, two)) of the vectors that can link.

    A class has equal vectors and labels, told by two hashes of 64 bits; its vec_id is the smallest of its members.
    """
    e = F.col("embedding")
    sound = (F.size(e) > 0) & F.forall(e, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(math.inf)), F.lit(False))) & F.exists(e, lambda v: v != 0)
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    marked = vectors.select("vec_id", "embedding", "label", F.when(able, F.xxhash64("embedding")).alias("one"), F.when(able, F.xxhash64(F.lit(1), "embedding")).alias("two"))
    found = marked.where("one is not null").groupBy("label", "one", "two").agg(F.min("vec_id").alias("vec_id"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
    return marked.select("vec_id", "label", "one", "two"), checkpointed(found)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, **how) -> DataFrame:
    """vectors (vec_id, embedding, label; more are ignored) -> (vec_id, n_links, component_id, kept), a row for each vector.

    Linked: equal labels that aren't null, vectors of one length and cosine >= threshold in double
    precision. A vector that is null, empty, zero or has a null or non-finite component links with
    nothing and is kept, and so is one without a vec_id. Rows of one vec_id count as links of their own, and are in one
    component if their vectors link; an empty table gives no rows.
    """
    members, own = classes(vectors)
    found = checkpointed(near_duplicate_links(own, threshold, **how).groupBy("vec_id", "root").agg(F.sum("links").alias("links")))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    component = connected_components(found, "vec_id", "root").select(F.col("id").alias("vec_id"), F.col("component").alias("component_id"))
    ended = own.select("vec_id", "label", "one", "two", "copies").join(counts, "vec_id", "left").join(component, "vec_id", "left")
    ended = ended.select("label", "one", "two", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    # Written, so that a class of very many copies can be split when they meet it.
    every = members.join(checkpointed(ended), ["label", "one", "two"], "left")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
