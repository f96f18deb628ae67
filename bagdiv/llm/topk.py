"""Exact top-k search by inner product: best-first search of M-trees.

Inner products become distances by one more coordinate: with peak at least the squared length of every vector x of a
tree, x gets sqrt(peak - |x|^2) and a query 0, so that their squared distance is |q|^2 + peak - 2 q.x, a whole number
that falls as the product grows.

The vectors are dealt to cells around pivots, and cells to trees of a bounded size. A tree is a table of pages: an
inner page has routing vectors with the covering radius of what lies below each and the distance to the page's own
routing vector, a leaf page has vectors with such distances. A search keeps a heap of pages by the least distance that anything
in them can have, and ends when that exceeds the k-th distance found; within a page, the stored distances to the parent
settle by the triangle inequality for which entries no product is needed. Every query searches the tree of its own
vector first, and then the others with the k-th score known from there.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: Whole components beyond this size are cut to it, so that sums of products fit in 64 bits.
LIMIT = 1 << 27
#: Vectors of a tree and queries that meet it in one task, at most; pivots at most, and bytes of them; entries of a page.
TREE, QUERIES, PIVOTS, PIVOT_BYTES, PAGE = 1 << 16, 1 << 16, 1024, 1 << 24, 256
#: A vector without an id comes after all others among equals.
NO_ID = (1 << 63) - 1


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, dim, code): floor(scale * x) of each component, of vectors without null or non-finite ones; a written table."""
    e = F.col("embedding")
    sound = e.isNotNull() & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False)))
    cut = lambda x: F.greatest(F.least(F.floor(x.cast("double") * float(scale)), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    code = F.transform(e, cut).alias("code")
    return checkpointed(vectors.where(sound).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.size(e).alias("dim"), code))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y of whole numbers, exactly: by floating point where every sum fits in its digits."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, x.shape[-1])
    return (x.astype(float) @ y.astype(float)).astype(np.int64) if most < 1 << 53 else x @ y


def _cells(pivots: dict[int, np.ndarray]):
    """Rows (row, vec_id, dim, code) -> (row, vec_id, dim, cell, raw): the nearest pivot of the same length, the first of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = pa.array(np.flatnonzero(dims == dim))
                part = batch.take(rows)
                x = part.column("code").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), dim)
                at = pivots.get(int(dim))
                cell = np.zeros(len(x), np.int64) if at is None else ((at * at).sum(1) - 2 * products(x, at.T)).argmin(1)
                raw = pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("vec_id"), part.column("dim"), pa.array(cell, pa.int32()), raw], ["row", "vec_id", "dim", "cell", "raw"])

    return run


class Page(NamedTuple):
    """Entries of a page: whole vectors, distance to the page's routing vector (none in the root), and the pages below with their radii, or rows and ids."""

    codes: np.ndarray
    up: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    rows: np.ndarray
    ids: np.ndarray


def built(codes: np.ndarray, rows: np.ndarray, ids: np.ndarray, capacity: int = PAGE) -> tuple[int, list[Page]]:
    """(peak, pages) of an M-tree in bulk; page 0 is the root.

    Some vectors of a node are drawn as routing vectors and the others join the nearest, again and again, until a
    node fits in a page. Where that parts nothing, as among copies, a node is cut by order.
    """
    squares = (codes * codes).sum(1)
    peak = int(squares.max(initial=0))
    more = np.sqrt((peak - squares).astype(float))
    nothing = np.zeros(0, np.int64)
    pages: list[Page] = []

    def far(own: int, others: np.ndarray) -> np.ndarray:
        return np.sqrt(((codes[others] - codes[own]) ** 2).sum(1) + (more[others] - more[own]) ** 2)

    todo = [(0, np.arange(len(codes)), -1)]
    pages.append(None)
    while todo:
        page, held, own = todo.pop()
        up = far(own, held) if own >= 0 else np.zeros(len(held))
        if len(held) <= capacity:
            pages[page] = Page(codes[held], up, nothing.astype(float), nothing, rows[held], ids[held])
            continue
        seeds = held[np.unique(np.linspace(0, len(held) - 1, min(capacity, math.ceil(len(held) / capacity)) + 1).astype(np.int64)[:-1])]
        # The nearest has the largest product, as all have one length with the further coordinate.
        part = (products(codes[held], codes[seeds].T) + more[held, None] * more[seeds]).argmax(1)
        parts = [(int(seed), held[part == i]) for i, seed in enumerate(seeds)]
        parts = [(seed, x) for seed, x in parts if len(x)]
        if max(len(x) for _, x in parts) == len(held):
            parts = [(int(x[0]), x) for x in np.array_split(held, min(capacity, math.ceil(len(held) / capacity)))]
        child = np.arange(len(pages), len(pages) + len(parts))
        pages += [None] * len(parts)
        heads = np.array([seed for seed, _ in parts])
        radius = np.array([far(seed, x).max() for seed, x in parts])
        pages[page] = Page(codes[heads], far(own, heads) if own >= 0 else np.zeros(len(heads)), radius, child, nothing, nothing)
        todo += [(int(c), x, seed) for c, (seed, x) in zip(child, parts)]
    return peak, pages


PAGES = "dim int, tree long, peak long, page int, codes binary, up binary, radius binary, child binary, rows binary, ids binary"
KINDS = dict(codes="<i4", up="<f8", radius="<f8", child="<i8", rows="<i8", ids="<i8")


def _pages(capacity: int):
    """Rows (dim, tree, row, vec_id, raw), sorted by tree -> its pages."""

    def of_tree(dim: int, tree: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        codes = np.frombuffer(b"".join(table.column("raw").to_pylist()), "<i4").reshape(len(table), dim).astype(np.int64)
        peak, pages = built(codes, table.column("row").to_numpy(), table.column("vec_id").fill_null(NO_ID).to_numpy(), capacity)
        for lo in range(0, len(pages), 256):
            some = pages[lo : lo + 256]
            head = [pa.array(np.full(len(some), v), t) for v, t in ((dim, pa.int32()), (tree, pa.int64()), (peak, pa.int64()))]
            body = [pa.array([getattr(p, name).astype(kind).tobytes() for p in some], pa.binary()) for name, kind in KINDS.items()]
            yield pa.RecordBatch.from_arrays([*head, pa.array(np.arange(lo, lo + len(some)), pa.int32()), *body], ["dim", "tree", "peak", "page", *KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.column_stack([batch.column("dim").to_numpy().astype(np.int64), batch.column("tree").to_numpy()])
            edges = np.flatnonzero(np.append((keys[1:] != keys[:-1]).any(1), True)) + 1
            lo = 0
            for hi in edges:
                if held and tuple(keys[lo]) != key:
                    yield from of_tree(*key, held)
                    held = []
                key = tuple(map(int, keys[lo]))
                held.append(batch.slice(lo, hi - lo))
                lo = hi
        if held:
            yield from of_tree(*key, held)

    return run


class Found(NamedTuple):
    scores: np.ndarray
    ids: np.ndarray
    products: int


def best_first(peak: int, pages: list[Page], query: np.ndarray, own: int, k: int, least: int | None) -> Found:
    """The k vectors of the highest products with the query, ties to smaller ids, without the row `own`; only those that
    reach `least`, where it is given. products: how many were computed."""
    square = int(query @ query)
    # No sum of products is larger than the product of the lengths.
    exact = max(square, peak) < 1 << 52
    times = query.astype(float) if exact else query
    slack = 1e-9 * (1 + math.sqrt(square) + math.sqrt(peak))
    reach = lambda score: math.sqrt(max(0, square + peak - 2 * score)) + slack
    limit = math.inf if least is None else reach(least)
    scores, ids, count = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    heap = [(0.0, 0, math.nan)]
    while heap:
        low, number, parent = heapq.heappop(heap)
        if low > limit:
            break
        page = pages[number]
        leaf = not len(page.child)
        codes, at = page.codes if exact else page.codes.astype(np.int64), None
        if not math.isnan(parent):
            gap = np.abs(page.up - parent)
            at = np.flatnonzero((gap if leaf else gap - page.radius) <= limit + slack)
            if not len(at):
                continue
            codes = codes if len(at) == len(codes) else codes[at]
        got = (codes @ times).astype(np.int64)
        count += len(got)
        if leaf:
            rows, names = (page.rows, page.ids) if at is None else (page.rows[at], page.ids[at])
            ok = rows != own
            if least is not None:
                ok &= got >= least
            if len(scores) == k:
                ok &= got >= scores[-1]
            if not ok.any():
                continue
            scores, ids = np.concatenate([scores, got[ok]]), np.concatenate([ids, names[ok]])
            order = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[order], ids[order]
            if len(scores) == k:
                limit = min(limit, reach(int(scores[-1])))
        else:
            away = np.sqrt(np.maximum(square + peak - 2 * got, 0))
            radius, child = (page.radius, page.child) if at is None else (page.radius[at], page.child[at])
            lows = away - radius - slack
            for i in np.flatnonzero(lows <= limit):
                heapq.heappush(heap, (max(low, float(lows[i])), int(child[i]), float(away[i])))
    return Found(scores, ids, count)


FOUND = "row long, query_id long, vec_id long, score long, products long"


def _searched(k: int):
    """Rows by (dim, tree, batch), pages in their order before queries -> what each query found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pages, peak = None, [], 0
        for batch in batches:
            out = {"row": [], "query_id": [], "vec_id": [], "score": [], "products": []}
            for r in (r for lo in range(0, batch.num_rows, 256) for r in batch.slice(lo, 256).to_pylist()):
                now = (r["dim"], r["tree"], r["batch"])
                if now != key:
                    key, pages = now, []
                if r["page"] >= 0:
                    peak, held = r["peak"], {name: np.frombuffer(r[name], kind) for name, kind in KINDS.items()}
                    held["codes"] = held["codes"].astype(float).reshape(max(len(held["child"]), len(held["rows"])), r["dim"])
                    pages.append(Page(**held))
                    continue
                found = best_first(peak, pages, np.frombuffer(r["raw"], "<i4").astype(np.int64), r["row"], k, r["least"])
                n = len(found.scores)
                for name, value in (("row", [r["row"]] * n), ("query_id", [r["query_id"]] * n), ("vec_id", found.ids.tolist()), ("score", found.scores.tolist()), ("products", [found.products] * n)):
                    out[name] += value
            if out["row"]:
                yield pa.RecordBatch.from_pydict({name: pa.array(values, pa.int64()) for name, values in out.items()})

    return run


def _search(pages: DataFrame, queries: DataFrame, parts: int, k: int) -> DataFrame:
    """queries (row, query_id, dim, tree, raw, least) -> FOUND. Both sides meet by tree and batch of queries, so that a tree
    is read by `parts` tasks."""
    batch = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("batch")
    sides = pages.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).unionByName(queries.withColumn("page", F.lit(-1)).withColumn("batch", batch), allowMissingColumns=True)
    key = ["dim", "tree", "batch"]
    # Pages count from 0, so queries, of page -1, come last by its descending sign.
    ordered = sides.repartition(*key).sortWithinPartitions(*key, F.col("page") < 0, "page")
    return ordered.mapInArrow(_searched(k), FOUND)


def trees(codes: DataFrame, tree: int = TREE, capacity: int = PAGE, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(row, vec_id, dim, code) -> (placed (row, vec_id, dim, tree, trees, raw), pages); written tables.

    The pivots are fitted on a sample, the vectors of the least hashes, of `pivots` rows and PIVOT_BYTES at most; all rows
    are indexed. A cell with more than `tree` vectors is dealt to several trees by row number, so copies without end
    make more trees and no larger ones. trees: how many there are of this length; a tree's number is below it.
    """
    size = codes.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    # Small tables are cut finer, for tasks enough.
    tree = min(tree, max(2048, size.n // 32))
    some = min(pivots, math.ceil(size.n / tree), max(1, PIVOT_BYTES // (8 * max(1, size.dim or 1))))
    chosen: dict[int, list] = {}
    for r in codes.orderBy(F.xxhash64("code", "row"), "row").select("dim", "code").limit(max(1, some)).collect():
        chosen.setdefault(r.dim, []).append(r.code)
    at = {d: np.array(rows, np.int64).reshape(len(rows), d) for d, rows in chosen.items()}
    dealt = checkpointed(codes.mapInArrow(_cells(at), "row long, vec_id long, dim int, cell int, raw binary"))
    # A row for each pivot and each length of vectors.
    sizes = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / tree).alias("tiles"))
    by_dim = W.partitionBy("dim").orderBy("cell")
    sizes = sizes.select("dim", "cell", "tiles", (F.sum("tiles").over(by_dim) - F.col("tiles")).alias("first"), F.sum("tiles").over(W.partitionBy("dim")).alias("trees"))
    placed = dealt.join(sizes, ["dim", "cell"]).select("row", "vec_id", "dim", (F.col("first") + F.pmod("row", "tiles")).alias("tree"), "trees", "raw")
    placed = checkpointed(placed)
    by_tree = placed.select("dim", "tree", "row", "vec_id", "raw").repartition("dim", "tree").sortWithinPartitions("dim", "tree", "row")
    return placed, checkpointed(by_tree.mapInArrow(_pages(capacity), PAGES))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, tree: int = TREE, capacity: int = PAGE, batch: int = QUERIES) -> DataFrame:
    """vectors (vec_id, embedding; more are ignored) -> (query_id, rank, vec_id, score).

    Components become floor(scale * x), cut at +-2^27. Rows whose vec_id is divisible by `every` are queries; each gets the k
    rows of the highest inner products among all rows of its length but itself, ties to the smaller vec_id, all if there are
    fewer. Vectors that are null or hold null or non-finite components take no part; empty ones have the product 0 with
    each other. Repeated rows are rows of their own: each is a query, and a candidate for the others. Rows without a
    vec_id are candidates, after all others among equals. No rows give none.
    """
    placed, pages = trees(whole(vectors, scale), tree, capacity)
    queries = placed.where(F.col("vec_id") % every == 0).select("row", F.col("vec_id").alias("query_id"), "dim", "tree", "trees", "raw")
    parts = max(1, math.ceil(queries.count() / batch))
    home = checkpointed(_search(pages, queries.drop("trees").withColumn("least", F.lit(None).cast("long")), parts, k))
    bounds = home.groupBy("row").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    there = F.filter(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1), lambda t: t != F.col("tree"))
    others = queries.where("trees > 1").join(bounds, "row", "left").select("row", "query_id", "dim", F.explode(there).alias("tree"), "raw", "least")
    found = home.unionByName(_search(pages, others, parts, k))
    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e::double[], c.e::double[])::bigint as score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from p
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
