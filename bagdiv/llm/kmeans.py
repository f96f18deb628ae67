"""Exact k-means over whole vectors, by the filtering algorithm on kd-trees.

Each partition packs its vectors into blocks, each with a kd-tree whose nodes hold a count, the sum of their vectors
and their bounding box, all whole numbers; the blocks are written once. A round sends the centroids down every tree: a
centroid that is farther than another from each point of a node's box is pruned there, a node with one centroid left
is assigned as a whole by its sums, and the leaves that are left are resolved vector by vector. What leaves a block is a
count and a sum for each centroid, so that no vector is shuffled in any round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .topk import LIMIT, products

#: Vectors of a block, and of a leaf, at most; numbers compared at once.
BLOCK, LEAF, AT_ONCE = 1 << 14, 16, 1 << 20


class Tree(NamedTuple):
    """Vectors in the order of the tree. Of each node: first and end of its vectors, its left child (the right one follows, -1: a leaf), box and sum."""

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def kd_tree(codes: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """(order of the vectors, tree): nodes are halved across the widest side of their box; equal vectors make one leaf."""
    order = np.arange(len(codes))
    start, end, left, low, high, total = [0], [len(codes)], [], [], [], []
    i = 0
    while i < len(start):
        a, b = start[i], end[i]
        x = codes[order[a:b]]
        low.append(x.min(0)), high.append(x.max(0)), total.append(x.sum(0))
        side = int((high[i] - low[i]).argmax()) if x.shape[1] else 0
        if b - a <= leaf or not x.shape[1] or high[i][side] == low[i][side]:
            left.append(-1)
        else:
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(x[:, side], middle)]
            left.append(len(start))
            start += [a, a + middle]
            end += [a + middle, b]
        i += 1
    return order, Tree(codes[order], np.array(start), np.array(end), np.array(left), np.array(low), np.array(high), np.array(total))


class Assigned(NamedTuple):
    """count and sum of each centroid, the centroid of each vector in tree order, and for how many vectors distances were computed."""

    count: np.ndarray
    total: np.ndarray
    label: np.ndarray
    resolved: int


def filtered(tree: Tree, centers: np.ndarray) -> Assigned:
    """Every vector to its nearest centroid, the first of equals: whole numbers throughout, so nothing depends on rounding."""
    k = len(centers)
    squares = (centers * centers).sum(1)
    count, total, label, resolved = np.zeros(k, np.int64), np.zeros((k, centers.shape[1]), np.int64), np.zeros(len(tree.codes), np.int32), 0
    never = np.iinfo(np.int64).max

    def take(node: int, to: int) -> None:
        a, b = tree.start[node], tree.end[node]
        count[to] += b - a
        total[to] += tree.total[node]
        label[a:b] = to

    nodes, left_over = np.array([0]), np.ones((1, k), bool)
    while len(nodes):
        below, masks = [], []
        some_nodes = max(1, AT_ONCE // max(1, centers.size))
        for lo in range(0, len(nodes), some_nodes):
            at, mask = nodes[lo : lo + some_nodes], left_over[lo : lo + some_nodes]
            # The one nearest to the middle of the box, by four times its squared distance less what all share.
            middle = np.where(mask, squares - products(tree.low[at] + tree.high[at], centers.T), never)
            best = middle.argmin(1)
            # At the corner of the box that suits a centroid most: its squared distance less that of the best one.
            across = centers[None] - centers[best][:, None]
            corner = np.where(across > 0, tree.high[at][:, None], tree.low[at][:, None])
            gap = squares - squares[best][:, None] - 2 * (across * corner).sum(2)
            mask = mask & (gap <= 0)
            many = mask.sum(1)
            for i in range(len(at)):
                node = int(at[i])
                if many[i] == 1:
                    take(node, int(best[i]))
                elif tree.left[node] >= 0:
                    below += [int(tree.left[node]), int(tree.left[node]) + 1]
                    masks += [mask[i], mask[i]]
                else:
                    a, b = tree.start[node], tree.end[node]
                    some = np.flatnonzero(mask[i])
                    x = tree.codes[a:b]
                    to = some[(squares[some] - 2 * products(x, centers[some].T)).argmin(1)]
                    label[a:b] = to
                    np.add.at(count, to, 1)
                    np.add.at(total, to, x)
                    resolved += b - a
        nodes, left_over = np.array(below, np.int64), np.array(masks, bool).reshape(len(below), k)
    return Assigned(count, total, label, resolved)


#: A vector is 4 bytes a component; boxes and sums of about n / 8 nodes are twice and four times that.
BLOCKS = "n int, ids array<long>, codes binary, start binary, end binary, left binary, low binary, high binary, total binary"
KINDS = dict(codes="<i4", start="<i4", end="<i4", left="<i4", low="<i4", high="<i4", total="<i8")


def _blocks(dim: int, block: int, leaf: int):
    def packed(ids: list[pa.Array], codes: list[np.ndarray]) -> pa.RecordBatch:
        ids, codes = pa.concat_arrays(ids), np.concatenate(codes)
        order, tree = kd_tree(codes, leaf)
        ids = ids.take(pa.array(order))
        row = {"n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64()))}
        return pa.RecordBatch.from_pydict(row | {name: pa.array([getattr(tree, name).astype(kind).tobytes()], pa.binary()) for name, kind in KINDS.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, n = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                codes.append(part.column("code").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), dim))
                ids.append(part.column("vec_id"))
                n += len(part)
                if n >= block:
                    yield packed(ids, codes)
                    ids, codes, n = [], [], 0
        if n:
            yield packed(ids, codes)

    return run


def _trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.ListScalar, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            got = {name: np.frombuffer(batch.column(name)[i].as_buffer(), kind).astype(np.int64) for name, kind in KINDS.items()}
            yield batch.column("ids")[i], Tree(**{name: x.reshape(-1, dim) if name in ("codes", "low", "high", "total") else x for name, x in got.items()})


def whole(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, code) of the vectors with dim components, none null or non-finite: floor(scale * x)."""
    e = F.col("embedding")
    sound = (F.size(e) == dim) & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False)))
    cut = lambda x: F.greatest(F.least(F.floor(x.cast("double") * float(scale)), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return vectors.where(e.isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, cut).alias("code"))


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """vectors (vec_id, embedding; more are ignored) -> (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Vectors with exactly dim components, none null or non-finite, are kept; components become floor(scale * x), cut at
    +-2^27. Centroids start as the k kept vectors of the smallest sha256 over `<seed>:<vec_id>`, and are fewer
    if fewer are kept; ties go by the components. Without a vec_id nothing stands behind the colon. Each round
    takes every vector to the nearest centroid, ties to the smaller number, and then replaces centroids that have
    vectors by the floors of their means. Repeated rows count as often as they come. No vectors give no rows.

    Only k centroids, with a count and sums for each, reach the driver. A task holds a block of vectors and its tree, about 7
    MB of 64 dimensions.
    """
    kept = whole(vectors, dim, scale)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select(named.alias("name"), "code").orderBy("name", "code").limit(k).collect()
    centers = np.array([r.code for r in first], np.int64).reshape(len(first), dim)
    blocks = checkpointed(kept.mapInArrow(_blocks(dim, block, leaf), BLOCKS))

    def sums(centers: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(centers), np.int64), np.zeros(centers.shape, np.int64)
            for _, tree in _trees(batches, dim):
                got = filtered(tree, centers)
                count, total = count + got.count, total + got.total
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(count[some]), "total": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

        return run

    for _ in range(rounds if len(first) else 0):
        found = blocks.mapInArrow(sums(centers), "cluster int, n long, total array<long>")
        found = found.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.element_at("total", i + 1)).alias(f"x{i}") for i in range(dim)))
        new = centers.copy()
        for r in found.collect():
            new[r.cluster] = [r[f"x{i}"] // r.n for i in range(dim)]
        if np.array_equal(new, centers):
            break
        centers = new

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, dim):
            label = filtered(tree, centers).label
            distance = ((tree.codes - centers[label]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(label), pa.array(distance)], ["vec_id", "cluster", "distance"])

    ended = checkpointed(blocks.mapInArrow(labels, "vec_id long, cluster int, distance long"))
    # A row for each centroid.
    own = {r.cluster: r.total for r in ended.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    marks = [(i, own[i], sum(own.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centers) if i in own]
    table = vectors.sparkSession.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return ended.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64) -> str:
    """The same in DuckDB: every vector against every centroid."""
    sql = [f"""v as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double))::double[{dim}] as e from embeddings
  where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as cluster, e as c from v qualify cluster < {k})"]
    near = lambda n: f"a{n} as materialized (select row, arg_min(cluster, (d, cluster)) as cluster, min(d) as d from (select row, cluster, array_inner_product(e, e) + array_inner_product(c, c) - 2 * array_inner_product(e, c) as d from v, c{n}) group by row)"
    for n in range(rounds):
        sql.append(near(n))
        mean = f"[{', '.join(f'floor(sum(e[{i}]) / count(*))' for i in range(1, dim + 1))}]::double[{dim}]"
        sql.append(f"m{n} as materialized (select cluster, {mean} as c from v join a{n} using (row) group by cluster)")
        sql.append(f"c{n + 1} as materialized (select cluster, coalesce(m{n}.c, c{n}.c) as c from c{n} left join m{n} using (cluster))")
    sql.append(near(rounds))
    return f"""with {", ".join(sql)}
select vec_id, a{rounds}.cluster::int as cluster, d::bigint as distance, (sum(d) over (partition by a{rounds}.cluster))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(list_transform(c::double[], lambda x: x::bigint), ',')) as centroid_sha256
from v join a{rounds} using (row) join c{rounds} on c{rounds}.cluster = a{rounds}.cluster
"""
