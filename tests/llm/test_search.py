"""Importance resampling, exact top-k search and k-means against brute force, on odd rows and on the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bagdiv.llm import importance, kmeans, topk

TEXTS = [None, "", " .,- ", "one", "Two words", "The É-cole of İstanbul is OLD; naïve x1 " * 4, "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s", "...lead and trail...", "same words here " * 30, "same words here " * 30, "日本 語\x00x\x7fy", "Straße STRASSE " * 12, "long " * 40_000]
TARGETS = [None, "", "same words there and the ecole", "A b C"]


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resampling(rows, targets, percent, least, seed=42, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *features(t)) for i, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in targets for f in features(x)[1])
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in {*s, *t}}
    out = []
    for i, n, fs in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_importance(spark, percent):
    rows = [*enumerate(TEXTS), (3, TEXTS[5]), (None, TEXTS[5]), (None, TEXTS[6]), (None, None), *((100 + i, " ".join(f"w{(i * j) % 23}" for j in range(i))) for i in range(60))]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, rank int, bucket string, b1 int")
    target = spark.createDataFrame([(t, 1) for t in TARGETS], "text string, key int")
    got = importance.resampled(docs, target, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert ordered(got.collect()) == ordered(brute_resampling(rows, TARGETS, percent, 20))


def test_importance_of_few_buckets(spark):
    """Ties of scores, a table larger than its broadcast, and another order."""
    rows = [(i % 7, "one two three four five six seven") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("one two",)], "text string")
    assert ordered(importance.resampled(docs, target, percent=50, least_words=3, buckets=11).collect()) == ordered(brute_resampling(rows, ["one two"], 50, 3, buckets=11))


def test_importance_of_nothing(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("x y",)], "text string")
    assert importance.resampled(docs, target).collect() == []
    few = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert ordered(importance.resampled(few, target.where("false"), least_words=1, percent=100).collect()) == brute_resampling([(1, "a b c")], [], 100, 1)


def test_importance_shuffles_texts_and_not_words(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = importance.positions(docs, 3, 100, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Window") < plan.index("Generate") < plan.index("Exchange")
    assert "Python" not in plan and "Arrow" not in plan


def odd_vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((260, 6))
    x[40:90] = x[40]
    x[90:130] = x[7] + rng.standard_normal((40, 6)) * 1e-3
    rows = [(int(i), [float(v) for v in a]) for i, a in enumerate(x)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[40][1]), (None, rows[8][1]), (300, None), (350, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (400, [math.nan] + [1.0] * 5), (450, [math.inf] + [1.0] * 5)]
    return rows + [(500, [0.0] * 6), (501, [1.0, 2.0]), (550, [2.0, 1.0]), (600, []), (601, []), (650, [1e30] * 6), (651, [-1e30] * 6), (0, rows[0][1])]


def sound(rows, scale=256, limit=1 << 27):
    return [(i, tuple(max(-limit, min(limit, math.floor(v * scale))) for v in e)) for i, e in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]


def brute_top_k(rows, k, every):
    held, out = sound(rows), []
    for n, (i, q) in enumerate(held):
        if i is not None and i % every == 0:
            all_ = [(-sum(a * b for a, b in zip(q, c)), j is None, j) for m, (j, c) in enumerate(held) if m != n and len(c) == len(q)]
            out += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(sorted(all_, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize(("k", "every", "tree", "capacity", "batch"), [(5, 50, 1 << 16, 64, 1 << 16), (5, 1, 40, 4, 50), (300, 10, 30, 8, 7)])
def test_top_k(spark, k, every, tree, capacity, batch):
    rows = odd_vectors()
    vectors = spark.createDataFrame([(i, e, "clash", 1, 2) for i, e in rows], "vec_id long, embedding array<double>, row string, rank int, tree int").repartition(3)
    got = topk.top_k(vectors, k=k, every=every, tree=tree, capacity=capacity, batch=batch)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert ordered(got.collect()) == ordered(brute_top_k(rows, k, every))


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none).collect() == []
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one).collect() == []


def test_bounds_save_products():
    """On vectors in a few dimensions most pages are never read, and within pages stored distances settle entries."""
    rng = np.random.default_rng(0)
    x = np.floor(rng.standard_normal((4000, 3)) * 1000).astype(np.int64)
    peak, pages = topk.built(x, np.arange(len(x)), np.arange(len(x)), 16)
    pages = [p._replace(codes=p.codes.astype(float)) for p in pages]
    computed = 0
    for i in range(0, len(x), 100):
        got = topk.best_first(peak, pages, x[i], i, 5, None)
        scores = x @ x[i]
        scores[i] = -(10**15)
        order = np.lexsort((np.arange(len(x)), -scores))[:5]
        assert got.ids.tolist() == order.tolist() and got.scores.tolist() == scores[order].tolist()
        computed += got.products
    assert computed < 0.25 * 40 * len(x)


def brute_kmeans(rows, k, rounds, dim, seed=2):
    held = [(i, np.array(c, np.int64)) for i, c in sound(rows) if len(c) == dim]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centers = [c.tolist() for _, c in sorted(held, key=lambda r: (name(r[0]), r[1].tolist()))[:k]]
    nearest = lambda c: min((sum((a - b) ** 2 for a, b in zip(c.tolist(), z)), n) for n, z in enumerate(centers))
    for _ in range(rounds):
        by = {}
        for _, c in held:
            by.setdefault(nearest(c)[1], []).append(c.tolist())
        for n, members in by.items():
            centers[n] = [sum(v) // len(members) for v in zip(*members)]
    out = [(i, *reversed(nearest(c))) for i, c in held]
    inertia = Counter()
    for _, n, d in out:
        inertia[n] += d
    return [(i, n, d, inertia[n], inertia.total(), hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest()) for i, n, d in out]


@pytest.mark.parametrize(("k", "rounds", "block", "leaf"), [(7, 5, 1 << 14, 16), (7, 0, 50, 4), (40, 5, 64, 1), (500, 2, 100, 8)])
def test_kmeans(spark, k, rounds, block, leaf):
    rows = [r for r in odd_vectors() if r[0] not in (650, 651)] + [(900, [1e6] * 6)]
    vectors = spark.createDataFrame([(i, e, "clash", 1) for i, e in rows], "vec_id long, embedding array<double>, cluster string, n int").repartition(3)
    got = kmeans.clusters(vectors, k=k, rounds=rounds, dim=6, block=block, leaf=leaf)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert ordered(got.collect()) == ordered(brute_kmeans(rows, k, rounds, 6))


def test_kmeans_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert kmeans.clusters(none).collect() == []
    wrong = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id long, embedding array<float>")
    assert kmeans.clusters(wrong).collect() == []


def test_boxes_save_distances():
    """Clusters far from each other are assigned by nodes, and copies as one leaf."""
    rng = np.random.default_rng(0)
    middles = rng.integers(-100_000, 100_000, (8, 4))
    x = np.repeat(middles, 500, 0) + rng.integers(-50, 50, (4000, 4))
    _, tree = kmeans.kd_tree(x)
    got = kmeans.filtered(tree, middles)
    label = ((tree.codes[:, None] - middles[None]) ** 2).sum(2).argmin(1)
    assert (got.label == label).all() and (got.count == np.bincount(label, minlength=8)).all() and got.resolved < 100
    assert all((got.total[i] == tree.codes[label == i].sum(0)).all() for i in range(8))
    _, alike = kmeans.kd_tree(np.ones((1000, 4), np.int64))
    assert len(alike.left) == 1
