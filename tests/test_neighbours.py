"""The join with bounds, the approximate join and the randomised projection, against the plain ones and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagdiv import queries as Q
from bagdiv import schema
from bagdiv.operators import approx, divergence, knn, pruned, transforms

SF = "/root/testdata/sf0.001"


def ordered(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture(scope="module")
def clusters(spark):
    """Bags that share clusters, one of which holds a third of all points, all alike; one bag of two points."""
    rng = np.random.default_rng(0)
    middles = rng.uniform(-1000, 1000, (40, 2))
    x = middles[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 2))
    x[:1300] = middles[0]
    bag = np.where(np.arange(4000) < 2, 9, np.arange(4000) % 3)
    return spark.createDataFrame([(f"bag{b}", i, [float(v) for v in p]) for i, (b, p) in enumerate(zip(bag, x))], "bag_id string, point_id long, features array<double>").cache()


@pytest.mark.parametrize("source", [Q.balances, Q.parts, Q.vectors])
def test_pruned_equals_grid_on_core_bags(spark, source):
    pts = source(spark, "/root/testdata/sf0.01").cache()
    assert ordered(knn.nearest(pts, 3, how="pruned")) == ordered(knn.nearest(pts, 3, how="grid"))


def test_pruned_equals_grid_on_clusters(clusters, monkeypatch):
    monkeypatch.setattr(pruned, "PART", 300)
    monkeypatch.setattr(pruned, "ASKING", 500)
    assert ordered(knn.nearest(clusters, 5, how="pruned")) == ordered(knn.nearest(clusters, 5, how="grid"))


def test_pruned_with_pairs_and_splits(spark):
    pts = Q.balances(spark, SF)
    pairs = spark.createDataFrame([(0, 1), (3, 0), (5, 5)], "p int, q int")
    assert ordered(knn.nearest(pts, 2, pairs, "pruned")) == ordered(knn.nearest(pts, 2, pairs, "grid"))
    split = pts.withColumn("split", F.col("bag_id") < 5)
    assert ordered(knn.nearest(split, 2, how="pruned")) == ordered(knn.nearest(split, 2, how="grid"))


def test_pruned_of_scales_and_single_points(spark):
    """Large and tiny features at once, and bags of one point, whose own neighbours don't exist."""
    rng = np.random.default_rng(1)
    x = np.concatenate([1e9 + rng.standard_normal((60, 2)) * 1e-3, rng.standard_normal((60, 2)) * 1e-6, rng.standard_normal((2, 2)) * 1e12])
    pts = spark.createDataFrame([(i % 4 if i < 120 else i, i, p.tolist()) for i, p in enumerate(x)], "bag_id int, point_id long, features array<double>")
    assert ordered(knn.nearest(pts, 3, how="pruned")) == ordered(knn.nearest(pts, 3, how="grid"))


def test_bounds_send_few_points(clusters):
    """Of all (point, cell of a bag) pairs a small part is sent, and none of what is needed is missing (see above)."""
    points, asking = pruned.sent(clusters, 3)
    cells = points.select("bag_id", "cell").distinct().count()
    assert asking.agg(F.sum("asking")).first()[0] < 0.2 * clusters.count() * cells
    assert asking.count() < 0.5 * points.select("bag_id", "cell").distinct().count() * cells


def test_divergences_by_bounds(spark, monkeypatch):
    """The same sums by either join, so the same divergences; auto takes the join with bounds from a size on."""
    pts = Q.parts(spark, "/root/testdata/sf0.01")
    specs = ["kl_raw", "renyi:0.8", "js", "l2"]
    rounded = lambda: ordered(divergence.estimate_divs(pts, specs, [1, 3]).select("p", "q", "spec", "k", F.round("value", 9)))
    want = rounded()
    used = []
    monkeypatch.setattr(knn, "MANY_POINTS", 1)
    monkeypatch.setattr(pruned, "pruned_near", lambda *a, f=pruned.pruned_near, **b: used.append(1) or f(*a, **b))
    assert rounded() == want and used


def test_unknown_join(spark):
    with pytest.raises(ValueError, match="unknown join"):
        knn.nearest(Q.balances(spark, SF), 1, how="tree")


@pytest.mark.parametrize(("source", "sf"), [(Q.parts, "/root/testdata/sf0.1"), (Q.vectors, "/root/testdata/sf0.1")])
def test_recall_of_approximate_join(spark, source, sf):
    """Ids divisible by 100 against all rows: recall of 0.9 at least; what is found has exact distances and ranks."""
    pts = source(spark, sf).cache()
    ask = pts.where("point_id % 100 = 0").select("bag_id", "point_id").cache()
    exact = knn.nearest(pts, 3).join(ask.select(F.col("bag_id").alias("p"), F.col("point_id").alias("i")), ["p", "i"], "left_semi").cache()
    found = approx.approximate_nearest(pts, 3, ask).cache()
    assert approx.recall(found, exact) >= 0.9
    both = found.withColumnRenamed("dist", "d").join(exact.drop("rank"), ["p", "i", "q", "j"])
    assert both.where("abs(d - dist) > 1e-12").isEmpty()
    assert found.groupBy("p", "i", "q").agg(F.max("rank").alias("most"), F.count("*").alias("n")).where("most <> n or n > 3").isEmpty()


def test_approximate_join_in_parts(clusters, monkeypatch):
    """A bucket of copies is cut into parts that all meet; one table with wide buckets is the exact join."""
    monkeypatch.setattr(approx, "PART", 256)
    monkeypatch.setattr(approx, "width_of", lambda *_: 1e9)
    few = clusters.where("point_id < 900 or point_id % 7 = 0")
    got = approx.approximate_nearest(few, 4, tables=2, functions=1)
    want = knn.nearest(few, 4, how="grid")
    assert [(r[0], r[1], r[2], r[4]) for r in ordered(got)] == [(r[0], r[1], r[2], r[4]) for r in ordered(want)]
    assert approx.recall(got, want) > 0.5 and ordered(got.groupBy("p", "q").agg(F.round(F.sum("dist"), 6))) == ordered(want.groupBy("p", "q").agg(F.round(F.sum("dist"), 6)))


def test_randomised_projection_is_exact_where_it_can_be(spark):
    pts = Q.parts(spark, "/root/testdata/sf0.01")
    exact, got = transforms.Projection.fit(pts, 2), transforms.Projection.fit_randomized(pts, 2)
    assert np.allclose(exact.components, got.components, atol=1e-9) and np.allclose(exact.variances, got.variances) and np.allclose(exact.mean, got.mean)


def test_randomised_projection_of_embeddings(spark):
    """The variances hardly fall, so that no space stands out: with half of the dimensions sketched and four passes the first is within 3 %, all three within 5 %."""
    pts = Q.vectors(spark, "/root/testdata/sf0.1").cache()
    exact, got = transforms.Projection.fit(pts, 3), transforms.Projection.fit_randomized(pts, 3, more=29, passes=4)
    assert (got.variances <= exact.variances * (1 + 1e-9)).all()
    assert got.variances[0] > 0.97 * exact.variances[0] and got.variances.sum() > 0.95 * exact.variances.sum()
    assert np.allclose(got.components.T @ got.components, np.eye(3))
    again = transforms.Projection.fit_randomized(pts, 3, more=29, passes=4)
    assert np.allclose(again.components, got.components)


def test_randomised_projection_of_a_plane(spark):
    """Points in a plane of many dimensions: the plane is found exactly, whitened too; no dim x dim sums are made."""
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.standard_normal((300, 2)))[0]
    x = rng.standard_normal((500, 2)) * [5, 2] @ turn.T + 3
    pts = schema.from_bags(spark, [x])
    exact, got = transforms.Projection.fit(pts, 2), transforms.Projection.fit_randomized(pts, 2, more=3)
    assert np.allclose(np.abs(exact.components.T @ got.components), np.eye(2), atol=1e-6)
    y = np.array([r.features for r in transforms.pca(pts, 2, whiten=True, randomize=True).collect()])
    assert np.allclose(np.cov(y.T, bias=True), np.eye(2), atol=1e-6)
    with pytest.raises(ValueError, match="needs k"):
        transforms.pca(pts, randomize=True)
