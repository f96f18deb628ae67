"""Oversampled seeds of k-means, and what the command line says about its results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagdiv import __main__ as command
from bagdiv import queries as Q
from bagdiv.operators import transforms
from bagdiv.sources import files

SF = "/root/testdata/sf0.01"


def total(pts, condensed):
    centers = condensed.groupBy("bag_id").agg(F.collect_list("features").alias("centers"))
    return transforms.cost(pts, centers).agg(F.sum("cost")).first()[0]


def test_oversampled_seeds_cost_less_and_do_not_change(spark):
    pts = Q.parts(spark, SF).cache()
    plain = total(pts, transforms.condense_kmeans(pts, 5))
    two = transforms.condense_kmeans(pts, 5, runs=2).cache()
    assert total(pts, two) <= plain
    again = transforms.condense_kmeans(pts.repartition(7), 5, runs=2)
    key = lambda df: sorted((r.bag_id, r.point_id, tuple(np.round(r.features, 6))) for r in df.collect())
    assert key(again) == key(two)
    first = transforms.condense_kmeans(pts, 5, runs=1)
    by_bag = lambda df: {r.bag_id: r.cost for r in transforms.cost(pts, df.groupBy("bag_id").agg(F.collect_list("features").alias("centers"))).collect()}
    best, one = by_bag(two), by_bag(first)
    assert all(best[b] <= one[b] * (1 + 1e-9) for b in one)


def test_oversampled_seeds_find_far_clusters(spark):
    """Three clusters of which the points of the smallest ids show one alone; copies, and a bag that stays as it is."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(500, 1, (20, 2)), rng.normal(-900, 1, (5, 2))])
    rows = [(0, i, p.tolist()) for i, p in enumerate(x)] + [(1, i, [2.0, 2.0]) for i in range(50)] + [(2, 0, [1.0, 1.0])]
    pts = spark.createDataFrame(rows, "bag_id long, point_id long, features array<double>")
    got = transforms.condense_kmeans(pts, 3, runs=1)
    found = sorted(tuple(np.round(r.features, 3)) for r in got.where("bag_id = 0").collect())
    assert found == sorted(tuple(np.round(m, 3)) for m in (x[:300].mean(0), x[300:320].mean(0), x[320:].mean(0)))
    assert [r.features for r in got.where("bag_id = 1").collect()] == [[2.0, 2.0]] * 3
    assert [(r.point_id, r.features) for r in got.where("bag_id = 2").collect()] == [(0, [1.0, 1.0])]


def test_runs_share_their_rounds_and_points_are_spread(spark, tmp_path):
    """More runs are no more jobs, and points in one small file are no single task: before, each run had rounds of its own, read by one task."""
    rng = np.random.default_rng(2)
    spark.createDataFrame([(i % 3, i, p.tolist()) for i, p in enumerate(rng.integers(0, 9, (40_000, 2)).astype(float))], "bag_id long, point_id long, features array<double>").coalesce(1).write.parquet(str(tmp_path / "pts"))
    pts = spark.read.parquet(str(tmp_path / "pts"))
    assert pts.rdd.getNumPartitions() == 1
    jobs = {}
    for runs in (1, 4):
        spark.sparkContext.setJobGroup(f"condense {runs}", "")
        assert transforms.condense_kmeans(pts, 4, rounds=1, runs=runs).count() == 12
        jobs[runs] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"condense {runs}"))
    spark.sparkContext.setJobGroup("", "")
    assert 0 < jobs[4] <= jobs[1] + 12
    blocks = transforms._blocks(pts, pts.groupBy("bag_id").agg(F.count("*").alias("_n")), 2)
    assert blocks.rdd.getNumPartitions() > 1 and blocks.agg(F.sum(F.size("ids"))).first()[0] == 40_000


def test_blocks_change_no_result(spark, monkeypatch):
    """Blocks of seven points, of a whole bag, and plain expressions over rows give the same draws, centers and costs."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(30, 1, (100, 3)), rng.normal(9, 5, (9, 3))])
    rows = [("ab"[i % 2] if i < 500 else "c", i // 2, p.tolist()) for i, p in enumerate(x)] + [("d", 7, [1.0, 2.0, 3.0])] * 40 + [(None, 1, [0.0] * 3)]
    pts = spark.createDataFrame(rows, "bag_id string, point_id long, features array<double>")
    key = lambda df: sorted((r.bag_id, r.point_id, tuple(np.round(r.features, 9))) for r in df.collect())
    whole = [key(transforms.condense_kmeans(pts, 4, rounds=3, runs=runs, seed=5)) for runs in (0, 3)]
    monkeypatch.setattr(transforms, "BLOCK", 7), monkeypatch.setattr(transforms, "AT_ONCE", 8)
    assert [key(transforms.condense_kmeans(pts, 4, rounds=3, runs=runs, seed=5)) for runs in (0, 3)] == whole
    assert [sum(r[0] == b for r in whole[1]) for b in "abcd"] == [4, 4, 4, 4]
    blocks = transforms._blocks(pts, pts.groupBy("bag_id").agg(F.count("*").alias("_n")), 3)
    assert blocks.agg(F.max(F.size("ids"))).first()[0] <= 7
    centers = spark.createDataFrame([(b, 0, x[i : i + 5].tolist()) for i, b in enumerate("abc")], "bag_id string, run int, centers array<array<double>>")
    got = {r.bag_id: r.cost for r in transforms._assigned(blocks, centers, 3).groupBy("bag_id").agg(F.sum("cost").alias("cost")).collect()}
    want = {r.bag_id: r.cost for r in transforms.cost(pts, centers).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[b], want[b]) for b in want)


def test_nearest_of_odd_numbers_is_as_in_spark(spark):
    odd = [0.0, 1.0, float("inf"), float("nan")]
    rows = np.array([[a, b, c] for a in odd for b in odd for c in odd])
    want = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "i long, g array<double>").orderBy("i").select(F.array_position("g", F.array_min("g")).alias("at")).collect()
    assert (transforms._least(rows) + 1).tolist() == [r.at for r in want]
    pts = spark.createDataFrame([(0, i, [1.0, None if i == 3 else 2.0]) for i in range(9)], "bag_id long, point_id long, features array<double>")
    with pytest.raises(Exception, match="must not have null"):
        transforms.condense_kmeans(pts, 2)


def test_command_line_says_parameters_and_odd_values(spark, tmp_path):
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(b, i, (rng.normal(3 * (b % 2), 1, 2)).tolist()) for b in range(12) for i in range(10)], "bag_id long, point_id long, features array<double>")
    labels = spark.createDataFrame([(b, b % 2) for b in range(12)], "bag_id long, label long")
    pts.where("bag_id < 8").write.parquet(str(tmp_path / "train")), pts.where("bag_id >= 8").write.parquet(str(tmp_path / "test")), labels.write.parquet(str(tmp_path / "labels"))
    command.main(["predict", *(str(tmp_path / n) for n in ("train", "labels", "test", "out"))])
    said = files.read_attrs(spark, str(tmp_path / "out"))
    assert said["params"]["sigma"] > 0 and "c" in said["params"] and said["kind"] == "SVC"
    command.main(["divs", str(tmp_path / "train"), str(tmp_path / "divs"), "--div", "kl", "-K", "2", "--strict"])
    assert files.DivergenceCache(spark, str(tmp_path / "divs")).held() == {("kl", 2)}
    spark.createDataFrame([(0, i, [0.0, float(i)]) for i in range(3)] + [(1, i, [float(i)] * 2) for i in range(90)], "bag_id long, point_id long, features array<double>").write.parquet(str(tmp_path / "few"))
    with pytest.warns(UserWarning, match="js with K = 1"):
        command.main(["divs", str(tmp_path / "few"), str(tmp_path / "odd"), "--div", "js", "-K", "1"])
