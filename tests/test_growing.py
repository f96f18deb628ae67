"""The growing matrix of divergences, its checks while writing, the exact median, and categories up to their names."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagdiv import schema
from bagdiv.operators import divergence, kernel
from bagdiv.sources import growing

SPECS, KS = ["kl_raw", "renyi:0.8", "l2", "js"], [2, 3]
KIND = "bag_id long, point_id long, features array<double>"


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = [(b, i, rng.normal(b / 3, 1 + b / 10, 2).tolist()) for b in range(7) for i in range(12 + b)]
    return spark.createDataFrame(rows, KIND).cache()


def values(df):
    return {(r.p, r.q, r.spec, r.k): r.value for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == value or got[key] == pytest.approx(value, rel=1e-9, abs=1e-9), key


def quiet(f, *args, **how):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return f(*args, **how)


@pytest.fixture(scope="module")
def whole(spark, points):
    return values(divergence.estimate_divs(points, SPECS, KS))


def test_growing_equals_computing_again(spark, points, whole, tmp_path, monkeypatch):
    """In any order and dealing of bags, and no pair of old bags is asked for or met again."""
    grown = growing.GrowingDivergences(spark, str(tmp_path / "m"), SPECS, KS)
    asked, met = [], []
    estimate, near = divergence.estimate_divs, divergence.near
    monkeypatch.setattr(growing.divergence, "estimate_divs", lambda pts, specs, ks, pairs, least: asked.append({tuple(r) for r in pairs.collect()}) or estimate(pts, specs, ks, pairs, least))
    monkeypatch.setattr(divergence, "near", lambda *a, **b: met.append(near(*a, **b)) or met[-1])
    assert quiet(grown.add, points.where("bag_id in (5, 1, 3)")) == 3
    assert quiet(grown.add, points.where("bag_id in (0, 6)")) == 2
    assert quiet(grown.add, points.orderBy(F.rand(1))) == 2
    assert quiet(grown.add, points) == 0
    same(values(grown.divs()), whole)
    assert [len(a) for a in asked] == [9, 25 - 9, 49 - 25] and set.union(*asked) == {(p, q) for p in range(7) for q in range(7)}
    again = {(r.p, r.q) for r in met[2].select("p", "q").distinct().collect()}
    assert {(p, q) for p, q in again if p != q and {p, q} <= {0, 1, 3, 5, 6}} == set()


def test_a_failed_addition_counts_for_nothing(spark, points, whole, tmp_path, monkeypatch):
    grown = growing.GrowingDivergences(spark, str(tmp_path / "m"), SPECS, KS)
    quiet(grown.add, points.where("bag_id < 4"), "one")
    with monkeypatch.context() as m:
        m.setattr(growing, "counted", lambda divs, specs, ks, write, strict: write(divs) or 1 / 0)
        with pytest.raises(ZeroDivisionError):
            grown.add(points, "two")
    assert grown.batches() == {"one"} and len(values(grown.divs())) == 16 * 8
    assert quiet(grown.add, points, "three") == 3
    same(values(grown.divs()), whole)
    assert grown.divs().count() == len(whole)
    assert quiet(grown.add, points, "three") == 0


def test_bags_that_changed_and_other_specs(spark, points, tmp_path):
    grown = growing.GrowingDivergences(spark, str(tmp_path / "m"), ["kl"], [2])
    with pytest.raises(ValueError, match="no bags"):
        grown.divs()
    assert grown.add(points.where("false")) == 0
    grown.add(points.where("bag_id < 2"))
    for other in (points.where("bag_id = 1 and point_id > 0"), points.where("bag_id = 1").withColumn("features", F.transform("features", lambda x: x + 1))):
        with pytest.raises(ValueError, match="other points"):
            grown.add(other)
    for specs, ks, least in ((["kl"], [3], None), (["bc"], [2], None), (["kl"], [2], 0.1)):
        with pytest.raises(ValueError, match="holds divergences for"):
            growing.GrowingDivergences(spark, str(tmp_path / "m"), specs, ks, least).divs()


def test_bags_of_a_stream(spark, points, whole, tmp_path):
    source = str(tmp_path / "in")
    for bags in ((0, 1, 2), (3, 4), (5, 6)):
        points.where(F.col("bag_id").isin(*bags)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source)
    grown = growing.GrowingDivergences(spark, str(tmp_path / "m"), SPECS, KS)
    query = grown.follow(stream, str(tmp_path / "check"), availableNow=True)
    assert query.awaitTermination(300)
    assert grown.batches() == {"stream-0", "stream-1", "stream-2"}
    same(values(grown.divs()), whole)


def test_values_that_are_not_finite_are_counted_while_writing(spark, tmp_path):
    rows = [(0, 1, "kl", 1, 0.5), (1, 0, "kl", 1, math.inf), (0, 0, "kl", 3, math.nan), (1, 1, "js", 3, None), (0, 1, "js", 3, None), (0, 1, "bc", 1, 1.0)]
    divs = spark.createDataFrame(rows, "p int, q int, spec string, k int, value double")
    jobs = []
    write = lambda df: jobs.append(1) or df.write.parquet(str(tmp_path / f"out{len(jobs)}"))
    with pytest.warns(UserWarning, match="js with K = 3: 2 null"):
        found = growing.counted(divs, ["kl", "js", "bc"], [1, 3], write)
    assert found == {("kl", 1): {"infinite": 1}, ("kl", 3): {"nan": 1}, ("js", 3): {"null": 2}}
    with pytest.raises(ValueError, match="aren't finite"):
        growing.counted(divs, ["kl"], [1], write, strict=True)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert growing.counted(divs.where("spec = 'bc'"), ["bc"], [1], write) == {}
        assert growing.counted(divs.where("false"), ["bc"], [1], write) == {}
    assert spark.read.parquet(str(tmp_path / "out1")).count() == 6


def test_strict_matrix(spark, tmp_path):
    """js of bags for which K is too small is an error before the batch counts."""
    pts = spark.createDataFrame([(b, i, [float(i) + b]) for b, n in ((0, 4), (1, 40)) for i in range(n)], KIND)
    grown = growing.GrowingDivergences(spark, str(tmp_path / "m"), ["js"], [1], strict=True)
    plain = values(divergence.estimate_divs(pts, ["js"], [1]))
    if any(v is None or not math.isfinite(v) for v in plain.values()):
        with pytest.raises(ValueError, match="aren't finite"):
            grown.add(pts)
        assert grown.batches() == set()
    else:
        assert grown.add(pts) == 2


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 101, 20_000, 20_001])
def test_exact_median(spark, monkeypatch, n):
    monkeypatch.setattr(kernel, "FEW", 50)
    monkeypatch.setattr(kernel, "CELLS", 16)
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.3, 1.5, rng.standard_normal(n) * 10.0 ** rng.integers(-9, 9, n))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "x double")
    assert kernel.median(df, "x") == (float(np.median(x)) if n else None)


def test_median_of_extremes(spark):
    of = lambda *x: kernel.median(spark.createDataFrame([(v,) for v in x], "x double"), "x")
    assert of(math.inf, math.inf, 1.0) == math.inf and of(-math.inf, 3.0, math.inf) == 3.0 and of(*[2.0] * 9) == 2.0
    assert of(-1.7e308, 0.0, 1.7e308) == 0.0 and of(-math.inf, -math.inf, math.inf) == -math.inf
    with pytest.raises(ValueError, match="no divergence"):
        kernel.median_positive(spark.createDataFrame([(-1.0,)], "value double"))


def test_matrix_of_a_bounded_size(spark, monkeypatch):
    divs = spark.createDataFrame([(1, 2, 0.5), (2, 1, None), (9, 1, 3.0)], "p int, q int, value double")
    assert np.array_equal(kernel.matrix(divs, [1, 2]), [[np.nan, 0.5], [np.nan, np.nan]], equal_nan=True)
    monkeypatch.setattr(kernel, "BAGS", 1)
    with pytest.raises(ValueError, match="1 bags at most"):
        kernel.matrix(divs, [1, 2])


def test_categories_up_to_their_names(spark):
    df = spark.createDataFrame([(1.0, "x"), (1.0, "x"), (2.0, "y"), (None, "z"), (3.5, None)], "a double, b string")
    assert {tuple(r) for r in schema.relabelled(df, "a", "b").collect()} == {("1", "x"), ("2", "y")}
    same_ = spark.createDataFrame([(1.0, 1, "01"), (20.0, 20, "20.0")], "a double, b int, c string")
    assert {tuple(r) for r in schema.relabelled(same_, "a", "b").collect()} == {("1", "1"), ("20", "20")}
    assert {tuple(r) for r in schema.relabelled(same_, "b", "c").collect()} == {("1", "1"), ("20", "20")}
    for rows in ([(1, "x"), (2, "x")], [(1, "x"), (1, "y")]):
        with pytest.raises(ValueError, match="same up to"):
            schema.relabelled(spark.createDataFrame(rows, "a int, b string"), "a", "b")
    assert schema.relabelled(df.where("false"), "a", "b").count() == 0


