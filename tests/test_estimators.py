import io
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagdiv.__main__ import main
from bagdiv.operators import divergence, machines
from bagdiv.operators.estimators import BagMachine
from bagdiv.sources import files

SCHEMA = "bag_id long, point_id long, features array<double>"


def gaussians(spark, n, seed, size=30):
    rng = np.random.default_rng(seed)
    rows = [(b, i, v.tolist()) for b in range(n) for i, v in enumerate(rng.normal(0, 1 + 2 * (b % 2), (size, 2)))]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(b, b % 2) for b in range(n)], "bag_id long, label long")


def test_split_leaves_the_other_pairs_as_they_were(spark):
    pts, _ = gaussians(spark, 5, 1)
    every = {(r.p, r.q, r.spec): r.value for r in divergence.estimate_divs(pts, ["kl", "l2", "js"], [3]).collect()}
    some = {(r.p, r.q, r.spec): r.value for r in divergence.estimate_divs(pts.withColumn("split", F.col("bag_id") < 2), ["kl", "l2", "js"], [3]).collect()}
    assert some == pytest.approx({k: v for k, v in every.items() if k[0] == k[1] or (k[0] < 2) != (k[1] < 2)})


def test_fit_and_predict_other_bags_of_the_same_ids(spark):
    pts, labels = gaussians(spark, 12, 2)
    other, truth = gaussians(spark, 8, 3)
    part = labels.where("bag_id < 10")  # the last two bags have no label
    m = BagMachine(sigmas=(1.0, 4.0), params=[{"c": 1.0}, {"c": 64.0}], probability=True).fit(pts, part)
    assert m.score(other, truth) >= 0.85
    for r in m.probabilities(other).collect():
        assert sum(r.probability) == pytest.approx(1) and min(r.probability) >= 0
    assert {len(r.decision) for r in m.decision(other).collect()} == {1}


def test_regression_and_one_class(spark):
    pts, labels = gaussians(spark, 8, 4)
    assert BagMachine("SVR", sigmas=(2.0,), params=[{"c": 10.0, "epsilon": 0.05}]).fit(pts, labels).score(pts, labels) < 0.4
    assert set(r.pred for r in BagMachine("OneClassSVM").fit(pts).predict(pts).collect()) <= {-1, 1}


def test_one_label_is_too_few(spark):
    pts, labels = gaussians(spark, 3, 5)
    with pytest.raises(ValueError):
        BagMachine().fit(pts, labels.where("bag_id = 0"))


def test_probabilities_of_three_classes_follow_the_classes():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 1, (30, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    y = np.repeat([0, 1, 2], 30)
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 4)
    p = machines.Machine().fit(k, y).calibrate(k, y).probabilities(k)
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y).mean() > 0.9


def test_coupling_gives_back_consistent_ratios():
    p = np.array([0.5, 0.3, 0.2])
    assert machines.coupled(p[:, None] / (p[:, None] + p[None])) == pytest.approx(p)


def brute_entropy(d, k, a, dim):
    n = len(d)
    r = np.sort(d, axis=1)[:, k - 1]
    volume = math.pi ** (dim / 2) / math.gamma(dim / 2 + 1)
    return math.log(math.gamma(k) / math.gamma(k - a + 1) * (volume * (n - 1)) ** (1 - a) * np.mean(r ** (dim * (1 - a)))) / (1 - a)


def test_jensen_renyi_against_brute_force(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(20, 2)), rng.normal(2, 1, (20, 2))
    rows = [(b, i, v.tolist()) for b, z in enumerate((x, y, x[:15])) for i, v in enumerate(z)]
    got = {(r.p, r.q): r.value for r in divergence.jensen_renyi(spark.createDataFrame(rows, SCHEMA), [0.8], [3], clamp=False).collect()}

    def d(z):
        out = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
        np.fill_diagonal(out, np.inf)
        return out

    want = brute_entropy(d(np.concatenate([x, y])), 3, 0.8, 2) - brute_entropy(d(x), 3, 0.8, 2) / 2 - brute_entropy(d(y), 3, 0.8, 2) / 2
    assert got[0, 1] == pytest.approx(want) and got[1, 0] == pytest.approx(want)
    assert got[0, 0] == 0 and got[0, 2] is None


def array(x):
    out = io.BytesIO()
    np.save(out, x)
    return b"\xaa" + struct.pack(">i", len(out.getvalue())) + out.getvalue()


def text(s):
    return b"\x07" + struct.pack(">i", len(s.encode())) + s.encode()


def test_typed_bytes(spark, tmp_path):
    a, b = np.arange(6.0).reshape(3, 2), np.ones((1, 2))
    bag = lambda name, x: text(name) + b"\x0a" + struct.pack(">i", 2) + text("features") + array(x) + text("size") + b"\x06" + struct.pack(">d", 1.5)
    (tmp_path / "data_0.tb").write_bytes(bag("u/one", a) + bag("v/two", b))
    (tmp_path / "data_2.tb").write_bytes(bag("u/three", b))
    rows = files.read_typedbytes(spark, str(tmp_path)).collect()
    assert sorted((r.category, r.name) for r in rows) == [("u", "one")] * 3 + [("u", "three"), ("v", "two")]
    assert [r.features for r in rows if r.name == "one"] == a.tolist()
    assert files.read_typedbytes(spark, str(tmp_path), ["v"]).count() == 1
    data = b"\x08" + struct.pack(">i", 2) + b"\x03" + struct.pack(">i", -5) + b"\x09" + b"\x02\x01" + b"\xff"
    assert files.typed(memoryview(data), 0) == ([-5, [True]], len(data))
    with pytest.raises(ValueError):
        files.typed(memoryview(b"\x63" + struct.pack(">i", 0)), 0)


def test_command_line(spark, tmp_path, capsys):
    pts, labels = gaussians(spark, 8, 6, 20)
    pts.write.parquet(f"{tmp_path}/points"), labels.write.parquet(f"{tmp_path}/labels")
    main(["divs", f"{tmp_path}/points", f"{tmp_path}/divs", "--div", "kl", "renyi:.5", "-K", "1", "3"])
    assert spark.read.parquet(f"{tmp_path}/divs").count() == 8 * 8 * 2 * 2
    main(["predict", f"{tmp_path}/points", f"{tmp_path}/labels", f"{tmp_path}/points", f"{tmp_path}/preds", "--kind", "NuSVC", "--div", "hellinger"])
    assert spark.read.parquet(f"{tmp_path}/preds").count() == 8
