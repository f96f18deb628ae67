import math

import numpy as np
import pytest

from bagdiv import schema
from bagdiv.functions import specs as S
from bagdiv.operators import divergence, kernel, knn, machines, transforms
from bagdiv.sources import files


def bags(spark, x, y):
    rows = [(b, i, [float(v)] if np.isscalar(v) else [*map(float, v)]) for b, z in enumerate((x, y)) for i, v in enumerate(z)]
    return spark.createDataFrame(rows, "bag_id long, point_id long, features array<double>")


GOLDEN = {
    "B": (((0, 1, 3), (0.2, 1.2, 3.2, 6.2)), {"js": -0.033266724, "js_clamp": 0.0, "l2": 0.0, "kl": 0.0}),
    "C": ((((0, 0), (1, 0), (0, 1.5), (2, 2)), ((5, 5), (6, 5.5), (5, 7), (7.5, 6), (8, 8))), {"kl": 3.190816339, "linear": 0.001397745, "alpha:0.5": 0.180405525, "bc": 0.180405525, "hellinger": 0.905314572, "renyi:0.8": 3.283718175, "tsallis:0.8": 2.407314328, "l2": 0.224279613, "js": 1.022009602, "js_clamp": 0.693147181}),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_divergences(spark, name):
    points, want = GOLDEN[name]
    got = {r.spec: r.value for r in divergence.estimate_divs(bags(spark, *points), [*want], [2]).where("p = 0 and q = 1").collect()}
    assert got == pytest.approx(want, abs=1e-8)


def test_chunks_do_not_change_distances(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pts = bags(spark, rng.normal(size=(60, 3)), rng.normal(size=(41, 3)) * 2)
    values = lambda: {(r.p, r.q): r.value for r in divergence.estimate_divs(pts, ["kl_raw"], [3]).collect()}
    near = lambda: sorted(map(tuple, knn.nearest(pts, 2).collect()))
    want, found = values(), near()
    monkeypatch.setattr(knn, "CHUNK", 16)
    assert values() == pytest.approx(want) and near() == found


def test_only_pairs_that_are_asked_for_are_computed(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(b, i, rng.normal(size=2).tolist()) for b in range(6) for i in range(9)]
    pts = spark.createDataFrame(rows, "bag_id long, point_id long, features array<double>")
    pairs = spark.createDataFrame([(0, 1), (3, 2)], "p long, q long")
    met = {(r.p, r.q) for r in knn.near(pts, 2, pairs=pairs).select("p", "q").collect()}
    assert met == {(0, 1), (3, 2), (0, 0), (1, 1), (2, 2), (3, 3)}
    for spec in ("kl_raw", "l2", "js"):
        every = {(r.p, r.q): r.value for r in divergence.estimate_divs(pts, [spec], [2]).collect()}
        some = {(r.p, r.q): r.value for r in divergence.estimate_divs(pts, [spec], [2], pairs).collect()}
        assert some == {k: pytest.approx(every[k]) for k in ((0, 1), (3, 2))}


def test_scaler_and_projection_of_other_points(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4)), rng.normal(size=(7, 4))
    pts = bags(spark, a, b)
    train, test = pts.where("bag_id = 0"), pts.where("bag_id = 1")
    of = lambda df: np.array([r.features for r in df.orderBy("point_id").collect()])
    assert np.allclose(of(transforms.Scaler.fit(train).apply(test)), (b - a.mean(0)) / a.std(0))
    p = transforms.Projection.fit(train, 2, whiten=True)
    values, vectors = np.linalg.eigh(np.cov(a.T, bias=True))
    want = (b - a.mean(0)) @ vectors[:, ::-1][:, :2] / np.sqrt(values[::-1][:2])
    assert np.allclose(np.abs(of(p.apply(test))), np.abs(want))
    done, projection, scaler = transforms.prepared(train, k=3)
    assert np.allclose(of(done).std(0), 1) and np.allclose(of(scaler.apply(projection.apply(train))), of(done))


def test_condense_equals_plain_kmeans(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 2)), rng.normal(size=(3, 2))
    got = {(r.bag_id, r.point_id): r.features for r in transforms.condense_kmeans(bags(spark, x, y), 4).collect()}
    centers = x[:4].copy()
    for _ in range(20):
        code = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        centers = np.array([x[code == c].mean(0) if (code == c).any() else centers[c] for c in range(4)])
    assert np.allclose([got[0, i] for i in range(4)], centers) and np.allclose([got[1, i] for i in range(3)], y) and len(got) == 7


def test_crossvalidation_options(spark):
    rng = np.random.default_rng(5)
    y = np.array([0, 1] * 15)
    x = rng.normal(size=30) + 3 * y
    d = np.abs(x[:, None] - x[None])
    weight = rng.uniform(0.7, 1.3, 30)
    how = {"sigmas": (1.0,), "params": [{"c": 1.0}]}
    for more in ({"weight": weight}, {"stratified": True}, {"fold": np.arange(30) % 4}, {"project_all": False}):
        score, preds = machines.crossvalidate(spark, d, y, n_folds=5, **more, **how)
        assert score >= 0.85 and score == pytest.approx(np.average(preds == y, weights=more.get("weight")))
    f = machines.folds(30, 5, 0, y)
    assert all((y[f == i] == 1).sum() == 3 for i in range(5))
    logs = machines.transduct(d, y[:20], 20, mode="log_probabilities")
    assert np.allclose(np.exp(logs), machines.transduct(d, y[:20], 20, mode="probabilities")) and (machines.transduct(d, y[:20], 20) == y[20:]).mean() >= 0.8


@pytest.mark.parametrize("form", ["npz", "typedbytes", "parquet"])
def test_points_round_trip(spark, tmp_path, form):
    rng = np.random.default_rng(6)
    rows = [(c, n, i, rng.normal(size=3).tolist()) for c in ("a", "b") for n in ("x", "y") for i in range(5)]
    pts = spark.createDataFrame(rows, "category string, name string, point_id long, features array<double>")
    files.save(pts, str(tmp_path / "out"), form)
    assert sorted(map(tuple, files.load(spark, str(tmp_path / "out")).collect())) == sorted(rows)
    assert {r.category for r in files.load(spark, str(tmp_path / "out"), ["b"]).collect()} == {"b"}


@pytest.mark.parametrize("value", [np.arange(30, dtype=np.uint8), np.random.default_rng(0).normal(size=(10, 12, 100)), np.linspace(1, 3.2, 121, dtype=np.longdouble), 5, -(2**40), 1.5, True, "text", b"raw", [1, "a"], {"k": [2.5]}])
def test_typed_bytes_round_trip(value):
    got, at = files.typed(memoryview(files.as_typed(value)), 0)
    assert at == len(files.as_typed(value)) and (np.array_equal(got, value) if isinstance(value, np.ndarray) else got == value)


def test_divergence_cache_is_checked(spark, tmp_path):
    rng = np.random.default_rng(7)
    pts = bags(spark, rng.normal(size=(9, 2)), rng.normal(size=(8, 2)))
    cache = files.DivergenceCache(spark, str(tmp_path / "divs"))
    first = {tuple(r) for r in cache.get(pts, ["kl"], [2]).collect()}
    assert cache.held() == {("kl", 2)} and len(first) == 4
    assert {tuple(r) for r in cache.get(pts, ["kl", "renyi:0.9"], [2]).where("spec = 'kl'").collect()} == first
    assert cache.held() == {("kl", 2), ("renyi:0.9", 2)}
    with pytest.raises(ValueError):
        cache.get(pts.where("point_id < 8"), ["kl"], [2])
    with pytest.raises(ValueError):
        cache.get(pts, ["kl"], [2], min_dist=0.1)
    with pytest.raises(ValueError):
        files.checked(bags(spark, [1.0, float("nan")], [2.0]))


def test_images_and_nonempty_bags(spark, tmp_path):
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "one.png").write_bytes(bytes(range(12)))
    (tmp_path / "cat" / "none.jpg").write_bytes(b"")
    (tmp_path / "cat" / "note.txt").write_bytes(b"no")
    pts = files.image_points(spark, str(tmp_path), lambda b: np.frombuffer(b, np.uint8).reshape(-1, 4))
    assert sorted((r.category, r.name, r.point_id, r.features) for r in pts.collect()) == [("cat", "one.png", i, [4.0 * i + j for j in range(4)]) for i in range(3)]
    table = spark.createDataFrame([(0,), (1,), (2,)], "bag_id long")
    assert files.nonempty(bags(spark, [1.0], [2.0]), table).count() == 2


@pytest.mark.parametrize("bad", [["nothing"], ["kl:0.5"], ["alpha"], ["kl", "kl"]])
def test_bad_specs(bad):
    with pytest.raises(ValueError):
        S.parse(bad)


def test_k_too_large(spark):
    with pytest.raises(ValueError):
        divergence.estimate_divs(bags(spark, (0, 1, 3), (1, 2, 4)), ["kl"], [3])


def test_repairs():
    m = np.array([[1.0, 2.0], [2.0, 1.0]])
    for how in ("clip", "flip", "shift", "square"):
        assert np.linalg.eigvalsh(kernel.repair(m, how)[0]).min() > -1e-9


@pytest.mark.parametrize("kind", ["SVC", "NuSVC"])
def test_classifiers_tell_classes_apart(kind):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (30, 2)), rng.normal(4, 1, (30, 2)), rng.normal((0, 8), 1, (30, 2))])
    y = np.repeat([0, 1, 2], 30)
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 4)
    assert (machines.Machine(kind, nu=0.2).fit(k, y).predict(k) == y).mean() > 0.95


@pytest.mark.parametrize("kind", ["SVR", "NuSVR"])
def test_regressors_follow_a_curve(kind):
    x = np.linspace(0, 6, 60)
    k = np.exp(-((x[:, None] - x[None]) ** 2))
    assert np.abs(machines.Machine(kind, c=10.0, epsilon=0.05).fit(k, np.sin(x)).predict(k) - np.sin(x)).mean() < 0.15


def test_one_class_marks_the_far_point():
    x = np.append(np.random.default_rng(0).normal(size=40), 30.0)
    m = machines.Machine("OneClassSVM", nu=0.1).fit(np.exp(-((x[:40, None] - x[None, :40]) ** 2) / 2))
    assert m.predict(np.exp(-((x[:, None] - x[None, :40]) ** 2) / 2))[-1] == -1


def test_cross_validation_of_gaussian_bags(spark):
    rng = np.random.default_rng(42)
    rows = [(b, i, v.tolist()) for b in range(20) for i, v in enumerate(rng.normal(0, 1 + b % 2, (40, 2)))]
    pts = spark.createDataFrame(rows, "bag_id long, point_id long, features array<double>")
    d = kernel.matrix(divergence.estimate_divs(pts, ["kl"], [3]), [*range(20)])
    score, _ = machines.crossvalidate(spark, d, np.arange(20) % 2, n_folds=3, sigmas=(1.0, 4.0), params=[{"c": 1.0}, {"c": 64.0}])
    assert score >= 0.85


def test_transforms(spark):
    rng = np.random.default_rng(3)
    pts = bags(spark, rng.normal(size=(30, 3)), rng.normal(size=(8, 3)))
    x = np.array([r.features for r in transforms.standardize(pts).collect()])
    assert np.allclose(x.mean(0), 0) and np.allclose(x.std(0), 1)
    assert transforms.condense_kmeans(pts, 10).count() == 18
    z = np.array([r.features for r in transforms.pca(pts, k=2, whiten=True).collect()])
    assert np.allclose(np.cov(z.T, ddof=0), np.eye(2))


def test_npz_and_cache(spark, tmp_path):
    (tmp_path / "a").mkdir()
    np.savez(tmp_path / "a" / "one.npz", features=np.arange(6.0).reshape(3, 2))
    assert [(r.category, r.name, r.features) for r in files.read_npz(spark, str(tmp_path)).orderBy("point_id").collect()] == [("a", "one", [2.0 * i, 2.0 * i + 1]) for i in range(3)]
    cache = files.DivergenceCache(spark, str(tmp_path / "cache"))
    cache.write(spark.createDataFrame([(0, 1, "kl", 3, 0.5), (0, 1, "kl", 5, 0.7)], "p int, q int, spec string, k int, value double"))
    assert [r.value for r in cache.read("kl", 5).collect()] == [0.7]


def test_bags_of_a_matrix_and_of_arrays(spark):
    x = np.arange(10.0).reshape(5, 2)
    want = [(0, 0, [0.0, 1.0]), (0, 1, [2.0, 3.0]), (1, 0, [4.0, 5.0]), (1, 1, [6.0, 7.0]), (1, 2, [8.0, 9.0])]
    for pts in (schema.from_matrix(spark, x, [2, 3]), schema.from_bags(spark, [x[:2], x[2:]])):
        assert sorted(map(tuple, pts.collect())) == want
    for n_pts in ([2, 2], [5, 0], [2.5, 2.5], [[2, 3]]):
        with pytest.raises(ValueError):
            schema.from_matrix(spark, x, n_pts)
    for arrays in ([], [x, x[:, :1]]):
        with pytest.raises(ValueError):
            schema.from_bags(spark, arrays)


@pytest.mark.parametrize("form", ["npz", "typedbytes", "parquet"])
def test_only_the_bags_that_are_asked_for_are_loaded(spark, tmp_path, form):
    rows = [(c, n, 0, [1.0]) for c in ("a", "b") for n in ("x", "y")]
    out = str(tmp_path / "out")
    files.save(spark.createDataFrame(rows, "category string, name string, point_id long, features array<double>"), out, form, made="here", sizes=[1, 2])
    names = lambda **how: sorted((r.category, r.name) for r in files.load(spark, out, **how).collect())
    pairs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "category string, name string")
    assert names(pairs=pairs) == [("a", "x"), ("b", "y")]
    assert names(cats=["b"], pairs=pairs) == [("b", "y")]
    assert names(choose=lambda bags: bags.where("name = 'x'")) == [("a", "x"), ("b", "x")]
    assert files.read_attrs(spark, out) == {"made": "here", "sizes": [1, 2]} and files.read_attrs(spark, str(tmp_path)) == {}


def test_images_by_category_and_their_side_files(spark, tmp_path):
    for c in ("cat", "dog"):
        (tmp_path / "in" / c).mkdir(parents=True)
        for i in range(5):
            (tmp_path / "in" / c / f"{i}.jpg").write_bytes(b"x")
    (tmp_path / "in" / "cat" / "1.jpg.weight").write_text(" 2.5\n")
    (tmp_path / "in" / "cat" / "note.weight").write_text("7")
    picked = lambda how: sorted((r.category, r.file) for r in files.find_images(spark, str(tmp_path), 3, how).collect())
    assert picked("first") == [(c, f"{i}.jpg") for c in ("cat", "dog") for i in (0, 1, 2)]
    assert picked("uniform") == [(c, f"{i}.jpg") for c in ("cat", "dog") for i in (0, 2, 4)]
    assert [tuple(r) for r in files.side_labels(spark, str(tmp_path), ".weight").collect()] == [("cat", "1.jpg", "2.5")]
    assert files.side_labels(spark, str(tmp_path), ".weight").columns == ["category", "file", "weight"]
    (tmp_path / "other" / "cat").mkdir(parents=True)
    (tmp_path / "other" / "cat" / "1.jpg").write_bytes(b"x")
    with pytest.raises(ValueError):
        files.find_images(spark, str(tmp_path))


def test_divergences_of_the_user(spark, monkeypatch):
    monkeypatch.setattr(S, "CUSTOM", {})
    S.register("both", ["kl", "alpha:.5"], lambda kl, half: kl - half)
    rng = np.random.default_rng(8)
    pts = bags(spark, rng.normal(size=(9, 2)), rng.normal(size=(8, 2)))
    got = {(r.p, r.q, r.spec): r.value for r in divergence.estimate_divs(pts, ["both", "kl_raw", "alpha:0.5"], [2]).collect()}
    for p, q in ((0, 1), (1, 0), (0, 0)):
        assert got[p, q, "both"] == pytest.approx(got[p, q, "kl_raw"] - got[p, q, "alpha:0.5"])
    for name, bases in (("kl", ["linear"]), ("both", ["kl"]), ("a:b", ["kl"]), ("new", []), ("new", ["js"])):
        with pytest.raises(ValueError):
            S.register(name, bases, lambda *_: None)


def test_searches_of_all_folds_in_one_job_find_what_each_alone_finds(spark):
    rng = np.random.default_rng(9)
    y = np.array([0, 1] * 15)
    x = rng.normal(size=30) + 1.5 * y
    d, fold = np.abs(x[:, None] - x[None]), np.arange(30) % 3
    how = {"sigmas": (0.25, 1.0, 4.0), "params": [{"c": 0.1}, {"c": 10.0}]}
    found = machines.crossvalidated(spark, d, y, fold=fold, **how)
    for f in range(3):
        at = np.flatnonzero(fold != f)
        assert found["params"][f] == machines.tune(spark, d[np.ix_(at, at)], y[at], **how)
    assert (found["fold"] == fold).all() and found["score"] == pytest.approx((found["preds"] == y).mean())


def test_codewords_are_means_of_their_points_and_noise_fills_blanks(spark):
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=(60, 2)), rng.normal(size=(50, 2)) + 9
    pts = bags(spark, x, y)
    centers = transforms.codewords(pts, 3)
    every = np.concatenate([x, y])
    code = ((every[:, None] - centers[None]) ** 2).sum(2).argmin(1)
    assert np.allclose(centers, [every[code == c].mean(0) for c in range(3)], atol=1e-2)
    got = {(r.bag_id, r.code): r.n for r in transforms.bag_of_words(pts, centers).collect()}
    assert got == {(b, c): n for b, part in enumerate((code[:60], code[60:])) for c, n in enumerate(np.bincount(part, minlength=3)) if n}
    of = lambda: {(r.bag_id, r.point_id): r.features for r in transforms.blanks(pts, "fill", 12.0).collect()}
    filled = of()
    assert filled == of()
    for b, z in enumerate((x, y)):
        for i, v in enumerate(z):
            if v.sum() < 12:
                assert all(0 <= u < 36 for u in filled[b, i]) and filled[b, i] != v.tolist()
            else:
                assert filled[b, i] == v.tolist()


def test_symmetrize_keeps_pairs_of_both_directions_and_their_nulls(spark):
    rows = [(1, 1, 3, 0.5), (1, 2, 3, 1.0), (2, 1, 3, 2.0), (1, 3, 3, 4.0), (2, 3, 3, None), (3, 2, 3, 1.0), (1, 2, 5, 7.0), (2, 1, 5, float("nan"))]
    got = {(r.p, r.q, r.k): r.value for r in kernel.symmetrize(spark.createDataFrame(rows, "p int, q int, k int, value double")).collect()}
    # Pair (1, 3) has one direction only.
    assert {k for k in got if k[2] == 3} == {(1, 1, 3), (1, 2, 3), (2, 1, 3), (2, 3, 3), (3, 2, 3)}
    assert got[1, 1, 3] == 0.5 and got[1, 2, 3] == got[2, 1, 3] == 1.5 and got[2, 3, 3] is None and got[3, 2, 3] is None
    assert all(math.isnan(got[p, q, 5]) for p, q in ((1, 2), (2, 1)))
    assert kernel.symmetrize(spark.createDataFrame([], "p string, q string, value double")).collect() == []


@pytest.mark.parametrize(("dim", "points", "tasks"), [(64, 2_000, 8), (1, 15_000, 4), (2, 100, 1), (64, 200_000_000, 200), (8, 10_000_000, 3_000)])
def test_grid_bounds_the_neighbours_of_a_cell(dim, points, tasks):
    lines, columns = knn.grid(knn.Shape(dim, points, 5, 5), tasks)
    assert columns * knn.CELL_BYTES >= points * dim * 8 and lines * columns >= min(tasks, 256)
    # A chunk is sent to every column of its line and every line of its column.
    assert lines + columns <= 2 * max(columns, 16)


def test_divergences_of_plain_specs_write_no_table(spark, monkeypatch):
    written = []
    monkeypatch.setattr(divergence, "checkpointed", lambda df: written.append(1) or df)
    pts = bags(spark, [i * 3 % 11 for i in range(9)], [(7 + i * 3) % 13 for i in range(8)])
    divergence.estimate_divs(pts, ["kl", "alpha:0.8"], [2])
    assert not written
    divergence.estimate_divs(pts, ["l2", "js"], [2])
    assert len(written) == 1
