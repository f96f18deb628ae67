"""The parts of the neighbour joins that make them grow no faster than they must."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagdiv import queries as Q
from bagdiv.operators import knn, pruned


def made(kind: str) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16))
    if kind == "copies":
        x = np.repeat(x[:30], 100, axis=0) + 1e6
    if kind == "near copies":
        x = np.repeat(x[:30], 100, axis=0) + 1e-7 * x
    if kind == "tiny":
        x *= 1e-180
    if kind == "not finite":
        x[7, 3], x[40, 1], x[2000, 0] = np.nan, np.inf, -np.inf
    return x, rng.permutation(3000)


@pytest.mark.parametrize("kind", ["plain", "copies", "near copies", "tiny", "not finite"])
@pytest.mark.parametrize("own", [True, False])
def test_products_find_what_all_distances_find(kind, own):
    x, ids = made(kind)
    with np.errstate(all="ignore"):
        got = knn.Bag("b", 3000, None, [ids[:1000], ids[1000:]], [x[:1000], x[1000:]]).nearest(x[:300], ids[:300], 5, own, True)
        want = knn.exact_nearest(x[:300], ids[:300], x, ids, 5, own)
    assert np.array_equal(got[0], want[0], equal_nan=True)
    assert np.array_equal(got[1][np.isfinite(got[0])], want[1][np.isfinite(want[0])])


def test_products_need_few_distances(monkeypatch):
    """All distances of many dimensions were made one by one."""
    x, ids = made("plain")
    pairs = []
    monkeypatch.setattr(knn, "_gaps", lambda x, y, i, j, f=knn._gaps: pairs.append(len(i)) or f(x, y, i, j))
    monkeypatch.setattr(knn, "distances", None)
    knn.Bag("b", 3000, None, [ids], [x]).nearest(x[:300], ids[:300], 5, True, False)
    assert sum(pairs) < 10 * 300


def test_cells_have_bounded_products():
    for tasks in (2, 24, 200):
        lines, columns = knn.grid(knn.Shape(64, 615_000, 5, 60_000), tasks)
        assert lines * columns * knn.CELL_PRODUCTS >= 615_000**2


def test_a_cell_gives_one_row_for_a_bag(spark, monkeypatch):
    """Not one for each chunk of it."""
    monkeypatch.setattr(knn, "CHUNK", 20)
    pts = Q.vectors(spark, "/root/testdata/sf0.01")
    rows = knn.near(pts, 3, how="grid").groupBy("p", "part", "q").count().agg(F.max("count")).first()[0]
    assert rows <= knn.grid(knn.shape(pts), int(spark.conf.get("spark.sql.shuffle.partitions")))[1]


def test_cells_grow_with_the_points():
    """A part was searched as a whole, and pivots, 4,096 at most, didn't grow with the input: a search now makes few distances a point."""
    rng = np.random.default_rng(5)
    made = []
    for n in (2000, 16000):
        x, codes, squares = rng.uniform(size=(n, 2)), np.arange(n), []
        with pytest.MonkeyPatch.context() as m:
            m.setattr(pruned, "_square", lambda q, y, f=pruned._square: squares.append(q.shape[0] * q.shape[1] * y.shape[1]) or f(q, y))
            near, ids = pruned.search(pruned.Asking(x, codes), pruned.Held(x, codes, codes, 3), 3, True, True)
        made.append(sum(squares) / n)
        want = knn.exact_nearest(x[:200], codes[:200], x, codes, 3, True)
        assert np.array_equal(near[:200], want[0]) and np.array_equal(ids[:200], want[1])
    assert made[1] < 1.5 * made[0] < 1000


@pytest.mark.parametrize("dim", [1, 2, 3])
@pytest.mark.parametrize("k", [3, 7])
def test_search_with_copies_and_ties(dim, k):
    rng = np.random.default_rng(dim)
    x = np.round(rng.standard_normal((1500, dim)), 1)
    x[7, 0] = np.nan
    ids = np.sort(rng.permutation(5000)[:1500])
    codes = np.arange(1500)
    near, names = pruned.search(pruned.Asking(x, codes), pruned.Held(x, ids, codes, k), k, True, True)
    fine = np.isfinite(x).all(1)
    want = knn.exact_nearest(x[fine], ids[fine], x[fine], ids[fine], k, True)
    assert np.array_equal(near[fine], want[0]) and np.array_equal(names[fine], want[1]) and np.isnan(near[7]).all()


def test_few_points_ask_other_cells(spark):
    """Parts stay whole on their way, so that only points near the edge of a cell ask another."""
    pts = Q.order_values(spark, "/root/testdata/sf0.1").where("point_id % 4 = 0").cache()
    asked = pruned.sent(pts, 3)[1].agg(F.sum("asking")).first()[0]
    assert 0 < asked < 0.3 * 5 * pts.count()
