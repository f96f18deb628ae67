"""Transforms of features: each fits with aggregates over all points and applies as column expressions or per-bag kernels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import dimension
from ..tables import checkpointed, dropped


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


@dataclass(frozen=True)
class Scaler:
    """Means and spreads of the dimensions of some points, to be applied to any of the same dimension."""

    mean: tuple[float, ...]
    spread: tuple[float, ...]

    @staticmethod
    def fit(pts: DataFrame) -> "Scaler":
        """Population variance; a constant dimension has the spread 1."""
        dim = dimension(pts)
        at = [F.element_at("features", i + 1) for i in range(dim)]
        row = pts.agg(*(F.avg(x) for x in at), *(F.stddev_pop(x) for x in at)).first()
        return Scaler(tuple(row[:dim]), tuple(x or 1.0 for x in row[dim:]))

    def apply(self, pts: DataFrame) -> DataFrame:
        mean, spread = (F.array(*map(F.lit, x)) for x in (self.mean, self.spread))
        return pts.withColumn("features", F.zip_with(F.zip_with("features", mean, lambda a, b: a - b), spread, lambda a, b: a / b))


def standardize(pts: DataFrame) -> DataFrame:
    """Zero mean and unit population variance in each dimension; a constant dimension becomes 0."""
    return Scaler.fit(pts).apply(pts)


def normalize(pts: DataFrame, norm: str = "l2") -> DataFrame:
    """Unit norm for each point; the zero vector stays."""
    length = F.sqrt(_total(F.transform("features", lambda x: x * x))) if norm == "l2" else _total(F.transform("features", F.abs))
    return pts.withColumn("_length", length).withColumn("features", F.when(F.col("_length") == 0, F.col("features")).otherwise(F.transform("features", lambda x: x / F.col("_length")))).drop("_length")


def blanks(pts: DataFrame, handler: str, threshold: float = 1000.0, seed: int = 0) -> DataFrame:
    """Points whose features sum to less than the threshold: drop, zero, or fill with uniform noise."""
    blank, dim = _total(F.col("features")) < threshold, dimension(pts)
    if handler == "drop":
        return pts.where(~blank)
    if handler == "zero":
        new = F.array_repeat(F.lit(0.0), dim)
    elif handler == "fill":
        unit = lambda i: F.pmod(F.xxhash64("bag_id", "point_id", i, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
        new = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.lit(6 * threshold / dim) * unit(i))
    else:
        raise ValueError(f"unknown handler {handler!r}")
    return pts.withColumn("features", F.when(blank, new).otherwise(F.col("features")))


def append_xy(pts: DataFrame, x: str | None = "x", y: str | None = "y", per_bag: bool = False) -> DataFrame:
    """Features with the point's place appended, over the largest of all (or of its bag)."""
    names = [c for c in (x, y) if c]
    most = [F.max(c).alias(f"_{c}") for c in names]
    met = pts.join(pts.groupBy("bag_id").agg(*most), "bag_id") if per_bag else pts.crossJoin(F.broadcast(pts.agg(*most)))
    return met.withColumn("features", F.concat("features", F.array(*(F.col(c).cast("double") / F.col(f"_{c}") for c in names)))).drop(*(f"_{c}" for c in names))


def _summed(pts: DataFrame, dim: int, of) -> np.ndarray:
    """The sum of of(points) over blocks of points, an array of one shape, flat: each task adds its own, Spark adds the tasks'."""

    def run(batches):
        total = None
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for lo in range(0, len(x), 4096):
                part = of(x[lo : lo + 4096]).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total))), "x": pa.array(total)})

    rows = pts.select("features").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow().sort_by("at")
    return rows.column("x").to_numpy()


def _column_sums(pts: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    found = _summed(pts, dim, lambda x: np.concatenate([[len(x)], x.sum(0)]))
    return int(found[0]), found[1:]


@dataclass(frozen=True)
class Projection:
    """Principal components of some points, to be applied to any of the same dimension."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    whiten: bool = False

    @staticmethod
    def fit(pts: DataFrame, k: int | None = None, varfrac: float = 0.7, whiten: bool = False) -> "Projection":
        """k dimensions, or the fewest that explain varfrac. Only dim x dim sums leave the executors."""
        dim = dimension(pts)

        def sums(batches):
            n, s, ss = 0, np.zeros(dim), np.zeros((dim, dim))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
            found = np.concatenate([[n], s, ss.ravel()])
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(found))), "x": pa.array(found)})

        rows = pts.select("features").mapInArrow(sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
        n, s, ss = rows[0].x, np.array([r.x for r in rows[1 : dim + 1]]), np.array([r.x for r in rows[dim + 1 :]]).reshape(dim, dim)
        mean = s / n
        values, vectors = np.linalg.eigh(ss / n - np.outer(mean, mean))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(dim)] < 0, -1, 1)
        if k is None:
            k = min(dim, int(np.searchsorted(np.cumsum(values) / values.sum(), varfrac) + 1))
        return Projection(mean, vectors[:, :k], values[:k], whiten)

    @staticmethod
    def fit_randomized(pts: DataFrame, k: int, whiten: bool = False, more: int = 10, passes: int = 2, seed: int = 0) -> "Projection":
        """About what `fit` gives, for dimensions whose dim x dim sums are too large: no task and not the driver holds more than dim x (k + more).

        A Gaussian sketch of the covariance finds the space of its largest components: each pass multiplies the covariance by what
        the last one gave, one point after another, and its sums are added over the tasks. A last pass takes the exact
        covariance within that space. With k + more >= dim nothing is lost; beyond, each pass more brings the space nearer.
        """
        dim = dimension(pts)
        width = min(dim, k + more)
        n, mean = _column_sums(pts, dim)
        mean = mean / n
        space = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
        for _ in range(passes if width < dim else 0):
            basis = space
            product = _summed(pts, dim, lambda x: (x - mean).T @ ((x - mean) @ basis))
            space = np.linalg.qr(product.reshape(dim, width))[0]
        inner = _summed(pts, dim, lambda x: ((x - mean) @ space).T @ ((x - mean) @ space)).reshape(width, width) / n
        values, vectors = np.linalg.eigh(inner)
        values, vectors = np.maximum(values[::-1], 0)[:k], (space @ vectors[:, ::-1])[:, :k]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
        return Projection(mean, vectors, values, whiten)

    def apply(self, pts: DataFrame) -> DataFrame:
        components = self.components / np.sqrt(np.maximum(self.variances, 1e-300)) if self.whiten else self.components
        mean, dim = self.mean, len(self.mean)

        def scores(batches):
            for batch in batches:
                at = batch.schema.get_field_index("features")
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                new = pa.array(list((x - mean) @ components), pa.list_(pa.float64()))
                yield batch.set_column(at, "features", new)

        return pts.mapInArrow(scores, pts.schema)


def pca(pts: DataFrame, k: int | None = None, varfrac: float = 0.7, whiten: bool = False, randomize: bool = False, seed: int = 0) -> DataFrame:
    """Points in their principal components; randomize: by `Projection.fit_randomized`, which needs k."""
    if randomize and k is None:
        raise ValueError("a randomised projection needs k")
    return (Projection.fit_randomized(pts, k, whiten, seed=seed) if randomize else Projection.fit(pts, k, varfrac, whiten)).apply(pts)


def prepared(pts: DataFrame, k: int | None = None, varfrac: float = 0.7, blank: str | None = None, threshold: float = 1000.0, xy: bool = False) -> tuple[DataFrame, Projection, Scaler]:
    """Points through the usual chain (blanks, principal components, place, unit variance), and what was fitted for it."""
    if blank:
        pts = blanks(pts, blank, threshold)
    projection = Projection.fit(pts, k, varfrac)
    pts = projection.apply(pts)
    pts = append_xy(pts) if xy else pts
    scaler = Scaler.fit(pts)
    return scaler.apply(pts), projection, scaler


def _gap(c: Column) -> Column:
    """Squared distance of a point to a center."""
    return _total(F.zip_with("features", c, lambda a, b: (a - b) * (a - b)))


#: Points of a block and numbers in it at most; distances measured at once; numbers for a task of a large table.
BLOCK, NUMBERS, AT_ONCE, TASK = 1 << 13, 1 << 19, 1 << 16, 1 << 22


def condense_kmeans(pts: DataFrame, k: int, rounds: int = 20, runs: int = 0, seed: int = 0) -> DataFrame:
    """Bags of more than k points become their k cluster centers, numbered from 0; others stay.

    Each bag starts from its k points of the smallest ids, or with runs from oversampled seeds (see `_oversampled`), as many times
    as said, of which the one of the least cost stays. The points are written once in blocks of one bag each, so that
    a bag of any size is spread over tasks. A round, of all runs at once, sends the centers of a bag to its blocks, and sums by center come
    back; a center that loses all points stays. A bag takes part until none of its centers moves.
    """
    dim = dimension(pts)
    sizes = checkpointed(pts.groupBy("bag_id").agg(F.count("*").alias("_n")))
    blocks = _blocks(pts, sizes.where(F.col("_n") > k), dim)
    centers = _lloyd(blocks, _oversampled(blocks, k, seed, runs, dim) if runs else checkpointed(_first(blocks, k, dim)), rounds, dim)
    if runs > 1:
        costs = _assigned(blocks, centers, dim).groupBy("bag_id", "run").agg(F.sum("cost").alias("cost"))
        tried, centers = centers, checkpointed(costs.join(centers, ["bag_id", "run"]).groupBy("bag_id").agg(F.min_by("centers", F.struct("cost", "run")).alias("centers")))
        dropped(tried)
    dropped(blocks)
    condensed = centers.select("bag_id", F.posexplode("centers").alias("point_id", "features")).withColumn("point_id", F.col("point_id").cast("long"))
    small = pts.select("bag_id", "point_id", "features").join(sizes.where(F.col("_n") <= k).select("bag_id"), "bag_id", "left_semi")
    return small.unionByName(condensed)


def cost(pts: DataFrame, centers: DataFrame) -> DataFrame:
    """(bag_id, cost): squared distances of a bag's points to the nearest of its centers (bag_id, centers), added up."""
    met = pts.join(centers.select("bag_id", "centers"), "bag_id")
    return met.groupBy("bag_id").agg(F.sum(F.array_min(F.transform("centers", _gap))).alias("cost"))


def _blocks(pts: DataFrame, sizes: DataFrame, dim: int) -> DataFrame:
    """(bag_id, ids, features) of the bags in sizes (bag_id, _n): some thousand points of one bag by their ids, with all their features in one array; a written table.

    Tasks get pieces of bags, as many as there are points for: a file of few bytes would be read by one task alone.
    """
    most = max(1, min(BLOCK, NUMBERS // dim))
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    tasks = max(1, min(2 * pts.sparkSession.sparkContext.defaultParallelism, n // BLOCK), n * dim // TASK)
    rows = pts.select("bag_id", "point_id", F.col("features").cast("array<double>").alias("features")).join(sizes, "bag_id")
    pieces = rows.withColumn("_piece", F.pmod(F.xxhash64("point_id", "features"), F.ceil(F.col("_n") * 2 / most)))
    dealt = pieces.repartition(tasks, "bag_id", "_piece").sortWithinPartitions("bag_id", "point_id").select("bag_id", "point_id", "features")

    def run(batches):
        for batch in batches:
            bag, points = batch.column("bag_id"), batch.column("features")
            x = points.flatten()
            if points.null_count or x.null_count:
                raise ValueError("points to condense must not have null features")
            first = np.ones(len(batch), bool)
            first[1:] = pc.not_equal(bag[1:], bag[:-1]).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(first)
            start = np.concatenate([np.arange(lo, hi, most) for lo, hi in zip(start, [*start[1:], len(batch)])]) if len(start) else start
            ends = np.append(start, len(batch))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), batch.column("point_id"))
            yield pa.RecordBatch.from_arrays([bag.take(pa.array(start)), ids, pa.ListArray.from_arrays(pa.array(ends * dim, pa.int32()), x)], ["bag_id", "ids", "features"])

    bag, point = (pts.schema[c].dataType.simpleString() for c in ("bag_id", "point_id"))
    return checkpointed(dealt.mapInArrow(run, f"bag_id {bag}, ids array<{point}>, features array<double>"))


def _matrix(column: pa.Array, i: int, dim: int) -> np.ndarray:
    """Row i of a column of arrays, or of arrays of arrays, with dim numbers a line."""
    x = column[i].values
    return (x.flatten() if pa.types.is_list(x.type) else x).to_numpy(zero_copy_only=False).reshape(-1, dim)


def _gaps(x: np.ndarray, centers: np.ndarray):
    """(first line, squared distances of some lines of x to the centers), added up in the order of the dimensions as in `_gap`."""
    step = max(1, AT_ONCE // len(centers))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        far = np.zeros((len(part), len(centers)))
        for i in range(x.shape[1]):
            far += (part[:, i, None] - centers[:, i]) ** 2
        yield lo, far


def _least(far: np.ndarray) -> np.ndarray:
    """The place of the least number of each line, the first of equals; what isn't a number is more than all others."""
    odd = np.isnan(far)
    if not odd.any():
        return far.argmin(1)
    at = np.where(odd, np.inf, far).argmin(1)
    return np.where(odd[np.arange(len(far)), at], (~odd).argmax(1), at)


def _assigned(blocks: DataFrame, centers: DataFrame, dim: int) -> DataFrame:
    """(bag_id, run, code, n, cost, total): of the points of a block nearest to a center (bag_id, run, centers) the number, squared distances and sum."""

    def run(batches):
        for batch in batches:
            row, code, n, gaps, total = [], [], [], [], []
            for i in range(batch.num_rows):
                x, c = _matrix(batch.column("features"), i, dim), _matrix(batch.column("centers"), i, dim)
                near, least = np.empty(len(x), np.int64), np.empty(len(x))
                for lo, far in _gaps(x, c):
                    at = _least(far)
                    near[lo : lo + len(far)], least[lo : lo + len(far)] = at, far[np.arange(len(far)), at]
                count = np.bincount(near, minlength=len(c))
                some = np.flatnonzero(count)
                row.append(np.full(len(some), i)), code.append(some), n.append(count[some]), gaps.append(np.bincount(near, least, len(c))[some])
                total.append(np.stack([np.bincount(near, x[:, j], len(c)) for j in range(dim)], 1)[some])
            if not row:
                continue
            at, sums = pa.array(np.concatenate(row)), np.concatenate(total)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * dim, pa.int32()), pa.array(sums.ravel()))
            found = [pa.array(np.concatenate(code), pa.int32()), pa.array(np.concatenate(n)), pa.array(np.concatenate(gaps)), lists]
            yield pa.RecordBatch.from_arrays([batch.column("bag_id").take(at), batch.column("run").take(at), *found], ["bag_id", "run", "code", "n", "cost", "total"])

    met = blocks.select("bag_id", "features").join(centers.select("bag_id", "run", "centers"), "bag_id")
    return met.mapInArrow(run, f"bag_id {blocks.schema['bag_id'].dataType.simpleString()}, run int, code int, n long, cost double, total array<double>")


def _lloyd(blocks: DataFrame, centers: DataFrame, rounds: int, dim: int) -> DataFrame:
    """(bag_id, run, centers) after that many rounds, or when none moves; the table of the centers given is deleted."""
    key = ["bag_id", "run"]
    state = centers.withColumn("moved", F.lit(True))
    for _ in range(rounds):
        moving = state.where("moved")
        sums = _assigned(blocks, moving, dim).groupBy(*key, "code").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.element_at("total", i + 1)) for i in range(dim))).alias("total"))
        means = sums.select(*key, "code", F.transform("total", lambda x: x / F.col("n")).alias("mean"))
        new = means.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("code", "mean"))).alias("by_code")).join(moving, key)
        new = new.select(*key, F.transform("centers", lambda c, i: F.coalesce(F.element_at("by_code", i), c)).alias("centers"), F.col("centers").alias("was"))
        new = new.select(*key, "centers", (F.col("centers") != F.col("was")).alias("moved"))
        was, state = state, checkpointed(new.unionByName(state.where(~F.col("moved"))))
        moved = not state.where("moved").isEmpty()
        dropped(was)
        if not moved:
            break
    return state.select(*key, "centers")


def _oversampled(blocks: DataFrame, k: int, seed: int, runs: int, dim: int, passes: int = 4) -> DataFrame:
    """(bag_id, run, centers): k seeds of each bag and run, for all of them at once; a written table.

    From one point on, each pass draws about 2k points of every bag, each by its share of the cost that the points drawn before
    leave. The points drawn are weighted by how many others are nearest to them, and k of these some 2k * passes are
    chosen within one row of the bag. Draws come from hashes of ids and seed + run, so they don't change. The cost of a bag is no less
    than that of one of its blocks, so a block gives away about 2k points alone, among which those drawn by the cost of the bag are.
    """
    key, kind = ["bag_id", "run"], {c: blocks.schema[c].dataType for c in ("bag_id", "ids")}

    def draws(batches):
        for batch in batches:
            row, part, far, at = [], [], [], []
            starts = batch.column("ids").offsets.to_numpy()
            for i in range(batch.num_rows):
                c, unit = _matrix(batch.column("centers"), i, dim), batch.column("units")[i].values.to_numpy()
                if not len(c):
                    row.append([i]), part.append([None]), far.append([None]), at.append([starts[i] + unit.argmin()])
                    continue
                gaps = np.concatenate([np.fmin.reduce(f, 1) for _, f in _gaps(_matrix(batch.column("features"), i, dim), c)])
                whole = gaps.sum()
                some = np.flatnonzero(unit * whole < 2 * k * gaps)
                # The first row has the sum and no point.
                row.append([i] * (len(some) + 1)), part.append([whole] + [None] * len(some)), far.append([None, *gaps[some]]), at.append([None, *(starts[i] + some)])
            rows, part, far, at = (pa.array([v for x in y for v in x], t) for y, t in ((row, pa.int64()), (part, pa.float64()), (far, pa.float64()), (at, pa.int64())))
            points = pa.FixedSizeListArray.from_arrays(batch.column("features").values, dim).cast(pa.list_(pa.float64()))
            found = [part, batch.column("units").values.take(at), far, batch.column("ids").values.take(at), points.take(at)]
            yield pa.RecordBatch.from_arrays([batch.column("bag_id").take(rows), batch.column("run").take(rows), *found], ["bag_id", "run", "part", "unit", "far", "point_id", "features"])

    unit = lambda n: lambda i: F.pmod(F.xxhash64("bag_id", i, F.col("run") + F.lit(seed), F.lit(n)), F.lit(1 << 40)) / float(1 << 40)
    none = F.array().cast("array<array<double>>")
    drawn = checkpointed(blocks.select("bag_id").distinct().select("bag_id", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), none.alias("centers")))
    for n in range(passes + 1):
        met = blocks.join(drawn, "bag_id").withColumn("units", F.transform("ids", unit(n)))
        found = checkpointed(met.mapInArrow(draws, f"bag_id {kind['bag_id'].simpleString()}, run int, part double, unit double, far double, point_id {kind['ids'].elementType.simpleString()}, features array<double>"))
        if n == 0:
            more = found.groupBy(*key).agg(F.array(F.min_by("features", F.struct("unit", "point_id"))).alias("more"))
        else:
            whole = found.groupBy(*key).agg(F.sum("part").alias("whole"))
            some = found.join(whole, key).where(F.col("unit") * F.col("whole") < F.lit(2 * k) * F.col("far"))
            more = some.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("point_id", "features"))), lambda r: r["features"]).alias("more"))
        new = drawn.join(more, key, "left").select(*key, F.concat("centers", F.coalesce("more", none)).alias("centers"))
        was, drawn = drawn, checkpointed(new)
        dropped(was, found)
    weights = _assigned(blocks, drawn, dim).groupBy(*key, "code").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("weights"))
    rows = drawn.join(weights, key).select(*key, "centers", F.transform("centers", lambda c, i: F.coalesce(F.element_at("weights", i), F.lit(0)).cast("double")).alias("weight"))

    def run(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                x, weight = np.array(r["centers"], float), np.array(r["weight"])
                draw, at, least = np.random.default_rng(seed + r["run"]), [], np.full(len(x), np.inf)
                for _ in range(k):
                    share = weight if not at else weight * least
                    share = np.where(np.isin(np.arange(len(x)), at), 0, share)
                    if not share.sum():
                        share = (~np.isin(np.arange(len(x)), at)).astype(float)
                    if not share.sum():
                        share = np.ones(len(x))
                    at.append(int(draw.choice(len(x), p=share / share.sum())))
                    least = np.minimum(least, ((x - x[at[-1]]) ** 2).sum(1))
                found.append(x[at].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("bag_id"), batch.column("run"), pa.array(found, pa.list_(pa.list_(pa.float64())))], ["bag_id", "run", "centers"])

    chosen = checkpointed(rows.mapInArrow(run, f"bag_id {kind['bag_id'].simpleString()}, run int, centers array<array<double>>"))
    dropped(drawn)
    return chosen


def _first(blocks: DataFrame, k: int, dim: int) -> DataFrame:
    """(bag_id, run, centers): the k points of each bag with the smallest ids, by rank among those of its blocks; one run, 0."""
    from pyspark.sql import Window as W

    point = lambda i: F.struct(F.element_at("ids", i).alias("point_id"), F.slice("features", (i - 1) * dim + 1, dim).alias("features"))
    some = blocks.select("bag_id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("ids"), F.lit(k))), point)).alias("r")).select("bag_id", "r.*")
    few = some.withColumn("_r", F.row_number().over(W.partitionBy("bag_id").orderBy("point_id"))).where(F.col("_r") <= k)
    rows = F.sort_array(F.collect_list(F.struct("point_id", "features")))
    return few.groupBy("bag_id").agg(F.transform(rows, lambda r: r["features"]).alias("centers")).select("bag_id", F.lit(0).alias("run"), "centers")


def codewords(pts: DataFrame, k: int, rounds: int = 100, seed: int = 0) -> np.ndarray:
    """Centers of a global k-means over all points, by Spark's own; more centers than points are an error."""
    if pts.limit(k).count() < k:
        raise ValueError(f"{k} codewords need as many points")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    return np.array(KMeans(k=k, maxIter=rounds, seed=seed).fit(pts.select(array_to_vector("features").alias("features"))).clusterCenters())


def bag_of_words(pts: DataFrame, centers: np.ndarray) -> DataFrame:
    """(bag_id, code, n): how many points of a bag are nearest to each center, the first of equals."""
    if len(centers) < 1:
        raise ValueError("there must be a center")
    gap = lambda c: _total(F.zip_with("features", F.array(*map(F.lit, c.tolist())), lambda a, b: (a - b) * (a - b)))
    gaps = F.array(*(gap(c) for c in centers))
    coded = pts.withColumn("_gaps", gaps).withColumn("code", F.array_position("_gaps", F.array_min("_gaps")) - 1)
    return coded.groupBy("bag_id", "code").agg(F.count("*").alias("n"))


def sample_bags(df: DataFrame, category: str, name: str, n: int, how: str = "first", seed: int = 0) -> DataFrame:
    """At most n rows of each category: the first by name, evenly spaced ones, or random ones."""
    from pyspark.sql import Window as W

    order = F.xxhash64(name, F.lit(seed)) if how == "random" else F.col(name)
    out = df.withColumn("_i", F.row_number().over(W.partitionBy(category).orderBy(order, name)) - 1)
    if how != "uniform":
        return out.where(F.col("_i") < n).drop("_i")
    out = out.withColumn("_n", F.count("*").over(W.partitionBy(category)))
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (F.col("_n") - 1) / F.lit(max(1, n - 1))).cast("int"))
    return out.where((F.col("_n") <= n) | F.array_contains(spots, F.col("_i"))).drop("_i", "_n")
