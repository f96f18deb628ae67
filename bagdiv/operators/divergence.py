"""Divergences between all bags, from nearest-neighbour distances.

All specs and all K share one neighbour pass. It leaves additive sums per pair of bags, which one aggregate adds up,
a row for each pair and K, and from which column expressions make the divergences. Those that need both directions join
these rows with their transpose, for which they are written once; others are written only where the caller writes them.
Pairs that nobody asked for are not computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import specs as S
from ..tables import checkpointed
from .knn import Shape, by_pair, merged, near, shape


def js_terms(rho: np.ndarray, nu: np.ndarray, k: int, dim: int, n: int, m: int) -> np.ndarray:
    """d ln r - psi(N) of each point. Weights are whole numbers, so a neighbour on the threshold counts for certain."""
    d = np.concatenate([rho, nu], axis=1)
    w = np.where(np.isinf(d), 0, np.concatenate([np.full(rho.shape[1], m), np.full(nu.shape[1], n)])[None])
    order = np.argsort(d, axis=1, kind="stable")
    d, w = np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1)
    inside = (np.cumsum(w, axis=1) * (n + m - 1) <= k * m * (2 * n - 1)) & np.isfinite(d)
    count = inside.sum(1)
    table = np.array([math.nan, *(S.psi(i) for i in range(1, d.shape[1] + 1))])
    r = d[np.arange(len(d)), np.maximum(count - 1, 0)]
    return dim * np.log(r) - table[count]


def _of_points(stat: str, k: int, dim: int, own: bool, rho: np.ndarray, nu: np.ndarray, n: int, m: int) -> tuple[str, np.ndarray]:
    """(name of the sum, its terms) for the points of a chunk."""
    a, b = rho[:, k - 1], nu[:, k - 1]
    if stat == "linear":
        return stat, b**-dim
    if stat == "kl":
        return stat, np.log(b) - np.log(a)
    if stat.startswith("mix:"):
        r = a if own else np.sort(np.concatenate([rho[:, :k], nu[:, :k]], axis=1), axis=1)[:, k - 1]
        return stat, r ** (dim * (1 - float(stat[4:])))
    if stat == "js-core":
        return ("log-rho", np.log(a)) if own else (stat, js_terms(rho, nu, k, dim, n, m))
    return stat, (a / b) ** (dim * (1 - float(stat[6:])))


def _sums(bases: list[str], ks: list[int], dim: int, width: int, least: float):
    """Rows of `near` -> (p, q, n, m, stat, k, total) over a chunk's points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rho, kind, out = np.zeros((0, width)), None, []

        def batch_of() -> pa.RecordBatch:
            types = (kind, kind, pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], ["p", "q", "n", "m", "stat", "k", "total"])

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("p").type
                yield batch

        for (p, _, q), rows in by_pair(noted()):
            nu = merged([(r["width"], r["near"]) for r in rows], width, least)
            if p == q:
                rho = nu
            n, m = rows[0]["n"], rows[0]["m"]
            with np.errstate(all="ignore"):
                for k in ks:
                    for stat in bases:
                        name, terms = _of_points(stat, k, dim, p == q, rho, nu, n, m)
                        out.append((p, q, n, m, name, k, float(terms.sum())))
            if len(out) > 10_000:
                yield batch_of()
                out = []
        if out:
            yield batch_of()

    return run


def _chunk_sums(pts: DataFrame, bases: list[str], ks: list[int], least: float | None, of: Shape, pairs: DataFrame | None) -> DataFrame:
    """(p, q, n, m, stat, k, total): sums over the points of a chunk of p, for every pair of bags (or those in pairs), p = q included."""
    least = S.min_dist(of.dim) if least is None else least
    most = max(ks)
    if min(ks) < 1 or most >= of.smallest:
        raise ValueError(f"K must be from 1 to less than the smallest bag, which has {of.smallest} points")
    width = 2 * most + 1 if "js-core" in bases else most
    kind = pts.schema["bag_id"].dataType.simpleString()
    return near(pts, width, of, pairs).mapInArrow(_sums(bases, ks, of.dim, width, least), f"p {kind}, q {kind}, n long, m long, stat string, k int, total double")


def base_sums(pts: DataFrame, bases: list[str], ks: list[int], least: float | None = None, of: Shape | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(p, q, n, m, stat, k, total): sums over the points of p, for every pair of bags (or those in pairs), p = q included; a written table."""
    sums = _chunk_sums(pts, bases, ks, least, of or shape(pts), pairs)
    return checkpointed(sums.groupBy("p", "q", "n", "m", "stat", "k").agg(F.sum("total").alias("total")))


def _by_k(ks: list[int], of) -> Column:
    out = F.when(F.col("k") == ks[0], F.lit(of(ks[0])))
    for k in ks[1:]:
        out = out.when(F.col("k") == k, F.lit(of(k)))
    return out


def estimate_divs(pts: DataFrame, specs: list[str], ks: list[int], pairs: DataFrame | None = None, min_dist: float | None = None) -> DataFrame:
    """points (bag_id, point_id, features) -> (p, q, spec, k, value), the divergence of bag p from bag q.

    pairs (p, q) restricts the neighbour pass to these (and their transposes, where a spec needs them), a column split in
    the points to pairs of bags of different splits; each bag meets itself. K must be below the size of every bag.
    js is null where K is too small for the sizes of the two bags.
    """
    wanted = S.parse(specs)
    bases = sorted(frozenset().union(*(s.bases for s in wanted)))
    of = shape(pts)
    dim, asked = of.dim, pairs
    if pairs is not None:
        asked = pairs.select("p", "q")
        asked = asked.union(asked.select("q", "p")) if any(s.transposed for s in wanted) else asked
    sums = _chunk_sums(pts, bases, ks, min_dist, of, asked)
    same, n, m = F.col("p") == F.col("q"), F.col("n"), F.col("m")
    stats = [*bases, *(["log-rho"] if "js-core" in bases else [])]
    name = lambda s: s.replace(":", "_").replace(".", "_").replace("-", "_")
    added = sums.groupBy("p", "q", "n", "m", "k").agg(*(F.sum(F.when(F.col("stat") == s, F.col("total"))).alias(name(s)) for s in stats))

    def base(s: str) -> Column:
        mean = F.col(name(s)) / n
        if s == "linear":
            return _by_k(ks, lambda k: S.density_constant(k, dim)) / F.when(same, n).otherwise(m) * mean
        if s == "kl":
            return F.when(same, F.lit(0.0)).otherwise(F.lit(dim) * mean + F.log(m / (n - 1)))
        if s.startswith("alpha:"):
            a = float(s[6:])
            one = _by_k(ks, lambda k: S.alpha_constant(k, a)) * F.pow((n - 1) / m, F.lit(1 - a)) * mean
            return F.when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), one))
        return mean

    wide = added.select("p", "q", "n", "m", "k", *(base(s).alias(name(s)) for s in stats))
    if any(s.transposed for s in wanted):
        wide = checkpointed(wide)
    if "linear" in bases and any(s.name == "l2" for s in wanted):
        # The self value divides by n; the integral of p squared divides by n - 1.
        own = wide.where(same).select(F.col("p").alias("_b"), F.col("k").alias("_k"), (F.col("linear") * n / (n - 1)).alias("_q"))
        for side in ("p", "q"):
            part = own.select(F.col("_b").alias(side), F.col("_k").alias("k"), F.col("_q").alias(f"quadratic_{side}"))
            wide = wide.join(part, [side, "k"])
        back = wide.select(F.col("q").alias("p"), F.col("p").alias("q"), "k", F.col("linear").alias("linear_back"))
        wide = wide.join(back, ["p", "q", "k"])
    if any(s.transposed and s.name != "l2" for s in wanted):
        own = wide.where(same).select(F.col("p").alias("_b"), F.col("k").alias("_k"), (F.lit(dim) * F.col("log_rho") + F.log(n - 1)).alias("_bit"))
        for side in ("p", "q"):
            wide = wide.join(own.select(F.col("_b").alias(side), F.col("_k").alias("k"), F.col("_bit").alias(f"bit_{side}")), [side, "k"])
        wide = wide.join(wide.select(F.col("q").alias("p"), F.col("p").alias("q"), "k", F.col("js_core").alias("js_core_back")), ["p", "q", "k"])
    js = F.when(F.col("p") == F.col("q"), F.lit(0.0)).otherwise(0.5 * (_known("js_core") + _known("js_core_back") - _known("bit_p") - _known("bit_q")) + F.log(F.col("n") + F.col("m") - 1) + _by_k(ks, S.psi)) if any(s.bases == {"js-core"} for s in wanted) else None

    def of(s: S.Spec) -> Column:
        if s.name in S.CUSTOM:
            parts, own = S.CUSTOM[s.name]
            return own(*(F.col(name(b)) for b in parts)).cast("double")
        a = F.col(name(f"alpha:{s.alpha}")) if s.name in S.WITH_ALPHA else None
        half = F.col("alpha_0_5") if s.name in ("bc", "hellinger") else None
        match s.name:
            case "linear":
                return F.col("linear")
            case "kl":
                return F.greatest(F.lit(0.0), F.col("kl"))
            case "kl_raw":
                return F.col("kl")
            case "alpha":
                return a
            case "bc":
                return F.least(half, F.lit(1.0))
            case "hellinger":
                return F.sqrt(F.greatest(F.lit(0.0), 1 - half))
            case "renyi":
                return F.greatest(F.lit(0.0), F.log(F.greatest(a, F.lit(S.FLOOR))) / F.lit(s.alpha - 1))
            case "tsallis":
                return (a - 1) / F.lit(s.alpha - 1)
            case "l2":
                return F.when(F.col("p") == F.col("q"), F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("quadratic_p") + F.col("quadratic_q") - F.col("linear") - F.col("linear_back"))))
            case "js-core":
                return _known("js_core")
            case "js_clamp":
                return F.least(F.lit(math.log(2)), F.greatest(F.lit(0.0), js))
            case _:
                return js

    rows = F.explode(F.array(*(F.struct(F.lit(str(s)).alias("spec"), of(s).alias("value")) for s in wanted))).alias("r")
    out = wide.select("p", "q", "k", rows).select("p", "q", "r.spec", "k", "r.value")
    return out if pairs is None else out.join(pairs.select("p", "q"), ["p", "q"], "left_semi")


def _known(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def entropy_constant(k: int, a: float, dim: int) -> float:
    return math.exp((1 - a) * (dim / 2 * math.log(math.pi) - math.lgamma(dim / 2 + 1)) + math.lgamma(k) - math.lgamma(k - a + 1))


def jensen_renyi(pts: DataFrame, alphas: list[float], ks: list[int], clamp: bool = True) -> DataFrame:
    """(p, q, alpha, k, value): Renyi entropy of the mixture of two bags less the mean of theirs; at least 0 with clamp.

    The neighbours of a point in the mixture are those in either bag. Symmetric, and 0 for p = q; null for bags of
    different sizes, for whose mixture the estimator isn't defined.
    """
    of = shape(pts)
    dim = of.dim
    sums = base_sums(pts, [f"mix:{a}" for a in alphas], ks, of=of).withColumn("alpha", F.substring("stat", 5, 40).cast("double"))
    constant = F.lit(None).cast("double")
    for a in alphas:
        constant = F.when(F.col("alpha") == a, _by_k(ks, lambda k, a=a: entropy_constant(k, a, dim))).otherwise(constant)
    entropy = lambda total, n: F.log(constant * F.pow(n - 1, 1 - F.col("alpha")) * total / n) / (1 - F.col("alpha"))
    own = sums.where("p = q").select("p", "alpha", "k", entropy(F.col("total"), F.col("n")).alias("own"))
    back = sums.select(F.col("q").alias("p"), F.col("p").alias("q"), "alpha", "k", F.col("total").alias("back"))
    met = sums.join(back, ["p", "q", "alpha", "k"]).join(own, ["p", "alpha", "k"]).join(own.select(F.col("p").alias("q"), "alpha", "k", F.col("own").alias("other")), ["q", "alpha", "k"])
    value = entropy(F.col("total") + F.col("back"), 2 * F.col("n")) - (F.col("own") + F.col("other")) / 2
    value = F.greatest(F.lit(0.0), value) if clamp else value
    return met.select("p", "q", "alpha", "k", F.when(F.col("p") == F.col("q"), 0.0).when(F.col("n") == F.col("m"), value).alias("value"))


def bag_entropy(pts: DataFrame, alpha: float, k: int) -> DataFrame:
    """(p, value): Renyi entropy of each bag, which meets itself alone."""
    of = shape(pts)
    own = pts.select(F.col("bag_id").alias("p"), F.col("bag_id").alias("q")).distinct()
    sums = base_sums(pts, [f"mix:{alpha}"], [k], of=of, pairs=own)
    n, total, constant = F.col("n"), F.col("total"), entropy_constant(k, alpha, of.dim)
    return sums.select("p", (F.log(F.lit(constant) * F.pow(n - 1, F.lit(1 - alpha)) * total / n) / F.lit(1 - alpha)).alias("value"))
