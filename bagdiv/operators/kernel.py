"""From divergences to kernels: a column expression, a median, and repairs of the collected Gram matrix (one row per bag)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Cells of a histogram, values that are few enough to be sorted on the driver, and bags of a collected matrix at most.
CELLS, FEW, BAGS = 4096, 4096, 10_000


def median(df: DataFrame, column: str) -> float | None:
    """The exact median of a column's numbers, without null and NaN; None if there are none.

    Values are counted in cells between the least and the largest, and the cell that the median falls in is cut again, until few
    values are left; so nothing but counts is gathered, where an aggregate for exact percentiles keeps all different values in
    one task. Each round reads the table once.
    """
    x = F.col(column).cast("double")
    held = df.select(x.alias("x")).where("x is not null and not isnan(x)")
    inf = float("inf")
    n, below, finite, low, high = held.agg(F.count("*"), F.count_if(F.col("x") == -inf), F.count_if(F.abs("x") < inf), F.min(F.when(F.abs("x") < inf, F.col("x"))), F.max(F.when(F.abs("x") < inf, F.col("x")))).first()
    if not n:
        return None
    found = [-inf if at < below else inf if at >= below + finite else _ranked(held, at - below, finite, low, high) for at in sorted({(n - 1) // 2, n // 2})]
    return sum(found) / len(found)


def _ranked(held: DataFrame, at: int, n: int, low: float, high: float) -> float:
    """The value of a rank, from 0, among the n values from low to high."""
    while low < high:
        inside = held.where(F.col("x").between(low, high))
        if n <= FEW:
            return sorted(r.x for r in inside.collect())[at]
        cell = F.least(F.floor((F.col("x") / 2 - low / 2) / (high / 2 - low / 2) * CELLS), F.lit(CELLS - 1))
        for r in sorted(inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()):
            if at < r.n:
                n, low, high = r.n, r.low, r.high
                break
            at -= r.n
    return low


def median_positive(divs: DataFrame) -> float:
    value = median(divs.where("value > 0"), "value")
    if value is None:
        raise ValueError("no divergence is positive")
    return value


def symmetrize(divs: DataFrame) -> DataFrame:
    """The mean of both directions, for pairs that have both; null where one of them is. Both meet in one aggregate, so
    divergences are computed once even where they aren't written."""
    keys = [c for c in divs.columns if c not in ("p", "q", "value")]
    both = divs.groupBy(F.least("p", "q").alias("_a"), F.greatest("p", "q").alias("_b"), *keys).agg(F.sum("value").alias("_sum"), F.count("value").alias("_known"), F.count("*").alias("_n"))
    both = both.where("_a = _b or _n = 2")
    ends = F.when(F.col("_a") == F.col("_b"), F.array(F.struct(F.col("_a").alias("p"), F.col("_b").alias("q")))).otherwise(F.array(F.struct(F.col("_a").alias("p"), F.col("_b").alias("q")), F.struct(F.col("_b").alias("p"), F.col("_a").alias("q"))))
    value = F.when(F.col("_known") == F.col("_n"), F.col("_sum") / F.col("_n")).alias("value")
    return both.select(F.explode(ends).alias("_e"), *keys, value).select("_e.p", "_e.q", *keys, "value")


def rbf(divs: DataFrame, sigma: float | None) -> DataFrame:
    """Null without a sigma."""
    s = F.lit(sigma).cast("double")
    return divs.withColumn("value", F.exp(-F.col("value") * F.col("value") / (2 * s * s)))


def matrix(divs: DataFrame, ids: list) -> np.ndarray:
    """Values by the places of p and q among ids, NaN where there is none; more than BAGS bags are an error."""
    if len(ids) > BAGS:
        raise ValueError(f"a matrix is collected for {BAGS} bags at most, not for {len(ids)}")
    at, out = {b: i for i, b in enumerate(ids)}, np.full((len(ids), len(ids)), np.nan)
    table = divs.select("p", "q", F.col("value").cast("double").alias("value")).toArrow()
    p, q = (np.array([at.get(b, -1) for b in table.column(c).to_pylist()], int) for c in ("p", "q"))
    known = (p >= 0) & (q >= 0)
    out[p[known], q[known]] = table.column("value").to_numpy()[known]
    return out


def repair(gram: np.ndarray, how: str = "clip", least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(positive semi-definite Gram matrix, T): rows of a test kernel times T match it."""
    s = (gram + gram.T) / 2
    if how == "identity":
        return gram, np.eye(len(s))
    if how == "square":
        return s @ s.T, s.T
    values, v = np.linalg.eigh(s)
    if how in ("clip", "project"):
        return (v * np.maximum(values, least)) @ v.T, (v * (values > 0)) @ v.T
    if how == "flip":
        return (v * np.abs(values)) @ v.T, (v * np.sign(values)) @ v.T
    if how == "shift":
        return s + max(0.0, least - values[0]) * np.eye(len(s)), np.eye(len(s))
    raise ValueError(f"unknown repair {how!r}")
