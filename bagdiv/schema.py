"""Bags of vectors as tables: points (bag_id, point_id, features) and bags (bag_id, category, name, n_pts, …)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def points(df: DataFrame, bag: str, point: str, features) -> DataFrame:
    """Points of a table; features is a column of numbers or an array of them."""
    return df.select(F.col(bag).alias("bag_id"), F.col(point).cast("long").alias("point_id"), F.transform(features, lambda x: x.cast("double")).alias("features"))


def from_matrix(spark: SparkSession, rows: np.ndarray, n_pts: list[int]) -> DataFrame:
    """Points of bags 0, 1, … that lie below each other in one matrix on the driver, n_pts rows for each."""
    rows, counts = np.asarray(rows, float), np.asarray(n_pts)
    if rows.ndim != 2 or rows.shape[1] < 1:
        raise ValueError(f"a matrix of points is expected, not an array of shape {rows.shape}")
    if counts.ndim != 1 or (counts < 1).any() or (counts != np.rint(counts)).any() or counts.sum() != len(rows):
        raise ValueError(f"numbers of points must be positive whole numbers with the sum {len(rows)}")
    counts = counts.astype(int)
    first = np.cumsum(counts) - counts
    bag = np.repeat(np.arange(len(counts)), counts)
    table = pa.table({"bag_id": bag, "point_id": np.arange(len(rows)) - first[bag], "features": pa.FixedSizeListArray.from_arrays(rows.ravel(), rows.shape[1]).cast(pa.list_(pa.float64()))})
    return spark.createDataFrame(table)


def from_bags(spark: SparkSession, arrays: list[np.ndarray]) -> DataFrame:
    """Points of bags 0, 1, …, each an array of points on the driver; a vector is a bag of one point."""
    arrays = [np.atleast_2d(np.asarray(a, float)) for a in arrays]
    if len({a.shape[1] for a in arrays}) != 1:
        raise ValueError("one bag at least, and all of one dimension, are expected")
    return from_matrix(spark, np.concatenate(arrays), [len(a) for a in arrays])


def bags(pts: DataFrame) -> DataFrame:
    return pts.groupBy("bag_id").agg(F.count("*").alias("n_pts"))


def dimension(pts: DataFrame) -> int:
    """The one length of all features; anything else is an error."""
    low, high = pts.agg(F.min(F.size("features")), F.max(F.size("features"))).first()
    if low is None or low != high or low < 1:
        raise ValueError(f"features must have one length, not {low} to {high}")
    return int(low)


def numbered(df: DataFrame) -> DataFrame:
    """bags (category, name, …) with a bag_id by (category, name), which must be unique."""
    if df.groupBy("category", "name").count().where("count > 1").limit(1).count():
        raise ValueError("(category, name) must be unique")
    return df.withColumn("bag_id", F.row_number().over(W.orderBy("category", "name")).cast("long"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both collections with the columns that they have in common."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(*common).unionByName(b.select(*common))


def with_extra(bag_table: DataFrame, extra: DataFrame, default=None) -> DataFrame:
    """bags with further columns of a table by bag_id; a name that is there already is an error."""
    new = [c for c in extra.columns if c != "bag_id"]
    if clash := set(new) & set(bag_table.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    out = bag_table.join(extra, "bag_id", "left")
    return out if default is None else out.fillna({c: default for c in new})


def text_of(category: Column) -> Column:
    """A category as text: whole numbers without a fraction, whatever their type was."""
    real = category.try_cast("double")
    whole = real.isNotNull() & (F.abs(real) < 1e15) & (real == F.floor(real))
    return F.when(whole, real.cast("long").cast("string")).otherwise(category.cast("string"))


def relabelled(df: DataFrame, own: str, other: str) -> DataFrame:
    """(own, other): which category of one column is which of another, as text; an error if two of one go with one of the other.

    Each side is one grouped count of the distinct pairs, so it costs no more than a distinct. Rows with a null on either side
    say nothing.
    """
    met = df.select(text_of(F.col(own)).alias("own"), text_of(F.col(other)).alias("other")).where("own is not null and other is not null").distinct()
    for side, back in (("own", "other"), ("other", "own")):
        if rows := met.groupBy(side).agg(F.count("*").alias("n"), F.min(back).alias("one"), F.max(back).alias("two")).where("n > 1").orderBy(side).limit(3).collect():
            raise ValueError(f"categories aren't the same up to their names: {[(r[0], r.one, r.two) for r in rows]}")
    return met
