"""Counts of keys over all documents, and the most frequent keys within a stated bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def above_cutoff(counts: DataFrame, most: int, least: int = 1) -> DataFrame:
    """Rows of counts (…, n) whose n reaches the smallest cutoff that at most `most` rows reach.

    The cutoff comes from a histogram of the counts, of which only the few values that can matter
    reach the driver; so neither a sort of all keys nor one large task is needed.
    """
    levels = counts.where(F.col("n") >= least).groupBy(F.least("n", F.lit(1 << 14)).alias("n")).agg(F.count("*").alias("rows")).collect()
    cutoff, room = 1 << 14, most
    for n, rows in sorted(levels, reverse=True):
        if rows > room:
            break
        room -= rows
        cutoff = n
    else:
        cutoff = least
    kept = counts.where(F.col("n") >= cutoff)
    return kept if cutoff < 1 << 14 else kept.orderBy(F.desc("n")).limit(most)
