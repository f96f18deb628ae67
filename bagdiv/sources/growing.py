"""A matrix of divergences that grows: new bags cost the pairs that they are in, and nothing is computed twice.

Below one folder lie the points of the bags, what identifies each bag (size and hashes of its points), the divergences, and a row
for each batch of bags that was added. That row is written last, and only what belongs to such a batch is read, so
that an addition which fails on its way counts for nothing and can be made again.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.specs import parse
from ..operators import divergence
from ..tables import scratch

PAIR = ["p", "q", "spec", "k", "value"]


def counted(divs: DataFrame, specs: list[str], ks: list[int], write: Callable[[DataFrame], None], strict: bool = False) -> dict[tuple[str, int], dict[str, int]]:
    """Writes divergences and counts, in the same job, those that are null, not a number or infinite, by spec and K.

    Any such values give a warning, or with strict an error, after the job; null is what js gives where K is too small
    for two bags.
    """
    at = {f"c{i}_{j}": (s, k) for i, s in enumerate(specs) for j, k in enumerate(ks)}
    what = {"null": F.col("value").isNull(), "nan": F.isnan("value"), "infinite": F.abs("value") == float("inf")}
    seen = Observation(f"divergences-{uuid.uuid4().hex}")
    metrics = [F.count_if(F.coalesce((F.col("spec") == s) & (F.col("k") == k) & is_, F.lit(False))).alias(f"{c}_{name}") for c, (s, k) in at.items() for name, is_ in what.items()]
    write(divs.observe(seen, *metrics))
    got = seen.get
    found = {(s, k): bad for c, (s, k) in at.items() if (bad := {name: got[f"{c}_{name}"] for name in what if got.get(f"{c}_{name}")})}
    if found:
        said = "; ".join(f"{s} with K = {k}: {', '.join(f'{n} {name}' for name, n in bad.items())}" for (s, k), bad in found.items())
        if strict:
            raise ValueError(f"divergences that aren't finite: {said}")
        warnings.warn(f"divergences that aren't finite: {said}", stacklevel=2)
    return found


class GrowingDivergences:
    """Divergences (p, q, spec, k, value) of all bags that were added, for fixed specs, ks and min_dist."""

    def __init__(self, spark: SparkSession, path: str, specs: list[str], ks: list[int], min_dist: float | None = None, strict: bool = False):
        self.spark, self.path, self.ks, self.min_dist, self.strict = spark, path, sorted(set(ks)), min_dist, strict
        self.specs = [str(s) for s in parse(specs)]
        self.asked = f"{sorted(self.specs)} {self.ks} {min_dist}"

    def _held(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None

    def _of_batches(self, name: str, batches: set[str]) -> DataFrame | None:
        held = self._held(name) if batches else None
        return None if held is None else held.where(F.col("batch").isin(sorted(batches)))

    def batches(self) -> set[str]:
        """The batches that are complete; those of other specs, ks or min_dist are an error."""
        made = self._held("made")
        rows = [] if made is None else made.collect()
        if other := {r.asked for r in rows} - {self.asked}:
            raise ValueError(f"{self.path} holds divergences for {sorted(other)}, not for {self.asked}")
        return {r.batch for r in rows}

    @staticmethod
    def facts(pts: DataFrame) -> DataFrame:
        """(bag_id, n_pts, one, two): hashes over the points of a bag in any order."""
        of = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "point_id", "features"))
        return pts.groupBy("bag_id").agg(F.count("*").alias("n_pts"), of(1).alias("one"), of(2).alias("two"))

    def add(self, pts: DataFrame, batch: str | None = None) -> int:
        """Adds the bags of points (bag_id, point_id, features) that aren't there yet; gives their number.

        Bags that are there must have the same points, in any order. A batch with a name that is there already does nothing, so
        a repeated call is safe. Every K must be below the size of every bag.
        """
        done = self.batches()
        batch = batch or uuid.uuid4().hex
        if batch in done:
            return 0
        pts = pts.select("bag_id", "point_id", "features")
        facts, known = self.facts(pts), self._of_batches("bags", done)
        if known is not None:
            was = known.select("bag_id", F.col("n_pts").alias("n"), F.col("one").alias("a"), F.col("two").alias("b"))
            other = facts.join(was, "bag_id").where("n_pts <> n or one <> a or two <> b")
            if rows := other.limit(5).collect():
                raise ValueError(f"bags that are there with other points: {[r.bag_id for r in rows]}")
            facts = facts.join(known.select("bag_id"), "bag_id", "left_anti")
        named = lambda df: df.withColumn("batch", F.lit(batch))
        put = lambda df, name, *by: df.write.mode("append").partitionBy("batch", *by).parquet(f"{self.path}/{name}")
        put(named(facts), "bags")
        new = self._of_batches("bags", {batch})
        n = 0 if new is None else new.count()
        if n:
            put(named(pts.join(new.select("bag_id"), "bag_id", "left_semi")), "points")
            points = self._of_batches("points", done | {batch}).select("bag_id", "point_id", "features")
            with scratch(self.spark):
                divs = divergence.estimate_divs(points, self.specs, self.ks, self.pairs(new, done | {batch}), self.min_dist)
                counted(divs.select(*PAIR), self.specs, self.ks, lambda df: put(named(df), "divs", "spec", "k"), self.strict)
            self.spark.createDataFrame([(batch, self.asked, n)], "batch string, asked string, bags long").write.mode("append").parquet(f"{self.path}/made")
        return n

    def pairs(self, new: DataFrame, batches: set[str]) -> DataFrame:
        """(p, q) with a new bag on one side at least: as many rows as divergences will be added for each spec and K."""
        every = self._of_batches("bags", batches).select(F.col("bag_id").alias("q"))
        one = new.select(F.col("bag_id").alias("p")).crossJoin(every)
        return one.union(one.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()

    def divs(self) -> DataFrame:
        """All divergences so far."""
        held = self._of_batches("divs", self.batches())
        if held is None:
            raise ValueError(f"no bags in {self.path}")
        return held.select("p", "q", F.col("spec").cast("string").alias("spec"), F.col("k").cast("int").alias("k"), "value")

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Adds the bags of a stream of points, micro-batch by micro-batch; every bag must come whole within one.

        A micro-batch that is repeated after a failure is known by its number.
        """

        def on_batch(pts: DataFrame, number: int) -> None:
            self.add(pts, f"stream-{number}")

        writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
