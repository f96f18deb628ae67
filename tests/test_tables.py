"""Written tables and who deletes them."""

import os

import pytest
from pyspark.sql import functions as F

from bagdiv import tables
from bagdiv.operators import divergence
from bagdiv.sources import files, growing


def held(spark) -> set[str]:
    folder = tables.checkpoint_folder(spark).removeprefix("file:")
    return {name for name in os.listdir(folder) if name.startswith("table-")}


def points(spark, bags: int):
    return spark.range(bags * 12).select((F.col("id") % bags).alias("bag_id"), F.col("id").alias("point_id"), F.array(F.sin(F.col("id") * 7), F.cos(F.col("id") * 3)).alias("features"))


def test_scratch_owns_its_tables_and_no_others(spark):
    before = held(spark)
    outer = tables.checkpointed(spark.range(5))
    with tables.scratch(spark):
        one = tables.checkpointed(spark.range(3))
        with tables.scratch(spark):
            two = tables.checkpointed(one.where("id > 0"))
            assert two.count() == 2 and len(held(spark) - before) == 3
        assert one.count() == 3 and len(held(spark) - before) == 2
    assert outer.count() == 5 and len(held(spark) - before) == 1
    tables.dropped(outer)
    assert held(spark) == before


def test_scratch_deletes_after_an_error_and_what_is_gone_is_none(spark):
    before = held(spark)
    with pytest.raises(ZeroDivisionError), tables.scratch(spark):
        tables.dropped(tables.checkpointed(spark.range(3)))
        tables.checkpointed(spark.range(4))
        _ = 1 // 0
    assert held(spark) == before
    tables.checkpointed(spark.range(2))
    assert len(held(spark) - before) == 1


def test_results_that_are_written_leave_no_table_behind(spark, tmp_path):
    before, pts = held(spark), points(spark, 4)
    want = {(r.p, r.q, r.spec): r.value for r in divergence.estimate_divs(pts, ["l2", "js"], [2]).collect()}
    between = held(spark)
    assert len(between - before) == 1
    got = files.DivergenceCache(spark, str(tmp_path / "cache")).get(pts, ["l2", "js"], [2])
    assert {(r.p, r.q, r.spec): r.value for r in got.collect()} == pytest.approx(want)
    grown = growing.GrowingDivergences(spark, str(tmp_path / "grown"), ["l2", "js"], [2])
    grown.add(pts.where("bag_id < 3"))
    grown.add(pts)
    assert {(r.p, r.q, r.spec): r.value for r in grown.divs().collect()} == pytest.approx(want)
    assert held(spark) == between
