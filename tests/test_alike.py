"""Bags between which no divergence is positive: large bags of few values, which hold each other's values."""

import duckdb
import numpy as np
import pytest

from bagdiv import queries
from bagdiv.operators import kernel, machines


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """25 nations of the same balances."""
    folder = str(tmp_path_factory.mktemp("alike"))
    duckdb.sql(f"copy (select range as c_custkey, (range % 25)::int as c_nationkey, (range // 25)::double as c_acctbal from range(25 * 12)) to '{folder}/customer.parquet'")
    return folder


@pytest.mark.parametrize("name", ["symmetrize", "median_sigma", "rbf_kernel"])
def test_alike_against_sql(spark, alike, name):
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{alike}/customer.parquet'")
    df = queries.queries()[name](spark, alike)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_kernel_of_alike_bags_is_one(spark, alike):
    rows = queries.queries()["psd_clip"](spark, alike).collect()
    assert {(r.p, r.q) for r in rows} == {(a, b) for a in range(25) for b in range(25)} and len(rows) == 625
    assert np.allclose([r.value for r in rows], 1)


@pytest.mark.parametrize(("name", "bags"), [("svc_predictions", range(15, 25)), ("svc_cv_predictions", range(25))])
def test_machines_of_alike_bags_predict(spark, alike, name, bags):
    rows = queries.queries()[name](spark, alike).collect()
    assert sorted(r.bag_id for r in rows) == [*bags] and {r.pred for r in rows} <= {0, 1}


def test_no_scale_where_divergences_are_negative_or_unknown():
    assert machines.sigma_scale(np.zeros((3, 3))) == 1 and machines.sigma_scale(np.array([[0, 2.0], [4.0, np.nan]])) == 3
    for value in (-1.0, np.nan):
        with pytest.raises(ValueError, match="no divergence"):
            machines.sigma_scale(np.array([[0, value], [value, 0]]))


def test_kernel_without_sigma_is_null(spark):
    assert kernel.rbf(spark.createDataFrame([(0.0,)], "value double"), None).first().value is None
