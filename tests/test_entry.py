import duckdb
import pytest

from bagdiv import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Bags of customers have 43 points at least; at sf0.001 some have 3, too few for K = 3.
SF = "/root/testdata/sf0.01"
#: At sf0.001 some bags have no more points than centers are asked for.
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "sf"), [*((name, SF) for name in queries.oracle_sql()), ("condense_one_round", SMALL), ("bag_stats", SMALL), ("sample_uniform", SMALL)])
def test_against_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    names = sorted(df.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    want = con.execute(f"select {', '.join(names)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(want, key=key)
