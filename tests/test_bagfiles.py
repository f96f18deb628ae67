"""Files of bags: splits, filters that pass over values, writing all or nothing, extras of every form."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from bagdiv.sources import bagfiles, files

ROWS = [(f"c{b % 3}", f"bag{b:02d}", i, [float(b), i / 7]) for b in range(30) for i in range(b % 5 + 1)]
POINTS = "category string, name string, point_id long, features array<double>"


@pytest.fixture
def points(spark):
    return spark.createDataFrame(ROWS, POINTS).repartition(4)


def rows_of(df):
    return sorted(map(tuple, df.select("category", "name", "point_id", "features").collect()))


def names_in(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if not f.startswith("."))


def test_splits_inside_files(spark, points, tmp_path):
    """Files larger than a split are read in several, with the writer's index and without; bags aren't torn apart."""
    out = str(tmp_path / "tb")
    assert files.write_typedbytes(points, out) == 30
    for indexed in (True, False):
        reader = bagfiles.BagReader(f"file:{out}", False, 600)
        splits = reader.partitions()
        assert len(splits) > 2 * len({s.path for s in splits}) and all(a.end == b.start for a, b in zip(splits, splits[1:]) if a.path == b.path)
        assert sum(b.num_rows for s in splits for b in reader.read(s)) == len(ROWS)
        read = bagfiles.read_bags(spark, out, split_bytes=600)
        assert read.rdd.getNumPartitions() == len(splits) and rows_of(read) == sorted(ROWS)
        if indexed:
            os.remove(f"{out}/_index.json")


def test_filters_pass_over_values(spark, points, tmp_path, monkeypatch):
    out = str(tmp_path / "tb")
    files.write_typedbytes(points, out)
    reader = bagfiles.BagReader(f"file:{out}", False, 1 << 20)
    rest = GreaterThan(("point_id",), 1)
    assert list(reader.pushFilters([EqualTo(("category",), "c1"), In(("name",), ["bag01", "bag04", "bag05"]), rest])) == [rest]
    loaded = []
    monkeypatch.setattr(np, "load", lambda *a, f=np.load, **b: loaded.append(1) or f(*a, **b))
    assert {b.column("name")[0].as_py() for s in reader.partitions() for b in reader.read(s)} == {"bag01", "bag04"}
    assert len(loaded) == 2
    monkeypatch.undo()
    read = bagfiles.read_bags(spark, out)
    assert rows_of(read.where("category = 'c1' and point_id > 1")) == sorted(r for r in ROWS if r[0] == "c1" and r[2] > 1)
    assert rows_of(read.where(F.col("category").isin("c0", "c2") & F.col("name").isin("bag02"))) == sorted(r for r in ROWS if r[1] == "bag02")
    assert rows_of(files.read_typedbytes(spark, out, ["c2"])) == sorted(r for r in ROWS if r[0] == "c2")


@pytest.mark.parametrize("form", ["npz", "typedbytes"])
def test_failed_jobs_leave_nothing(spark, points, tmp_path, form):
    out = str(tmp_path / form)
    bad = points.withColumn("features", F.when(F.col("name") == "bag17", F.raise_error(F.lit("no")).cast("array<double>")).otherwise(F.col("features")))
    write = files.write_npz if form == "npz" else files.write_typedbytes
    with pytest.raises(Exception, match="no"):
        write(bad, out)
    assert not os.path.exists(out) or names_in(out) == []
    assert write(points, out) == 30
    assert rows_of(files.load(spark, out)) == sorted(ROWS) and not os.path.exists(f"{out}/_temporary")


@pytest.mark.parametrize("form", ["npz", "typedbytes"])
def test_attempts_that_do_not_count_leave_nothing(tmp_path, form, monkeypatch):
    """Two attempts of a task, one of which is committed, and a third that is cut off."""
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda _: type("C", (), {"partitionId": lambda _: 0})()))
    batch = pa.RecordBatch.from_pydict({"category": ["a", "a"], "name": ["x", "y"], "features": [[[1.0, 2.0]], [[3.0, 4.0], [5.0, 6.0]]], "extras": ["{}", '{"w": 2.5}']})
    writer = bagfiles.BagWriter(f"file:{tmp_path}/out", form, 1, False)
    writer.write(iter([batch]))
    done = writer.write(iter([batch]))

    def cut_off():
        yield batch
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(cut_off())
    writer.commit([done, None])
    assert len(names_in(tmp_path / "out")) == 3 and "_index.json" in names_in(tmp_path / "out")
    assert not os.path.exists(tmp_path / "out" / "_temporary")
    aborted = bagfiles.BagWriter(f"file:{tmp_path}/none", form, 1, False)
    aborted.abort([aborted.write(iter([batch]))])
    assert names_in(tmp_path / "none") == []


def test_bags_that_are_there_already(spark, points, tmp_path):
    out = str(tmp_path / "npz")
    files.write_npz(points.where("category = 'c0'"), out)
    before = names_in(out)
    with pytest.raises(Exception, match="there already"):
        files.write_npz(points, out)
    assert names_in(out) == before
    assert files.write_npz(points.where("category <> 'c0'"), out) == 30
    assert bagfiles.write_bags(files._packed(points.where("category = 'c1'"), None), out, "npz", mode="overwrite") == 10
    assert {r[0] for r in rows_of(files.load(spark, out))} == {"c1"}


@pytest.mark.parametrize("form", ["npz", "typedbytes", "parquet"])
def test_extras_come_back(spark, points, tmp_path, form):
    """Scalars, strings and arrays by frame; whole and real numbers become one type, keys that a bag lacks its default."""
    out = str(tmp_path / form)
    extras = [(c, n, k if k % 2 else None, k / 2 if k % 3 else float(k), f"text {k} é" if k % 4 else None, [float(k), 0.5], [[k, 1], [k, 2]], k % 2 == 0) for k, (c, n) in enumerate(sorted({r[:2] for r in ROWS}))]
    table = spark.createDataFrame(extras, "category string, name string, label long, weight double, said string, at array<double>, frames array<array<long>>, odd boolean")
    files.save(points, out, form, table, made="here")
    assert files.read_attrs(spark, out) == {"made": "here"}
    got = files.read_extras(spark, out, {"label": -1})
    kinds = dict(got.dtypes)
    assert kinds["label"] == "bigint" and kinds["weight"] == "double" and kinds["said"] == "string" and kinds["at"] == "array<double>" and kinds["odd"] == "boolean"
    want = {r[:2]: (-1 if r[2] is None else r[2], r[3], r[4], r[5], r[6], r[7]) for r in extras}
    assert {(r.category, r.name): (r.label, r.weight, r.said, r["at"], r.frames, r.odd) for r in got.collect()} == want
    assert rows_of(files.load(spark, out)) == sorted(ROWS)


def test_extras_of_types_that_differ(spark, tmp_path):
    for name, value in (("a", 1), ("b", 2.5), ("c", None)):
        os.makedirs(tmp_path / "x", exist_ok=True)
        np.savez(tmp_path / "x" / f"{name}.npz", features=np.ones((1, 1)), **({} if value is None else {"v": value, "w": value if name == "a" else "t"}))
    got = {r.name: (r.v, r.w) for r in files.read_extras(spark, str(tmp_path)).collect()}
    assert got == {"a": (1.0, "1"), "b": (2.5, "t"), "c": (None, None)}


def test_no_extras(spark, points, tmp_path):
    for form in ("npz", "typedbytes", "parquet"):
        files.save(points, str(tmp_path / form), form)
        got = files.read_extras(spark, str(tmp_path / form))
        assert got.columns == ["category", "name"] and got.count() == 30


def test_cut_off_and_unknown_values():
    with pytest.raises(ValueError, match="ends within"):
        files.typed(memoryview(b"\x07\x00\x00\x00\x09abc"), 0)
    with pytest.raises(ValueError, match="unknown form"):
        bagfiles.BagSource({"path": "x", "form": "hdf"}).writer(None, False)
