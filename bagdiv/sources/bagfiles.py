"""Files of bags as a Spark data source: typed bytes read in planned splits, typed bytes and npz written all or not at all.

`spark.read.format("bags")` plans splits inside large files, from the index that the writer leaves or from the lengths in the file,
and passes over the values of bags whose category or name a filter excludes. Writing, every task attempt has a folder of its
own; the driver moves the files of the attempts that count when all tasks have ended, so that attempts that were
retried, were run twice or failed leave nothing.

Paths are those of pyarrow's file systems (local and shared folders, s3, gs, hdfs); `qualified` gives a path without a scheme that
of Hadoop's default file system.
"""

from __future__ import annotations

import io
import json
import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .files import PLAIN_CODES, as_typed

INDEX, POINTS, EXTRAS = "_index.json", "category string, name string, point_id long, features array<double>", "category string, name string, extras string"
#: Bytes of a split and of a file, and points of a batch.
SPLIT_BYTES, FILE_BYTES, BATCH = 64 << 20, 500 << 20, 10_000


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: Hadoop's default one where it has none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path with a scheme."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Stream:
    """Typed bytes values of an open file, one after another; a skipped one costs its headers alone."""

    def __init__(self, file):
        self.file = file

    def take(self, n: int) -> bytes:
        data = self.file.read(n)
        if len(data) < n:
            raise ValueError("the file ends within a value")
        return data

    def _over(self, n: int) -> None:
        self.file.seek(self.file.tell() + n)

    def value(self, skip: bool = False, only: set[str] | None = None, without: set[str] = frozenset()):
        """The next value, None if it is skipped. only, without: the keys of a map whose values are read, or aren't."""
        code = self.take(1)[0]
        if code in PLAIN_CODES:
            form = PLAIN_CODES[code]
            return struct.unpack(form, self.take(struct.calcsize(form)))[0]
        if code == 9:
            out = []
            while (more := self.take(1)[0]) != 255:
                self.file.seek(self.file.tell() - 1)
                out.append(self.value(skip))
            return None if skip else out
        n = struct.unpack(">i", self.take(4))[0]
        if code in (0, 7, 0xAA):
            if skip:
                return self._over(n)
            raw = self.take(n)
            return raw.decode() if code == 7 else np.load(io.BytesIO(raw), allow_pickle=False) if code == 0xAA else raw
        if code == 8:
            out = [self.value(skip) for _ in range(n)]
            return None if skip else out
        if code != 10:
            raise ValueError(f"unknown type code {code}")
        held = {}
        for _ in range(n):
            key = text(self.value())
            passed = skip or key in without or (only is not None and key not in only)
            one = self.value(passed)
            if not passed:
                held[key] = one
        return None if skip else held


def text(value) -> str:
    return value.decode() if isinstance(value, bytes) else str(value)


def plain(value):
    """What JSON can hold: arrays as lists, bytes as text, numbers that aren't finite as null."""
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    if isinstance(value, np.generic):
        return plain(value.item())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {text(k): plain(v) for k, v in value.items()}
    if isinstance(value, bytes):
        return value.decode()
    return None if isinstance(value, float) and not math.isfinite(value) else value


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class BagReader(DataSourceReader):
    def __init__(self, path: str, extras: bool, split_bytes: int):
        self.path, self.extras, self.split_bytes = path, extras, split_bytes
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("category",), ("name",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Split]:
        where, root = store(self.path)
        found = [f for f in where.get_file_info(fs.FileSelector(root)) if f.is_file]
        index = next((json.loads(where.open_input_stream(f.path).read()) for f in found if f.base_name == INDEX), {})
        out = []
        for f in sorted((f for f in found if f.base_name.startswith("data_") and f.extension == "tb"), key=lambda f: f.path):
            known = index.get(f.base_name)
            starts = [0] if f.size <= self.split_bytes else known["starts"] if known and known["size"] == f.size else self.walked(where, f.path, f.size)
            kept = [0]
            for s in starts:
                if s - kept[-1] >= self.split_bytes:
                    kept.append(s)
            out += [Split(f.path, a, b) for a, b in zip(kept, [*kept[1:], f.size]) if b > a]
        return out

    def walked(self, where: fs.FileSystem, path: str, size: int) -> list[int]:
        """Where bags begin in a file without an index: the lengths in it are read, and no value."""
        starts = []
        with where.open_input_file(path) as file:
            stream = Stream(file)
            while file.tell() < size:
                starts.append(file.tell())
                stream.value(True), stream.value(True)
        return starts

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        where, _ = store(self.path)
        with where.open_input_file(split.path) as file:
            file.seek(split.start)
            stream = Stream(file)
            while file.tell() < split.end:
                category, _, name = text(stream.value()).partition("/")
                if category not in self.wanted.get("category", {category}) or name not in self.wanted.get("name", {name}):
                    stream.value(True)
                elif self.extras:
                    held = stream.value(without={"features"})
                    yield pa.RecordBatch.from_pydict({"category": [category], "name": [name], "extras": [json.dumps(plain(held))]})
                else:
                    x = np.atleast_2d(np.asarray(stream.value(only={"features"})["features"], float))
                    for lo in range(0, len(x), BATCH):
                        part = x[lo : lo + BATCH]
                        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(np.ascontiguousarray(part).ravel()))
                        yield pa.RecordBatch.from_pydict({"category": pa.array([category] * len(part)), "name": pa.array([name] * len(part)), "point_id": pa.array(np.arange(lo, lo + len(part))), "features": rows})


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]
    starts: dict[str, dict]
    bags: int


class BagWriter(DataSourceArrowWriter):
    """Rows (category, name, features, extras), one for each bag, extras being JSON."""

    def __init__(self, path: str, form: str, file_bytes: int, overwrite: bool):
        self.path, self.form, self.file_bytes, self.overwrite = path, form, file_bytes, overwrite
        self.job = uuid.uuid4().hex[:12]

    def bags(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, dict]]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("features")[i].values
                x = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
                more = json.loads(batch.column("extras")[i].as_py() or "{}")
                more = {k: np.asarray(v) if isinstance(v, list) and v and np.asarray(v).dtype.kind in "ifb" else v for k, v in more.items()}
                yield batch.column("category")[i].as_py(), batch.column("name")[i].as_py(), {"features": x, **more}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        where, root = store(self.path)
        attempt = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}"
        where.create_dir(attempt, recursive=True)
        done = Written(attempt, [], {}, 0)
        if self.form == "npz":
            for category, name, bag in self.bags(iterator):
                data = io.BytesIO()
                np.savez(data, **bag)
                where.create_dir(f"{attempt}/{category}", recursive=True)
                with where.open_output_stream(f"{attempt}/{category}/{name}.npz") as out:
                    out.write(data.getvalue())
                done.files.append(f"{category}/{name}.npz")
                done.bags += 1
            return done
        out, name, size = None, "", 0
        for category, bag_name, bag in self.bags(iterator):
            if out is None or size > self.file_bytes:
                if out is not None:
                    out.close()
                    done.starts[name]["size"] = size
                name, size = f"data_{self.job}_{TaskContext.get().partitionId():05d}_{len(done.files):05d}.tb", 0
                out = where.open_output_stream(f"{attempt}/{name}")
                done.files.append(name)
                done.starts[name] = {"starts": []}
            row = as_typed(f"{category}/{bag_name}") + as_typed(bag)
            out.write(row)
            done.starts[name]["starts"].append(size)
            size += len(row)
            done.bags += 1
        if out is not None:
            out.close()
            done.starts[name]["size"] = size
        return done

    def commit(self, messages: list[Written | None]) -> None:
        where, root = store(self.path)
        messages = [m for m in messages if m is not None]
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(root)):
                if f.base_name != "_temporary":
                    (where.delete_dir if f.type == fs.FileType.Directory else where.delete_file)(f.path)
        names = [f"{root}/{f}" for m in messages for f in m.files]
        if there := [f.path for f in where.get_file_info(names) if f.type != fs.FileType.NotFound]:
            raise ValueError(f"bags are there already: {there[:5]}")
        for m in messages:
            for f in m.files:
                where.create_dir(f"{root}/{f}".rpartition("/")[0], recursive=True)
                where.move(f"{m.folder}/{f}", f"{root}/{f}")
        at = f"{root}/{INDEX}"
        known = json.loads(where.open_input_stream(at).read()) if where.get_file_info(at).is_file else {}
        for m in messages:
            known |= m.starts
        known["bags"] = known.get("bags", 0) + sum(m.bags for m in messages)
        with where.open_output_stream(at) as out:
            out.write(json.dumps(known).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Whatever is below the folder of this job goes."""
        where, root = store(self.path)
        folder = f"{root}/_temporary/{self.job}"
        if where.get_file_info(folder).type == fs.FileType.Directory:
            where.delete_dir(folder)
        if where.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory and not where.get_file_info(fs.FileSelector(f"{root}/_temporary")):
            where.delete_dir(f"{root}/_temporary")


class BagSource(DataSource):
    """Options: path; reading: extras (true for a row of JSON for each bag), split_bytes; writing: form (typedbytes or npz), file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "bags"

    def schema(self) -> str:
        return EXTRAS if self.options.get("extras") == "true" else POINTS

    def reader(self, schema) -> BagReader:
        return BagReader(self.options["path"], self.options.get("extras") == "true", int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> BagWriter:
        if (form := self.options.get("form", "typedbytes")) not in ("typedbytes", "npz"):
            raise ValueError(f"unknown form {form!r}")
        return BagWriter(self.options["path"], form, int(self.options.get("file_bytes", FILE_BYTES)), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source `bags` and with filters pushed to such sources."""
    spark.dataSource.register(BagSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_bags(spark: SparkSession, path: str, extras: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """points of typed bytes files, or with extras a row (category, name, extras) for each bag."""
    read = registered(spark).read.format("bags").option("split_bytes", split_bytes).option("extras", str(extras).lower())
    return read.load(qualified(spark, path))


def write_bags(packed: DataFrame, path: str, form: str, file_bytes: int = FILE_BYTES, mode: str = "append") -> int:
    """A row (category, name, features, extras) for each bag -> files; the number of bags in the folder then."""
    spark = registered(packed.sparkSession)
    full = qualified(spark, path)
    packed.select("category", "name", "features", "extras").write.format("bags").option("form", form).option("file_bytes", file_bytes).mode(mode).save(full)
    where, root = store(full)
    return json.loads(where.open_input_stream(f"{root}/{INDEX}").read())["bags"]


def unified(extras: DataFrame, defaults: dict | None = None) -> DataFrame:
    """(category, name, extras as JSON) -> (category, name, and a column for each key that some bag has).

    Spark folds the types of all bags to one: whole and real numbers to double, what doesn't agree otherwise to string;
    a bag that lacks a key has null or the default.
    """
    said = extras.agg(F.expr("schema_of_variant_agg(parse_json(extras))")).first()[0]
    if said is None or not said.startswith("OBJECT<") or said == "OBJECT<>":
        return extras.select("category", "name")
    kind = F.from_json("extras", columns_of(said)).alias("held")
    out = extras.select("category", "name", kind).select("category", "name", "held.*")
    return out.fillna({k: v for k, v in (defaults or {}).items() if k in out.columns})


def columns_of(said: str) -> str:
    """The type of a variant as one that JSON is read with."""
    import re

    said = re.sub(r"DECIMAL\(\d+, ?\d+\)|FLOAT", "DOUBLE", said.replace("OBJECT<", "STRUCT<"))
    return re.sub(r"\b(VARIANT|VOID)\b", "STRING", said)
