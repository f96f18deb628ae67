"""Files of bags: one npz per bag, label files, image folders, and the cache of divergences."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import scratch

IMAGES = ("jpg", "jpeg", "png", "bmp")
#: Codes of plain values in the typed bytes format.
PLAIN_CODES = {1: ">b", 2: ">?", 3: ">i", 4: ">q", 5: ">f", 6: ">d"}


def _place(path):
    parts = F.split(path, "/")
    return F.element_at(parts, -2).alias("category"), F.element_at(parts, -1).alias("file")


def chosen(df: DataFrame, pairs: DataFrame | None = None, choose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of the bags (category, name) in pairs, and of those that choose keeps of the bags left."""
    if pairs is not None:
        df = df.join(pairs.select("category", "name"), ["category", "name"], "left_semi")
    return df if choose is None else df.join(choose(df.select("category", "name").distinct()).select("category", "name"), ["category", "name"], "left_semi")


def read_npz(spark: SparkSession, path: str, cats: list[str] | None = None, names_only: bool = False, pairs: DataFrame | None = None, choose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """root/<category>/<name>.npz -> points (category, name, point_id, features); object arrays are refused.

    pairs and choose as in `chosen`: files that they leave out aren't parsed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path)
    files = files.select(*_place(F.col("path")), *([] if names_only else ["content"])).withColumn("name", F.regexp_replace("file", r"\.npz$", ""))
    files = chosen(files.where(F.col("category").isin(cats)) if cats else files, pairs, choose)
    if names_only:
        return files.select("category", "name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                with np.load(io.BytesIO(r.content), allow_pickle=False) as z:
                    x = np.atleast_2d(z["features"].astype(float))
                yield pd.DataFrame({"category": r.category, "name": r.name, "point_id": np.arange(len(x)), "features": list(x)})

    return files.select("category", "name", "content").mapInPandas(run, "category string, name string, point_id long, features array<double>")


def typed(data: memoryview, at: int) -> tuple[object, int]:
    """The typed bytes value at an offset, and the offset behind it. Code 0xAA: an array in npy format behind its length."""
    from .bagfiles import Stream

    file = io.BytesIO(data)
    file.seek(at)
    return Stream(file).value(), file.tell()


def read_typedbytes(spark: SparkSession, path: str, cats: list[str] | None = None, pairs: DataFrame | None = None, choose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Files data_*.tb of pairs `category/name`, {features: array, ...} -> points (category, name, point_id, features).

    Large files are read in splits, and bags of other categories than cats are passed over (see `bagfiles`). pairs and choose as
    in `chosen`.
    """
    from .bagfiles import read_bags

    found = read_bags(spark, path)
    return chosen(found.where(F.col("category").isin(cats)) if cats else found, pairs, choose)


def _packed(pts: DataFrame, extras: DataFrame | None) -> DataFrame:
    """points (category, name, point_id, features) -> a row for each bag: rows in order of point_id, and its extras as JSON."""
    rows = F.sort_array(F.collect_list(F.struct("point_id", "features"))).alias("rows")
    out = pts.groupBy("category", "name").agg(rows).select("category", "name", F.col("rows.features").alias("features"))
    if extras is None:
        return out.withColumn("extras", F.lit("{}"))
    own = [c for c in extras.columns if c not in ("category", "name")]
    return out.join(extras.select("category", "name", F.to_json(F.struct(*own)).alias("extras")), ["category", "name"], "left").fillna("{}", ["extras"])


def write_npz(pts: DataFrame, path: str, extras: DataFrame | None = None) -> int:
    """points (category, name, point_id, features) -> root/<category>/<name>.npz with features and the extras of the bag
    (a table by category and name). A bag is one file, so it is held by one task. All files appear when the job ends, or
    none; bags that are there already are an error. Gives the number of bags in the folder."""
    from .bagfiles import write_bags

    return write_bags(_packed(pts, extras), path, "npz")


def as_typed(value) -> bytes:
    """A value in the typed bytes format; arrays as code 0xAA with their npy bytes."""
    if isinstance(value, np.ndarray):
        data = io.BytesIO()
        np.save(data, value, allow_pickle=False)
        return b"\xaa" + struct.pack(">i", len(data.getvalue())) + data.getvalue()
    if isinstance(value, bool):
        return struct.pack(">B?", 2, value)
    if isinstance(value, (int, np.integer)):
        return struct.pack(">Bi", 3, value) if -(2**31) <= value < 2**31 else struct.pack(">Bq", 4, value)
    if isinstance(value, (float, np.floating)):
        return struct.pack(">Bd", 6, value)
    if isinstance(value, bytes):
        return struct.pack(">Bi", 0, len(value)) + value
    if isinstance(value, str):
        return struct.pack(">Bi", 7, len(value.encode())) + value.encode()
    if isinstance(value, dict):
        return struct.pack(">Bi", 10, len(value)) + b"".join(as_typed(k) + as_typed(v) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return struct.pack(">Bi", 8, len(value)) + b"".join(map(as_typed, value))
    raise TypeError(f"no typed bytes for {type(value).__name__}")


def write_typedbytes(pts: DataFrame, path: str, extras: DataFrame | None = None, file_bytes: int = 500 << 20) -> int:
    """points -> files data_<job>_<partition>_<file>.tb of pairs `category/name`, {features, extras…}, which appear when the job
    ends, or not at all; a new file begins beyond file_bytes. Gives the number of bags in the folder."""
    from .bagfiles import write_bags

    return write_bags(_packed(pts, extras), path, "typedbytes", file_bytes)


def read_extras(spark: SparkSession, path: str, defaults: dict | None = None) -> DataFrame:
    """(category, name, extras…) of the bags in a folder of any form: a row for each bag, with one type for each name (see
    `bagfiles.unified`). Features aren't read."""
    from .bagfiles import plain, read_bags, unified

    form = form_of(spark, path)
    if form == "parquet":
        try:
            return unified(spark.read.parquet(f"{path}/_extras.parquet"), defaults)
        except AnalysisException:
            return spark.read.parquet(path).select("category", "name").distinct()
    if form == "tb":
        return unified(read_bags(spark, path, extras=True), defaults)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path)
    files = files.select(*_place(F.col("path")), "content").withColumn("name", F.regexp_replace("file", r"\.npz$", ""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                with np.load(io.BytesIO(r.content), allow_pickle=False) as z:
                    held = {k: plain(z[k]) for k in z.files if k != "features"}
                yield pd.DataFrame({"category": [r.category], "name": [r.name], "extras": [json.dumps(held)]})

    return unified(files.select("category", "name", "content").mapInPandas(run, "category string, name string, extras string"), defaults)


def write_attrs(spark: SparkSession, path: str, attrs: dict) -> None:
    """Facts about the data in a folder, as the text file _attrs.json in it, which readers of its data pass over."""
    spark.createDataFrame([(json.dumps(attrs),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_attrs.json")


def read_attrs(spark: SparkSession, path: str) -> dict:
    """What `write_attrs` wrote; empty if nothing was."""
    try:
        return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/_attrs.json").collect()) or "{}")
    except AnalysisException:
        return {}


def save(pts: DataFrame, path: str, form: str = "parquet", extras: DataFrame | None = None, **attrs) -> None:
    """points in one of the forms that `load` tells apart, extras (by category and name) that `read_extras` gives back, and what
    `read_attrs` shall give."""
    if form not in ("parquet", "npz", "typedbytes"):
        raise ValueError(f"unknown form {form!r}")
    if form == "parquet":
        write_points(pts, path)
        if extras is not None:
            own = [c for c in extras.columns if c not in ("category", "name")]
            extras.select("category", "name", F.to_json(F.struct(*own)).alias("extras")).write.parquet(f"{path}/_extras.parquet")
    else:
        (write_npz if form == "npz" else write_typedbytes)(pts, path, extras)
    if attrs:
        write_attrs(pts.sparkSession, path, attrs)


def form_of(spark: SparkSession, path: str) -> str:
    """parquet, npz or tb, by the names of the files in a folder."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", r"\."), -1).alias("kind"))
    kinds = {r.kind for r in names.distinct().collect()} & {"parquet", "npz", "tb"}
    if len(kinds) != 1:
        raise ValueError(f"files of one form are expected in {path}, not of {sorted(kinds) or 'none'}")
    return kinds.pop()


def load(spark: SparkSession, path: str, cats: list[str] | None = None, pairs: DataFrame | None = None, choose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """points (category, name, point_id, features) of a folder, by the names of the files in it; pairs and choose as in `chosen`."""
    reader = {"parquet": read_points, "npz": read_npz, "tb": read_typedbytes}[form_of(spark, path)]
    return reader(spark, path, cats, pairs=pairs, choose=choose).select("category", "name", "point_id", "features")


def write_points(pts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    pts.write.mode(mode).partitionBy("category").parquet(path)


def read_points(spark: SparkSession, path: str, cats: list[str] | None = None, pairs: DataFrame | None = None, choose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return chosen(out.where(F.col("category").isin(cats)) if cats else out, pairs, choose)


def find_images(spark: SparkSession, path: str, n: int | None = None, how: str = "first", seed: int = 0) -> DataFrame:
    """(category, file, path) of the images below a folder, the category being their own folder; n: that many of each
    category, picked as by `sample_bags`. Two images of one category and file name are an error."""
    from ..operators.transforms import sample_bags

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGES)).select(*_place(F.col("path")), "path")
    if twice := files.groupBy("category", "file").count().where("count > 1").limit(5).collect():
        raise ValueError(f"images of the same category and name: {[f'{r.category}/{r.file}' for r in twice]}")
    return files if n is None else sample_bags(files, "category", "file", n, how, seed)


def side_labels(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(category, file, <name>) of images with a file `<image><suffix>` beside them that holds one value, as text without
    white space at its ends; the name is the suffix without a leading `.`, `_` or `-`."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    found = found.select(*_place(F.col("path")), F.regexp_replace(F.col("content").cast("string"), r"^\s+|\s+$", "").alias(suffix.lstrip("._-")))
    image = F.col("file").substr(F.lit(1), F.length("file") - len(suffix))
    ends = F.col("file").endswith(suffix) & F.lower(F.element_at(F.split(image, r"\."), -1)).isin(*IMAGES)
    return found.where(ends).withColumn("file", image)


def read_labels(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines `file,value` without a header -> (file, <name>); lines without a number are null."""
    return spark.read.schema(f"file string, {name} double").csv(path)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", "true").csv(path)
    return df.select("path", F.coalesce(F.col("cat") if "cat" in df.columns else F.lit(None), F.lit("default")).alias("cat"))


class DivergenceCache:
    """Divergences by (spec, k) as Parquet, with what they were made for; writing some replaces those alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, divs: DataFrame) -> None:
        divs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("spec", "k").parquet(self.path)

    def read(self, spec: str, k: int) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "false").parquet(self.path).where((F.col("spec") == spec) & (F.col("k") == k))

    def held(self) -> set[tuple[str, int]]:
        """(spec, k) of what is there; nothing if there is no cache yet."""
        try:
            rows = self.spark.read.parquet(self.path).select("spec", "k").distinct().collect()
        except AnalysisException:
            return set()
        return {(str(r.spec), int(r.k)) for r in rows}

    def get(self, pts: DataFrame, specs: list[str], ks: list[int], min_dist: float | None = None) -> DataFrame:
        """(p, q, spec, k, value): from the cache, and computed and added to it where it lacks some. A cache of other bags,
        other numbers of points, another dimension or min_dist is an error."""
        from ..functions.specs import min_dist as usual
        from ..functions.specs import parse
        from ..operators.divergence import estimate_divs
        from ..operators.knn import shape

        of = shape(pts)
        facts = pts.groupBy("bag_id").agg(F.count("*").alias("n_pts")).select(F.col("bag_id").cast("string").alias("bag_id"), "n_pts", F.lit(of.dim).alias("dim"), F.lit(float(usual(of.dim) if min_dist is None else min_dist)).alias("min_dist"))
        names = [str(s) for s in parse(specs)]
        known = self.held()
        if known:
            was = self.spark.read.parquet(f"{self.path}-bags")
            if not (facts.exceptAll(was).isEmpty() and was.exceptAll(facts).isEmpty()):
                raise ValueError(f"{self.path} holds divergences of other bags, or of another min_dist")
        else:
            facts.write.mode("overwrite").parquet(f"{self.path}-bags")
        lacking = [s for s in names if any((s, k) not in known for k in ks)]
        if lacking:
            with scratch(self.spark):
                self.write(estimate_divs(pts, lacking, ks, min_dist=min_dist))
        found = self.spark.read.parquet(self.path)
        return found.where(F.col("spec").isin(names) & F.col("k").isin(ks)).select("p", "q", F.col("spec").cast("string").alias("spec"), F.col("k").cast("int").alias("k"), "value")


def checked(pts: DataFrame) -> DataFrame:
    """The points, or an error if a feature is null or not finite."""
    bad = pts.where(F.exists("features", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))) | F.col("features").isNull()).groupBy("bag_id").count()
    if rows := bad.limit(5).collect():
        raise ValueError(f"features that are null or not finite in bags {[r.bag_id for r in rows]}")
    return pts


def nonempty(pts: DataFrame, bag_table: DataFrame) -> DataFrame:
    """Bags that have points."""
    return bag_table.join(pts.select("bag_id").distinct(), "bag_id", "left_semi")


def image_points(spark: SparkSession, path: str, describe) -> DataFrame:
    """points (category, name, point_id, features) of the images below a folder: describe takes a file's bytes and gives an
    array of descriptors, a row for each; images without any give no points."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGES)).select(*_place(F.col("path")), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                x = np.atleast_2d(np.asarray(describe(r.content), float))
                if x.size:
                    yield pd.DataFrame({"category": r.category, "name": r.file, "point_id": np.arange(len(x)), "features": list(x)})

    return files.mapInPandas(run, "category string, name string, point_id long, features array<double>")
