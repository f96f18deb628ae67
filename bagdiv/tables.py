"""Tables in the shared folder, which cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that belong to the innermost `scratch`.
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and the executors are threads of this process, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="bagdiv-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder: computed once, compressed, and read again from any executor."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    if (owned := _owned.get()) is not None:
        owned.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, *paths: str) -> None:
    """Folders of any file system that Spark knows; one that isn't there is none to delete."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `checkpointed` writes inside, in operators called there too, are deleted at the end, also after an error.

    So a result must be written or collected inside. An inner one owns what is written in it. Tables written from other
    threads are left alone.
    """
    mark = _owned.set([])
    try:
        yield
    finally:
        paths = _owned.get()
        _owned.reset(mark)
        deleted(spark, *paths)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `checkpointed` wrote, once nothing reads them any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if folder.rsplit("/", 1)[-1].startswith("table-"):
                deleted(df.sparkSession, folder)
