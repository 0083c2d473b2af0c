"""Intermediate tables in the folder that the cluster shares.

A table that is written once and read several times cuts lineage: losing an
executor afterwards repeats a read, not the work before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Used only with a local master on which no folder is set.
LOCAL_FALLBACK = "/tmp/checkpoints"

_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, from the session or the context."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = LOCAL_FALLBACK
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def move_new(spark: SparkSession, source: str, target: str) -> None:
    """Rename in one step; fails, whatever the file system, if the target is there already."""
    jvm = spark.sparkContext._jvm
    path, rename = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(source).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(path(source), path(target), options)


@contextmanager
def _shuffled_files_go(spark: SparkSession) -> Iterator[None]:
    """Queries that are run within delete their shuffled files at their end, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables of one run, each in a folder of its own below the shared root."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{shared_root(spark)}/waymark/{label}-{uuid.uuid4().hex}"
        _made.append(self.path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back; its file size is then known to the planner. What was shuffled
        for it is of no more use then, and goes at once."""
        target = f"{self.path}/{name}"
        with _shuffled_files_go(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(target)
        return self.spark.read.schema(StructType.fromJson(df.schema.jsonValue())).parquet(target)

    def drop(self, name: str) -> None:
        delete_path(self.spark, f"{self.path}/{name}")


def sweep(spark: SparkSession) -> None:
    """Delete all scratch tables made by this process; results that read them must be written by then."""
    while _made:
        delete_path(spark, _made.pop())
