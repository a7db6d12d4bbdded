"""Cutting lineage in loops: tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode where the session names no folder (tests, notebooks).
LOCAL_FOLDER = "file:///tmp/checkpoints"

#: Tables written by this process that are still there.
_written: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where it is unset, local mode takes one of its own; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors would write to folders that no other machine can read")
        return LOCAL_FOLDER
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet and read it back with its schema."""
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _written.add(path)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*(f"`{c}`" for c in df.columns))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back."""
    return store(df, new_path(df.sparkSession, "loop"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this process has written and not deleted; for the end of a session, when no result is read any more."""
    for path in list(_written):
        remove(spark, path)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends; else the garbage collector decides, which keeps those of the last query."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables of one run of a loop: when it ends, all of them go but the result given to keep()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, "loop")
        self.paths.append(path)
        return store(df, path)

    def keep(self, df: DataFrame) -> DataFrame:
        return checkpoint(df)

    def drop(self, first: int, last: int) -> None:
        """Delete the tables from one number to before another, in the order in which they were written; only those that nothing reads any more."""
        for path in self.paths[first:last]:
            remove(self.spark, path)
        del self.paths[first:last]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        for path in self.paths:
            remove(self.spark, path)
