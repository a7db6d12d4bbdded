"""Shared-folder tables: what cuts lineage and survives the loss of an executor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runpath.operators.storage import Scratch, exists, new_path, remove, shared_folder, shuffles_go, store  # noqa: F401


def materialize(df: DataFrame, name: str = "table", partition_by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back with its schema."""
    path = path or new_path(df.sparkSession, name)
    out = store(df, path, partition_by)
    out.table_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables made by materialize(); only of those that nothing reads any more."""
    for df in tables:
        remove(spark, df.table_path)


class Tables(Scratch):
    """Tables of one run of an operator: when it ends, all of them go but the result given to keep()."""

    def write(self, df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
        out = materialize(df, name, partition_by)
        self.paths.append(out.table_path)
        return out

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        return materialize(df, name)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


#: Rows of an Arrow batch at most: texts are long, and a batch is held several times over on both sides of the pipe.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS where it is higher.

    The setting is read when a plan runs, which is after an operator has returned, so it stays lowered.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
