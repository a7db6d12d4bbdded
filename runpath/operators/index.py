"""Tables kept as Parquet, partitioned by bucket of a key, and the symbol index made of them."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath.errors import ConcurrentChangeError
from runpath.functions import text as T
from runpath.operators import relational as R
from runpath.operators.storage import Scratch, new_path, remove


class BucketedTable:
    """Rows in buckets of the hash of one column (the path, as a rule).  A change writes the buckets of the changed keys only.

    A version of the table is a small file that names the folder of each bucket.  A change writes its buckets to a folder
    of its own and then the next version, all of it or nothing: the file is written aside and renamed, which fails if
    another change has made that version.  What is there is never overwritten, so a reader goes on with the version that
    it began with; vacuum() deletes what no version that is kept names.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = 64, column: str = "path"):
        self.spark, self.folder, self.schema, self.buckets, self.column = spark, folder.rstrip("/"), schema, buckets, column

    # -- versions -----------------------------------------------------------------------------------------------------
    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [s.getPath().getName() for s in self._fs().listStatus(where)] if self._fs().exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names("versions") if n.startswith("v"))

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, str]]:
        """(version, bucket -> folder below the table's) of the last version, or of the one given; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, {}
        stream = self._fs().open(self._path(f"versions/v{version}"))
        try:
            return version, json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, buckets: dict[str, str]) -> None:
        jvm = self.spark.sparkContext._jvm
        draft, done = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"versions/v{version}")
        self._fs().mkdirs(done.getParent())
        stream = self._fs().create(draft, False)
        stream.write(json.dumps(buckets).encode())
        stream.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, done, plain)
        except Py4JJavaError as e:
            self._fs().delete(draft, False)
            if not self._fs().exists(done):
                raise
            raise ConcurrentChangeError(f"version {version} of {self.folder} was made by another change") from e

    def _written(self, rows: DataFrame) -> dict[str, str]:
        """Write rows to a new folder; the folder of each bucket that has any."""
        name = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(self.column), F.lit(self.buckets)).cast("int")
        # Few buckets are written in pieces, so that all cores have some.
        pieces = -(-2 * self.spark.sparkContext.defaultParallelism // self.buckets)
        dealt = ["bucket", *([F.pmod(F.xxhash64(self.column, F.lit(1)), F.lit(pieces))] if pieces > 1 else [])]
        rows.withColumn("bucket", bucket).repartition(*dealt).write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        return {n.split("=")[1]: f"{name}/{n}" for n in self._names(name) if n.startswith("bucket=")}

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last versions, and the folders that these do not name."""
        kept = self.versions()[-keep:]
        used = {folder for v in kept for folder in self.manifest(v)[1].values()}
        for v in self.versions():
            if v not in kept:
                remove(self.spark, f"{self.folder}/versions/v{v}")
        for name in self._names("data"):
            for bucket in self._names(f"data/{name}"):
                if bucket.startswith("bucket=") and f"data/{name}/{bucket}" not in used:
                    remove(self.spark, f"{self.folder}/data/{name}/{bucket}")

    # -- rows ---------------------------------------------------------------------------------------------------------
    def _stored(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        return self._stored([*self.manifest(version)[1].values()])

    def save(self, rows: DataFrame) -> None:
        """The whole table anew (K3)."""
        self._commit(self.manifest()[0] + 1, self._written(rows))

    def clear(self) -> None:
        self._commit(self.manifest()[0] + 1, {})

    def replace(self, keys: DataFrame, rows: DataFrame | None, key: tuple[str, ...] | None = None, stored: bool = False) -> None:
        """All rows whose key is in keys are replaced by rows (K1, K2, K4: no rows deletes).

        stored: keys and rows are read from tables that stay as they are, so they need not be written once more.
        """
        key = key or (self.column,)
        version, now = self.manifest()
        bucket = F.pmod(F.xxhash64(self.column), F.lit(self.buckets)).cast("int").alias("b")
        with Scratch(self.spark) as scratch:
            keys = keys.select(*key)
            if not stored:
                keys, rows = scratch.write(keys.distinct()), rows if rows is None else scratch.write(rows)
            at = keys.select(bucket) if rows is None else keys.select(bucket).union(rows.select(bucket))
            touched = {str(r.b) for r in at.distinct().collect()}  # at most `buckets` rows
            held = [f for b, f in now.items() if b in touched]
            left = self._stored(held).join(keys, list(key), "left_anti") if held else None
            parts = [p for p in (left, rows) if p is not None]
            new = self._written(reduce(lambda x, y: x.select(*y.columns).unionByName(y), parts)) if parts else {}
        self._commit(version + 1, {b: f for b, f in now.items() if b not in touched} | new)

    def append(self, rows: DataFrame) -> None:
        """rows besides those that are there."""
        self.replace(rows.select(self.column).where("false"), rows)

    def upsert(self, rows: DataFrame, key: tuple[str, ...]) -> None:
        """rows take the place of those of equal keys, the last of equal ones in any order (K1, K2)."""
        once = rows.dropDuplicates(list(key))
        self.replace(once, once, key)


#: Columns of the tables, so that an empty one can be read.
SCHEMAS = {
    "functions": "path string, name string, line int, end_line int, return_type string, calls array<string>",
    "structs": "path string, name string, line int, refs array<string>",
    "versions": "path string, mtime timestamp, size bigint, hash bigint",
}

#: What is kept of the symbols of a file that is read.
READ = "path string, kind string, name string, line int, end_line int, return_type string, calls array<string>, refs array<string>"


class SymbolIndex:
    """Tables functions, structs and versions below one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tables = {name: BucketedTable(spark, f"{self.folder}/{name}", schema, buckets) for name, schema in SCHEMAS.items()}

    @classmethod
    def temporary(cls, spark: SparkSession, buckets: int = 64) -> SymbolIndex:
        """An empty index in the shared folder, for one session (M6)."""
        index = cls(spark, new_path(spark, "index"), buckets)
        index.clear()
        return index

    def clear(self) -> None:
        for t in self.tables.values():
            t.clear()

    def read(self, table: str) -> DataFrame:
        return self.tables[table].read()

    def save(self, table: str, rows: DataFrame) -> None:
        self.tables[table].save(rows)

    def replace_files(self, table: str, paths: DataFrame, rows: DataFrame, stored: bool = False) -> None:
        self.tables[table].replace(paths, rows, stored=stored)

    def remove_files(self, paths: DataFrame) -> None:
        """Forget files and all their symbols (K4, ST4)."""
        with Scratch(self.spark) as scratch:
            paths = scratch.write(paths.select("path").distinct())
            for t in self.tables.values():
                t.replace(paths, None, stored=True)

    def changed(self, snapshot: DataFrame) -> DataFrame:
        """Files of snapshot(path, mtime, size) that need to be read again."""
        return R.needs_reindex(snapshot, self.read("versions"), by_size=True)

    def refresh(self, files: DataFrame) -> DataFrame:
        """Read again what has changed of files(path, mtime, size, content), by the hash of the content, and return its paths (S6, ST4).

        A file that only has a new time keeps its symbols and gets the new time.
        """
        from runpath.sources import c_front

        with Scratch(self.spark) as scratch:
            before = self.read("versions").select("path", F.col("hash").alias("__h"), F.col("mtime").alias("__m"))
            now = files.select("path", "mtime", "size", T.content_hash("content").alias("hash"))
            state = scratch.write(now.join(before, "path", "left"))
            stale = state.where("__h is null or __h <> hash").select("path")
            again = c_front.dealt(files).join(stale, "path", "left_semi")
            rows = scratch.write(c_front.rows_of(again, READ, c_front.symbols_of).where("kind <> 'error'"))
            self.replace_files("functions", stale, rows.where("kind = 'function'").select("path", "name", "line", "end_line", "return_type", "calls"), stored=True)
            self.replace_files("structs", stale, rows.where("kind = 'struct'").select("path", "name", "line", "refs"), stored=True)
            touched = state.where("__h is null or __h <> hash or __m is null or __m <> mtime")
            self.replace_files("versions", touched, touched.select("path", "mtime", "size", "hash"), stored=True)
            return scratch.keep(stale)

    def stats(self) -> DataFrame:
        """(what, n) of functions, structs and files (A1)."""
        return R.index_stats(self.read("functions"), self.read("structs"), self.read("versions"))


class DefinitionIndex:
    """Symbols of files, kept by the chunks that they are cut into: a chunk that is there is not read again, wherever it stands.

    places(path, ord, first_line, hash) tells the chunks of each file; rows holds the symbols of each distinct chunk, lines
    counted from its first.  Chunks that many files share are read once.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        from runpath.sources import c_front

        folder = folder.rstrip("/")
        self.spark = spark
        self.places = BucketedTable(spark, f"{folder}/places", "path string, ord int, first_line int, hash string", buckets)
        self.rows = BucketedTable(spark, f"{folder}/rows", c_front.SYMBOLS.replace("path string", "hash string", 1), buckets, "hash")

    @classmethod
    def temporary(cls, spark: SparkSession, buckets: int = 64) -> DefinitionIndex:
        return cls(spark, new_path(spark, "definitions"), buckets)

    def refresh(self, files: DataFrame) -> DataFrame:
        """Take in files(path, content); returns the chunks (hash, content) that had to be read.

        Rows of new chunks are committed before the places that name them, so that what is read is whole at any time.
        """
        from runpath.sources import c_chunks

        with Scratch(self.spark) as scratch:
            found = scratch.write(c_chunks.chunks(files))
            new = scratch.write(found.dropDuplicates(["hash"]).join(self.rows.read().select("hash").distinct(), "hash", "left_anti").select("hash", "content"))
            self.rows.append(c_chunks.symbols(new))
            self.places.replace(files.select("path"), found.drop("content"))
            return scratch.keep(new)

    def remove_files(self, paths: DataFrame) -> None:
        self.places.replace(paths.select("path"), self.places.read().where("false"))

    def symbols(self) -> DataFrame:
        """The columns of c_front.symbols, of all files."""
        from runpath.sources import c_chunks

        return c_chunks.placed(self.places.read(), self.rows.read())

    def vacuum(self) -> None:
        """Forget chunks that no file has any more, and what is left of older versions."""
        gone = self.rows.read().select("hash").distinct().join(self.places.read().select("hash").distinct(), "hash", "left_anti")
        self.rows.replace(gone, self.rows.read().where("false"))
        self.rows.vacuum(1)
        self.places.vacuum(1)
