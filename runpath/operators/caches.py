"""Caches as tables: preprocessed texts, parse results, and the level at which an entry is held."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath import fixed
from runpath.functions import text as T
from runpath.operators import relational as R
from runpath.operators.index import BucketedTable
from runpath.operators.storage import new_path

#: An entry is valid for equal options, time and content of its file.
KEY = ["path", "options_hash", "mtime", "content_hash"]
SCHEMA = "path string, options_hash bigint, mtime bigint, content_hash bigint, text string"


class TextCache:
    """Preprocessed text by path.  A disabled cache keeps and finds nothing."""

    def __init__(self, spark: SparkSession, folder: str | None = None, enabled: bool = True, buckets: int = 64):
        self.enabled = enabled
        self.table = BucketedTable(spark, folder or new_path(spark, "cache"), SCHEMA, buckets)
        if folder is None:
            self.table.clear()

    def read(self) -> DataFrame:
        rows = self.table.read()
        return rows if self.enabled else rows.where("false")

    def get(self, requests: DataFrame) -> DataFrame:
        """requests(path, options_hash, mtime, content_hash) that the cache answers, with their text."""
        return hits(requests, self.read())

    def put(self, rows: DataFrame) -> None:
        """rows(path, options_hash, mtime, content_hash, text) take the place of what their paths had."""
        if self.enabled:
            self.table.upsert(rows.select(*KEY, "text"), ("path",))

    def invalidate(self, paths: DataFrame) -> None:
        self.table.replace(paths, self.table.read().where("false"))

    def clear(self) -> None:
        if self.enabled:
            self.table.clear()

    def stats(self) -> DataFrame:
        """(entries, bytes, size): one row."""
        return stats(self.read().select(F.octet_length("text").alias("bytes")))

    def save_index(self, folder: str) -> None:
        """The entries without their texts as JSON lines, with the name of the file that would hold the text."""
        self.read().select(*KEY, T.hex_name(T.content_hash("path")).alias("cache_file")).write.mode("overwrite").json(folder)

    @staticmethod
    def load_index(spark: SparkSession, folder: str) -> DataFrame:
        return spark.read.schema("path string, options_hash bigint, mtime bigint, content_hash bigint, cache_file string").json(folder)


def hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose options, time and content are those of the cache."""
    return requests.join(cache, KEY)


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select(*KEY), KEY, "left_anti")


def read_through(requests: DataFrame, cache: TextCache, make) -> DataFrame:
    """Texts of requests(path, options_hash, mtime, content_hash, content): from the cache, or made from the content and put there."""
    cache.put(make(misses(requests, cache.read())).select(*KEY, "text"))
    return cache.get(requests.select(*KEY))


def stats(entries: DataFrame, capacity: int | None = None) -> DataFrame:
    """(entries, bytes, size[, capacity]) of entries(bytes)."""
    out = entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes")).withColumn("size", T.human_size("bytes"))
    return out if capacity is None else out.withColumn("capacity", F.lit(capacity))


def valid_results(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Parse results of cache(path, hash, ...) whose file still has the same content (ST1, M13). files(path, content)."""
    return cache.join(files.select("path", T.content_hash("content").alias("hash")), ["path", "hash"])


def levels(accesses: DataFrame, key: str, seq: str, hot: int, capacity: int = fixed.CACHE_ENTRIES) -> DataFrame:
    """(key, last_used, level): the keys touched last are held hot, the next ones in the LRU cache, all others on disk.

    Only the keys of the upper two levels are put in order.
    """
    last = accesses.groupBy(key).agg(F.max(seq).alias("last_used"))
    top = R.lru(accesses, key, seq, hot + capacity).select(key, "last_used")
    first = top.orderBy(F.desc("last_used"), key).limit(hot).select(key, F.lit("hot").alias("level"))
    held = top.join(first, key, "left").withColumn("level", F.coalesce("level", F.lit("lru")))
    return last.join(F.broadcast(held.select(key, "level")), key, "left").withColumn("level", F.coalesce("level", F.lit("disk")))  # at most hot + capacity rows
