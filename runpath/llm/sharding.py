"""Sharding by fixed virtual slots.

Records hash into ``slots`` virtual slots for good; a small versioned map says
which shard holds each slot.  Bytes are summed by slot (partial sums before the
shuffle).  Version 1 deals the slots out in turn; a rebalance edits the map: it
moves slots from the fullest shard to the emptiest as long as this brings the
two closer, and writes the next version.  The versions of a corpus stand in one
folder (``map_path``): a run starts from the last whole one, so few slots move
when the corpus grows, and it writes no version if no slot moves.  A version is
written aside and renamed, which fails where it is there already: of two runs at
once one starts again from the other's version.  Without a folder a run has a map
of its own, so that its result follows from the rows alone.  Only the map, of
``slots`` rows at any input size, reaches the driver.

The law of the query is ``bytes``: the sizes of shards are near equal.  Within a
shard each row has a place, gapless from 0, counted by slot first: the slots of
a shard follow one another, and rows are ranked within their slot only.  Equal
texts (groups of copies) are not kept together: rows of other ids have slots of
their own, and so a group of any size is spread over the shards.

Defined results: a null text counts 0 bytes and has the checksum of an empty
text; rows hash by id, size and text checksum, so null ids spread; equal rows
share a slot and get different places in any order; an empty table has an empty
result; texts of any length count whole; columns besides id and text are not
looked at, whatever their names.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runpath.llm.storage import children, exists, materialize, new_path, remove


@dataclass(frozen=True)
class ShardParams:
    """shards to fill, virtual slots (fixed for the life of a corpus), bytes a record takes besides its text."""

    shards: int = 40
    slots: int = 8192
    overhead: int = 16


PARAMS = ShardParams()

def initial_map(p: ShardParams = PARAMS) -> list[int]:
    """Shard of each slot in version 1: dealt out in turn."""
    return [s % p.shards for s in range(p.slots)]


def rebalance(shard_of: list[int], bytes_of: list[int], shards: int) -> list[int]:
    """The next version: slots move from the fullest to the emptiest shard while that narrows the gap.

    With more shards than before, the new ones start empty and slots move into them first.
    """
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    load = [0] * shards
    for slot, s in enumerate(shard_of):
        load[s] += bytes_of[slot]
        if bytes_of[slot]:
            held[s].append((bytes_of[slot], slot))
    out = list(shard_of)
    for h in held:
        h.sort()
    low = [(load[s], s) for s in range(shards)]
    heapq.heapify(low)
    high = [(-load[s], s) for s in range(shards)]
    heapq.heapify(high)
    while high and low:
        while low and load[low[0][1]] != low[0][0]:
            heapq.heappop(low)
        while high and load[high[0][1]] != -high[0][0]:
            heapq.heappop(high)
        if not high or not low:
            break
        a, b = high[0][1], low[0][1]
        gap = load[a] - load[b]
        # The largest slot that at most halves the gap, else the smallest that still narrows it.
        fit = [x for x in held[a] if 0 < x[0] < gap]
        if not fit:
            break
        size, slot = min(fit, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        held[a].remove((size, slot))
        held[b].append((size, slot))
        load[a] -= size
        load[b] += size
        out[slot] = b
        for s in (a, b):
            heapq.heappush(low, (load[s], s))
            heapq.heappush(high, (-load[s], s))
    return out


def records(documents: DataFrame, p: ShardParams = PARAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of each row."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = documents.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + p.overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(p.slots)).cast("int"))


def last_version(spark: SparkSession, map_path: str, p: ShardParams = PARAMS) -> tuple[int, list[int]] | None:
    """Number and shards of the last version that was written whole."""
    numbers = [int(n.split("=")[1]) for n in children(spark, map_path) if n.startswith("version=") and exists(spark, f"{map_path}/{n}/_SUCCESS")]
    if not numbers:
        return None
    rows = spark.read.parquet(f"{map_path}/version={max(numbers)}").select("vslot", "shard").collect()  # slots rows
    if len(rows) != p.slots:
        raise ValueError(f"the map at {map_path} has {len(rows)} slots, not {p.slots}: their number is fixed for the life of a corpus")
    shard_of = [0] * p.slots
    for r in rows:
        shard_of[r.vslot] = r.shard
    return max(numbers), shard_of


def _write_version(spark: SparkSession, map_path: str, version: int, shard_of: list[int], bytes_of: list[int]) -> bool:
    """Write a version whole or not at all; False if another run has written it in the meantime."""
    n = len(shard_of)
    table = pa.table({"vslot": pa.array(range(n), pa.int32()), "shard": pa.array(shard_of, pa.int32()), "bytes": pa.array(bytes_of, pa.int64())})
    draft = f"{map_path}/draft-{uuid.uuid4().hex}"
    spark.createDataFrame(table).coalesce(1).write.parquet(draft)  # slots rows
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        # Fails where the version is there already.
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(map_path).toUri(), conf).rename(path(draft), path(f"{map_path}/version={version}"), plain)
    except Py4JJavaError:
        remove(spark, draft)
        if not exists(spark, f"{map_path}/version={version}"):
            raise
        return False
    return True


def slot_map(rows: DataFrame, p: ShardParams = PARAMS, map_path: str | None = None) -> DataFrame:
    """(vslot, shard, version) of the version that fits rows, which is written to map_path unless it is there."""
    spark = rows.sparkSession
    map_path = map_path or new_path(spark, "slot-map")
    bytes_of = [0] * p.slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect():  # at most p.slots rows
        bytes_of[r.vslot] = r.bytes
    while True:  # once more where another run was first with a version
        known = last_version(spark, map_path, p)
        version, shard_of = known or (1, initial_map(p))
        if known is None and not _write_version(spark, map_path, 1, shard_of, bytes_of):
            continue
        balanced = rebalance(shard_of, bytes_of, p.shards)
        if balanced == shard_of:
            break
        version += 1
        if _write_version(spark, map_path, version, balanced, bytes_of):
            break
    return spark.read.schema("vslot int, shard int, bytes bigint").parquet(f"{map_path}/version={version}").select("vslot", "shard", F.lit(version).alias("version"))


def shard(documents: DataFrame, p: ShardParams = PARAMS, map_path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version), one row for each row of documents."""
    rows = materialize(records(documents, p), "records")
    placed = slot_map(rows, p, map_path)
    counts = rows.groupBy("vslot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.join(counts, "vslot").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("rank", rank).join(F.broadcast(starts), "vslot")  # p.slots rows at any input size
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"),
    )


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
