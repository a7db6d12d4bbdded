"""Membership filters of bounded size, so that texts need not be shuffled to meet a short list of ids.

A filter is a bit map over hashes of ids, built by partial aggregation; at any input
size it has at most BITS / 32768 rows of 4 KB, which are broadcast.  It passes every
id of the list and, the fuller it is, some others: an exact join follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB at most.
BITS = 1 << 26


def _hash(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(BITS))


def bit_map(ids: DataFrame, column: str) -> DataFrame:
    """(bucket, bits) of the ids."""
    h = ids.where(F.col(column).isNotNull()).select(_hash(column).alias("h"))
    return h.groupBy(F.bitmap_bucket_number("h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__bits"))


def split(rows: DataFrame, column: str, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be in the list, rows that are not), with the columns of rows; rows of a null id are not."""
    h = _hash(column)
    marked = rows.withColumn("__bucket", F.when(F.col(column).isNotNull(), F.bitmap_bucket_number(h))).join(F.broadcast(bits), "__bucket", "left")
    at = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substr(F.col("__bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    names = [F.col(f"`{c}`") for c in rows.columns]
    return marked.where(hit).select(*names), marked.where(~hit).select(*names)


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows whose column is not in ids (one column of that name); only rows that may be are shuffled."""
    maybe, others = split(rows, column, bit_map(ids, column))
    names = [F.col(f"`{c}`") for c in rows.columns]
    return others.union(maybe.join(ids.select(column).distinct(), column, "left_anti").select(*names))
