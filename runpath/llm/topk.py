"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors are turned into integers (floor of 1024 times each component).  Queries
are dealt into blocks of about ``query_block``; each pass over the rows takes
``pass_blocks`` of them, broadcasts them, and writes its results, so neither what
is broadcast nor a plan grows with the number of queries.  Within a batch of rows
the integers lie in vertical layout, one array for each dimension.  Inner products
are accumulated block of dimensions by block, largest query components first.
After each block the largest value a row can still reach is its sum so far plus
the product of the norms of what remains of query and row (Cauchy-Schwarz); rows
that cannot reach the k-th best score so far are dropped and the survivors are
compacted.  The bound is rounded up, so the result is exact, ties included.

A pass begins with an exact search among ``seed_rows`` of the rows, about, chosen by
a hash of their id; its k-th best scores are floors that all tasks start from.
Each task keeps k rows for each query; their union is ranked by query.

Defined results: vectors that are null, empty or hold a null or a component that
is not finite take no part, neither as queries nor as candidates; a query meets
only rows of its own dimension; rows of the query's own vec_id are its own and
are no candidates; of a repeated query id the row of the smallest vector is the
query; repeated rows of another id are candidates each; of equal scores the
smaller vec_id comes first; an empty table gives no rows; vectors of any length
are compared whole; columns besides id and vector are not looked at.  Scores must
fit in a signed 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runpath.llm.storage import discard, materialize


@dataclass(frozen=True)
class TopKParams:
    """k results; queries are ids divisible by every; queries of a block, about; dimensions accumulated at once."""

    k: int = 10
    every: int = 100
    query_block: int = 2048
    dims_block: int = 8
    scale: int = 1024
    #: Blocks of queries that one pass over the rows takes.
    pass_blocks: int = 4
    #: Rows, about, of the search that gives each query a floor; none for tables of less than four times as many.
    seed_rows: int = 8192


PARAMS = TopKParams()


def usable(vector: Column) -> Column:
    """The vector as doubles, null where it takes no part."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & (F.size(x) > 0) & ~bad, x)


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda v: F.floor(v * scale).cast("long"))


class Block:
    """One block of queries of one dimension, with what is needed of each at every step."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dims_block: int):
        self.ids, self.vectors = ids, vectors
        self.floor: np.ndarray | None = None  # a score that the k-th best of each query reaches at least
        mass = np.square(vectors.astype(np.float64)).sum(axis=0)
        self.order = np.argsort(-mass, kind="stable")  # dimensions of most mass first
        self.steps = [self.order[i : i + dims_block] for i in range(0, len(self.order), dims_block)]
        left = np.stack([np.square(vectors[:, s].astype(np.float64)).sum(axis=1) for s in self.steps])
        self.rest = np.sqrt(np.maximum(left.sum(axis=0) - np.cumsum(left, axis=0), 0))  # step x query


def search_batch(block: Block, ids: np.ndarray, vectors: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
    """Improve best (scores, ids of each query) by a batch of candidates."""
    columns = np.ascontiguousarray(vectors.T)  # vertical layout
    left = np.stack([np.square(columns[s].astype(np.float64)).sum(axis=0) for s in block.steps])
    rest = np.sqrt(np.maximum(left.sum(axis=0) - np.cumsum(left, axis=0), 0))
    for q in range(len(block.ids)):
        scores, found = best[q]
        alive = np.flatnonzero(ids != block.ids[q])
        total = np.zeros(len(alive), dtype=np.int64)
        least = scores[-1] if len(scores) >= k else None
        if block.floor is not None:
            least = block.floor[q] if least is None else max(least, block.floor[q])
        for step, dims in enumerate(block.steps):
            for d in dims:
                total += block.vectors[q, d] * columns[d][alive]
            if least is not None and step + 1 < len(block.steps):
                # Both norms are rounded; a slack of a millionth and of one keeps the bound above the truth.
                bound = total + block.rest[step, q] * rest[step][alive] * (1 + 1e-6) + 1
                keep = bound >= least
                if not keep.all():
                    alive, total = alive[keep], total[keep]
                    if not len(alive):
                        break
        if len(alive):
            s, i = np.concatenate([scores, total]), np.concatenate([found, ids[alive]])
            top = np.lexsort((i, -s))[:k]
            best[q] = s[top], i[top]


def _search(shared: Broadcast, p: TopKParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = shared.value
        best = {n: [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(b.ids) for n, b in blocks.items()}
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat, ids = lists.flatten().to_numpy(zero_copy_only=False), batch.column("vec_id").to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for n, block in blocks.items():
                rows = np.flatnonzero(sizes == n)
                for lo in range(0, len(rows), 4096):
                    at = rows[lo : lo + 4096]
                    if len(at):
                        search_batch(block, ids[at], flat[starts[at][:, None] + np.arange(n)], best[n], p.k)
        for n, block in blocks.items():
            if len(block.ids):
                count = [len(s) for s, _ in best[n]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(block.ids, count)), pa.array(np.concatenate([i for _, i in best[n]])), pa.array(np.concatenate([s for s, _ in best[n]]))],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def top_k(rows: DataFrame, queries: DataFrame, p: TopKParams = PARAMS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query."""
    spark = rows.sparkSession

    def shaped(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("vec_id"), usable(F.col(vector_col)).alias("v")).where("v is not null and vec_id is not null")
        return v.select("vec_id", integers(F.col("v"), p.scale).alias("v"))

    candidates, wanted = shaped(rows), shaped(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
    found = "query_id long, vec_id long, score long"

    def searched(blocks: dict[int, Block], among: DataFrame, name: str) -> DataFrame:
        shared = spark.sparkContext.broadcast(blocks)
        out = materialize(ranked(among.mapInArrow(_search(shared, p), found)), name)
        shared.destroy()
        return out

    n_rows = rows.count()
    seeds = candidates.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(max(n_rows // p.seed_rows, 1))) == 0) if n_rows >= 4 * p.seed_rows else None
    few = wanted.limit(p.query_block + 1).collect()  # at most a block and one
    if not few:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if len(few) <= p.query_block:
        passes = iter([few])
    else:
        n_blocks = -(-wanted.count() // p.query_block)
        stored = materialize(wanted.withColumn("pass", F.floor(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) / p.pass_blocks).cast("int")), "queries", ["pass"])
        passes = (stored.where(F.col("pass") == i).collect() for i in range(-(-n_blocks // p.pass_blocks)))  # about pass_blocks * query_block vectors at a time
    paths = []
    for block in passes:
        if not block:
            continue
        made = {n: Block(np.array([r.vec_id for r in block if len(r.v) == n], np.int64), np.array([r.v for r in block if len(r.v) == n], np.int64), p.dims_block) for n in sorted({len(r.v) for r in block})}
        if seeds is not None:
            first = searched(made, seeds, "seeds")
            floors = {r.query_id: r.score for r in first.where(F.col("rank") == p.k).select("query_id", "score").collect()}  # a row for each query of the pass
            discard(spark, first)
            for b in made.values():
                b.floor = np.array([floors.get(i, np.iinfo(np.int64).min) for i in b.ids.tolist()], np.int64)
        paths.append(searched(made, candidates, "top-k").table_path)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(*paths)


def op10_branch_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where(F.col("vec_id") % PARAMS.every == 0))


#: DuckDB: the same scores by brute force.
OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
