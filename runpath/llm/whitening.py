"""Whitening of vectors by their leading principal components, without forming a covariance matrix.

Vectors become integers, x = floor(scale * c) + shift.  The model is fitted on each
distinct integer vector once: a stored table, over which Spark sums.  The leading
eigenvectors of its covariance V come from block Lanczos: each step multiplies a block of
directions by V in one distributed pass (Xᵀ(X v) of centred rows, a d x block partial sum
from each task), makes the product orthogonal to the whole basis, twice, and goes on with
it.  Directions that vanish (the basis is invariant) are replaced by random ones, a
restart; a basis of ``max_basis`` directions is cut back to its best Ritz vectors.  It
ends when the residuals |Vu - eu| of all wanted pairs are below ``tolerance`` times the
largest eigenvalue, or when the basis spans the whole space.  Only d x basis numbers are
on the driver; the model of d x components numbers is broadcast.

With S the sums of the fit list and n its length, rows are centred exactly: n*x - S is
formed in integers.  The trace of V is the sum of the squares of these deviations.

Defined results: vectors that are null, empty or hold a null, or a component that is not
finite or of 2^55 and more, take no part; vectors of each length are fitted and whitened
by themselves; each of equal rows gets its rows, also without an id; components whose
variance is below ``least_share`` of the largest can't be told from none and are not
returned, so a list of one distinct vector, like an empty table, gives no rows; a
deviation that does not fit a long is null.  Columns besides id and vector are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath.llm import kernel
from runpath.llm.storage import Tables


@dataclass(frozen=True)
class WhiteningParams:
    components: int = 16
    scale: int = 64
    shift: int = 1_000_000
    #: Directions multiplied in one pass.
    block: int = 16
    #: Directions held at a time.
    max_basis: int = 512
    #: Passes at most; residuals that rounding keeps above the tolerance end there.
    max_passes: int = 200
    tolerance: float = 1e-14
    least_share: float = 1e-11
    seed: int = 11


PARAMS = WhiteningParams()

#: Rows whose doubles are held at a time.
CHUNK = 4096


def integers(vector: Column, p: WhiteningParams = PARAMS) -> Column:
    """The integer vector, null where it takes no part."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= 2.0**55))
    return F.when((F.size(x) > 0) & ~bad, F.transform(x, lambda v: F.floor(v * p.scale).cast("long") + F.lit(p.shift).cast("long")))


@dataclass(frozen=True)
class Centre:
    """n and S of a fit list as whole numbers: S = n * whole + rest, so that n*x - S = n * (x - whole) - rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(n: int, sums: list[int]) -> Centre:
        return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exactly: int64 where its squares' sums fit, else Python integers."""
        dx = x - self.whole
        reach = (int(np.abs(dx).max(initial=0)) + 1) * self.n
        if reach * reach * x.shape[1] < 2**63:
            return self.n * dx - self.rest
        return dx.astype(object) * self.n - self.rest.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)


def vectors(batches: Iterator[pa.RecordBatch], length: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their integer vectors as a matrix) of at most CHUNK rows, all of the given length."""
    for b in batches:
        for lo in range(0, b.num_rows, CHUNK):
            part = b.slice(lo, CHUNK)
            flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
            if part.num_rows:
                yield part, flat.reshape(part.num_rows, length or -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for _, x in vectors(batches):
        s = x.astype(object).sum(axis=0) if int(np.abs(x).max()) > 2**50 else x.sum(axis=0).astype(object)
        total = s if total is None else total + s
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(s) for s in total], pa.string())], names=["i", "s"])


def _added(parts: Callable[[np.ndarray], np.ndarray]):
    """Task function: (i, values) of the matrix that parts() makes of each chunk of vectors, added up over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in vectors(batches):
            m = parts(x)
            total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    return kernel.trimmed(run)


def add_up(fit: DataFrame, shape: tuple[int, int], parts: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all vectors of the matrices (of the given shape) that parts() makes of chunks of them."""
    tasks = fit.mapInArrow(_added(parts), "i int, v array<double>")
    sums = tasks.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros(shape)
    for r in sums.collect():  # a number for each entry of the matrix
        out[r.i, r.j] = r.v
    return out


def orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Unit directions orthogonal to the basis and each other that span block; random ones in place of those that vanish."""
    out = basis
    for column in block.T:
        size = np.linalg.norm(column)
        fresh = size == 0
        while True:
            v = rng.standard_normal(len(column)) if fresh else column / size
            before = np.linalg.norm(v)
            for _ in range(2):
                v = v - out @ (out.T @ v)
            after = np.linalg.norm(v)
            if after > before * 1e-10:
                break
            fresh = True
        v = v / after
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
        if out.shape[1] == len(column):
            break
    return out[:, basis.shape[1] :]


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], d: int, p: WhiteningParams = PARAMS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric d x d operator: the leading ones, at most p.components."""
    rng = np.random.default_rng(p.seed)
    wanted = min(p.components, d)
    basis = images = np.zeros((d, 0))
    block = rng.standard_normal((d, min(max(p.block, wanted), d)))
    for number in range(p.max_passes):
        block = orthogonal(block, basis, rng)
        basis, images = np.column_stack([basis, block]), np.column_stack([images, multiply(block)])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        found = basis @ turns[:, :wanted]
        residual = np.linalg.norm(images @ turns[:, :wanted] - found * values[:wanted], axis=0)
        if basis.shape[1] == d or (number and (residual <= p.tolerance * abs(values[0])).all()):
            break
        block = images[:, -block.shape[1] :]
        if basis.shape[1] + block.shape[1] > max(p.max_basis, 4 * wanted):
            keep = turns[:, : 2 * wanted]
            basis, images = basis @ keep, images @ keep
    return values[:wanted], found / np.linalg.norm(found, axis=0)


@dataclass(frozen=True)
class Model:
    """What whitens vectors of one length."""

    centre: Centre
    turn: np.ndarray  # d x components, each divided by the root of its eigenvalue
    explained: np.ndarray
    identity_error: float


def fit_length(fit: DataFrame, p: WhiteningParams = PARAMS) -> Model | None:
    """Fit on a table of distinct vectors x of one length; None if they do not vary."""
    n = fit.count()
    sums = fit.mapInArrow(_sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    centre = Centre.of(n, [int(r.s) for r in sorted(sums.collect(), key=lambda r: r.i)])
    d = len(centre.whole)

    def multiply(block: np.ndarray) -> np.ndarray:
        def parts(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ block)

        return add_up(fit, block.shape, parts) / n

    values, found = block_lanczos(multiply, d, p)
    there = values > max(values[0], 0) * p.least_share
    if not there.any():
        return None
    values, turn = values[there], found[:, there] / np.sqrt(values[there])
    k = len(values)

    def checked(x: np.ndarray) -> np.ndarray:
        """Products of whitened rows, their sums, and the sum of deviations."""
        v = centre.scaled(x)
        w = (v / n).astype(np.float64) @ turn
        out = np.zeros((k + 2, k))
        out[:k], out[k], out[k + 1, 0] = w.T @ w, w.sum(axis=0), float((v * v).sum(axis=1).astype(np.float64).sum())
        return out

    sums_of = add_up(fit, (k + 2, k), checked)
    mean = sums_of[k] / n
    error = float(np.abs(sums_of[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    trace = sums_of[k + 1, 0] / n / n / n
    return Model(centre, turn, values / trace, error)


def fit_models(rows: DataFrame, vector_col: str = "embedding", p: WhiteningParams = PARAMS) -> dict[int, Model]:
    """Length -> model of the vectors of that length."""
    with Tables(rows.sparkSession) as tables:
        distinct = rows.select(integers(F.col(f"`{vector_col}`"), p).alias("x")).where("x is not null").distinct()
        fit = tables.write(distinct.withColumn("d", F.size("x")), "fit", ["d"])
        lengths = sorted(r.d for r in fit.select("d").distinct().collect())
        models = {d: fit_length(fit.where(F.col("d") == d).select("x"), p) for d in lengths}
    return {d: m for d, m in models.items() if m is not None}


def _whiten(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[int, Model] = shared.value
        for b in batches:
            lengths = b.column("x").value_lengths()
            for d, m in models.items():
                for part, x in vectors(iter([b.filter(pa.compute.equal(lengths, d))]), d):
                    v = m.centre.scaled(x)
                    whitened = (v / m.centre.n).astype(np.float64) @ m.turn
                    deviation = [s if s < 2**63 else None for s in (v * v).sum(axis=1).tolist()]
                    k, rows = m.turn.shape[1], part.num_rows
                    every = np.repeat(np.arange(rows), k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id").take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, m.centre.n)),
                            pa.array(deviation, pa.int64()).take(pa.array(every)), pa.array(whitened.ravel()), pa.array(np.tile(m.explained, rows)), pa.array(np.full(rows * k, m.identity_error)),
                        ],
                        names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return kernel.trimmed(run)


def whiten(rows: DataFrame, p: WhiteningParams = PARAMS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector that takes part and each component."""
    models = fit_models(rows, vector_col, p)
    shared = rows.sparkSession.sparkContext.broadcast(models)
    x = rows.select(F.col(f"`{id_col}`").alias("id"), integers(F.col(f"`{vector_col}`"), p).alias("x")).where("x is not null")
    kind = rows.schema[id_col].dataType.simpleString()
    out = x.mapInArrow(_whiten(shared), f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)


def op11_block_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: DuckDB: the exact part, which needs no eigenvectors.
DEVIATIONS_SQL = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), f AS (SELECT DISTINCT x FROM x),
s AS (SELECT len(x) AS d, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM f, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY 1, 2),
v AS (SELECT d, any_value(n) AS n, list(s ORDER BY i) AS s FROM s GROUP BY d)
SELECT vec_id, n, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (n * x[i] - s[i]) * (n * x[i] - s[i]))) AS BIGINT) AS deviation
FROM x JOIN v ON v.d = len(x.x)
"""
