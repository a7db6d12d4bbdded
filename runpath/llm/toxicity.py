"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs with one
word left out.  One task fits the model on a bounded sample of labelled rows
(``max_fit_rows``); per-coordinate rates and the L1 term leave few non-zero
weights, at most 2**bits, which are broadcast for scoring.

Defined results: a null or empty text has no features and gets the score of the
bias alone; a null id is hashed as an empty string by the split; rows of a
repeated id each get the same score as their text, and each is learnt from; labels
that are null, and labels without a document, teach nothing, of different labels
of one id the larger counts; when no row can be learnt from, every score is 0.0
plus the bias of an untrained model (0.5).  Texts are read whole, however long; a
tie with the threshold counts as toxic.  An empty table gives no rows.  Columns
besides id and text pass through, but for one that has the name of the score's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runpath.llm import kernel
from runpath.llm.storage import small_batches


@dataclass(frozen=True)
class ToxicityParams:
    """max_fit_rows bounds the labelled rows that the one fitting task sees, at any input size."""

    bits: int = 21
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 4
    max_fit_rows: int = 12_000
    threshold: float = 0.3
    seed: int = 7


PARAMS = ToxicityParams()

#: Texts, and bytes of them, whose features are held at a time.
CHUNK, CHUNK_BYTES = 256, 1 << 20


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) of every n-gram occurrence, unordered, repeats kept."""
    h, first = kernel.word_hashes(column)
    own = kernel.owner(first)
    shift = np.uint64(64 - bits)
    docs, feats = [own], [h >> shift]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(h) > gap:
            same = own[gap:] == own[:-gap]
            pair = kernel.combine(h[:-gap], h[gap:] ^ np.uint64(salt))
            docs.append(own[gap:][same])
            feats.append((pair >> shift)[same])
    return np.concatenate(docs), np.concatenate(feats).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal state of a logistic regression with binary features."""

    def __init__(self, p: ToxicityParams):
        self.p = p
        self.z = np.zeros((1 << p.bits) + 1)
        self.n = np.zeros((1 << p.bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        p, z = self.p, self.z[at]
        w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2)
        return np.where(np.abs(z) <= p.l1, 0.0, w)

    def update(self, feats: np.ndarray, y: float) -> None:
        """One example: feats are distinct; the last coordinate is the bias."""
        at = np.append(feats.astype(np.int64), len(self.z) - 1)
        w = self.weights(at)
        g = float(sigmoid(np.asarray(w.sum()))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g


def _feature_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernel.chunks(batches, CHUNK, CHUNK_BYTES):
            doc, feat = features(b.column("text"), bits)
            keys = np.unique((doc << bits) | feat)
            doc, feat = keys >> bits, (keys & ((1 << bits) - 1)).astype("<u4")
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            rows = [feat[cut[i] : cut[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("rank"), b.column("label"), pa.array(rows, pa.binary())], names=["rank", "label", "feats"])

    return kernel.trimmed(run)


def _fit_rows(p: ToxicityParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows = Ftrl(p), []
        for b in batches:
            rows += [(np.frombuffer(f, dtype="<u4"), float(y)) for f, y in zip(b.column("feats").to_pylist(), b.column("label").to_pylist(), strict=True)]
        order = np.random.default_rng(p.seed)
        for _ in range(p.epochs):
            for i in order.permutation(len(rows)):
                model.update(*rows[i])
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["feature", "weight"])

    return kernel.trimmed(run)


def held_out(doc_id: str = "doc_id", parts: int = 4, kept_out: int = 2):
    """Column: the row belongs to the part that nothing is learnt from."""
    return F.coalesce(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == kept_out, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, p: ToxicityParams = PARAMS) -> DataFrame:
    """Weights (feature, weight) learnt from labelled rows outside the held-out part.

    The sample is the labelled ids whose hash lies in the share max_fit_rows / all of them, so
    it does not depend on the order of rows; the expected size is bounded at every input size.
    """
    small_batches(documents.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label")).where(~held_out())
    total = known.count()
    space = 1 << 24
    share = space if total <= p.max_fit_rows else int(space * p.max_fit_rows / total)
    sample = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(p.seed)), F.lit(space)) < share)
    rows = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        .join(F.broadcast(sample), "doc_id")  # at most about max_fit_rows narrow rows
        .select(F.xxhash64("doc_id", "text").alias("rank"), "label", "text")
    )
    feats = rows.mapInArrow(_feature_rows(p.bits), "rank long, label int, feats binary")
    return feats.repartition(1).sortWithinPartitions("rank").mapInArrow(_fit_rows(p), "feature long, weight double")


def scorer(spark: SparkSession, weights: DataFrame, p: ToxicityParams = PARAMS):
    """A column function text -> score; at most 2**bits weights are collected and broadcast."""
    found = weights.toPandas()
    dense = np.zeros((1 << p.bits) + 1, dtype=np.float32)
    dense[found["feature"].to_numpy(np.int64)] = found["weight"].to_numpy(np.float64)
    at = np.flatnonzero(dense)
    shared = spark.sparkContext.broadcast((at.astype(np.int32), dense[at]))
    bits = p.bits
    cache: dict[str, np.ndarray] = {}

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        if "w" not in cache:
            w = np.zeros((1 << bits) + 1, dtype=np.float32)
            w[shared.value[0]] = shared.value[1]
            cache["w"] = w
        w, out = cache["w"], []
        for part in kernel.chunks(iter([pa.RecordBatch.from_arrays([text], names=["text"])]), CHUNK, CHUNK_BYTES):
            doc, feat = features(part.column("text"), bits)
            hit = w[feat] != 0
            keys = np.unique((doc[hit] << bits) | feat[hit])
            total = np.bincount(keys >> bits, weights=w[keys & ((1 << bits) - 1)], minlength=part.num_rows)
            out.append(sigmoid(total + w[-1]))
        kernel.trim()
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return lambda column: score(F.col(column).cast("binary"))


def score_toxicity(documents: DataFrame, labels: DataFrame, p: ToxicityParams = PARAMS, score_col: str = "score") -> DataFrame:
    """documents and its score; every row is kept."""
    score = scorer(documents.sparkSession, fit(documents, labels, p), p)
    return documents.withColumn(score_col, score("text"))


def reject_toxic(documents: DataFrame, labels: DataFrame, p: ToxicityParams = PARAMS) -> DataFrame:
    """documents without the rows scored at the threshold or above; same columns."""
    score = scorer(documents.sparkSession, fit(documents, labels, p), p)
    # Rows go whole, in one column, so that no name of theirs meets one of ours.
    scored = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), score("text").alias("score"))
    return scored.where(F.col("score") < p.threshold).select(*(F.col("row")[c].alias(c) for c in documents.columns))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(documents.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PARAMS.threshold).cast("int").alias("predicted"))
