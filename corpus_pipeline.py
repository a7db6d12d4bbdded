"""The corpus pipeline: each stage works on all its predecessor kept.

run() applies STAGES in order, writing each result as Parquet to the shared
folder and reading it again as the next stage's documents; a result goes once the
next one is written.  All stages but the last return the columns of documents; the
last returns one row for each kept document (or copy) with its shard.

Defined results of all stages: an empty table stays empty; texts of any length are
worked on whole; columns besides doc_id, text, source and n_chars pass through,
whatever their names.  What is defined for each stage stands at its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runpath.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from runpath.llm.storage import discard, materialize


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    A null or empty text gets the score of the bias alone; a score at the threshold rejects; equal rows share their fate;
    rows without an id are scored like others.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.reject_toxic(docs, labels)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the smallest id.

    Null and empty texts are near nothing and stay; of equal rows one stays; rows of one id with different texts are
    different documents; rows without an id stay.
    """
    return near_dedup.keep_one(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut from the texts; texts that mostly consist of them go.

    Null and empty texts stay; a text of which exactly the limit is hit is cut and stays; each row is worked on by itself.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document comes up to twice.

    Null and empty texts, which have no words, are taken no times; a null source is one of its own; equal rows share their
    random number; ties in the order go to the smaller document, then the smaller id.
    """
    return mixing.take(docs)


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets a shard of near equal bytes and its place there.

    A null text has no bytes; equal rows share a slot and get different places; rows without an id are placed like others.
    """
    return sharding.shard(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
    ("shard", stage_shard),
]

#: SQL can't express a trained model; tests/llm/test_pipeline.py holds run() against plain-Python decisions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; the last stage's rows."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(spark, before)
        before = docs
    return docs
