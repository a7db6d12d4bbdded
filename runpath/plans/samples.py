"""Training samples from the knowledge tables, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runpath.functions import text as T


def samples(kb: dict[str, DataFrame]) -> DataFrame:
    """(task, instruction, input, output, metadata): callbacks and call chains as questions and answers."""
    cb = kb["callbacks"]
    meta = lambda **k: F.create_map(*(x for a, b in k.items() for x in (F.lit(a), b)))
    when = cb.select(
        F.lit("callback_timing").alias("task"), F.lit("When is this callback called?").alias("instruction"), F.concat_ws(".", "framework", "callback").alias("input"),
        F.col("description").alias("output"), meta(framework=F.col("framework")).alias("metadata"),
    )
    what = cb.select(
        F.lit("function_pointer_target").alias("task"), F.lit("What is the signature of this callback?").alias("instruction"), F.concat_ws(".", "framework", "callback").alias("input"),
        F.col("signature").alias("output"), meta(framework=F.col("framework")).alias("metadata"),
    )
    ordered = kb["chains"].groupBy("chain_id", "trigger").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "function"))), lambda s: s["function"]).alias("nodes"))
    chain = ordered.select(
        F.lit("call_chain").alias("task"), F.concat(F.lit("Which calls follow: "), "trigger").alias("instruction"), F.col("chain_id").alias("input"), T.numbered("nodes").alias("output"), meta(chain=F.col("chain_id")).alias("metadata")
    )
    nested = ordered.select(
        F.lit("call_chain").alias("task"), F.concat(F.lit("Draw the call chain of "), "chain_id").alias("instruction"), F.col("trigger").alias("input"), T.nested_chain("nodes").alias("output"), meta(chain=F.col("chain_id")).alias("metadata")
    )
    sleep = kb["apis"].select(
        F.lit("sync_mechanism").alias("task"), F.lit("May this function sleep?").alias("instruction"), F.col("name").alias("input"), F.when(F.col("can_sleep"), "yes").otherwise("no").alias("output"), meta(api=F.col("name")).alias("metadata")
    )
    return when.unionByName(what).unionByName(chain).unionByName(nested).unionByName(sleep)


def of_functions(functions: DataFrame, kb: dict[str, DataFrame]) -> DataFrame:
    """(path, task, instruction, input, output, metadata) of functions(path, name, framework) that stand for a known callback: the samples of the knowledge, asked of the function."""
    known = samples(kb).where("task in ('callback_timing', 'function_pointer_target')").withColumnRenamed("input", "framework")
    hit = functions.where("framework is not null").select("path", F.col("name").alias("input"), "framework").join(F.broadcast(known), "framework")
    return hit.select("path", "task", "instruction", "input", "output", "metadata")


def save(rows: DataFrame, folder: str, by_task: bool = False) -> None:
    """JSON lines, one folder for each task if by_task (K9)."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("task") if by_task else writer).json(folder)


def with_thinking(rows: DataFrame) -> DataFrame:
    """thinking and answer in one output."""
    return rows.withColumn("output", F.concat(F.lit("<think>\n"), "thinking", F.lit("\n</think>\n\n"), "answer")).drop("thinking", "answer")
