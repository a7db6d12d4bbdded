"""What users teach: questions about calls, their answers, and the store that holds both (S11, K6, ST7, U3, U4, D14, F29)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath.errors import LearningError
from runpath.functions import text as T
from runpath.operators import relational as R
from runpath.operators.storage import checkpoint

ANNOTATIONS = "id string, call_site string, targets array<string>, note string"
QUERIES = "id string, location string, call_expr string, expected_signature string, candidates array<struct<name:string,signature:string,defined_in:string,score:int>>, reason string"
NO_REASON = "Unknown function pointer target"


def question(calls: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Queries from calls(location, call_expr, expected_signature, reason), with their candidates(id, name, signature, defined_in, score), best first."""
    asked = calls.select(
        T.query_id("location", "call_expr").alias("id"), "location", "call_expr", F.col("expected_signature").cast("string").alias("expected_signature"),
        F.coalesce(F.col("reason").cast("string"), F.lit(NO_REASON)).alias("reason"),
    )
    none = F.expr("cast(array() as array<struct<name:string,signature:string,defined_in:string,score:int>>)")
    if candidates is None:
        return asked.select("id", "location", "call_expr", "expected_signature", none.alias("candidates"), "reason")
    item = F.struct((-F.col("score")).alias("order"), "name", "signature", "defined_in", F.col("score").cast("int").alias("score"))
    lists = candidates.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("found"))
    best = F.transform("found", lambda c: F.struct(c["name"].alias("name"), c["signature"].alias("signature"), c["defined_in"].alias("defined_in"), c["score"].alias("score")))
    return asked.join(lists, "id", "left").select("id", "location", "call_expr", "expected_signature", F.coalesce(best, none).alias("candidates"), "reason")


@dataclass(frozen=True)
class LearningStore:
    """Annotations and pending queries, with the numbers of queries asked and answered.  Every change gives a new store.

    What a change adds is written once, as it is counted there and read again by what follows.
    """

    annotations: DataFrame
    pending: DataFrame
    total_queries: int = 0
    answered_queries: int = 0

    @staticmethod
    def empty(spark: SparkSession) -> LearningStore:
        return LearningStore(spark.createDataFrame([], ANNOTATIONS), spark.createDataFrame([], QUERIES))

    def add_queries(self, queries: DataFrame) -> LearningStore:
        """Queries whose id is pending already are not added, nor counted."""
        once = queries.dropDuplicates(["id"])
        new = checkpoint(once.join(self.pending.select("id"), "id", "left_anti").select(*self.pending.columns))
        return replace(self, pending=self.pending.unionByName(new), total_queries=self.total_queries + new.count())

    def annotate(self, annotations: DataFrame) -> LearningStore:
        """Annotations take the place of earlier ones of their id; each counts as an answer."""
        new = checkpoint(annotations.select(*self.annotations.columns))
        rest = self.annotations.join(new.select("id"), "id", "left_anti").select(*self.annotations.columns)
        return replace(self, annotations=rest.unionByName(new.dropDuplicates(["id"])), answered_queries=self.answered_queries + new.count())

    def answer(self, answers: DataFrame) -> LearningStore:
        """answers(id, targets, note): the queries are no longer pending, and their ids are annotated (U4, ST7)."""
        left = replace(self, pending=R.answered(self.pending, answers).select(*self.pending.columns))
        return left.annotate(answers.select("id", F.col("id").alias("call_site"), "targets", "note"))

    def clear_pending(self) -> LearningStore:
        return replace(self, pending=self.pending.where("false"))

    def merge(self, other: LearningStore) -> LearningStore:
        """What this store lacks of the other's annotations and queries."""
        return replace(self, annotations=R.keep_left(self.annotations, other.annotations, "id")).add_queries(other.pending)

    def stats(self) -> DataFrame:
        spark = self.annotations.sparkSession
        return spark.range(1).select(F.lit(self.total_queries).cast("long").alias("total"), F.lit(self.answered_queries).cast("long").alias("answered"), F.lit(0).cast("long").alias("auto_applied"))

    def apply(self, calls: DataFrame, call_site: str = "call_site") -> DataFrame:
        """calls with the targets and note that users gave for their call site; such calls are certain."""
        notes = self.annotations.select(F.col("call_site").alias(call_site), F.col("targets").alias("user_targets"), F.coalesce("note", F.lit("User annotation")).alias("user_reason"))
        out = calls.join(R.first_occurrence(notes, [call_site], ["user_reason"]), call_site, "left")
        return out.withColumn("user_confidence", F.when(F.col("user_targets").isNotNull(), "Certain"))

    def save(self, folder: str) -> None:
        """As JSON lines in three folders (K6)."""
        self.annotations.write.mode("overwrite").json(f"{folder}/annotations")
        self.pending.write.mode("overwrite").json(f"{folder}/pending")
        self.stats().write.mode("overwrite").json(f"{folder}/stats")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> LearningStore:
        """A saved store."""
        from pyspark.errors import AnalysisException

        try:
            n = spark.read.schema("total long, answered long, auto_applied long").json(f"{folder}/stats").first()
            return LearningStore(spark.read.schema(ANNOTATIONS).json(f"{folder}/annotations"), spark.read.schema(QUERIES).json(f"{folder}/pending"), n.total, n.answered)
        except (AnalysisException, AttributeError) as e:
            raise LearningError(f"no learning store at {folder}") from e

    def as_pack(self, name: str) -> DataFrame:
        """(text): the annotations as lines of a YAML pack, by id (D14). Texts are quoted as JSON strings, which YAML reads."""
        quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
        item = F.concat_ws("\n", F.concat(F.lit("  - call_site: "), quoted(F.col("call_site"))), F.concat(F.lit("    targets: "), F.to_json("targets")), F.when(F.col("note").isNotNull(), F.concat(F.lit("    note: "), quoted(F.col("note")))))
        head = self.annotations.sparkSession.range(1).select(F.lit("").alias("id"), F.lit(f"{name}:\n  annotations:").alias("text"))
        return head.union(self.annotations.select("id", F.regexp_replace(item, "(?m)^", "  ").alias("text"))).orderBy("id").select("text")
