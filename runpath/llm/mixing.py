"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source gets a target of words.  A document of a source whose target is
m times the source's size has an expected number of copies m: floor(m) copies
are certain, and one more is drawn with inclusion probability f = m - floor(m).
Documents are ranked by Pareto's order variable, the random odds u / (1 - u)
divided by the inclusion odds f / (1 - f), and taken in this order as long as the
source's remaining words allow it: one that is larger than what remains is passed
over, and the draw goes on with those after it until none is left that fits.

A source may hold any share of all rows: ranks are first cut into ``bins`` equal
steps, words are summed by source and bin (partial sums before the shuffle), and
only the documents of the one bin in which a source's target falls are put in
order.  What remains then is less than one document's words, so only documents
smaller than that go on, the next ``step`` of each source at a time.  Sources are
taken to be few: one task holds a row for each of them, not their documents.

The random number of a document is a hash of the seed and its id, text size and
text digest, so that reruns agree.

Defined results: a null text and a text without words have size 0 and are taken
0 times; a null source is a source of its own, the last; rows that are equal in
all columns share their random number and are taken or passed over together as far
as they stand in the same step, and ties between rows of different size go to the
smaller one first; an empty table gives no rows; texts of any length count whole;
columns besides id, text and source pass through take() whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runpath.llm.storage import Tables, materialize


@dataclass(frozen=True)
class MixParams:
    """weights repeat over the sources in order; percent of all words that the mix takes; copies at most."""

    weights: tuple[int, ...] = (5, 2, 1)
    percent: int = 150
    most_copies: int = 2
    bins: int = 1 << 14
    #: Documents of a source that are gone through at a time once its draw has passed one over.
    step: int = 4096
    seed: str = "mix-1"


PARAMS = MixParams()


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """52 bits of an md5 as a double in (0, 1)."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, p: MixParams = PARAMS) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Shares are proportional to the weights; a target above the cap is set to it and the excess
    is shared again by weight among the others, until none is above.  The end of these rounds is
    found at once: sources in ascending order of cap per weight are capped as long as the share
    that would be left for each unit of weight is not below their cap per weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    weights = F.array(*(F.lit(float(w)) for w in p.weights))
    numbered = per.withColumn("weight", F.element_at(weights, F.pmod(F.row_number().over(order) - 1, F.lit(len(p.weights))) + 1))
    numbered = numbered.withColumn("cap", F.col("source_size").cast("double") * p.most_copies)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = numbered.select(
        "*",
        (F.sum("source_size").over(every).cast("double") * p.percent / 100).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left"),
    ).withColumn("unit", (F.col("total") - F.col("capped")) / F.col("left"))
    # Sources above their cap at their unit are capped. The first that is not has the largest unit of
    # the others, as what it leaves unused lowers the units after it; it fixes the unit of all that follow.
    free = level.withColumn("final", F.max(F.when(F.col("unit") * F.col("weight") <= F.col("cap"), F.col("unit"))).over(every))
    return free.select("source", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


PLACE = ("q", "size", "doc_id", "digest")


def keyed(documents: DataFrame, p: MixParams = PARAMS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> list[Column]:
    """Columns (doc_id, source, size, digest, u) of each row; u is the row's random number."""
    text, digest = F.col(text_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    size = n_words(text)
    u = uniform(F.lit(p.seed), F.col(id_col), size, digest)
    return [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), digest.alias("digest"), u.alias("u")]


def with_targets(rows: DataFrame, goal: DataFrame, p: MixParams = PARAMS) -> DataFrame:
    """rows with what is known of their source, the order variable q (null: no draw) and its bin."""
    g = goal.withColumnRenamed("source", "__s")
    known = rows.join(g, rows["source"].eqNullSafe(g["__s"])).drop("__s")
    odds, wanted = F.col("u") / (1 - F.col("u")), F.col("f") / (1 - F.col("f"))
    q = F.when((F.col("rest") > 0) & (F.col("size") > 0) & (wanted > 0), odds / wanted)
    return known.withColumn("q", q).withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * p.bins).cast("int"))


def plan(slim: DataFrame, p: MixParams = PARAMS) -> DataFrame:
    """One row for each source: size, target, certain copies, where the first part of the draw ends, and what is taken after it."""
    goal = targets(slim, p).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goal = goal.withColumn("sure", F.floor("ratio").cast("long")).withColumn("f", F.col("ratio") - F.floor("ratio"))
    with Tables(slim.sparkSession) as tables:
        goal = tables.write(goal.withColumn("rest", F.col("target") - F.col("sure") * F.col("source_size")).drop("ratio"), "targets")
        drawn = with_targets(slim, goal, p).where("q is not null")

        by_bin = drawn.groupBy("source", "rest", "bin").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edges = by_bin.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > F.col("rest"))
        edge = edges.groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("below"))).alias("e")).select("s", F.col("e.bin").alias("edge"), F.col("e.below").alias("below"))
        at_edge = drawn.join(edge, drawn["source"].eqNullSafe(edge["s"])).where("bin = edge")
        within = Window.partitionBy("s").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        fitting = at_edge.withColumn("run", F.col("below") + F.sum("size").over(within)).where(F.col("run") <= F.col("rest"))
        last = fitting.groupBy(F.col("s").alias("t")).agg(F.max(F.struct(*PLACE)).alias("last"), F.max("run").alias("run"))
        cut = edge.join(last, F.col("s").eqNullSafe(F.col("t")), "left").drop("t").withColumn("run", F.coalesce("run", "below")).drop("below")
        with_cut = tables.write(goal.join(cut, goal["source"].eqNullSafe(F.col("s")), "left").drop("s"), "cuts")

        none = F.lit(None).cast(with_cut.schema["last"].dataType)
        kind = with_cut.schema["last"].dataType.simpleString()
        state = tables.write(
            with_cut.where("edge is not null").select(F.col("source").alias("s"), F.col("edge").alias("from_bin"), F.coalesce(F.col("last"), none).alias("after"), (F.col("rest") - F.col("run")).alias("gap"), F.expr(f"cast(array() as array<{kind}>)").alias("more")), "draw"
        )
        while True:
            ahead = with_targets(slim, with_cut.select(*goal.columns), p).where("q is not null")
            later = (F.col("bin") > F.col("from_bin")) | (F.col("bin") == F.col("from_bin")) & (F.col("after").isNull() | (F.struct(*PLACE) > F.col("after")))
            fits = ahead.join(state, ahead["source"].eqNullSafe(state["s"])).where(later & (F.col("size") <= F.col("gap")))
            counts = fits.groupBy("s", "bin").agg(F.count("*").alias("n"))
            before = F.sum("n").over(Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
            near = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < p.step).groupBy(F.col("s").alias("t")).agg(F.max("bin").alias("to_bin"))
            rank = F.row_number().over(Window.partitionBy("s").orderBy(*PLACE))
            next_ = fits.join(near, fits["s"].eqNullSafe(near["t"])).where("bin <= to_bin").withColumn("rank", rank).where(F.col("rank") <= p.step)
            lists = tables.write(next_.groupBy("s").agg(F.array_sort(F.collect_list(F.struct(*PLACE, "bin"))).alias("docs")), "next")
            if lists.isEmpty():
                break
            place = lambda d: F.struct(*(d[c].alias(c) for c in PLACE))
            start = F.struct(F.col("gap").alias("gap"), F.expr(f"cast(array() as array<{kind}>)").alias("taken"))
            taken = lambda a, d: F.struct((a["gap"] - d["size"]).alias("gap"), F.concat(a["taken"], F.array(place(d))).alias("taken"))
            gone = lists.withColumnRenamed("s", "t").join(state, F.col("t").eqNullSafe(F.col("s")))
            gone = gone.withColumn("r", F.aggregate("docs", start, lambda a, d: F.when(d["size"] <= a["gap"], taken(a, d)).otherwise(a))).withColumn("end", F.element_at("docs", -1))
            moved = gone.select("s", F.col("end.bin").alias("from_bin"), place(F.col("end")).alias("after"), F.col("r.gap").alias("gap"), F.concat("more", "r.taken").alias("more"))
            rest = state.join(lists.select(F.col("s").alias("t"), F.lit(True).alias("moved")), F.col("s").eqNullSafe(F.col("t")), "left").where("moved is null").select(*state.columns)
            state = tables.write(rest.unionByName(moved), "draw")
        return tables.keep(with_cut.join(state.select("s", "more"), with_cut["source"].eqNullSafe(F.col("s")), "left").drop("s"), "mix-plan")


def _inside() -> Column:
    """The row comes before the end of its source's draw."""
    before = (F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & F.coalesce(F.struct(*PLACE) <= F.col("last"), F.lit(False)))
    return F.col("q").isNotNull() & (F.col("edge").isNull() | before)


def decide(rows: DataFrame, planned: DataFrame, p: MixParams = PARAMS) -> DataFrame:
    """rows (with the columns of keyed()) and their copies."""
    found = with_targets(rows, planned, p)
    extra = F.coalesce(_inside(), F.lit(False)) | F.coalesce(F.col("q").isNotNull() & F.array_contains("more", F.struct(*PLACE)), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("sure") + extra.cast("long")).otherwise(F.lit(0).cast("long"))
    return found.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix(documents: DataFrame, p: MixParams = PARAMS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row for each row of documents."""
    slim = materialize(documents.select(*keyed(documents, p)), "sizes")
    return decide(slim, plan(slim, p), p).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def take(documents: DataFrame, p: MixParams = PARAMS) -> DataFrame:
    """documents with each row as often as the mix takes it (0 to most_copies times); columns are those of documents.

    The texts are not shuffled: a row's copies follow from itself and the plan's row of its source.
    """
    slim = materialize(documents.select(*keyed(documents, p)), "sizes")
    whole = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("__row"), *keyed(documents, p))
    chosen = decide(whole, plan(slim, p), p).where("copies > 0")
    return chosen.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select(*(F.col("__row")[c].alias(c) for c in documents.columns))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
