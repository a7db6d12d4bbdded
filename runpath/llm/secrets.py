"""Secret scan with a randomness test battery, in DataFrame functions only.

Base spans are matches of three fixed patterns.  The method adds spans that look
like keys without saying so: runs of at least ``min_length`` characters of the
base64 family outside base spans.  For each run the smallest alphabet that holds
it is inferred, and three tests ask whether its characters could be drawn at
random from that alphabet: chi-squared for uniform counts, the Wald-Wolfowitz
runs test about the alphabet's middle, and lag-one serial correlation.  Their
smallest p-value, corrected for three tests, is the run's p-value.

A run can be reported if its alphabet mixes letters and digits and so many draws
from that alphabet carry at least ``min_bits`` bits.  Few characters give the tests
little power, so these runs are compared only with runs of their own length band,
and within each band the share of false reports is held at ``fdr``: a random run
has a p-value of at least t with probability (1 - t / 3)^3, and runs that are not
random hardly ever have one above the band's ``tail``, which is lower the longer the
runs are.  The runs above it tell how many random ones the band holds, so for every
cut t the reports beyond those that random runs explain are the false ones; the
smallest cut at which they are at most ``fdr`` of the reports is taken.  What is
reported of one text thus depends on all texts.

All positions come out of one pass over the texts: a pattern's matches and the
pieces between them have lengths, whose running sums are the offsets.  Only these
small rows are shuffled, by document.

Defined results: a null or empty text has no spans; rows of a repeated id are
treated each on its own; offsets are code points, ends exclusive; spans that start
together stand in the order of their kinds; runs of equal p-values are reported
together or not at all; texts are read whole, however long; an empty table gives
no rows; columns besides id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runpath.llm.storage import materialize


@dataclass(frozen=True)
class SecretParams:
    """min_length characters of a tested run; share of false reports in a band; bits a reported run carries; length bands."""

    min_length: int = 24
    fdr: float = 0.1
    min_bits: float = 80.0
    bands: tuple[int, ...] = (24, 32, 40, 64, 128)
    #: For each band the p-value above which runs count as random.
    tails: tuple[float, ...] = (0.9, 0.3, 0.1, 0.05, 0.05)
    steps: int = 10_000


PARAMS = SecretParams()

#: Kinds in order, and the pattern whose matches are looked at; what a match must be is in _kept().
# The hex pattern finds the same runs as one without a least length, as runs are maximal; so does the access pattern,
# as a run within a too short run is shorter still.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
}
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+"
#: Cheap conditions that hold for every text with a match.
MAYBE = {
    "assign": r"""(?i:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32}",
}
KINDS = tuple(PATTERNS)

#: Alphabets from small to large; a run belongs to the first that holds all its characters. The last two share one
#: index, as both write the same 64 values.
ALPHABETS = (
    ("digits", "[0-9]+", "0123456789"),
    ("hex", "[0-9a-f]+", "0123456789abcdef"),
    ("HEX", "[0-9A-F]+", "0123456789ABCDEF"),
    ("lower", "[a-z]+", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "[A-Z]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "[0-9A-Z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "[A-Za-z]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("alnum", "[0-9A-Za-z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "[0-9A-Za-z+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "[0-9A-Za-z_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)


def _matches(kind: str, pattern: str, maybe: Column) -> Column:
    """array<struct<kind, nth, gap, len, piece>>: each match, with the length of what stands before it since the last one."""
    text = F.col("text")
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    row = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(parts, F.lit(1), F.size(found)).alias("p")),
        lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(z["p"]).cast("long").alias("gap"), F.length(z["m"]).cast("long").alias("len"), z["m"].alias("piece")),
    )
    none = F.expr("cast(array() as array<struct<kind:string,nth:int,gap:bigint,len:bigint,piece:string>>)")
    return F.when(F.coalesce(maybe, F.lit(False)), row).otherwise(none)


def scan(documents: DataFrame, p: SecretParams = PARAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, kind, start, end, piece): all matches; a row of null kind for a text without any. One pass, then slim rows."""
    run = RUN % p.min_length
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lists = [_matches(k, PATTERNS[k], F.col("text").rlike(MAYBE[k])) for k in KINDS]
    lists.append(_matches("run", run, F.col("text").rlike(run)))
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*lists).alias("list"))
    rows = numbered.select("row", "doc_id", F.explode_outer("list").alias("m")).select("row", "doc_id", "m.*")
    rows = materialize(rows, "matches")  # numbers rows once
    ends = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("row", "kind").orderBy("nth"))
    # Texts without a match have nothing to add up and stay out of the window.
    placed = rows.where("kind is not null").withColumn("end", ends).withColumn("start", F.col("end") - F.col("len")).select("row", "doc_id", "kind", "start", "end", "piece")
    nothing = rows.where("kind is null").select("row", "doc_id", "kind", F.col("gap").alias("start"), F.col("len").alias("end"), "piece")
    return placed.union(nothing)


def _kept() -> Column:
    """The match of a base kind counts."""
    value = F.regexp_extract("piece", PATTERNS["assign"], 1)
    return (F.col("kind") == "assign") & (F.length(value) >= 8) | F.col("kind").isin("access", "hex")


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, within 0.0002."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def battery(runs: DataFrame, piece: str = "piece") -> DataFrame:
    """runs with alphabet, letters (its size), chi_p, runs_p, serial_p and p (the smallest, times three, at most 1)."""
    s = F.col(piece)
    name, size, index = F.lit("base64any"), F.lit(64), F.lit(ALPHABETS[-1][2])
    for a, pattern, letters in reversed(ALPHABETS):
        fits = s.rlike(f"^{pattern}$")
        name, size, index = F.when(fits, F.lit(a)).otherwise(name), F.when(fits, F.lit(len(letters))).otherwise(size), F.when(fits, F.lit(letters)).otherwise(index)
    named = runs.withColumns({"alphabet": name, "letters": size, "__index": index})
    chars = F.split(F.col(piece), "")
    chars = F.filter(chars, lambda c: c != "")
    # Place of each character in the alphabet, centred; characters of neither base64 form share the last place.
    centred = F.transform(chars, lambda c: F.greatest(F.instr(F.col("__index"), c), F.lit(1)).cast("double") - (F.col("letters") + 1) / 2)
    named = named.withColumn("__x", centred).withColumn("__n", F.size("__x").cast("double"))
    squares = F.aggregate(F.array_distinct("__x"), F.lit(0.0), lambda t, v: t + F.pow(F.size(F.filter("__x", lambda y: y == v)).cast("double"), F.lit(2.0)))
    df = (F.col("letters") - 1).cast("double")
    chi = squares * F.col("letters") / F.col("__n") - F.col("__n")
    wilson = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    high = F.size(F.filter("__x", lambda v: v > 0)).cast("double")
    low = F.col("__n") - high
    follow = F.slice("__x", 2, F.greatest(F.size("__x") - 1, F.lit(0)))
    lead = F.slice("__x", 1, F.greatest(F.size("__x") - 1, F.lit(0)))
    turns = F.aggregate(F.zip_with(lead, follow, lambda a, b: F.when((a > 0) != (b > 0), 1.0).otherwise(0.0)), F.lit(1.0), lambda t, v: t + v)
    mean = 2 * high * low / F.col("__n") + 1
    spread = (mean - 1) * (mean - 2) / (F.col("__n") - 1)
    runs_z = F.when(spread > 0, F.abs(turns - mean) / F.sqrt(spread)).otherwise(F.lit(0.0))
    total = F.aggregate("__x", F.lit(0.0), lambda t, v: t + v)
    square = F.aggregate("__x", F.lit(0.0), lambda t, v: t + v * v)
    product = F.aggregate(F.zip_with(lead, follow, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    var = square - total * total / F.col("__n")
    serial = F.when(var > 0, (product - total * total / F.col("__n")) / var).otherwise(F.lit(1.0))
    tests = named.withColumns({"chi_p": normal_tail(wilson), "runs_p": F.least(F.lit(1.0), 2 * normal_tail(runs_z)), "serial_p": F.least(F.lit(1.0), 2 * normal_tail(F.abs(serial) * F.sqrt(F.col("__n"))))})
    return tests.withColumn("p", F.least(F.lit(1.0), 3 * F.least("chi_p", "runs_p", "serial_p"))).drop("__index", "__x", "__n")


def random_runs(runs: DataFrame, p: SecretParams = PARAMS) -> DataFrame:
    """The runs that pass for random, with the estimated share of false ones among the reports of each length band at fdr at most."""
    n = F.length("piece")
    band = F.greatest(*(F.when(n >= b, F.lit(b)).otherwise(F.lit(0)) for b in p.bands))
    mixed = F.col("piece").rlike("[0-9]") & F.col("piece").rlike("[A-Za-z]")
    tested = battery(runs.where(mixed)).where(n * F.log2("letters") >= p.min_bits)
    tested = materialize(tested.withColumn("band", band).withColumn("step", F.floor(F.col("p") * p.steps).cast("int")), "battery")  # p-values rounded down
    limit = cuts(tested.groupBy("band", "step").agg(F.count("*").alias("n")), p)  # at most steps rows in each band
    return tested.join(F.broadcast(limit), "band").where(F.col("step") >= F.col("cut"))  # a row for each band


def cuts(counts: DataFrame, p: SecretParams = PARAMS) -> DataFrame:
    """(band, cut) from (band, step, n): the smallest step from which the reports beyond what random runs explain are at most fdr of them.

    A band without any run above its tail has no random ones, and no cut.
    """
    # Of all cuts between two steps the lowest one leaves most to random runs.
    low = F.coalesce(F.lag("step").over(Window.partitionBy("band").orderBy("step")), F.lit(-1)) + 1
    t = F.col("low") / p.steps
    tail = F.element_at(F.create_map(*(F.lit(x) for pair in zip(p.bands, p.tails, strict=True) for x in pair)), F.col("band"))
    above = F.sum("n").over(Window.partitionBy("band").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0))
    upper = F.sum(F.when(F.col("step") / p.steps >= tail, F.col("n"))).over(Window.partitionBy("band"))
    explained = lambda x: F.pow(1 - x / 3, F.lit(3.0))
    random = F.col("upper") / explained(tail) * explained(t)
    false = F.greatest(F.col("above") - random, F.lit(0.0))
    ok = F.col("upper").isNotNull() & (false <= p.fdr * F.col("above"))
    return counts.withColumns({"above": above, "upper": upper, "low": low}).where(ok).groupBy("band").agg(F.min("low").alias("cut"))


def find_secrets(documents: DataFrame, p: SecretParams = PARAMS) -> DataFrame:
    """(doc_id, spans), spans array<struct<start, rank, kind, end, base>> by start, then kind."""
    found = materialize(scan(documents, p), "spans")
    base = found.where(_kept())
    # Runs that overlap no base span of their row.
    taken = base.select("row", F.col("start").alias("s"), F.col("end").alias("e"))
    runs = found.where("kind = 'run'").join(taken, (found["row"] == taken["row"]) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")
    added = random_runs(runs, p)
    order = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)).cast("int")
    order = F.when(order == 0, len(KINDS) + 1).otherwise(order)
    spans = base.select("row", F.struct("start", order.alias("rank"), "kind", "end", F.lit(True).alias("base")).alias("s")).union(
        added.select("row", F.struct("start", F.lit(len(KINDS) + 1).alias("rank"), F.lit("random").alias("kind"), "end", F.lit(False).alias("base")).alias("s"))
    )
    rows = found.select("row", "doc_id", F.lit(None).cast("struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean>").alias("s")).dropDuplicates(["row"])
    lists = spans.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    return rows.select("row", "doc_id").join(lists, "row", "left").select("doc_id", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean>>)")).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_random_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.withColumn("base", base).select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
