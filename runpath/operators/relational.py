"""Search, lookups, joins, aggregates, windows, limits and set operations.

Relations: symbols(name, kind, file, line, is_callback), edges(src, dst), lines(doc, line, text),
events(key, seq, ...), files(path, mtime, size, hash).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runpath import fixed
from runpath.functions import text as T


# -- search and lookups -----------------------------------------------------------------------------------------------
def search(symbols: DataFrame, pattern: str, case_sensitive: bool = False, by: str = "name") -> DataFrame:
    """Rows whose name holds the pattern."""
    name = F.col(by) if case_sensitive else F.lower(by)
    return symbols.where(name.contains(pattern if case_sensitive else pattern.lower()))


def search_symbols(functions: DataFrame, structs: DataFrame, query: str, limit: int = fixed.SEARCH_ROWS) -> DataFrame:
    """Functions and structs by part of the name, in a fixed order, so many at most; nothing for under two characters."""
    both = functions.withColumn("kind", F.lit("function")).unionByName(structs.withColumn("kind", F.lit("struct")), allowMissingColumns=True)
    return (search(both, query) if len(query) >= 2 else both.where("false")).orderBy("name", "kind", "file", "line").limit(limit)


def lookup(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name)


def callbacks(functions: DataFrame) -> DataFrame:
    return functions.where("is_callback").withColumn("callback_context", F.coalesce("callback_context", F.lit("unknown")))


def in_file(symbols: DataFrame, file: str, by: str = "path") -> DataFrame:
    return symbols.where(F.col(by) == file)


def outline_filter(symbols: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Any of the columns holds the query, in any case; nulls hold nothing."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return symbols.where(hit)


def not_internal(symbols: DataFrame) -> DataFrame:
    return symbols.where(~F.col("name").startswith("__"))


# -- joins ------------------------------------------------------------------------------------------------------------
def mark_known(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """edges and whether the callee is known or External."""
    known = functions.select(F.col("name").alias("__n")).distinct()
    return edges.join(known, edges.dst == known["__n"], "left").withColumn("target", F.when(F.col("__n").isNull(), "External").otherwise("Known")).drop("__n")


def _whole(c: str, df: DataFrame) -> Column:
    """A whole number that orders like a column of numbers, dates or times."""
    kind = df.schema[c].dataType.typeName()
    return F.unix_date(c) if kind == "date" else F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.floor(c).cast("long")


def in_range(points: DataFrame, intervals: DataFrame, key: str, point: str, lo: str, hi: str) -> DataFrame:
    """Points within intervals of the same key, both ends included.

    An interval goes to the one or two bins that it touches at the level whose bins are at least as long as it; a point goes
    to its bin at every level that an interval has (64 at most, in practice few).  So the join is on equal key, level and
    bin, and a point meets only intervals about as far from it as they are long, however many its key has.
    """
    a, b = _whole(lo, intervals), _whole(hi, intervals)
    level = F.when(b > a, F.length(F.bin(b - a))).otherwise(0)
    bin_of = lambda c, level: F.call_function("shiftright", c, level)
    cut = intervals.where(F.col(lo) <= F.col(hi)).withColumn("__level", level)
    cut = cut.withColumn("__bin", F.explode(F.sequence(bin_of(a, F.col("__level")), bin_of(b, F.col("__level")))))
    levels = sorted(r[0] for r in cut.select("__level").distinct().collect())  # at most 65 numbers
    at = _whole(point, points)
    spread = points.withColumn("__level", F.explode(F.array(*(F.lit(n) for n in levels)).cast("array<int>"))).withColumn("__bin", bin_of(at, F.col("__level")))
    p, i = spread.alias("p"), cut.alias("i")
    same = [F.col(f"p.`{c}`") == F.col(f"i.`{c}`") for c in (key, "__level", "__bin")]
    inside = F.col(f"p.`{point}`").between(F.col(f"i.`{lo}`"), F.col(f"i.`{hi}`"))
    return p.join(i, same[0] & same[1] & same[2] & inside).drop(F.col(f"i.`{key}`")).drop("__level", "__bin")


def callers(edges: DataFrame, name: str, bindings: DataFrame | None = None) -> DataFrame:
    """Direct callers, and asynchronous ones by handler."""
    direct = edges.where(F.col("dst") == name).select(F.col("src").alias("caller"), F.lit("direct").alias("call_kind"))
    if bindings is None:
        return direct.distinct()
    return direct.union(bindings.where(F.col("handler") == name).select(F.col("mechanism").alias("caller"), F.lit("async").alias("call_kind"))).distinct()


def second_callers(edges: DataFrame) -> DataFrame:
    """(name, caller, caller_of_caller)."""
    a, b = edges.alias("a"), edges.alias("b")
    return a.join(b, F.col("a.src") == F.col("b.dst")).select(F.col("a.dst").alias("name"), F.col("a.src").alias("caller"), F.col("b.src").alias("caller_of_caller")).distinct()


def needs_reindex(snapshot: DataFrame, versions: DataFrame, by_size: bool = False) -> DataFrame:
    """Files without a version, or with another time (or size)."""
    v = versions.select("path", F.col("mtime").alias("__m"), *([F.col("size").alias("__s")] if by_size else []))
    other = F.col("__m").isNull() | (F.col("__m") != F.col("mtime"))
    if by_size:
        other = other | (F.col("__s") != F.col("size"))
    return snapshot.join(v, "path", "left").where(other).select(*snapshot.columns)


def resolve_invocations(bindings: DataFrame, invocations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, expr, handlers): handlers of invoked expressions, bound to the same target, or to elements of the same array.

    Where `by` names columns (the file, say), a call meets the bindings of its own values only.  Bindings become one set
    of handlers for each target, and for each array, before they meet the calls, so a join adds at most two rows to one.
    """
    base = lambda c: F.substring_index(c, "[", 1)
    b, i = bindings.select(*by, "target", "handler").distinct(), invocations.select(*by, "expr").distinct()
    sets = lambda df, key: df.groupBy(*by, key.alias("__key")).agg(F.collect_set("handler").alias("hs"))
    exact = i.withColumn("__key", F.col("expr")).join(sets(b.where(~F.col("target").contains("[")), F.col("target")), [*by, "__key"])
    arrays = i.where(F.col("expr").contains("[")).withColumn("__key", base(F.col("expr"))).join(sets(b.where(F.col("target").contains("[")), base(F.col("target"))), [*by, "__key"])
    return exact.unionByName(arrays).select(*by, "expr", F.array_sort("hs").alias("handlers"))


def _type_class(t: Column, pointers: bool) -> Column:
    """A type with the interchangeable integers as one, and all pointers as one if asked for."""
    n = T.normalize_type(t)
    out = F.when(n.isin(fixed.INTEGER_TYPES), "#int")
    return (out.when(n.endswith("*"), "#pointer") if pointers else out).otherwise(n)


def _signature_class(pointers: bool) -> Column:
    each = F.transform("params", lambda p: _type_class(p, pointers))
    return F.concat(_type_class(F.col("return_type"), pointers), F.lit("("), F.array_join(each, ","), F.lit(")"))


def compatible_functions(types: DataFrame, signatures: DataFrame) -> DataFrame:
    """(type_name, functions) with compatible return types and parameters.

    Without void* compatible signatures are equal but for their integers, which is the join key.  Signatures with void*
    meet those of their number and kinds of types (every pointer is one kind) and are compared.  Functions of one
    signature join once, as their list.
    """
    void = (T.normalize_type("return_type") == "void*") | F.exists("params", lambda p: T.normalize_type(p) == "void*")
    keyed = lambda df: df.withColumns({"exact": _signature_class(False), "wide": _signature_class(True), "void": void})
    t = keyed(types.select(F.col("name").alias("type_name"), "return_type", "params"))
    s = keyed(signatures.groupBy("return_type", "params").agg(F.collect_set("name").alias("names"))).withColumnsRenamed({"return_type": "fr", "params": "fp", "void": "fvoid"})
    plain = t.where("not void").join(s.where("not fvoid").select("exact", "names"), "exact").select("type_name", "names")
    each = F.forall(F.zip_with("fp", "params", lambda x, y: T.types_compatible(x, y)), lambda ok: ok)
    pairs = t.where("void").drop("exact").join(s.drop("exact"), "wide").unionByName(t.where("not void").drop("exact").join(s.where("fvoid").drop("exact"), "wide"))
    loose = pairs.where(T.types_compatible("fr", "return_type") & each).select("type_name", "names")
    return plain.union(loose).groupBy("type_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("functions"))


def _scored_forms(types: DataFrame, functions: DataFrame, names: Column) -> DataFrame:
    """(type_name, fr, fp, names, score): each type with each distinct signature, scores over 0.

    A score over 0 needs an equal number of parameters or compatible return types, so both are joined by what must agree
    and no pair of rows without a score is formed.
    """
    void = lambda c: F.when(F.trim(c).isin("void *", "void*"), "void*").when(F.trim(c).isin("int", "long"), "int").otherwise(F.trim(c))
    t = types.select(F.col("name").alias("type_name"), F.col("return_type").alias("tr"), F.col("params").alias("tp"))
    f = functions.groupBy(F.col("return_type").alias("fr"), F.col("params").alias("fp")).agg(names.alias("names"))
    pointer = lambda c: F.when(c.contains("struct") & c.contains("*"), F.array(void(c), F.lit("void*struct"))).when(F.trim(c).isin("void *", "void*"), F.array(F.lit("void*"), F.lit("void*struct"))).otherwise(F.array(void(c)))
    by_size = t.join(f, F.size("tp") == F.size("fp"))
    keyed_t, keyed_f = t.withColumn("k", F.explode(pointer(F.col("tr")))), f.withColumn("k", F.explode(pointer(F.col("fr"))))
    by_return = keyed_t.join(keyed_f, "k").drop("k").where(F.size("tp") != F.size("fp")).dropDuplicates(["type_name", "tr", "tp", "fr", "fp"])
    score = T.match_score(F.col("tr"), F.col("tp"), F.col("fr"), F.col("fp"))
    return by_size.unionByName(by_return).withColumn("score", score).where("score > 0")


def candidates(types: DataFrame, functions: DataFrame) -> DataFrame:
    """(type_name, function, score), scores over 0 (J11, F20). Distinct signatures are scored, whose functions are listed after."""
    forms = _scored_forms(types, functions, F.collect_set("name"))
    return forms.select("type_name", F.explode("names").alias("function"), "score").distinct()


def best_candidates(types: DataFrame, functions: DataFrame, k: int) -> DataFrame:
    """(type_name, rank, function, score): the k best functions of each type, by score, then name (O3).

    At most k functions of a signature can be among them, so no more are listed; ranks are cut before the shuffles, so no
    group holds all functions of a signature.
    """
    first = Window.partitionBy("return_type", "params").orderBy("name")
    cut = functions.select("name", "return_type", "params").withColumn("__r", F.dense_rank().over(first)).where(F.col("__r") <= k)
    rows = _scored_forms(types, cut, F.collect_set("name")).select("type_name", F.explode("names").alias("function"), "score").groupBy("type_name", "function").agg(F.max("score").alias("score"))
    order = Window.partitionBy("type_name").orderBy(F.desc("score"), "function")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("type_name", "rank", "function", "score")


def first_by_probe(wanted: DataFrame, files: DataFrame, key: str, path: str, priority: str) -> DataFrame:
    """Of the paths to try for each key, the first that exists."""
    found = wanted.join(files.select(path).distinct(), path, "left_semi")
    return found.groupBy(key).agg(F.min_by(path, priority).alias(path))


def line_diff(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, kind, text): lines compared at equal numbers; a changed line is removed and added."""
    keys = keys or ["line"]
    o, n = old.select(*keys, F.col("text").alias("o")), new.select(*keys, F.col("text").alias("n"))
    both = o.join(n, keys, "full_outer")
    row = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("text"))
    changes = F.when(F.col("o").eqNullSafe(F.col("n")), F.array(row("same", "o"))).otherwise(F.filter(F.array(row("removed", "o"), row("added", "n")), lambda r: r["text"].isNotNull()))
    return both.select(*keys, F.explode(changes).alias("c")).select(*keys, "c.kind", "c.text")


def diff_stats(diff: DataFrame) -> DataFrame:
    return diff.agg(F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"))


# -- aggregates -------------------------------------------------------------------------------------------------------
def index_stats(functions: DataFrame, structs: DataFrame, files: DataFrame) -> DataFrame:
    """Numbers of functions, structs and files in one pass each (A1)."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in (("functions", functions), ("structs", structs), ("files", files))]
    return parts[0].union(parts[1]).union(parts[2])


def classification_summary(edges: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Counts by confidence and the whole percentage of certain ones, 0 for none (A2)."""
    n = lambda c: F.count_if(F.col(confidence) == c)
    total = F.count("*")
    pct = F.when(total > 0, F.floor(n("Certain") * 100 / total)).otherwise(0).cast("long")
    return edges.agg(total.alias("total"), n("Certain").alias("certain"), n("Possible").alias("possible"), n("Unknown").alias("unknown"), pct.alias("percent"))


def overall_confidence(targets: DataFrame, key: list[str]) -> DataFrame:
    """The lowest confidence among the targets (A3)."""
    return targets.groupBy(*key).agg(T.confidence_of_rank(F.max(T.confidence_rank("confidence"))).alias("overall"))


def group_sorted(df: DataFrame, key: str, item: str, out: str) -> DataFrame:
    """Distinct items of each key, sorted."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias(out))


def last_wins(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The latest row of each key (A10, K1, K2)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*key, "r.*")


def sections(symbols: DataFrame, order: list[str]) -> DataFrame:
    """Kinds with their numbers, in a fixed order."""
    rank = F.coalesce(F.array_position(F.lit(order), F.col("kind")), F.lit(0)).cast("int")
    return symbols.groupBy("kind").agg(F.count("*").alias("n")).withColumn("section", rank).where("section > 0")


def counts_with_total(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by a, by b and in all."""
    return df.groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("n"))


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("n_lines", F.size(F.split(F.col(text), "\n", -1)).cast("long")).withColumn("n_code_points", F.length(text).cast("long"))


def variables(states: DataFrame, steps: str = "step", values: str = "variables") -> DataFrame:
    """Distinct names over all states, sorted."""
    return states.select(F.explode(F.map_keys(values)).alias("name")).distinct().orderBy("name")


def state_table(states: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """Steps by variables, - for a missing value."""
    return states.select(*(keys or ["step"]), *(F.coalesce(F.try_element_at("variables", F.lit(n)), F.lit("-")).alias(n) for n in names))


# -- windows ----------------------------------------------------------------------------------------------------------
def change_states(rows: DataFrame, key: list[str], seq: list[str], value: str) -> DataFrame:
    """new for the first value of a key, else changed or unchanged."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*seq))
    return rows.withColumn("change", F.when(before.isNull(), "new").when(before != F.col(value), "changed").otherwise("unchanged"))


def without_repeats(rows: DataFrame, key: list[str], seq: list[str], same: list[str], keep: int = fixed.NAVIGATION_STEPS) -> DataFrame:
    """Consecutive equal rows of a key once; the latest so many."""
    w = Window.partitionBy(*key).orderBy(*seq)
    item = F.struct(*same)
    once = rows.withColumn("__p", F.lag(item).over(w)).where(F.col("__p").isNull() | (F.col("__p") != item)).drop("__p")
    back = Window.partitionBy(*key).orderBy(*(F.desc(s) for s in seq))
    return once.withColumn("recency", F.row_number().over(back)).where(F.col("recency") <= keep)


def most_recent(rows: DataFrame, owner: list[str], key: list[str], seq: list[str], keep: int = fixed.RECENT_FILES) -> DataFrame:
    """The last row of each key; of each owner the latest so many."""
    last = Window.partitionBy(*owner, *key).orderBy(*(F.desc(s) for s in seq))
    once = rows.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    order = Window.partitionBy(*owner).orderBy(*(F.desc(s) for s in seq))
    return once.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= keep)


def search_ring(hits: DataFrame, key: list[str], order: list[str], hit: str) -> DataFrame:
    """Next and previous hit of each, around the ends."""
    w = Window.partitionBy(*key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return hits.withColumns({"next_hit": F.coalesce(F.lead(hit).over(w), F.first(hit).over(whole)), "previous_hit": F.coalesce(F.lag(hit).over(w), F.last(hit).over(whole))})


def debounce(events: DataFrame, key: list[str], ts: str, gap: str) -> DataFrame:
    """The last event of each burst: bursts end with a pause of at least gap (ST6)."""
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key, F.session_window(ts, gap).alias("w")).agg(F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("r"), F.count("*").alias("burst")).select(*key, "r.*", "burst")


def lru(accesses: DataFrame, key: str, seq: str, capacity: int = fixed.CACHE_ENTRIES) -> DataFrame:
    """What an LRU cache holds after these accesses: the keys touched last (ST1, ST2)."""
    return accesses.groupBy(key).agg(F.max(seq).alias("last_used")).orderBy(F.desc("last_used"), key).limit(capacity)


# -- limits and sets --------------------------------------------------------------------------------------------------
def palette(commands: DataFrame, query: str, name: str = "name") -> DataFrame:
    """The first commands for an empty query, else the best fuzzy matches."""
    if not query:
        return commands.withColumn("score", F.lit(0)).orderBy("ord").limit(fixed.PALETTE_COMMANDS)
    return commands.withColumn("score", T.fuzzy_score(query, name)).where("score is not null").orderBy(F.desc("score"), name).limit(fixed.PALETTE_ROWS)


def entries(listing: DataFrame) -> DataFrame:
    """Directories first, then by name in any case."""
    return listing.orderBy(F.desc("is_dir"), F.lower("name"), "name")


def keep_left(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a, and what of b has a key that a lacks."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti").select(*b.columns))


def answered(pending: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Queries that are still open (U4, ST7)."""
    return pending.join(answers.select(key).distinct(), key, "left_anti")


def reduce_union(parts: list[DataFrame]) -> DataFrame:
    """All rows of some tables of equal columns."""
    return reduce(DataFrame.unionByName, parts)


def first_occurrence(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


# -- classification and learning --------------------------------------------------------------------------------------
def classify_targets(calls: DataFrame, targets: Column) -> DataFrame:
    """No target Unknown, one Certain, more Possible."""
    n = F.size(targets)
    return calls.withColumn("confidence", F.when(n == 0, "Unknown").when(n == 1, "Certain").otherwise("Possible"))


def classify_known(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Certain for a known mechanism or table type, else Possible."""
    return rows.withColumn("confidence", F.when(F.col(column).isin(known), "Certain").otherwise("Possible"))


def apply_annotations(calls: DataFrame, annotations: DataFrame) -> DataFrame:
    """Calls with the targets that users gave for their call site, the first note of each."""
    first = first_occurrence(annotations, ["call_site"], ["ord"]).select("call_site", F.col("targets").alias("user_targets"))
    return calls.join(first, "call_site", "left")


def learning_stats(queries: DataFrame, annotations: DataFrame) -> DataFrame:
    """Numbers of questions, answers and automatic applications."""
    total = queries.agg(F.count("*").alias("total"))
    done = annotations.agg(F.count("*").alias("answered"))
    return total.join(done).withColumn("auto_applied", F.lit(0).cast("long"))
