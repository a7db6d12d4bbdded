"""Pattern scans over lines(path, line, text): bindings, triggers, operation tables, assignments, search.

A scan applies all patterns to a line in one projection, so the text is read once however many patterns there are.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runpath import fixed
from runpath.functions import text as T
from runpath.operators import relational as R


def lines_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, text): 1-based, without line ends; a final empty line is none."""
    text = F.regexp_replace(F.col(content), "\r?\n$", "")
    rows = files.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\r?\n", -1)).alias("at", "text"))
    return rows.select("path", (F.col("at") + 1).alias("line"), "text")


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups


def _unnamed(pattern: str) -> str:
    """The pattern without names of groups, which Java allows once only."""
    return re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern)


def literal_of(pattern: str) -> str:
    """A text that each match of a pattern holds: the longest run of plain characters outside all brackets, "" if none is sure."""
    if re.search(r"\(\?[^:P<=!]", pattern):  # flags can change what characters stand for
        return ""
    best = run = ""
    depth = 0
    for m in re.finditer(r"\[\^?\]?(?:\\.|[^\]\\])*\]|\\.|\{[^}]*\}|.", pattern, re.S):
        t = m[0]
        plain = t[-1] if not depth and (re.fullmatch(r"\w", t, re.A) or re.fullmatch(r"\\[^\w\s]", t, re.A)) else ""
        if plain:
            run += plain
            best = max(best, run, key=len)
            continue
        if t in "?*" or t[0] == "{":  # the character before can be missing
            best = run[:-1] if best == run else best
        elif t == "|" and not depth:
            return ""
        depth += (t == "(") - (t == ")")
        run = ""
    return best


def scan(lines: DataFrame, rules: list[tuple[str, dict]], groups: list[tuple[int | None, int | None]] | None = None) -> DataFrame:
    """(path, line, first, last, **fields): a row for each rule (pattern, fields) that matches in a line; one match of each in a line.

    first and last are the captures of the given groups, "" for None; by default last is the last group and first the
    first one where there are two.  The fields of all rules have the same names.
    """
    if groups is None:
        groups = [(1 if (n := _groups(_unnamed(p))) > 1 else None, n or None) for p, _ in rules]
    text, found = F.col("text"), []
    # Few lines hold a word that a match needs; only these are searched by patterns.
    words = [literal_of(_unnamed(p)) for p, _ in rules]
    for (pattern, fields), (first, last), word in zip(rules, groups, words, strict=True):
        pattern = _unnamed(pattern)
        got = lambda g: F.lit("") if g is None else F.regexp_extract(text, pattern, g)  # noqa: B023, E731
        hit = text.contains(word) & text.rlike(pattern) if word else text.rlike(pattern)
        found.append(F.when(hit, F.struct(got(first).alias("first"), got(last).alias("last"), *(F.lit(v).alias(k) for k, v in fields.items()))))
    names = list(rules[0][1]) if rules else []
    # A word within another one need not be looked for.
    needed = [w for w in dict.fromkeys(words) if not any(o in w and o != w for o in words)]
    likely = reduce(lambda a, b: a | b, (text.contains(w) for w in needed), F.lit(False)) if all(words) else F.lit(True)
    any_of = "|".join(f"(?:{_unnamed(p)})" for p, _ in rules) or "(?!)"
    rows = lines.where(likely).where(text.rlike(any_of)).select("path", "line", F.explode(F.filter(F.array(*found), lambda m: m.isNotNull())).alias("m"))
    return rows.select("path", "line", "m.first", "m.last", *(f"m.{n}" for n in names))


def async_scan(lines: DataFrame, patterns=None) -> DataFrame:
    """(path, line, first, last, role, pattern_id, nth, mechanism, flag, context, has_variable) of all bind and trigger patterns, in one pass."""
    patterns = fixed.ASYNC_PATTERNS if patterns is None else patterns
    rules = []
    for i, (mechanism, flag, context, binds, trigs) in enumerate(patterns):
        for role, group in (("bind", binds), ("trigger", trigs)):
            rules += [(p, {"role": role, "pattern_id": i, "nth": k, "mechanism": mechanism, "flag": flag, "context": context, "has_variable": _groups(p) > 0}) for k, p in enumerate(group)]
    return scan(lines, rules)


def bindings_in(found: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, pattern_id, nth, mechanism, flag, context, variable, handler, line) of a scan, for handlers that are functions of the file."""
    known = functions.select("path", F.col("name").alias("handler")).distinct()
    rows = found.where("role = 'bind'").select("path", "pattern_id", "nth", "mechanism", "flag", "context", F.col("first").alias("variable"), F.col("last").alias("handler"), "line")
    return rows.where("handler <> '' and handler <> 'NULL'").join(known, ["path", "handler"], "left_semi")


def triggers_in(found: DataFrame) -> DataFrame:
    """(path, pattern_id, nth, variable, has_variable, line) of a scan."""
    return found.where("role = 'trigger'").select("path", "pattern_id", "nth", F.col("last").alias("variable"), "has_variable", "line")


def bindings(lines: DataFrame, functions: DataFrame, patterns=None) -> DataFrame:
    return bindings_in(async_scan(lines, patterns), functions)


def triggers(lines: DataFrame, patterns=None) -> DataFrame:
    return triggers_in(async_scan(lines, patterns))


#: Bindings of one file and mechanism that meet its triggers in one task.
TOGETHER = 500


def _each_with_each(bound: DataFrame, triggers: DataFrame) -> DataFrame:
    """Pairs of equal path and mechanism.  There are as many as bindings times triggers, so the bindings of a key are cut into pieces, each of which meets all triggers in a task of its own."""
    key = ["path", "pattern_id"]
    pieces = bound.groupBy(*key).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("__n"))
    cut = bound.join(pieces, key).withColumn("__piece", F.pmod(F.xxhash64("line", "nth", "variable", "handler"), F.col("__n")).cast("int")).drop("__n")
    spread = triggers.join(pieces, key).withColumn("__piece", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    n = 4 * bound.sparkSession.sparkContext.defaultParallelism  # few small rows would go to few tasks, however many pairs they make
    return cut.join(spread.repartition(n, *key, "__piece"), [*key, "__piece"]).drop("__piece")


def match_triggers(bound: DataFrame, found: DataFrame) -> DataFrame:
    """Bindings with each of their trigger lines (J3): the same mechanism and file, and the same variable where both name one."""
    t = found.select("path", "pattern_id", F.col("variable").alias("tv"), "has_variable", F.col("line").alias("trigger_line"))
    named = bound.where("variable <> ''").withColumn("v", T.normalize_variable("variable"))
    keyed = t.where("has_variable").withColumn("v", T.normalize_variable("tv"))
    same = named.join(keyed, ["path", "pattern_id", "v"]).drop("v")
    free = _each_with_each(named.drop("v"), t.where("not has_variable"))
    every = _each_with_each(bound.where("variable = ''"), t)
    return same.unionByName(free).unionByName(every).drop("tv", "has_variable")


def async_edges(matched: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, src, dst, line, mechanism, flag): from the function around a trigger to the handler (G1, J2). functions(path, name, line, end_line)."""
    f = functions.select("path", F.col("name").alias("src"), F.col("line").alias("lo"), F.col("end_line").alias("hi"))
    m = matched.select("path", F.col("handler").alias("dst"), F.col("trigger_line").alias("line"), "mechanism", "flag")
    return R.in_range(m, f, "path", "line", "lo", "hi").select("path", "src", "dst", "line", "mechanism", "flag")


def pack_scan(lines: DataFrame, pack: list[dict]) -> DataFrame:
    """(path, line, pack, mechanism, role, nth, variable, handler): the patterns of loaded packs, as rules() of sources.packs gives them.

    A pattern's handler and variable are its groups of these names ("handler"; "var", or the group that stands for it).
    """
    rules, groups = [], []
    for r in pack:
        index = re.compile(r["pattern"]).groupindex
        rules.append((r["pattern"], {"pack": r["pack"], "mechanism": r["mechanism"], "role": r["role"], "nth": r["nth"]}))
        groups.append((index.get(r.get("variable") or "var"), index.get(r.get("handler") or "handler")))
    return scan(lines, rules, groups).withColumnsRenamed({"first": "variable", "last": "handler"})


def ops_initializers(files: DataFrame, nested: bool = True) -> DataFrame:
    """(path, struct_type, var_name, field, function, ord) of static operation tables, in their order.

    nested: a table may hold one level of braces; otherwise a closing brace ends it.
    """
    body = r"((?:[^{}]|\{[^{}]*\})+)" if nested else r"([^}]+)"
    pattern = r"(?s)static\s+(?:const\s+)?struct\s+(\w+)\s+(\w+)\s*=\s*\{" + body + r"\}"
    tables = files.select("path", F.posexplode(F.arrays_zip(*(F.regexp_extract_all("content", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "struct_type"), (2, "var_name"), (3, "body"))))).alias("table", "t"))
    pair = r"\.(\w+)\s*=\s*(\w+)"
    rows = tables.select("path", "table", "t.struct_type", "t.var_name", F.posexplode(F.arrays_zip(*(F.regexp_extract_all("t.body", F.lit(pair), F.lit(g)).alias(n) for g, n in ((1, "field"), (2, "function"))))).alias("at", "f"))
    return rows.select("path", "struct_type", "var_name", "f.field", "f.function", F.struct("table", "at").alias("ord"))


def ops_mappings(spark: SparkSession, initializers: DataFrame, functions: DataFrame) -> DataFrame:
    """Initializers of known callback fields with a known function (J5). A struct name belongs to each table type it begins with."""
    known = spark.createDataFrame([(t, f) for t, fs in fixed.OPS_FIELDS.items() for f in fs], "ops_type string, field string")
    hit = initializers.join(F.broadcast(known), "field").where(F.col("struct_type").startswith(F.col("ops_type")))
    return hit.join(functions.select("path", F.col("name").alias("function")).distinct(), ["path", "function"], "left_semi").select("path", "ops_type", "struct_type", "var_name", "field", "function", "ord")


def assignments(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, source, field, function, confidence) of a.b->c = fn; for a known function and a field that looks like a callback's.

    The member is what follows the last dot or >; what stands before is joined by dots.
    """
    both = (F.regexp_extract_all("content", F.lit(fixed.ASSIGNMENT), F.lit(g)).alias(n) for g, n in ((1, "left"), (2, "function")))
    rows = files.select("path", F.explode(F.arrays_zip(*both)).alias("a")).select("path", F.col("a.left").alias("left"), F.col("a.function").alias("function"))
    parts = F.split("left", r"[.>]", -1)
    hit = rows.where(F.col("left").rlike(r"->|\.")).withColumn("field", F.element_at(parts, -1)).withColumn("source", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "."))
    known = functions.select("path", F.col("name").alias("function")).distinct()
    return hit.where(T.looks_like_callback_field("field")).join(known, ["path", "function"], "left_semi").select("path", "source", "field", "function", F.lit("Medium").alias("confidence"))


def pointer_bindings(mappings: DataFrame, assigned: DataFrame) -> DataFrame:
    """(path, source, field, function, confidence): bindings of operation tables, of high confidence, and all assignments."""
    tables = mappings.select("path", F.col("var_name").alias("source"), "field", "function", F.lit("High").alias("confidence"))
    return tables.unionByName(assigned.select(*tables.columns))


def resolve_ops_calls(calls: DataFrame, mappings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, line, target, handlers, confidence): calls through a member ops->field, by the tables of the struct that the base is.

    calls(path, line, target, struct_type); a call whose struct is not known meets the field of every table.  Where `by`
    names columns of both (the file, say), only tables with a call's own values count.  Tables become one set of functions
    for each struct and field, and for each field, before they meet the calls.
    """
    asked = calls.withColumn("field", F.element_at(F.split("target", r"->|\."), -1)).distinct()
    sets = lambda *key: mappings.groupBy(*by, *key).agg(F.array_sort(F.collect_set("function")).alias("handlers"))
    known = asked.where("struct_type is not null").join(sets("struct_type", "field"), [*by, "struct_type", "field"])
    free = asked.where("struct_type is null").join(sets("field"), [*by, "field"])
    found = known.select("path", "line", "target", "handlers").union(free.select("path", "line", "target", "handlers"))
    # Two calls through one expression in a line may know different structs.
    one = found.groupBy("path", "line", "target").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("handlers")))).alias("handlers"))
    return one.withColumn("confidence", F.when(F.size("handlers") == 1, "Certain").otherwise("Possible"))


def module_entries(files: DataFrame) -> DataFrame:
    """(path, name, rank): the first module_init and the first module_exit."""
    names = F.array(*(F.struct(F.regexp_extract("content", rf"module_{w}\s*\(\s*(\w+)\s*\)", 1).alias("name"), F.lit(r).alias("rank")) for r, w in ((0, "init"), (1, "exit"))))
    return files.select("path", F.explode(names).alias("m")).select("path", "m.name", "m.rank").where("name <> ''")


def kernel_version(files: DataFrame) -> DataFrame:
    """(path, version) of a top Makefile (X11): from its first lines; a level counts only with those before it."""
    head = F.array_join(F.slice(F.split("content", "\n"), 1, fixed.MAKEFILE_LINES), "\n")
    get = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k} = (.*)$", 1)), F.lit(""))
    major, minor, patch = get("VERSION"), get("PATCHLEVEL"), get("SUBLEVEL")
    version = F.when(major.isNotNull() & minor.isNotNull(), F.concat_ws(".", major, minor, patch)).when(patch.isNull(), major)
    return files.select("path", version.alias("version")).where("version is not null")


def find_in_lines(lines: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False, whole_word: bool = False) -> DataFrame:
    """(path, line, column, length, match, text): all hits, columns from 1 (X13). A line with a match of no length has no hits.

    The hits of a line become rows before their columns are summed up, so the work is in proportion to the hits; the line
    joins again at the end.
    """
    pattern = query if regex else r"\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E"
    if whole_word:
        pattern = rf"\b(?:{pattern})\b"
    if not case_sensitive:
        pattern = "(?i)" + pattern
    hit = lines.where(F.col("text").rlike(pattern))
    found = F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m: m != "")
    gaps = F.transform(F.split("text", pattern, -1), lambda g: F.length(g))
    pairs = hit.select("path", "line", found.alias("found"), gaps.alias("gaps")).where(F.size("found") == F.size("gaps") - 1)
    rows = pairs.select("path", "line", F.posexplode(F.arrays_zip("found", F.slice("gaps", F.lit(1), F.size("found")).alias("gap"))).alias("at", "h"))
    length = F.length("h.found")
    before = Window.partitionBy("path", "line").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select("path", "line", "at", F.col("h.found").alias("match"), length.alias("length"), F.col("h.gap").alias("gap"))
    placed = placed.withColumn("column", (F.sum(F.col("gap") + F.col("length")).over(before) - F.col("length") + 1).cast("int"))
    whole = hit.select("path", "line", F.trim("text").alias("text"))
    return placed.join(whole, ["path", "line"]).select("path", "line", "column", "length", "match", "text")


def count_hits(lines: DataFrame, query: str) -> DataFrame:
    """(path, hits) of a text in any case; no positions are needed, so nothing is exploded."""
    return lines.select("path", F.regexp_count("text", F.lit(r"(?i)\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E")).alias("n")).groupBy("path").agg(F.sum("n").alias("hits"))


def replace_in(files: DataFrame, query: str, new: str, regex: bool = False, case_sensitive: bool = True, first_only: bool = False, content: str = "content") -> DataFrame:
    """files with the text replaced everywhere, or at its first place only."""
    pattern = ("" if case_sensitive else "(?i)") + (query if regex else r"\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E")
    safe = new if regex else new.replace("\\", "\\\\").replace("$", "\\$")
    if not first_only:
        return files.withColumn(content, F.regexp_replace(content, pattern, safe))
    once = F.split(content, pattern, 2)
    found = F.regexp_substr(content, F.lit(pattern))
    put = F.regexp_replace(found, pattern, safe)
    return files.withColumn(content, F.when(found.isNotNull(), F.concat(F.get(once, 0), put, F.get(once, 1))).otherwise(F.col(content)))


def warnings(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("text").contains("warning:"))


def included_files(lines: DataFrame) -> DataFrame:
    """(path, included): files named by # n "file" markers, each once, without pseudo files."""
    name = F.regexp_extract("text", r'^#\s+\d+\s+"([^"]+)"', 1)
    return lines.select("path", name.alias("included"), "line").where("included <> '' and not startswith(included, '<')").groupBy("path", "included").agg(F.min("line").alias("line"))


def dot_config(lines: DataFrame) -> DataFrame:
    """(name, value) of a kernel configuration: y and m are 1, n and "is not set" 0, strings unquoted; CONFIG_ only."""
    off, pair = r"^#\s*(CONFIG_\w+) is not set", r"^(CONFIG_\w+)=(.*)$"
    t = F.trim("text")
    name = F.coalesce(F.nullif(F.regexp_extract(t, pair, 1), F.lit("")), F.nullif(F.regexp_extract(t, off, 1), F.lit("")))
    raw = F.regexp_extract(t, pair, 2)
    value = F.when(t.rlike(off), "0").when(raw.isin("y", "m"), "1").when(raw == "n", "0").otherwise(F.regexp_replace(raw, '^"(.*)"$', "$1"))
    return lines.select("line", name.alias("name"), value.alias("value")).where("name is not null")


def config_enabled(config: DataFrame) -> DataFrame:
    """config with enabled: a value that is not 0."""
    return config.withColumn("enabled", F.coalesce(F.col("value") != "0", F.lit(False)))
