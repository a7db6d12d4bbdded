"""Operators around calls, changes and knowledge: callback identification, impact, bridges, lanes, parameter flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runpath.functions import text as T
from runpath.operators import graph as G
from runpath.operators import relational as R


def identify_callbacks(functions: DataFrame, callbacks: DataFrame) -> DataFrame:
    """(name, framework, callback): the callback whose name is part of the function's, the longest, then the first by name.

    Only substrings that can be a callback's name are joined, so this is an equality join.
    """
    known = callbacks.select("framework", "callback").distinct().withColumn("__len", F.length("callback"))
    lengths = [r[0] for r in known.select("__len").distinct().collect()]  # lengths of a fixed table's names
    n = F.length("name")

    def substrings(size: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substr(F.col("name"), i, F.lit(size)))
        return F.when(n >= size, every).otherwise(F.array().cast("array<string>"))

    picked = [substrings(size) for size in lengths]
    rows = functions.select("name").distinct().withColumn("callback", F.explode(F.array_distinct(F.concat(*picked)))).join(known, "callback")
    return rows.groupBy("name").agg(F.min(F.struct((-F.col("__len")).alias("l"), "framework", "callback")).alias("b")).select("name", "b.framework", "b.callback")


def impact(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, hops) of everything that calls a changed function, however far."""
    return G.closure(edges, changed, reverse=True)


def changed_functions(changed_lines: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions around changed lines (path, line)."""
    f = functions.select("path", "name", F.col("line").alias("lo"), F.col("end_line").alias("hi"))
    return R.in_range(changed_lines, f, "path", "line", "lo", "hi").select("path", "name").distinct()


def bridges(natives: DataFrame, symbols: DataFrame) -> DataFrame:
    """(method, name): native methods and the C functions that implement them (D3)."""
    return natives.select("method", T.jni_name("method").alias("name")).join(symbols.select("name").distinct(), "name").select("method", "name")


def registrations(functions: DataFrame) -> DataFrame:
    """Functions that register callbacks: by name, or as they take a function pointer."""
    takes = F.exists("params", lambda p: p["type_name"].contains("(*)"))
    return functions.where(T.is_register_function("name") | takes)


def parameter_flow(calls: DataFrame, parameters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Copy constraints from arguments to parameters, for the points-to solver (D9). calls(*by, callee, position, argument), parameters(*by, function, position, name)."""
    p = parameters.select(*by, F.col("function").alias("callee"), "position", F.col("name").alias("dest"))
    return calls.join(p, [*by, "callee", "position"]).select(*by, F.lit("Copy").alias("kind"), "dest", F.col("argument").alias("src"), F.lit(None).cast("string").alias("field")).distinct()


def active_lines(lines: DataFrame, regions: DataFrame, macros: DataFrame) -> DataFrame:
    """Lines outside conditional regions whose macro is off (D12). regions(path, lo, hi, macro), macros(name, value)."""
    on = macros.where("value <> '0'").select(F.col("name").alias("macro")).distinct()
    off = regions.join(on, "macro", "left_anti").select("path", "lo", "hi")
    hidden = R.in_range(lines.select("path", "line").distinct(), off, "path", "line", "lo", "hi").select("path", "line").distinct()
    return lines.join(hidden, ["path", "line"], "left_anti").select(*lines.columns)


def lanes(chains: DataFrame) -> DataFrame:
    """Chain nodes with their swim lane."""
    lane = F.when(F.col("is_user_entry"), "user").when(F.col("context") == "HardIrq", "hardware").otherwise("kernel")
    return chains.select("chain_id", "ord", "function", lane.alias("lane"))


def lanes_of(entries: DataFrame, chains: DataFrame) -> DataFrame:
    """(path, root, ord, function, lane): the lanes through which each entry(path, root, chain_id) is reached."""
    return entries.select("path", "root", "chain_id").join(F.broadcast(lanes(chains)), "chain_id").select("path", "root", "ord", "function", "lane")  # chains are a fixed table


def async_timeline(bindings: DataFrame, timeline: DataFrame, chains: DataFrame, patterns: Column) -> DataFrame:
    """(path, handler, phase, name, first_function, context): what runs before a bound handler, phase by phase.

    timeline(pattern, phase, name, context, chain_id), chains(chain_id, ord, function); patterns is the pattern of a binding.
    """
    first = chains.groupBy("chain_id").agg(F.min_by("function", "ord").alias("first_function"))
    phases = timeline.join(first, "chain_id").select("pattern", "phase", "name", "first_function", "context")  # fixed tables
    return bindings.select("path", "handler", patterns.alias("pattern")).distinct().join(F.broadcast(phases), "pattern").drop("pattern")


def page(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """One page of results in a fixed order."""
    return rows.orderBy(*order).offset(offset).limit(size)


def export_text(lines: DataFrame, folder: str, order: list[str], column: str = "text") -> None:
    """Lines in order (K8): one text file for each range of them, whose names are in order too, so that no task writes all."""
    lines.orderBy(*order).select(column).write.mode("overwrite").text(folder)
