"""Rows that front ends show: function lists and details, callers, outlines, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runpath import fixed
from runpath.functions import text as T
from runpath.operators import relational as R


def function_rows(functions: DataFrame) -> DataFrame:
    """(path, name, return_type, line, is_callback, callback_context, calls): the line of a function without one is 0."""
    return functions.select("path", "name", "return_type", F.coalesce("line", F.lit(0)).alias("line"), "is_callback", "callback_context", "calls")


def function_locations(functions: DataFrame) -> DataFrame:
    """(path, name, line, column, is_callback): columns count from 0, which is all that is known of them."""
    return functions.select("path", "name", F.coalesce("line", F.lit(0)).alias("line"), F.lit(0).alias("column"), "is_callback")


def function_details(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions with their lines, parameters, callees and callers (M21, P4); callers come from the reversed edges(path, src, dst)."""
    back = edges.groupBy("path", F.col("dst").alias("name")).agg(F.array_sort(F.collect_set("src")).alias("called_by"))
    rows = functions.select("path", "name", "return_type", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), "is_callback", "callback_context", "calls", "params")
    return rows.join(back, ["path", "name"], "left").withColumn("called_by", F.coalesce("called_by", F.array().cast("array<string>")))


def caller_rows(functions: DataFrame, name: str) -> DataFrame:
    """(name, path, line, call_type, mechanism) of the functions that call one (M21, P7): a call by a callback counts as async."""
    found = functions.where(F.array_contains("calls", name))
    return found.select("name", "path", F.coalesce("line", F.lit(0)).alias("line"), F.when(F.col("is_callback"), "async").otherwise("direct").alias("call_type"), F.col("callback_context").alias("mechanism"))


def project_info(functions: DataFrame, structs: DataFrame, files: DataFrame) -> DataFrame:
    """(files_count, functions_count, structs_count, indexed): one row."""
    wide = R.index_stats(functions, structs, files)
    n = lambda what: F.coalesce(F.max(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    return wide.agg(n("files").alias("files_count"), n("functions").alias("functions_count"), n("structs").alias("structs_count")).withColumn("indexed", F.col("files_count") > 0)


def outline(functions: DataFrame, structs: DataFrame) -> DataFrame:
    """(path, place, kind, section, name, line, signature): symbols of each file by line, then name."""
    f = functions.select("path", F.lit("function").alias("kind"), "name", "line", T.format_signature("return_type", "name", F.transform("params", lambda p: p["type_name"])).alias("signature"))
    s = structs.select("path", F.lit("struct").alias("kind"), "name", "line", F.concat(F.lit("struct "), "name").alias("signature"))
    return sorted_by_line(f.union(s)).withColumn("section", T.from_rows(F.col("kind"), fixed.OUTLINE_KINDS, 1))


def sorted_by_line(items: DataFrame) -> DataFrame:
    """items with their place in their file, by line, then name (O2)."""
    return items.withColumn("place", F.row_number().over(R.Window.partitionBy("path").orderBy("line", "name", "kind")))


def known_functions(outlines: DataFrame, tree: DataFrame) -> DataFrame:
    """(name): functions of outlines and nodes of trees."""
    return outlines.where("kind = 'function'").select("name").union(tree.select(F.col("node").alias("name"))).distinct()


def recent_matches(files: DataFrame, query: str) -> DataFrame:
    """Recent files whose name or path holds the query, in any case; all for an empty query."""
    if not query.strip():
        return files
    q = query.lower()
    return files.where(F.lower("name").contains(q) | F.lower("path").contains(q))


def flat_files(listing: DataFrame) -> DataFrame:
    """Files of a directory listing, without the directories."""
    return listing.where("not is_dir").select("path", "name")


def go_to_line(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(path, line) with valid: the line is one of the file's (M23). files(path, n_lines)."""
    return wanted.join(files.select("path", "n_lines"), "path", "left").withColumn("valid", F.coalesce(F.col("line").between(F.lit(1), F.col("n_lines")), F.lit(False))).drop("n_lines")


def tabs_after_close(tabs: DataFrame, closed: DataFrame) -> DataFrame:
    """(user, tab, active): open tabs(user, ord, tab, active) without the closed ones (user, tab); where the active one goes, the next one is active, else the one before (P20)."""
    w = R.Window.partitionBy("user")
    marked = tabs.join(closed.select("user", "tab").distinct().withColumn("gone", F.lit(True)), ["user", "tab"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    at = F.max(F.when(F.col("active"), F.col("ord"))).over(w)
    lost = F.max(F.col("active") & F.col("gone")).over(w)
    left = marked.withColumns({"at": at, "lost": lost}).where("not gone")
    after, before = F.min(F.when(F.col("ord") > F.col("at"), F.col("ord"))).over(w), F.max(F.when(F.col("ord") < F.col("at"), F.col("ord"))).over(w)
    return left.withColumn("active", F.when(F.col("lost"), F.coalesce(F.col("ord") == F.coalesce(after, before), F.lit(False))).otherwise(F.col("active"))).select("user", "ord", "tab", "active")


RECENT = "array<struct<path:string,name:string,timestamp:bigint,isProject:boolean>>"


def recent_state(states: DataFrame, keep: int = fixed.RECENT_FILES) -> DataFrame:
    """(user, place, path, name, timestamp, is_project): recent files from states(user, state), JSON lists, most recent first (S17); of a path that comes twice the last counts."""
    each = states.select("user", F.explode(F.from_json("state", RECENT)).alias("r")).select("user", "r.path", "r.name", "r.timestamp", F.col("r.isProject").alias("is_project")).where("path is not null")
    once = each.groupBy("user", "path").agg(F.max_by(F.struct("name", "timestamp", "is_project"), "timestamp").alias("r"))
    order = Window.partitionBy("user").orderBy(F.desc("r.timestamp"), F.desc(F.length("path")), F.desc("path"))
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).select("user", "place", "path", "r.name", "r.timestamp", "r.is_project")
