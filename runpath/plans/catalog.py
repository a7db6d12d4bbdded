"""Registered queries: the operators over the driver's tables, and the same in DuckDB SQL.

Relations are projections of whole tables: parts as symbols, line items as edges and constraints, orders as intervals
and classified edges, events as accesses, documents as files, pages as sources, conversations as scenario steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath.functions import text as T
from runpath.functions import values as V
from runpath.operators import caches
from runpath.operators import design as D
from runpath.operators import graph as G
from runpath.operators import patterns as P
from runpath.operators import points_to as PT
from runpath.operators import relational as R
from runpath.plans.registry import query, table
from runpath.sources.files import listing

SYMBOLS_SQL = """(SELECT p_name AS name, CASE p_size % 5 WHEN 0 THEN 'struct' WHEN 1 THEN 'macro' WHEN 2 THEN 'enum' ELSE 'function' END AS kind, p_brand AS file,
 CAST(p_partkey % 1000 + 1 AS BIGINT) AS line, p_size % 7 = 0 AS is_callback, p_type AS return_type, p_partkey AS id FROM part)"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 5
    kind = F.when(k == 0, "struct").when(k == 1, "macro").when(k == 2, "enum").otherwise("function")
    return table(spark, d, "part").select(
        F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_brand").alias("file"), (F.col("p_partkey") % 1000 + 1).alias("line"),
        (F.col("p_size") % 7 == 0).alias("is_callback"), F.col("p_type").alias("return_type"), F.col("p_partkey").alias("id"),
    )


EDGES_SQL = "(SELECT DISTINCT 's' || l_suppkey AS src, CASE WHEN l_partkey % 3 = 0 THEN 'x' || l_partkey % 50 ELSE 's' || l_partkey % 120 END AS dst FROM lineitem)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    s = lambda c: F.concat(F.lit("s"), c.cast("string"))
    dst = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("x"), (F.col("l_partkey") % 50).cast("string"))).otherwise(s(F.col("l_partkey") % 120))
    return table(spark, d, "lineitem").select(s(F.col("l_suppkey")).alias("src"), dst.alias("dst")).distinct()


# -- search -----------------------------------------------------------------------------------------------------------
@query("symbol_search", f"SELECT name, kind, file, line, id FROM {SYMBOLS_SQL} WHERE contains(lower(name), 'an')")
def _(s, d):
    return R.search(symbols(s, d), "AN").select("name", "kind", "file", "line", "id")


@query("symbol_search_case", f"SELECT name, id FROM {SYMBOLS_SQL} WHERE contains(name, 'a')")
def _(s, d):
    return R.search(symbols(s, d), "a", case_sensitive=True).select("name", "id")


@query("symbol_search_top", f"""WITH a AS (SELECT name, kind, file, line FROM (SELECT name, 'function' AS kind, file, line FROM {SYMBOLS_SQL} WHERE kind = 'function'
 UNION ALL SELECT name, 'struct' AS kind, file, line FROM {SYMBOLS_SQL} WHERE kind = 'struct') WHERE contains(lower(name), 'ar')) SELECT name, kind, file, line FROM a ORDER BY name, kind, file, line LIMIT 50""")
def _(s, d):
    x = symbols(s, d).select("name", "kind", "file", "line")
    return R.search_symbols(x.where("kind = 'function'").drop("kind"), x.where("kind = 'struct'").drop("kind"), "ar").select("name", "kind", "file", "line")


@query("outline_filter", f"SELECT id, name FROM {SYMBOLS_SQL} WHERE contains(lower(name), 'brand#1') OR contains(lower(file), 'brand#1') OR contains(lower(return_type), 'brand#1')")
def _(s, d):
    return R.outline_filter(symbols(s, d), "Brand#1", ["name", "file", "return_type"]).select("id", "name")


@query("name_predicates", """SELECT p_partkey AS id, regexp_matches(lower(n), 'register|subscribe|connect|bind|attach|add_handler|set_callback|on_|listen') AS is_register,
 regexp_matches(lower(n), 'queue_work|schedule_work|schedule_delayed_work|enqueue|push|add_task|submit|kthread_queue_work|queue_delayed_work|tasklet_schedule|tasklet_hi_schedule') AS is_queue,
 regexp_matches(lower(n), 'connect|signal_connect|g_signal_connect|on|bind|subscribe|attach_handler|add_signal_handler|notify_register') AS is_signal,
 regexp_matches(lower(n), 'callback|handler|func|fn|ops|probe|remove|open|close|read|write|init|exit|start|stop|notify') AS is_field,
 contains(n, '->') OR contains(n, '.') OR contains(n, '[') AS is_target, regexp_matches(n, '^(kmalloc|kzalloc|printk|pr_|dev_|list_)') AS is_api
 FROM (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'dev->' || p_name WHEN 1 THEN 'on_' || p_type WHEN 2 THEN 'list_' || p_name WHEN 3 THEN 'ops[' || p_size || ']' WHEN 4 THEN 'enqueue_' || p_brand ELSE p_name END AS n FROM part)""")
def _(s, d):
    k, f = F.col("p_size") % 6, F.concat
    n = F.when(k == 0, f(F.lit("dev->"), "p_name")).when(k == 1, f(F.lit("on_"), "p_type")).when(k == 2, f(F.lit("list_"), "p_name")).when(k == 3, f(F.lit("ops["), F.col("p_size").cast("string"), F.lit("]"))).when(k == 4, f(F.lit("enqueue_"), "p_brand")).otherwise(F.col("p_name"))
    x = table(s, d, "part").select(F.col("p_partkey").alias("id"), n.alias("n"))
    return x.select("id", T.is_register_function("n").alias("is_register"), T.is_queue_function("n").alias("is_queue"), T.is_signal_connect_function("n").alias("is_signal"), T.looks_like_callback_field("n").alias("is_field"), T.is_callback_target("n").alias("is_target"), T.is_kernel_api("n").alias("is_api"))


@query("callback_filter", f"SELECT id, name, coalesce(CASE WHEN line % 2 = 0 THEN file END, 'unknown') AS callback_context FROM {SYMBOLS_SQL} WHERE is_callback")
def _(s, d):
    x = symbols(s, d).withColumn("callback_context", F.when(F.col("line") % 2 == 0, F.col("file")))
    return R.callbacks(x).select("id", "name", "callback_context")


@query("fuzzy_palette", """WITH q AS (SELECT 'eoy' AS q), c AS (SELECT p_partkey, p_type AS name, lower(p_type) AS t FROM part),
 s AS (SELECT p_partkey, name, t, list_reduce(list_prepend({'at': 0, 'score': 0, 'last': '', 'c': ''}, list_transform(string_split(t, ''), lambda x: {'at': 0, 'score': 0, 'last': '', 'c': x})),
  lambda a, b: {'at': CASE WHEN b.c = substr('eoy#', a.at + 1, 1) THEN a.at + 1 ELSE a.at END,
   'score': a.score + CASE WHEN b.c = substr('eoy#', a.at + 1, 1) THEN CASE WHEN a.at > 0 AND a.last = substr('eoy', a.at, 1) THEN 15 ELSE 10 END ELSE 0 END, 'last': b.c, 'c': ''}) AS r FROM c)
 SELECT p_partkey AS id, name, CAST(CASE WHEN instr(t, 'eoy') > 0 THEN 100 - (instr(t, 'eoy') - 1) + CASE WHEN t = 'eoy' THEN 50 ELSE 0 END ELSE r.score END AS INTEGER) AS score
 FROM s WHERE instr(t, 'eoy') > 0 OR r.at = 3""")
def _(s, d):
    x = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    return x.withColumn("score", T.fuzzy_score("eoy", "name")).where("score is not null")


@query("palette_top", """WITH c AS (SELECT DISTINCT p_name AS name FROM part) SELECT name, CAST(100 - (instr(lower(name), 'gear') - 1) AS INTEGER) AS score FROM c WHERE contains(lower(name), 'gear') ORDER BY score DESC, name LIMIT 30""")
def _(s, d):
    return R.palette(table(s, d, "part").select(F.col("p_name").alias("name")).distinct(), "gear").select("name", "score")


# -- joins ------------------------------------------------------------------------------------------------------------
@query("mark_known_callees", f"SELECT e.src, e.dst, CASE WHEN f.name IS NULL THEN 'External' ELSE 'Known' END AS target FROM {EDGES_SQL} e LEFT JOIN (SELECT DISTINCT 's' || s_suppkey AS name FROM supplier) f ON e.dst = f.name")
def _(s, d):
    known = table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"))
    return R.mark_known(edges(s, d), known)


@query("callers_direct_async", f"SELECT DISTINCT src AS caller, 'direct' AS call_kind FROM {EDGES_SQL} WHERE dst = 's7' UNION SELECT DISTINCT event_type AS caller, 'async' AS call_kind FROM events WHERE 's' || user_id = 's7'")
def _(s, d):
    b = table(s, d, "events").select(F.col("event_type").alias("mechanism"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("handler"))
    return R.callers(edges(s, d), "s7", b)


NATION_EDGES = "(SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst FROM supplier)"


def nation_edges(s: SparkSession, d: str) -> DataFrame:
    n, u, c = table(s, d, "nation"), table(s, d, "supplier"), lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    return n.select(c("r", "n_regionkey").alias("src"), c("n", "n_nationkey").alias("dst")).union(u.select(c("n", "s_nationkey"), c("s", "s_suppkey")))


@query("second_level_callers", f"SELECT DISTINCT a.dst AS name, a.src AS caller, b.src AS caller_of_caller FROM {NATION_EDGES} a JOIN {NATION_EDGES} b ON a.src = b.dst")
def _(s, d):
    return R.second_callers(nation_edges(s, d))


@query("range_join", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("hi"))
    return R.in_range(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), o, "l_orderkey", "l_shipdate", "lo", "hi").select("l_orderkey", "l_linenumber", "l_shipdate")


@query("needs_reindex", "SELECT d.doc_id AS path, d.n_chars AS mtime FROM documents d LEFT JOIN (SELECT l.doc_id, x.n_chars + 1 - l.quality AS m FROM labels l JOIN documents x USING (doc_id)) v ON d.doc_id = v.doc_id WHERE v.m IS NULL OR v.m <> d.n_chars")
def _(s, d):
    snap = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"))
    v = table(s, d, "labels").select(F.col("doc_id").alias("path"), "quality").join(snap, "path").select("path", (F.col("mtime") + 1 - F.col("quality")).alias("mtime"))
    return R.needs_reindex(snap, v)


@query("resolve_invocations", """WITH b AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'h' || l_suppkey % 10 || '[' || l_linenumber || ']' ELSE 'o' || l_suppkey % 10 || '.cb' END AS target, 'f' || l_partkey % 30 AS handler FROM lineitem),
 i AS (SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 THEN 'h' || o_custkey % 12 || '[' || o_custkey % 5 || ']' ELSE 'o' || o_custkey % 12 || '.cb' END AS expr FROM orders)
 SELECT expr, array_to_string(list_sort(list(DISTINCT handler)), ',') AS handlers FROM b JOIN i ON target = expr OR (contains(target, '[') AND contains(expr, '[') AND string_split(target, '[')[1] = string_split(expr, '[')[1]) GROUP BY expr""")
def _(s, d):
    cat = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    b = li.select(F.when(F.col("l_linenumber") % 2 == 0, cat("h", F.col("l_suppkey") % 10, "[", F.col("l_linenumber"), "]")).otherwise(cat("o", F.col("l_suppkey") % 10, ".cb")).alias("target"), cat("f", F.col("l_partkey") % 30).alias("handler"))
    i = o.select(F.when(F.col("o_custkey") % 2 == 0, cat("h", F.col("o_custkey") % 12, "[", F.col("o_custkey") % 5, "]")).otherwise(cat("o", F.col("o_custkey") % 12, ".cb")).alias("expr"))
    return R.resolve_invocations(b, i).select("expr", F.array_join("handlers", ",").alias("handlers"))


SIGS_SQL = """(SELECT DISTINCT 'f' || p_type || p_size AS name, CASE p_size % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'size_t' WHEN 2 THEN 'const void*' ELSE 'struct dev*' END AS return_type,
 list_transform(string_split(p_type, ' '), lambda x: CASE WHEN x IN ('STANDARD', 'PROMO', 'SMALL') THEN 'int' WHEN x IN ('BRUSHED', 'PLATED') THEN 'void*' WHEN x = 'STEEL' THEN 'struct s*' ELSE lower(x) END) AS params FROM part)"""


def signatures(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 4
    ret = F.when(k == 0, "int").when(k == 1, "size_t").when(k == 2, "const void*").otherwise("struct dev*")
    par = F.transform(F.split("p_type", " "), lambda x: F.when(x.isin("STANDARD", "PROMO", "SMALL"), "int").when(x.isin("BRUSHED", "PLATED"), "void*").when(x == "STEEL", "struct s*").otherwise(F.lower(x)))
    return table(s, d, "part").select(F.concat(F.lit("f"), "p_type", F.col("p_size").cast("string")).alias("name"), ret.alias("return_type"), par.alias("params")).distinct()


_NORM = "trim(replace(replace(replace(replace(trim({0}), 'const ', ''), 'volatile ', ''), 'struct ', ''), '  ', ' '))"
_INTS = "('int', 'long', 'unsigned', 'unsigned int', 'unsigned long', 'size_t', 'ssize_t')"
_COMPAT = "({x} = {y} OR ({x} = 'void*' AND suffix({y}, '*')) OR ({y} = 'void*' AND suffix({x}, '*')) OR ({x} IN " + _INTS + " AND {y} IN " + _INTS + "))"
_both = lambda a, b: _COMPAT.format(x=_NORM.format(a), y=_NORM.format(b))


@query("compatible_functions", f"""WITH s AS {SIGS_SQL}, t AS (SELECT DISTINCT return_type, params FROM s)
 SELECT t.return_type || '(' || array_to_string(t.params, ',') || ')' AS type_name, CAST(count(DISTINCT s.name) AS BIGINT) AS n, md5(array_to_string(list_sort(list(DISTINCT s.name)), ',')) AS functions
 FROM t JOIN s ON len(t.params) = len(s.params) AND {_both('t.return_type', 's.return_type')}
 AND len(list_filter(range(1, len(s.params) + 1), lambda i: NOT {_both('s.params[i]', 't.params[i]')})) = 0 GROUP BY 1""")
def _(s, d):
    f = signatures(s, d)
    t = f.select(F.concat("return_type", F.lit("("), F.array_join("params", ","), F.lit(")")).alias("name"), "return_type", "params").distinct()
    out = R.compatible_functions(t, f)
    return out.select("type_name", F.size("functions").cast("long").alias("n"), F.md5(F.array_join("functions", ",").cast("binary")).alias("functions"))


_C = lambda a, b: f"(trim({a}) = trim({b}) OR (trim({a}) IN ('void *', 'void*') AND trim({b}) IN ('void *', 'void*')) OR (contains({a}, 'struct') AND contains({a}, '*') AND trim({b}) IN ('void *', 'void*')) OR (contains({b}, 'struct') AND contains({b}, '*') AND trim({a}) IN ('void *', 'void*')) OR (trim({a}) IN ('int', 'long') AND trim({b}) IN ('int', 'long')))"


@query("candidate_scores", f"""WITH s AS {SIGS_SQL}, t AS (SELECT DISTINCT return_type, params FROM s), p AS (
 SELECT t.return_type || '(' || array_to_string(t.params, ',') || ')' AS type_name, s.name AS function, CAST(CASE WHEN {_C('t.return_type', 's.return_type')} THEN 40 ELSE 0 END + CASE WHEN len(t.params) = len(s.params) THEN
  30 + len(list_filter(range(1, len(s.params) + 1), lambda i: {_C('t.params[i]', 's.params[i]')})) * (30 // greatest(len(t.params), 1)) ELSE 0 END AS INTEGER) AS score FROM t, s)
 SELECT type_name, score, CAST(count(*) AS BIGINT) AS n FROM p WHERE score > 0 GROUP BY 1, 2""")
def _(s, d):
    f = signatures(s, d)
    t = f.select(F.concat("return_type", F.lit("("), F.array_join("params", ","), F.lit(")")).alias("name"), "return_type", "params").distinct()
    return R.candidates(t, f).groupBy("type_name", "score").agg(F.count("*").alias("n"))


_TURNS = "(SELECT conv_id, turn // 2 AS line, text FROM conversations WHERE turn % 2 = {})"


@query("line_diff", f"""WITH o AS {_TURNS.format(0)}, n AS {_TURNS.format(1)}, b AS (SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, coalesce(o.line, n.line) AS line, o.text AS o, n.text AS n FROM o FULL JOIN n ON o.conv_id = n.conv_id AND o.line = n.line)
 SELECT conv_id, CAST(line AS BIGINT) AS line, 'same' AS kind, o AS text FROM b WHERE o IS NOT DISTINCT FROM n UNION ALL SELECT conv_id, CAST(line AS BIGINT), 'removed', o FROM b WHERE o IS DISTINCT FROM n AND o IS NOT NULL UNION ALL SELECT conv_id, CAST(line AS BIGINT), 'added', n FROM b WHERE o IS DISTINCT FROM n AND n IS NOT NULL""")
def _(s, d):
    c = table(s, d, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("line"), "turn", "text")
    return R.line_diff(c.where("turn % 2 = 0"), c.where("turn % 2 = 1"), ["conv_id", "line"])


# -- aggregates -------------------------------------------------------------------------------------------------------
@query("functions_by_file", f"SELECT file, CAST(count(DISTINCT name) AS BIGINT) AS n, md5(array_to_string(list_sort(list(DISTINCT name)), '|')) AS names FROM {SYMBOLS_SQL} GROUP BY file")
def _(s, d):
    return R.group_sorted(symbols(s, d), "file", "name", "names").select("file", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", "|").cast("binary")).alias("names"))


@query("index_stats", f"SELECT 'functions' AS what, count(*) AS n FROM {SYMBOLS_SQL} WHERE kind = 'function' UNION ALL SELECT 'structs', count(*) FROM {SYMBOLS_SQL} WHERE kind = 'struct' UNION ALL SELECT 'files', count(DISTINCT file) FROM {SYMBOLS_SQL}")
def _(s, d):
    x = symbols(s, d)
    return R.index_stats(x.where("kind = 'function'"), x.where("kind = 'struct'"), x.select("file").distinct())


@query("outline_sections", f"SELECT kind, count(*) AS n, CAST(list_position(['function', 'struct', 'enum'], kind) AS INTEGER) AS section FROM {SYMBOLS_SQL} WHERE kind IN ('function', 'struct', 'enum') GROUP BY kind")
def _(s, d):
    return R.sections(symbols(s, d), ["function", "struct", "enum"])


_CONF = "CASE {0} WHEN 'F' THEN 'Certain' WHEN 'O' THEN 'Possible' ELSE 'Unknown' END"


def conf(c: str):
    return F.when(F.col(c) == "F", "Certain").when(F.col(c) == "O", "Possible").otherwise("Unknown")


@query("classification_summary", f"WITH e AS (SELECT {_CONF.format('o_orderstatus')} AS c FROM orders) SELECT count(*) AS total, count(*) FILTER (c = 'Certain') AS certain, count(*) FILTER (c = 'Possible') AS possible, count(*) FILTER (c = 'Unknown') AS unknown, CAST(count(*) FILTER (c = 'Certain') * 100 // count(*) AS BIGINT) AS percent FROM e")
def _(s, d):
    return R.classification_summary(table(s, d, "orders").select(conf("o_orderstatus").alias("confidence")))


@query("overall_confidence", f"SELECT l_orderkey, CASE max(CASE {_CONF.format('l_linestatus')} WHEN 'Certain' THEN 0 WHEN 'Possible' THEN 1 ELSE 2 END) WHEN 0 THEN 'Certain' WHEN 1 THEN 'Possible' ELSE 'Unknown' END AS overall FROM lineitem GROUP BY l_orderkey")
def _(s, d):
    return R.overall_confidence(table(s, d, "lineitem").select("l_orderkey", conf("l_linestatus").alias("confidence")), ["l_orderkey"])


@query("classify_pointer_calls", "SELECT l_orderkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'Certain' ELSE 'Possible' END AS confidence FROM lineitem GROUP BY l_orderkey")
def _(s, d):
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("t"))
    return R.classify_targets(g, F.col("t")).select("l_orderkey", F.size("t").cast("long").alias("n"), "confidence")


@query("last_event_wins", "SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events GROUP BY user_id")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("seq"))
    return R.last_wins(e, ["user_id"], "seq").select("user_id", "event_id", "event_type")


@query("sample_statistics", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def _(s, d):
    return R.counts_with_total(table(s, d, "documents").select("lang", "source"), "lang", "source")


@query("text_stats", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(length(text) AS BIGINT) AS n_code_points FROM documents")
def _(s, d):
    return R.text_stats(table(s, d, "documents").select("doc_id", "text")).drop("text")


@query("line_scan", """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10))) AS t FROM documents)
 SELECT doc_id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM l GROUP BY doc_id""")
def _(s, d):
    return P.lines_of(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text").groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("find_in_text", """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10))) AS t FROM documents), p AS (SELECT doc_id, string_split(lower(t), 'tion') AS p FROM l WHERE contains(lower(t), 'tion'))
 SELECT doc_id, CAST(sum(len(p) - 1) AS BIGINT) AS hits, CAST(sum(list_sum(list_transform(range(1, len(p)), lambda i: length(array_to_string(p[1:i], 'tion')) + 1))) AS BIGINT) AS columns FROM p GROUP BY doc_id""")
def _(s, d):
    lines = P.lines_of(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return P.find_in_lines(lines, "tion").groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("hits"), F.sum("column").alias("columns"))


@query("replace_all", "SELECT doc_id, md5(replace(text, 'the', 'THE')) AS digest FROM documents")
def _(s, d):
    new = P.replace_in(table(s, d, "documents").select("doc_id", "text"), "the", "THE", content="text")
    return new.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("replace_first", r"SELECT doc_id, md5(regexp_replace(text, '(?i)tion[ ,.]', '[TION]')) AS digest FROM documents")
def _(s, d):
    new = P.replace_in(table(s, d, "documents").select("doc_id", "text"), r"tion[ ,.]", "[TION]", regex=True, case_sensitive=False, first_only=True, content="text")
    return new.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("content_hash", "SELECT doc_id, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS hash FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.content_hash("text").alias("hash"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# -- windows and state ------------------------------------------------------------------------------------------------
@query("change_states", "SELECT event_id, event_type, CASE WHEN p IS NULL THEN 'new' WHEN p <> event_type THEN 'changed' ELSE 'unchanged' END AS change FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def _(s, d):
    return R.change_states(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type", "change")


@query("navigation_history", """WITH a AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM a WHERE p IS NULL OR p <> event_type)
 SELECT user_id, event_id, CAST(recency AS INTEGER) AS recency FROM b WHERE recency <= 50""")
def _(s, d):
    return R.without_repeats(table(s, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "recency")


@query("recent_items", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS recency FROM a WHERE r = 1)
 SELECT event_type, user_id, event_id, CAST(recency AS INTEGER) AS recency FROM b WHERE recency <= 10""")
def _(s, d):
    return R.most_recent(table(s, d, "events"), ["event_type"], ["user_id"], ["ts", "event_id"]).select("event_type", "user_id", "event_id", "recency")


@query("search_ring", """SELECT conv_id, turn, coalesce(lead(turn) OVER w, first(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_hit,
 coalesce(lag(turn) OVER w, last(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_hit FROM (SELECT DISTINCT conv_id, turn FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(s, d):
    return R.search_ring(table(s, d, "conversations").select("conv_id", "turn").distinct(), ["conv_id"], ["turn"], "turn")


@query("lru_cache", "SELECT user_id, max(event_id) AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 100")
def _(s, d):
    return R.lru(table(s, d, "events"), "user_id", "event_id")


@query("debounce", """WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM a)
 SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, count(*) AS burst FROM b GROUP BY user_id, g""")
def _(s, d):
    return R.debounce(table(s, d, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", "6 hours").select("user_id", "event_id", "burst")


@query("keep_left_merge", "SELECT doc_id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    a, b = table(s, d, "labels").select("doc_id", F.lit("label").alias("origin")), table(s, d, "documents").select("doc_id", F.lit("document").alias("origin"))
    return R.keep_left(a, b, "doc_id")


@query("open_questions", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    return R.answered(table(s, d, "documents").select(F.col("doc_id").alias("id")), table(s, d, "labels").select(F.col("doc_id").alias("id")))


@query("first_occurrence", "SELECT file, arg_min(name, id) AS name FROM " + SYMBOLS_SQL + " GROUP BY file")
def _(s, d):
    return R.first_occurrence(symbols(s, d), ["file"], ["id"]).select("file", "name")


# -- graph ------------------------------------------------------------------------------------------------------------
_TREE = f"""WITH RECURSIVE e AS {NATION_EDGES}, k AS (SELECT DISTINCT src AS name FROM e), t AS (
 SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, ['r' || r_regionkey] AS path, CASE WHEN k.name IS NULL THEN 'External' ELSE 'Function' END AS node_type FROM region LEFT JOIN k ON 'r' || r_regionkey = k.name
 UNION ALL SELECT t.root, e.dst, t.node, t.depth + 1, list_append(t.path, e.dst), CASE WHEN list_contains(t.path, e.dst) THEN 'Ref' WHEN k.name IS NULL THEN 'KernelApi' ELSE 'Function' END FROM t JOIN e ON t.node = e.src LEFT JOIN k ON e.dst = k.name WHERE t.node_type = 'Function' AND t.depth < 20) """


def nation_tree(s: SparkSession, d: str) -> DataFrame:
    e = nation_edges(s, d)
    roots = table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("name"))
    return G.flow_tree(s, e, roots, e.select(F.col("src").alias("name")))


@query("flow_tree", _TREE + "SELECT root, node, parent, depth, array_to_string(path, '/') AS path, node_type FROM t")
def _(s, d):
    return nation_tree(s, d).select("root", "node", "parent", "depth", F.array_join("trail", "/").alias("path"), "node_type")


@query("tree_children", _TREE + "SELECT root, parent, count(*) AS n_children FROM t WHERE parent IS NOT NULL GROUP BY root, parent")
def _(s, d):
    return G.child_counts(nation_tree(s, d))


@query("tree_markdown", _TREE + "SELECT root, repeat('  ', depth) || '- `' || node || '`' AS text FROM t")
def _(s, d):
    return G.render(nation_tree(s, d), "markdown").select("root", "text")


@query("tree_lines", _TREE + ", m AS (SELECT *, lead(node) OVER (PARTITION BY root, parent ORDER BY array_to_string(path, chr(1))) IS NULL AS is_last FROM t) SELECT root, repeat('   ', greatest(depth - 1, 0)) || CASE WHEN depth = 0 THEN '' WHEN is_last THEN '└─ ' ELSE '├─ ' END || node AS text FROM m")
def _(s, d):
    return G.render(nation_tree(s, d), "tree").select("root", "text")


@query("tree_to_depth", _TREE + "SELECT root, node FROM t WHERE depth < 2")
def _(s, d):
    return G.up_to_depth(nation_tree(s, d), 2).select("root", "node")


@query("tree_reachability", _TREE + "SELECT root, node, len(list_filter(path, lambda x: x IN ('n3', 'n7', 'r4'))) = 0 AS reachable FROM t")
def _(s, d):
    blocked = s.range(1).select(F.explode(F.array(F.lit("n3"), F.lit("n7"), F.lit("r4"))).alias("node"))
    return G.reachability(nation_tree(s, d), blocked).select("root", "node", "reachable")


@query("folded_callees", _TREE + "SELECT parent, node, node_type, count(*) AS times FROM t WHERE parent IS NOT NULL GROUP BY parent, node, node_type")
def _(s, d):
    return G.fold(nation_tree(s, d))


@query("tree_graph_edges", _TREE + "SELECT DISTINCT parent, node FROM t WHERE parent IS NOT NULL")
def _(s, d):
    return G.graph_of(nation_tree(s, d))[1]


@query("callee_closure", f"WITH RECURSIVE e AS {EDGES_SQL}, c AS (SELECT 's1' AS name UNION SELECT e.dst FROM c JOIN e ON c.name = e.src) SELECT name FROM c")
def _(s, d):
    return G.closure(edges(s, d), s.range(1).select(F.lit("s1").alias("name"))).select("name")


@query("caller_closure", f"WITH RECURSIVE e AS {EDGES_SQL}, c AS (SELECT 'x3' AS name UNION SELECT e.src FROM c JOIN e ON c.name = e.dst) SELECT name FROM c")
def _(s, d):
    return G.closure(edges(s, d), s.range(1).select(F.lit("x3").alias("name")), reverse=True).select("name")


#: The call graph without the edges of some callees, and with one that leads past them.
LATER_SQL = f"(SELECT src, dst FROM {EDGES_SQL} WHERE NOT (dst LIKE 's1%' AND CAST(substr(dst, 2) AS INTEGER) % 2 = 1) UNION SELECT 's2', 's113')"


@query("closure_maintained", f"""WITH RECURSIVE e AS {LATER_SQL}, c(name, hops) USING KEY (name) AS (SELECT 's1' AS name, 0 AS hops UNION SELECT n.name, n.hops FROM (SELECT e.dst AS name, min(c.hops) + 1 AS hops FROM c JOIN e ON c.name = e.src GROUP BY e.dst) n
 LEFT JOIN recurring.c o ON o.name = n.name WHERE o.name IS NULL) SELECT name, CAST(hops AS INTEGER) AS hops FROM c""")
def _(s, d):
    """The closure of the whole graph, brought up to date after edges have gone and one has come."""
    all_edges, start = edges(s, d), s.range(1).select(F.lit("s1").alias("name"))
    gone = F.col("dst").startswith("s1") & (F.substr("dst", F.lit(2)).try_cast("int") % 2 == 1)
    extra = s.range(1).select(F.lit("s2").alias("src"), F.lit("s113").alias("dst"))
    now = all_edges.where(~gone).unionByName(extra).distinct()
    return G.maintain_closure(G.closure(all_edges, start), now, all_edges.where(gone).join(extra, ["src", "dst"], "left_anti"), extra, start)


@query("shortest_path", f"WITH RECURSIVE e AS {NATION_EDGES}, c AS (SELECT 'r1' AS name, ['r1'] AS path UNION ALL SELECT e.dst, list_append(c.path, e.dst) FROM c JOIN e ON c.name = e.src) SELECT array_to_string(min(path), '/') AS path, CAST(len(min(path)) - 1 AS INTEGER) AS hops FROM c WHERE name = (SELECT 's' || min(s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)")
def _(s, d):
    t = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("n_regionkey = 1").agg(F.min("s_suppkey")).first()[0]
    return G.shortest_path(nation_edges(s, d), "r1", f"s{t}").select(F.array_join("path", "/").alias("path"), "hops")


@query("entry_points", f"""WITH f AS (SELECT file, id, name || id AS name, line, is_callback, file < 'Brand#3' AS is_static, CASE WHEN id % 97 = 17 THEN 0 WHEN id % 97 = 5 THEN 1 END AS rank FROM {SYMBOLS_SQL} WHERE file <> 'Brand#11' OR NOT is_callback),
 l AS (SELECT *, CASE WHEN rank IS NOT NULL OR is_callback THEN 1 WHEN NOT is_static THEN 2 ELSE 3 END AS level FROM f), b AS (SELECT *, min(level) OVER (PARTITION BY file) AS best FROM l)
 SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY coalesce(rank, 10), line, name) AS INTEGER) AS ord, name FROM b WHERE level = best""")
def _(s, d):
    f = symbols(s, d).where("file <> 'Brand#11' or not is_callback").select("file", F.concat("name", F.col("id").cast("string")).alias("name"), "line", "is_callback", (F.col("file") < "Brand#3").alias("is_static"), "id")
    m = f.where("id % 97 in (17, 5)").select("file", "name", F.when(F.col("id") % 97 == 17, 0).otherwise(1).alias("rank"))
    return G.entry_points(f.drop("id"), m, ("file",))


@query("chain_injection", """WITH c AS (SELECT 'c' || n_regionkey AS chain_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS ord, n_name AS function, r_name AS trigger FROM nation JOIN region ON n_regionkey = r_regionkey),
 z AS (SELECT chain_id, count(*) AS n, min(trigger) AS trigger FROM c GROUP BY chain_id), en AS (SELECT 's' || s_suppkey AS root, 'c' || s_nationkey % 7 AS chain_id FROM supplier)
 SELECT root, root AS node, CAST(coalesce(n + 1, 0) AS INTEGER) AS depth FROM en LEFT JOIN z USING (chain_id) UNION ALL SELECT root, trigger, 0 FROM en JOIN z USING (chain_id) UNION ALL SELECT root, function, ord FROM en JOIN c USING (chain_id)""")
def _(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    c = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("chain_id"), F.row_number().over(R.Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("ord"), F.col("n_name").alias("function"), F.col("r_name").alias("trigger"))
    u = table(s, d, "supplier")
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    tree = u.select(name.alias("root"), name.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array(name).alias("trail"), F.lit("Function").alias("node_type"))
    entries = u.select(name.alias("root"), F.concat(F.lit("c"), (F.col("s_nationkey") % 7).cast("string")).alias("chain_id"))
    return G.inject_chain(tree, c, entries).select("root", "node", "depth")


CONSTRAINTS_SQL = """(SELECT DISTINCT CASE WHEN z < 7 THEN 'AddressOf' WHEN z = 7 THEN 'Copy' WHEN z = 8 THEN 'Load' WHEN z = 9 THEN 'Store' WHEN z = 10 THEN 'FieldStore' ELSE 'FieldLoad' END AS kind,
 'd' || k // 2 || CASE WHEN z = 7 AND k % 3 = 1 THEN '[]' ELSE '' END AS dest, CASE WHEN z < 7 AND k % 40 > 0 THEN 'f' || k % 499 ELSE 'd' || (k * 7919 % 10007) * (k + 1) // 10007 // 2 END || CASE WHEN z = 7 AND k % 3 = 2 THEN '[]' ELSE '' END AS src
 FROM (SELECT p_partkey AS k, p_size % 12 AS z FROM part))"""


def constraints(s: SparkSession, d: str) -> DataFrame:
    """All eight kinds over locations d0, d1, ... and functions f0, f1, ..."""
    x = table(s, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 12).alias("z"))
    kinds = F.when(F.col("z") < 7, "AddressOf")
    for test, name in (("z = 7 and k % 3 = 0", "Copy"), ("z = 7 and k % 3 = 1", "ArrayStore"), ("z = 7", "ArrayLoad"), ("z = 8", "Load"), ("z = 9", "Store"), ("z = 10", "FieldStore"), ("z = 11", "FieldLoad")):
        kinds = kinds.when(F.expr(test), name)
    place = lambda e: F.concat(F.lit("d"), F.expr(f"({e}) div 2").cast("string"))
    src = F.when((F.col("z") < 7) & (F.col("k") % 40 > 0), F.concat(F.lit("f"), (F.col("k") % 499).cast("string"))).otherwise(place("(k * 7919 % 10007) * (k + 1) div 10007"))
    return x.select(kinds.alias("kind"), place("k").alias("dest"), src.alias("src"), F.when(F.col("z").isin(10, 11), "f").alias("field"))


POINTS_TO_SQL = f"""WITH RECURSIVE c AS {CONSTRAINTS_SQL}, p(loc, target) USING KEY (loc, target) AS (
 SELECT DISTINCT dest AS loc, src AS target FROM c WHERE kind = 'AddressOf' UNION SELECT DISTINCT n.loc, n.target FROM (
  SELECT c.dest AS loc, q.target FROM recurring.p q JOIN c ON c.kind = 'Copy' AND c.src = q.loc
  UNION ALL SELECT c.dest, q.target FROM recurring.p x JOIN c ON c.kind = 'Load' AND c.src = x.loc JOIN recurring.p q ON q.loc = x.target
  UNION ALL SELECT c.dest, q.target FROM recurring.p x JOIN c ON c.kind = 'FieldLoad' AND c.src = x.loc JOIN recurring.p q ON q.loc = x.target || '.f'
  UNION ALL SELECT x.target, q.target FROM recurring.p x JOIN c ON c.kind = 'Store' AND c.dest = x.loc JOIN recurring.p q ON q.loc = c.src
  UNION ALL SELECT x.target || '.f', q.target FROM recurring.p x JOIN c ON c.kind = 'FieldStore' AND c.dest = x.loc JOIN recurring.p q ON q.loc = c.src) n
 LEFT JOIN recurring.p o ON o.loc = n.loc AND o.target = n.target WHERE o.loc IS NULL) """


@query("points_to", POINTS_TO_SQL + "SELECT loc, target FROM p")
def _(s, d):
    return PT.solve(constraints(s, d))


@query("function_targets", POINTS_TO_SQL + "SELECT loc, array_to_string(list_sort(list(DISTINCT target)), ',') AS targets FROM p WHERE NOT starts_with(target, 'alloc:') AND NOT contains(target, '.') GROUP BY loc")
def _(s, d):
    return PT.solve_functions(constraints(s, d), joined=",").select("loc", "targets")


#: Suppliers whose calls double at every step: both functions of a step call both of the next.
@query("shared_trees", """SELECT 's' || s_suppkey || '_0_0' AS root, 's' || s_suppkey || '_' || d || '_' || i AS node, CAST(power(2, d - 1) AS BIGINT) AS paths, array_to_string(list_transform(range(0, d + 1), lambda x: 's' || s_suppkey || '_' || x || '_' || CASE WHEN x = d THEN i ELSE 0 END), '/') AS first
 FROM supplier, unnest(range(1, 21)) a(d), unnest([0, 1]) b(i) UNION ALL SELECT 's' || s_suppkey || '_0_0', 's' || s_suppkey || '_0_0', 1, 's' || s_suppkey || '_0_0' FROM supplier""")
def _(s, d):
    """A million paths end in the last functions of each supplier."""
    u = table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("u"))
    name = lambda step, i: F.concat_ws("_", "u", step.cast("string"), i.cast("string"))
    step = u.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(19))))
    both = step.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    calls = both.select(name(F.col("step"), F.col("i")).alias("src"), name(F.col("step") + 1, F.col("j")).alias("dst"))
    known = calls.select(F.col("src").alias("name")).union(calls.select("dst"))
    roots = u.select(F.concat("u", F.lit("_0_0")).alias("name"))
    shared = G.shared_tree(s, calls, roots, known)
    return G.shared_paths(shared).select("root", "node", F.col("paths").cast("long").alias("paths"), F.array_join("first", "/").alias("first"))


# -- paths ------------------------------------------------------------------------------------------------------------
@query("url_parts", "SELECT page_id, string_split(url, '/')[-1] AS name, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, CAST(len(string_split(url, '/')) - 1 AS INTEGER) AS depth FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.base_name("url").alias("name"), T.parent_path("url").alias("parent"), T.depth("url").alias("depth"))


# -- functions --------------------------------------------------------------------------------------------------------
@query("target_and_type_functions", r"""SELECT p_partkey, regexp_replace(replace(a, ' ', ''), '\[\d+\]', '[*]', 'g') AS target, trim(replace(replace(replace(replace(trim(b), 'const ', ''), 'volatile ', ''), 'struct ', ''), '  ', ' ')) AS type,
 CASE WHEN regexp_matches(trim(b), '\s\w+$') THEN regexp_replace(regexp_replace(trim(b), '\s+\w+$', ''), '\s+', ' ', 'g') ELSE trim(b) END AS simple, replace(replace(replace(c, '&', ''), '->', '.'), ' ', '') AS variable,
 CASE WHEN instr(c, '->') > 0 THEN string_split(c, '->')[1] WHEN instr(c, '.') > 0 THEN regexp_extract(c, '^(.*)\.[^.]*$', 1) ELSE c END AS base
 FROM (SELECT p_partkey, 'ops [' || p_size || '].' || p_name AS a, 'const struct ' || p_brand || ' *  ' || p_type AS b, CASE p_size % 3 WHEN 0 THEN '&dev->' || p_name WHEN 1 THEN 'a.b.' || p_type ELSE p_brand END AS c FROM part)""")
def _(s, d):
    k, cat = F.col("p_size") % 3, F.concat
    x = table(s, d, "part").select(
        "p_partkey", cat(F.lit("ops ["), F.col("p_size").cast("string"), F.lit("]."), "p_name").alias("a"), cat(F.lit("const struct "), "p_brand", F.lit(" *  "), "p_type").alias("b"),
        F.when(k == 0, cat(F.lit("&dev->"), "p_name")).when(k == 1, cat(F.lit("a.b."), "p_type")).otherwise(F.col("p_brand")).alias("c"),
    )
    return x.select("p_partkey", T.normalize_target("a").alias("target"), T.normalize_type("b").alias("type"), T.simplify_type("b").alias("simple"), T.normalize_variable("c").alias("variable"), T.field_base("c").alias("base"))


@query("signature_functions", r"""SELECT p_partkey, trim(string_split(trim(g), '(')[1]) AS ret, array_to_string(list_filter(list_transform(string_split(regexp_extract(trim(g), '^[^(]*\((.*).$', 1), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS params FROM (SELECT p_partkey, p_brand || ' (' || replace(p_type, ' ', ', ') || ')' AS g FROM part)""")
def _(s, d):
    x = table(s, d, "part").select("p_partkey", F.concat("p_brand", F.lit(" ("), F.replace("p_type", F.lit(" "), F.lit(", ")), F.lit(")")).alias("g"))
    return x.select("p_partkey", T.signature_return("g").alias("ret"), F.array_join(T.signature_params("g"), "|").alias("params"))


@query("label_functions", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '✓' WHEN 'O' THEN '?' ELSE '❓' END AS symbol, CASE o_orderstatus WHEN 'F' THEN 'result-certain' WHEN 'O' THEN 'result-possible' ELSE 'result-unknown' END AS style,
 CASE o_orderstatus WHEN 'F' THEN 'solid' WHEN 'O' THEN 'dashed' ELSE 'dotted' END AS arrow, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' ELSE m // 1440 || 'd ago' END AS ago,
 lpad(lower(hex(o_orderkey)), 16, '0') || '.i' AS file FROM (SELECT *, o_custkey * 7 % 4000 AS m FROM orders)""")
def _(s, d):
    o = table(s, d, "orders").withColumn("m", F.col("o_custkey") * 7 % 4000).withColumn("c", conf("o_orderstatus"))
    return o.select("o_orderkey", T.confidence_symbol("c").alias("symbol"), T.confidence_class("c").alias("style"), T.confidence_arrow("c").alias("arrow"), T.relative_time("m").alias("ago"), T.hex_name("o_orderkey").alias("file"))


@query("config_reader", r"""SELECT p_partkey AS line, n AS name, CASE p_size % 5 WHEN 0 THEN '1' WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN p_brand ELSE '0' END AS value FROM (SELECT *, 'CONFIG_' || replace(p_type, ' ', '_') AS n FROM part)""")
def _(s, d):
    k = F.col("p_size") % 5
    n = F.concat(F.lit("CONFIG_"), F.replace("p_type", F.lit(" "), F.lit("_")))
    v = F.when(k == 0, "y").when(k == 1, "m").when(k == 2, "n").otherwise(F.concat(F.lit('"'), "p_brand", F.lit('"')))
    t = F.when(k == 4, F.concat(F.lit("# "), n, F.lit(" is not set"))).otherwise(F.concat(n, F.lit("="), v))
    return P.dot_config(table(s, d, "part").select(F.col("p_partkey").alias("line"), t.alias("text")))


# -- expressions ------------------------------------------------------------------------------------------------------
@query("evaluate_expressions", """WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_partkey AS p, l_suppkey AS s, l_returnflag = 'R' AS nul FROM lineitem)
 SELECT l_orderkey, l_linenumber, q + p * 2 AS a, CASE WHEN s % 7 = 0 THEN 0 ELSE p // (s % 7) END AS b, (q & 12) | 3 AS c, q << 2 < p AS d, (q > 25 OR p > 1000) AND NOT nul AS e, NOT nul AS f, xor(s, 5) AS g FROM v""")
def _(s, d):
    li = table(s, d, "lineitem")
    i = lambda c: V.value("Integer", i=c)
    env = {"q": i(F.col("l_quantity").cast("bigint")), "item->part": i(F.col("l_partkey")), "s": i(F.col("l_suppkey")), "ptr": V.value("Pointer", is_null=F.col("l_returnflag") == "R")}
    ev = lambda e: V.evaluate(e, env)
    return li.select(
        "l_orderkey", "l_linenumber", ev("q + part * 2")["i"].alias("a"), ev("item->part / (s % 7)")["i"].alias("b"), ev("(q & 12) | 3")["i"].alias("c"),
        ev("(q << 2) < item.part")["b"].alias("d"), ev("(q > 25 || part > 1000) && ptr != NULL")["b"].alias("e"), ev("!!ptr")["b"].alias("f"), ev("s ^ 0x5")["i"].alias("g"),
    )


@query("interval_compare", """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey AS lo, l_suppkey + l_linenumber - 1 AS hi, l_partkey % 100 AS x FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN hi < x THEN 'AlwaysTrue' WHEN lo >= x THEN 'AlwaysFalse' ELSE 'Unknown' END AS lt, CASE WHEN lo >= x THEN 'AlwaysTrue' WHEN hi < x THEN 'AlwaysFalse' ELSE 'Unknown' END AS ge,
 CASE WHEN lo = hi AND lo = x THEN 'AlwaysTrue' WHEN x < lo OR x > hi THEN 'AlwaysFalse' ELSE 'Unknown' END AS eq FROM r""")
def _(s, d):
    x = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("lo"), (F.col("l_suppkey") + F.col("l_linenumber") - 1).alias("hi"), (F.col("l_partkey") % 100).alias("x"))
    cmp = lambda op: V.range_compare(F.col("lo"), F.col("hi"), F.lit(op), F.col("x"))
    return x.select("l_orderkey", "l_linenumber", cmp("<").alias("lt"), cmp(">=").alias("ge"), cmp("==").alias("eq"))


@query("symbolic_values", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CASE WHEN p_partkey > 255 THEN '0x' || lower(hex(p_partkey)) ELSE CAST(p_partkey AS VARCHAR) END WHEN 1 THEN p_size || '..' || p_partkey WHEN 2 THEN CASE WHEN p_size > 25 THEN 'NULL' ELSE '<valid ptr>' END ELSE '"' || p_name || '"' END AS shown FROM part""")
def _(s, d):
    k = F.col("p_size") % 4
    t = F.when(k == 0, F.col("p_partkey").cast("string")).when(k == 1, F.concat_ws("..", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))).when(k == 2, F.when(F.col("p_size") > 25, "NULL").otherwise("valid")).otherwise(F.concat(F.lit('"'), "p_name", F.lit('"')))
    return table(s, d, "part").select("p_partkey", V.display(V.parse_symbolic(t, F.when(k == 2, "pointer").otherwise("integer"))).alias("shown"))


@query("scenario_table", """SELECT conv_id, turn, coalesce(CASE WHEN role = 'user' THEN md5(text) END, '-') AS "user", coalesce(CASE WHEN role = 'assistant' THEN md5(text) END, '-') AS assistant FROM conversations""")
def _(s, d):
    c = table(s, d, "conversations").select("conv_id", F.col("turn").alias("step"), F.create_map("role", F.md5(F.col("text").cast("binary"))).alias("variables"))
    return R.state_table(c, ["user", "assistant"], ["conv_id", "step"]).withColumnRenamed("step", "turn")


# -- knowledge, changes, labels ---------------------------------------------------------------------------------------
@query("identify_callbacks", """WITH c(framework, callback) AS (VALUES ('a', 'ring'), ('b', 'gear'), ('b', 'red'), ('c', 'widget')), f AS (SELECT DISTINCT p_name AS name FROM part),
 m AS (SELECT name, framework, callback, row_number() OVER (PARTITION BY name ORDER BY length(callback) DESC, framework, callback) AS r FROM f JOIN c ON contains(name, callback)) SELECT name, framework, callback FROM m WHERE r = 1""")
def _(s, d):
    c = s.createDataFrame([("a", "ring"), ("b", "gear"), ("b", "red"), ("c", "widget")], "framework string, callback string")
    return D.identify_callbacks(table(s, d, "part").select(F.col("p_name").alias("name")), c)


@query("patch_impact", f"""WITH RECURSIVE e AS {NATION_EDGES}, c AS (SELECT DISTINCT 's' || l_suppkey AS name FROM lineitem WHERE l_quantity > 49.5 AND l_linenumber = 1 UNION SELECT e.src FROM c JOIN e ON c.name = e.dst) SELECT name FROM c""")
def _(s, d):
    changed = table(s, d, "lineitem").where("l_quantity > 49.5 and l_linenumber = 1").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name"))
    return D.impact(changed, nation_edges(s, d)).select("name")


@query("native_bridges", "SELECT DISTINCT p_brand || '.' || p_type AS method, 'Java_' || replace(replace(replace(p_brand || '.' || p_type, '_', '_1'), '$', '_00024'), '.', '_') AS name FROM part")
def _(s, d):
    m = table(s, d, "part").select(F.concat_ws(".", "p_brand", "p_type").alias("method")).distinct()
    return D.bridges(m, m.select(T.jni_name("method").alias("name")))


@query("header_resolution", "SELECT doc_id AS include, min_by(p, pr) AS path FROM (SELECT doc_id, unnest([source || '/' || lang, lang || '/x', 'root']) AS p, unnest([0, 1, 2]) AS pr FROM documents) WHERE p IN (SELECT DISTINCT source || '/' || lang FROM documents WHERE n_chars > 5000 UNION SELECT 'root') GROUP BY doc_id")
def _(s, d):
    x = table(s, d, "documents")
    tries = F.array(*(F.struct(p.alias("path"), F.lit(i).alias("priority")) for i, p in enumerate((F.concat_ws("/", "source", "lang"), F.concat("lang", F.lit("/x")), F.lit("root")))))
    wanted = x.select(F.col("doc_id").alias("include"), F.explode(tries).alias("t")).select("include", "t.path", "t.priority")
    files = x.where("n_chars > 5000").select(F.concat_ws("/", "source", "lang").alias("path")).union(s.range(1).select(F.lit("root")))
    return R.first_by_probe(wanted, files, "include", "path", "priority")


@query("annotated_calls", "SELECT o_orderkey, a.t AS user_targets FROM orders LEFT JOIN (SELECT user_id, arg_min(event_type, event_id) AS t FROM events GROUP BY user_id) a ON o_custkey = a.user_id")
def _(s, d):
    calls = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("call_site"))
    notes = table(s, d, "events").select(F.col("user_id").alias("call_site"), F.col("event_type").alias("targets"), F.col("event_id").alias("ord"))
    return R.apply_annotations(calls, notes).select("o_orderkey", "user_targets")


@query("learning_stats", "SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM labels) AS answered, CAST(0 AS BIGINT) AS auto_applied")
def _(s, d):
    return R.learning_stats(table(s, d, "documents"), table(s, d, "labels"))


@query("file_globs", "SELECT p_partkey, suffix(p_name, 'bolt') AS ends, starts_with(p_name, 'red') AS begins, p_name = 'hot gear' AS exact FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.glob_match("p_name", "*bolt").alias("ends"), T.glob_match("p_name", "red*").alias("begins"), T.glob_match("p_name", "hot gear").alias("exact"))


@query("directory_listing", """WITH p AS (SELECT DISTINCT source || '/' || lang || '/' || doc_id AS path FROM documents), u AS (SELECT path AS p, false AS is_dir FROM p UNION SELECT regexp_extract(path, '^(.*)/[^/]*$', 1), true FROM p UNION SELECT string_split(path, '/')[1], true FROM p)
 SELECT p AS path, string_split(p, '/')[-1] AS name, regexp_extract(p, '^(.*)/[^/]*$', 1) AS parent, CAST(len(string_split(p, '/')) - 1 AS INTEGER) AS depth, is_dir FROM u""")
def _(s, d):
    return listing(table(s, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")))


@query("parse_cache", "SELECT d.doc_id AS path FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND d.n_chars % 2 = l.quality")
def _(s, d):
    k = lambda df, m: df.select(F.col("doc_id").alias("path"), F.lit(1).alias("options_hash"), m.cast("long").alias("mtime"), F.lit(2).alias("content_hash"))
    return caches.hits(k(table(s, d, "documents"), F.col("n_chars") % 2), k(table(s, d, "labels"), F.col("quality"))).select("path")


@query("value_kinds", """SELECT DISTINCT t AS c_type, CASE WHEN contains(t, '*') THEN 'pointer' WHEN regexp_matches(t, 'int|long|short|size_t|u8|u16|u32|u64') THEN 'integer' WHEN contains(t, 'char') THEN 'string' ELSE 'integer' END AS kind
 FROM (SELECT lower(CASE p_size % 4 WHEN 0 THEN 'unsigned int' WHEN 1 THEN 'char' WHEN 2 THEN 'struct ' || p_type || ' *' ELSE p_type END) AS t FROM part)""")
def _(s, d):
    k = F.col("p_size") % 4
    t = F.lower(F.when(k == 0, "unsigned int").when(k == 1, "char").when(k == 2, F.concat(F.lit("struct "), "p_type", F.lit(" *"))).otherwise(F.col("p_type")))
    return table(s, d, "part").select(t.alias("c_type"), T.guess_value_type(t).alias("kind")).distinct()


@query("answer_texts", """SELECT n_regionkey, array_to_string(list_transform(range(1, len(l) + 1), lambda i: i || '. ' || l[i]), chr(10)) AS numbered, array_to_string(list_transform(l, lambda x: '- ' || x), chr(10)) AS bulleted,
 array_to_string(list_transform(range(1, len(l) + 1), lambda i: repeat('  ', i - 1) || CASE WHEN i > 1 THEN '-> ' ELSE '' END || l[i]), chr(10)) AS nested FROM (SELECT n_regionkey, list_sort(list(n_name)) AS l FROM nation GROUP BY n_regionkey)""")
def _(s, d):
    g = R.group_sorted(table(s, d, "nation"), "n_regionkey", "n_name", "l")
    return g.select("n_regionkey", T.numbered("l").alias("numbered"), T.bulleted("l").alias("bulleted"), T.nested_chain("l").alias("nested"))


@query("markdown_html", r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^# (.+)$', '<h1>\1</h1>', 'g'), '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'), '(?m)^- (.+)$', '<li>\1</li>', 'g') AS html FROM (SELECT p_partkey, '# ' || p_name || chr(10) || '- **' || p_type || '**' AS t FROM part)""")
def _(s, d):
    t = F.concat(F.lit("# "), "p_name", F.lit("\n- **"), "p_type", F.lit("**"))
    return table(s, d, "part").select("p_partkey", T.markdown_to_html(t).alias("html"))


@query("conditional_lines", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderstatus = 'F' AND l.l_linenumber BETWEEN 2 AND 3)")
def _(s, d):
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"))
    regions = table(s, d, "orders").select(F.col("o_orderkey").alias("path"), F.lit(2).alias("lo"), F.lit(3).alias("hi"), F.col("o_orderstatus").alias("macro"))
    macros = s.createDataFrame([("O", "1"), ("P", "x"), ("F", "0")], "name string, value string")
    return D.active_lines(lines, regions, macros).select(F.col("path").alias("l_orderkey"), F.col("line").alias("l_linenumber"))


@query("result_page", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey LIMIT 20 OFFSET 10")
def _(s, d):
    return D.page(table(s, d, "supplier").select("s_suppkey", "s_name"), ["s_name", "s_suppkey"], 10, 20)
