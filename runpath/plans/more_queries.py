"""Further registered queries: classification, labels, files, caches, histories, scenarios, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath import fixed
from runpath.functions import text as T
from runpath.functions import values as V
from runpath.operators import caches
from runpath.operators import design as D
from runpath.operators import graph as G
from runpath.operators import patterns as P
from runpath.operators import relational as R
from runpath.operators import views
from runpath.operators.drawing import drawing
from runpath.operators.storage import checkpoint, new_path
from runpath.operators.types_db import TypeDatabase
from runpath.plans import samples
from runpath.plans.c_queries import values
from runpath.plans.catalog import _TREE, NATION_EDGES, edges, nation_edges, nation_tree
from runpath.plans.registry import query, table
from runpath.plans.session import restore, run_scenario, snapshot
from runpath.sources import packs
from runpath.sources import preprocess as PP
from runpath.sources.files import Scenario, children, driver_files, is_kernel_source, knowledge, listing, parse_scenarios, scan, yaml_to_json
from runpath.streaming import intake


def pick(index, *texts: str):
    """The index-th of some texts."""
    return F.element_at(F.array(*map(F.lit, texts)), (index + 1).cast("int"))


def picked(index: str, *texts: str) -> str:
    return f"{list(texts)!r}[{index} + 1]"


# -- classification and labels ----------------------------------------------------------------------------------------
MECHS, OPS = ("INIT_WORK", "request_irq", "made_up", "timer_setup"), ("usb_driver", "pci_driver", "net_device_ops")


@query("classify_known", f"SELECT o_orderkey, CASE WHEN o_custkey % 4 = 2 THEN 'Possible' ELSE 'Certain' END AS mechanism, CASE WHEN o_orderkey % 3 = 2 THEN 'Possible' ELSE 'Certain' END AS ops FROM orders")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", pick(F.col("o_custkey") % 4, *MECHS).alias("m"), pick(F.col("o_orderkey") % 3, *OPS).alias("t"))
    first = R.classify_known(o, "m", fixed.KNOWN_MECHANISMS).withColumnRenamed("confidence", "mechanism")
    return R.classify_known(first, "t", fixed.KNOWN_OPS).select("o_orderkey", "mechanism", F.col("confidence").alias("ops"))


REASONS = ("DirectCall", "KnownAsyncMechanism", "OpsTableAssignment", "VariableAssignment", "ConditionalAssignment", "ArrayIndex", "ExternalLibrary", "ComplexIndirectCall", "UserAnnotation")


@query("reason_texts", f"""SELECT o_orderkey, {picked('o_custkey % 9', 'Certain', 'Certain', 'Certain', 'Certain', 'Possible', 'Possible', 'Unknown', 'Unknown', 'Certain')} AS confidence,
 {picked('o_custkey % 9', 'Direct function call', 'Known async mechanism: ', 'Ops table assignment: ', 'Variable assignment', 'Conditional assignment', 'Array index access', 'External library: ', 'Complex indirect call', 'User annotation')}
 || CASE WHEN o_custkey % 9 IN (1, 2, 6) THEN o_orderpriority ELSE '' END AS description FROM orders""")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", pick(F.col("o_custkey") % 9, *REASONS).alias("r"), "o_orderpriority")
    return o.select("o_orderkey", T.reason_confidence("r").alias("confidence"), T.reason_text("r", "o_orderpriority").alias("description"))


KINDS = ("WorkQueue", "Timer", "Interrupt", "Tasklet", "Softirq", "KThread", "RcuCallback", "Notifier", "completion")


@query("mechanism_labels", f"""SELECT p_partkey, {picked('p_partkey % 9', '⚙️', '⏲️', '⚡', '🔄', '⚡', '🧵', '🔒', '📢', '📍')} AS icon,
 CASE WHEN p_size % 2 = 0 THEN {picked('p_partkey % 9', 'DelayedWork', 'HRTimer', 'ThreadedIRQ', 'Tasklet', 'SoftIRQ', 'KThread', 'RCU', 'Notifier', 'completion')} ELSE {picked('p_partkey % 9', 'WorkQueue', 'Timer', 'IRQ', 'Tasklet', 'SoftIRQ', 'KThread', 'RCU', 'Notifier', 'completion')} END AS name,
 CASE WHEN p_size % 2 = 0 THEN {picked('p_partkey % 9', 'DW', 'HR', 'TI', 'TL', 'SI', 'KT', 'RCU', 'NF', 'COM')} ELSE {picked('p_partkey % 9', 'WQ', 'TM', 'IRQ', 'TL', 'SI', 'KT', 'RCU', 'NF', 'COM')} END AS tag,
 replace({picked('p_partkey % 9', 'WorkQueue { delayed: # }', 'Timer { high_resolution: # }', 'Interrupt { threaded: # }', 'Tasklet', 'Softirq', 'KThread', 'RcuCallback', 'Notifier', 'Custom("completion")')}, '#', CAST(p_size % 2 = 0 AS VARCHAR)) AS text FROM part""")
def _(s, d):
    x = table(s, d, "part").select("p_partkey", pick(F.col("p_partkey") % 9, *KINDS).alias("k"), (F.col("p_size") % 2 == 0).alias("f"))
    return x.select("p_partkey", T.mechanism_icon("k", "f").alias("icon"), T.mechanism_name("k", "f").alias("name"), T.mechanism_tag("k", "f").alias("tag"), T.mechanism_text("k", "f").alias("text"))


NODE_TYPES = ("Function", "EntryPoint", "KernelApi", "External", "AsyncCallback", "Ref")


@query("node_labels", f"""SELECT p_partkey, {picked('p_partkey % 6', '📦', '🚀', '⚙️', '🔗', '⚡', '📦')} AS icon, {picked('p_partkey % 6', 'function', 'entry', 'kernel', 'external', 'async', 'function')} AS class,
 rpad(CASE WHEN p_partkey % 6 = 4 THEN '   [WQ]' WHEN p_size % 3 > 0 THEN '   :' || p_size WHEN p_partkey % 6 = 2 THEN '   [K]' WHEN p_partkey % 6 = 3 THEN '   [E]' ELSE '' END, 14, ' ') AS info,
 p_name || '()' || chr(10) || {picked('p_partkey % 6', *NODE_TYPES)} || CASE WHEN p_size % 4 > 0 THEN chr(10) || p_brand || CASE WHEN p_size % 3 > 0 THEN ':' || p_size ELSE '' END ELSE '' END || CASE WHEN p_size % 5 = 0 THEN '' ELSE chr(10) || p_type END AS tip FROM part""")
def _(s, d):
    x = table(s, d, "part").select("p_partkey", "p_name", pick(F.col("p_partkey") % 6, *NODE_TYPES).alias("t"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).otherwise(0).alias("line"), F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).alias("file"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")).alias("text"))
    return x.select("p_partkey", T.node_icon("t").alias("icon"), T.node_class("t").alias("class"), T.info_column("t", "line", F.when(F.col("t") == "AsyncCallback", "WQ")).alias("info"), T.tooltip("p_name", "t", "file", "line", "text").alias("tip"))


@query("contexts", f"SELECT n_nationkey, n_nationkey % 5 IN (0, 3) AS can_sleep, CASE WHEN n_nationkey % 5 IN (0, 3) THEN 'can sleep' ELSE 'cannot sleep' END AS words, {picked('n_nationkey % 5', 'Process', 'SoftIrq', 'HardIrq', 'Process', 'Unknown')} AS core FROM nation")
def _(s, d):
    x = table(s, d, "nation").select("n_nationkey", pick(F.col("n_nationkey") % 5, "Process", "SoftIrq", "HardIrq", "User", "Unknown").alias("c"))
    return x.select("n_nationkey", T.can_sleep("c").alias("can_sleep"), T.context_text("c").alias("words"), T.core_context("c").alias("core"))


@query("location_keys", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.' || p_type WHEN 2 THEN 'alloc:' || p_name ELSE p_name || '[]' END AS key, p_brand || ' ' || p_name || '(' || replace(p_type, ' ', ', ') || ')' AS signature, p_brand || ':' || p_size || ':0' AS place, p_brand || ':' || p_name AS question FROM part")
def _(s, d):
    x = table(s, d, "part").withColumn("kind", pick(F.col("p_size") % 4, "var", "field", "alloc", "array"))
    return x.select("p_partkey", T.location_key("kind", "p_name", "p_type").alias("key"), T.format_signature("p_brand", "p_name", F.split("p_type", " ")).alias("signature"), T.format_location("p_brand", "p_size", F.lit(0)).alias("place"), T.query_id("p_brand", "p_name").alias("question"))


_HASH = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"


@query("options_hashes", f"SELECT p_partkey, {_HASH.format('''p_type || chr(10) || p_brand || chr(1) || coalesce(CASE WHEN p_size % 2 = 0 THEN p_name END, chr(2)) || chr(10) || 'include' || chr(1) || p_brand''')} AS hash, lpad(lower(hex({_HASH.format('p_name')})), 16, '0') || '.i' AS file FROM part")
def _(s, d):
    x = table(s, d, "part")
    return x.select("p_partkey", T.options_hash("p_type", F.array("p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_name"))), F.array(F.lit("include"), "p_brand")).alias("hash"), T.hex_name(T.content_hash("p_name")).alias("file"))


@query("percentages", "SELECT l_orderkey, l_linenumber, CAST(floor(l_linenumber * 100 / l_quantity + 0.5) AS INTEGER) AS percent FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.percent("l_linenumber", "l_quantity").alias("percent"))


_SIZE = "CASE WHEN {0} < 1024 THEN {0} || ' bytes' WHEN {0} < 1048576 THEN printf('%.2f KB', {0} / 1024.0) WHEN {0} < 1073741824 THEN printf('%.2f MB', {0} / 1048576.0) ELSE printf('%.2f GB', {0} / 1073741824.0) END"


@query("human_sizes", f"SELECT o_orderkey, {_SIZE.format('n')} AS size FROM (SELECT o_orderkey, CAST(o_custkey * o_custkey * (o_orderkey % 7 + 1) * (o_orderkey % 3 * 400 + 1) AS BIGINT) AS n FROM orders)")
def _(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select("o_orderkey", T.human_size(F.col("o_custkey") * F.col("o_custkey") * (k % 7 + 1) * (k % 3 * 400 + 1)).alias("size"))


@query("languages", f"SELECT p_partkey, {picked('p_partkey % 8', 'C', 'C', 'C++', 'Rust', 'Python', 'TypeScript', 'JavaScript', 'Text')} AS language, CASE WHEN p_size > 59 THEN p_size // 60 || 'm ' || p_size % 60 || 's' ELSE p_size || 's' END AS elapsed FROM (SELECT p_partkey, p_size * 7 AS p_size FROM part)")
def _(s, d):
    x = table(s, d, "part").select("p_partkey", F.concat(F.lit("src/x."), pick(F.col("p_partkey") % 8, "c", "h", "cpp", "rs", "py", "tsx", "js", "md")).alias("f"), (F.col("p_size") * 7).alias("z"))
    return x.select("p_partkey", T.language_of("f").alias("language"), T.elapsed(F.col("z")).alias("elapsed"))


@query("native_signatures", f"""SELECT p_partkey, replace({picked('p_partkey % 4', 'void #(int)', 'boolean #(String, int)', 'String #(byte[])', 'List$Entry[] #(long[][], double)')}, '#', p_name) AS text FROM part""")
def _(s, d):
    x = table(s, d, "part").select("p_partkey", "p_name", pick(F.col("p_partkey") % 4, "(I)V", "(Ljava/lang/String;I)Z", "([B)Ljava/lang/String;", "([[JD)[Ljava/util/List$Entry;").alias("g"))
    return x.select("p_partkey", T.native_signature("p_name", "g").alias("text"))


@query("architectures", f"""SELECT n_nationkey, {picked('n_nationkey % 6', 'x86_64-linux-gnu', 'aarch64-linux-gnu', 'i386-linux-gnu', 'riscv32-linux-gnu', 'powerpc64-linux-gnu', 'mips-linux-gnu')} AS triple, {picked('n_nationkey % 6', 'x86', 'arm64', 'x86', 'riscv', 'powerpc', 'mips')} AS directory FROM nation""")
def _(s, d):
    x = table(s, d, "nation").select("n_nationkey", pick(F.col("n_nationkey") % 6, "AMD64", "aarch64", "x86", "riscv", "ppc64", "mips").alias("alias"))
    rows = knowledge(s)["architectures"].select(F.explode("aliases").alias("alias"), "triple", "directory")
    return x.withColumn("alias", F.lower("alias")).join(F.broadcast(rows), "alias").select("n_nationkey", "triple", "directory")


# -- files ------------------------------------------------------------------------------------------------------------
_PATHS_SQL = "(SELECT p_type || '/' || CASE WHEN p_size % 3 = 0 THEN p_brand || '/' || p_partkey || '.c' ELSE 'X' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '.h' ELSE '' END END AS path, p_partkey AS k FROM part)"


def paths(s: SparkSession, d: str) -> DataFrame:
    deep, flat = F.concat_ws("/", "p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(".c"))), F.concat(F.lit("X"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, ".h").otherwise(""))
    return table(s, d, "part").select(F.concat_ws("/", "p_type", F.when(F.col("p_size") % 3 == 0, deep).otherwise(flat)).alias("path"), F.col("p_partkey").alias("k"))


@query("directory_children", f"""WITH o AS (SELECT DISTINCT string_split(path, '/')[1] AS top, string_split(path, '/')[2] AS name, len(string_split(path, '/')) = 3 AS is_dir FROM {_PATHS_SQL}) SELECT name, is_dir, CASE WHEN NOT is_dir AND contains(name, '.') THEN string_split(name, '.')[2] END AS extension,
 CAST(row_number() OVER (ORDER BY is_dir DESC, lower(name), name) AS INTEGER) AS place FROM o WHERE top = 'ECONOMY'""")
def _(s, d):
    # The order is part of the result: rows are numbered as they come.
    listed = children(listing(paths(s, d)), "ECONOMY")
    return listed.select("name", "is_dir", "extension").withColumn("place", F.row_number().over(R.Window.orderBy(F.desc("is_dir"), F.lower("name"), "name")))


@query("flat_files", f"SELECT path, string_split(path, '/')[-1] AS name FROM {_PATHS_SQL}")
def _(s, d):
    return views.flat_files(listing(paths(s, d)))


@query("driver_files", f"SELECT 'drivers/' || path AS path FROM {_PATHS_SQL} WHERE suffix(path, '.c') ORDER BY path LIMIT 100")
def _(s, d):
    return driver_files(paths(s, d).select(F.concat(F.lit("drivers/"), "path").alias("path")))


@query("recent_matches", f"SELECT path, string_split(path, '/')[-1] AS name FROM {_PATHS_SQL} WHERE contains(lower(path), 'brand#1')")
def _(s, d):
    return views.recent_matches(paths(s, d).select("path", T.base_name("path").alias("name")), "BRAND#1")


@query("go_to_line", "SELECT doc_id AS path, n_chars % 40 AS line, n_chars % 40 BETWEEN 1 AND len(string_split(text, chr(10))) AS valid FROM documents")
def _(s, d):
    x = table(s, d, "documents")
    return views.go_to_line(R.text_stats(x.select(F.col("doc_id").alias("path"), "text")).select("path", "n_lines"), x.select(F.col("doc_id").alias("path"), (F.col("n_chars") % 40).alias("line")))


@query("scanned_files", "SELECT n_name AS unit, CAST(length(n_name) * 2 + 9 AS BIGINT) AS size, 'int ' || n_name || ';' || chr(10) || 'x ' || n_name || chr(10) AS content FROM nation WHERE n_regionkey <> 2")
def _(s, d):
    folder = new_path(s, "tree")
    x = table(s, d, "nation").select(F.col("n_name").alias("unit"), "n_regionkey", F.concat(F.lit("int "), "n_name", F.lit(";\nx "), "n_name").alias("value"))
    x.repartition(5, "unit").write.partitionBy("n_regionkey", "unit").text(folder)
    files = scan(s, folder, endings=("txt", "none"), include=("part-*",), exclude=("*.crc",))
    return files.where("path not like '%n_regionkey=2%'").select(F.regexp_extract("path", "unit=([^/]+)/", 1).alias("unit"), "size", "content")


@query("kernel_trees", "SELECT r_regionkey, r_regionkey % 2 = 0 AS is_kernel FROM region")
def _(s, d):
    x = table(s, d, "nation").select("n_regionkey", F.when((F.col("n_nationkey") < 5) & (F.col("n_regionkey") % 2 == 0), "arch/x86/Kconfig").otherwise(F.concat(F.lit("src/"), "n_name")).alias("path"))
    return is_kernel_source(x.withColumnRenamed("n_regionkey", "r_regionkey"), ("r_regionkey",))


@query("kernel_versions", "SELECT n_nationkey AS path, n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.' || n_regionkey || CASE WHEN n_nationkey % 4 = 0 THEN '.7' ELSE '' END ELSE '' END AS version FROM nation")
def _(s, d):
    text = F.concat(F.lit("# head\nVERSION = "), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("\nPATCHLEVEL = "), F.col("n_regionkey").cast("string"))).otherwise(""), F.when(F.col("n_nationkey") % 4 == 0, "\nSUBLEVEL = 7").otherwise(""), F.lit("\n" * 12 + "SUBLEVEL = 9\n"))
    return P.kernel_version(table(s, d, "nation").select(F.col("n_nationkey").alias("path"), text.alias("content")))


_MARKS = "(SELECT o_custkey AS path, o_orderkey AS line, CASE o_orderkey % 4 WHEN 0 THEN '# 1 \"dir/' || o_orderpriority || '.h\"' WHEN 1 THEN '# 3 \"<built-in>\"' WHEN 2 THEN 'x.c:3: warning: ' || o_orderstatus ELSE 'int x;' END AS text FROM orders)"


def marks(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit('# 1 "dir/'), "o_orderpriority", F.lit('.h"'))).when(k == 1, '# 3 "<built-in>"').when(k == 2, F.concat(F.lit("x.c:3: warning: "), "o_orderstatus")).otherwise("int x;")
    return table(s, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("line"), text.alias("text"))


@query("included_files", f"SELECT path, regexp_extract(text, '\"([^\"]+)\"', 1) AS included, min(line) AS line FROM {_MARKS} WHERE text LIKE '# 1%' GROUP BY ALL")
def _(s, d):
    return P.included_files(marks(s, d))


@query("compiler_warnings", f"SELECT path, line, text FROM {_MARKS} WHERE contains(text, 'warning:')")
def _(s, d):
    return P.warnings(marks(s, d))


@query("config_enabled", "SELECT p_partkey AS line, 'CONFIG_' || p_partkey AS name, p_size % 3 < 2 OR p_size % 3 = 2 AND p_size > 0 AS enabled FROM part WHERE p_size % 4 > 0 UNION ALL SELECT p_partkey, 'CONFIG_' || p_partkey, false FROM part WHERE p_size % 4 = 0")
def _(s, d):
    t = F.concat(F.lit("CONFIG_"), F.col("p_partkey").cast("string"))
    text = F.when(F.col("p_size") % 4 == 0, F.when(F.col("p_size") % 8 == 0, F.concat(t, F.lit("=n"))).otherwise(F.concat(F.lit("# "), t, F.lit(" is not set")))).when(F.col("p_size") % 3 < 2, F.concat(t, F.lit("=y"))).otherwise(F.concat(t, F.lit("="), F.col("p_size").cast("string")))
    return P.config_enabled(P.dot_config(table(s, d, "part").select(F.col("p_partkey").alias("line"), text.alias("text")))).drop("value")


@query("compiler_arguments", """WITH m AS (SELECT 'M' || p_type AS name, arg_max(CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS VARCHAR) ELSE '-' END, p_partkey) AS value, arg_max(p_size % 5 > 0, p_partkey) AS defined, max(p_partkey) AS ord FROM part GROUP BY p_type)
 SELECT CAST(-1 AS BIGINT) AS ord, '--target=x86_64-linux-gnu' AS arg UNION ALL SELECT ord, CASE WHEN NOT defined THEN '-U' || name WHEN value = '-' THEN '-D' || name ELSE '-D' || name || '=' || value END FROM m UNION ALL SELECT r_regionkey + 1000000, '-I' || r_name FROM region""")
def _(s, d):
    macros = table(s, d, "part").select(F.concat(F.lit("M"), "p_type").alias("name"), F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")).alias("value"), (F.col("p_size") % 5 > 0).alias("defined"), F.col("p_partkey").alias("ord"))
    return PP.clang_args(macros, table(s, d, "region").select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("path")), PP.architecture("amd64")[1])


@query("kernel_macros", "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS value FROM nation UNION ALL SELECT * FROM (VALUES ('__KERNEL__', NULL), ('__GNUC__', '12'), ('__GNUC_MINOR__', '0'), ('__riscv', NULL), ('__riscv_xlen', '64'), ('__LP64__', '1'))")
def _(s, d):
    own = table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("value")).union(s.range(1).select(F.lit("__GNUC__"), F.lit("4")))
    arch = [(m.split("=")[0], m.split("=")[1] if "=" in m else None) for m in PP.architecture("riscv64")[3]]
    return PP.with_macros(PP.with_macros(own, fixed.KERNEL_MACROS), arch)


@query("include_paths", """SELECT 'all' AS what, ord, path FROM (VALUES (0, 'k/include'), (1, 'k/include/uapi'), (2, 'k/arch/arm64/include'), (3, 'k/arch/arm64/include/uapi'), (4, 'k/arch/arm64/include/generated'), (5, 'k/arch/arm64/include/generated/uapi'), (6, 'k/include/generated'), (7, 'k/include/generated/uapi'), (8, 'extra')) v(ord, path)
 UNION ALL SELECT 'there', ord, path FROM (VALUES (1, 'k/include/uapi'), (6, 'k/include/generated')) v(ord, path) UNION ALL SELECT 'subsystem', 0, 'k/' || n FROM (SELECT unnest(['drivers', 'fs', 'net', 'kernel', 'mm', 'block', 'sound', 'crypto', 'security']) AS n)""")
def _(s, d):
    every = PP.add_include_path(PP.add_include_path(PP.include_paths(s, "k", "aarch64"), "extra"), "k/include")
    there = table(s, d, "region").select(pick(F.col("r_regionkey"), "k/include/uapi", "k/include/generated", "k/src", "k/x", "k").alias("path"))
    tag = lambda df, w: df.select(F.lit(w).alias("what"), "ord", "path")
    return tag(every, "all").union(tag(PP.existing_paths(every, there), "there")).union(tag(PP.subsystem_paths(s, "k").withColumn("ord", F.lit(0)), "subsystem"))


# -- caches and histories ---------------------------------------------------------------------------------------------
def cached_texts(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents")
    return x.select(F.col("doc_id").cast("string").alias("path"), F.lit(7).cast("long").alias("options_hash"), F.col("n_chars").alias("mtime"), T.content_hash("text").alias("content_hash"), "text")


@query("text_cache", "SELECT CAST(doc_id AS VARCHAR) AS path, md5(CASE WHEN doc_id % 5 = 0 THEN upper(lang) ELSE text END) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id % 3 > 0")
def _(s, d):
    """Texts are put, some of them anew, some invalidated; requests with another time find nothing."""
    cache, rows = caches.TextCache(s, buckets=8), cached_texts(s, d)
    cache.put(rows)
    cache.put(rows.join(table(s, d, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("path"), F.upper("lang").alias("new")), "path").withColumn("text", F.col("new")))
    cache.invalidate(table(s, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("path")))
    asked = rows.drop("text").withColumn("mtime", F.when(F.col("path").cast("long") % 3 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return cache.get(asked).select("path", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("text_cache_index", "SELECT CAST(doc_id AS VARCHAR) AS path, n_chars AS mtime, lpad(lower(hex(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT))), 16, '0') || '.i' AS cache_file FROM documents")
def _(s, d):
    cache, folder = caches.TextCache(s, buckets=8), new_path(s, "cache-index")
    cache.put(cached_texts(s, d))
    cache.save_index(folder)
    return caches.TextCache.load_index(s, folder).select("path", "mtime", "cache_file")


@query("cache_stats", f"SELECT count(*) AS entries, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, {_SIZE.format('coalesce(sum(strlen(text)), 0)')} AS size FROM documents UNION ALL SELECT 0, 0, '0 bytes'")
def _(s, d):
    cache = caches.TextCache(s, buckets=8)
    cache.put(cached_texts(s, d))
    full = checkpoint(cache.stats())  # before the cache is cleared
    cache.clear()
    return full.union(cache.stats())


@query("read_through", "SELECT CAST(doc_id AS VARCHAR) AS path, md5(lower(lang)) AS digest FROM documents")
def _(s, d):
    cache = caches.TextCache(s, buckets=8)
    x = cached_texts(s, d).drop("text").join(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("content")), "path")
    make = lambda rows: rows.withColumn("text", F.lower("content"))
    caches.read_through(x.where("path like '%1'"), cache, make)
    return caches.read_through(x, cache, make).select("path", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("valid_results", "SELECT doc_id AS path FROM documents WHERE doc_id % 4 > 0")
def _(s, d):
    x = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    held = x.select("path", T.content_hash(F.when(F.col("path") % 4 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("hash"))
    return caches.valid_results(x, held).select("path")


@query("cache_levels", "SELECT user_id, last_used, CASE WHEN r <= 10 THEN 'hot' WHEN r <= 110 THEN 'lru' ELSE 'disk' END AS level FROM (SELECT *, row_number() OVER (ORDER BY last_used DESC, user_id) AS r FROM (SELECT user_id, max(event_id) AS last_used FROM events GROUP BY user_id))")
def _(s, d):
    return caches.levels(table(s, d, "events"), "user_id", "event_id", 10)


@query("navigation_cursor", """WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'back' WHEN 'signup' THEN 'forward' ELSE 'push' END AS action, 'p' || event_id * 7 % 11 AS place, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 t AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST([] AS VARCHAR[]) AS stack, CAST(-1 AS BIGINT) AS at_ FROM e WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, stack, CASE WHEN action = 'push' THEN CASE WHEN same THEN at_ ELSE len(stack) - 1 END WHEN action = 'back' THEN CASE WHEN len(stack) > 0 THEN greatest(at_ - 1, 0) ELSE -1 END ELSE least(at_ + 1, len(stack) - 1) END FROM (
   SELECT t.user_id, e.n, e.event_id, e.action, at_, action = 'push' AND at_ >= 0 AND stack[at_ + 1] = place AS same,
    CASE WHEN action = 'push' AND NOT (at_ >= 0 AND coalesce(stack[at_ + 1] = place, false)) THEN list_append(stack[1:at_ + 1], place)[-6:] ELSE stack END AS stack FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1))
 SELECT CAST(user_id AS VARCHAR) AS "user", event_id AS seq, CASE WHEN len(stack) > 0 THEN stack[at_ + 1] END AS place FROM t WHERE n > 0""")
def _(s, d):
    action = F.when(F.col("event_type") == "error", "back").when(F.col("event_type") == "signup", "forward").otherwise("push")
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("user"), F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("p"), (F.col("event_id") * 7 % 11).cast("string")).alias("place"))
    return intake.navigation(e, keep=6)


def _lru_sql(overwrite: bool, hashed: bool) -> str:
    hit = "list_contains(held, struct_pack(k := key, h := hash))" if hashed else "len(list_filter(held, lambda x: x.k = key)) > 0"
    evict = "true" if overwrite else "len(list_filter(held, lambda x: x.k = key)) = 0"
    rest = "list_filter({0}, lambda x: x.k <> key)"
    return f"""WITH RECURSIVE e AS (SELECT event_type AS cache, CAST(user_id AS VARCHAR) AS key, event_id % 3 AS hash, CASE event_id % 5 WHEN 0 THEN 'remove' WHEN 1 THEN 'get' WHEN 2 THEN 'get' ELSE 'insert' END AS op, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
 z AS (SELECT cache, max(n) AS last FROM e GROUP BY cache),
 t AS (SELECT cache, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k VARCHAR, h BIGINT)[]) AS held FROM e WHERE n = 1
  UNION ALL SELECT t.cache, e.n, CASE op WHEN 'remove' THEN {rest.format('held')} WHEN 'get' THEN CASE WHEN {hit} THEN list_append({rest.format('held')}, list_filter(held, lambda x: x.k = key)[1]) ELSE held END
   ELSE list_append({rest.format(f'CASE WHEN len(held) >= 20 AND {evict} THEN held[2:] ELSE held END')}, struct_pack(k := key, h := hash)) END FROM t JOIN e ON e.cache = t.cache AND e.n = t.n + 1)
 SELECT t.cache, x.k AS key FROM t JOIN z ON t.cache = z.cache AND t.n = z.last, unnest(held) u(x)"""


def accesses(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 5
    return table(s, d, "events").select(F.col("event_type").alias("cache"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), F.when(n == 0, "remove").when(n < 3, "get").otherwise("insert").alias("op"), (F.col("event_id") % 3).alias("hash"))


@query("parse_cache_trace", _lru_sql(False, True))
def _(s, d):
    return intake.lru_trace(accesses(s, d), 20)


@query("tree_cache_trace", _lru_sql(True, False))
def _(s, d):
    return intake.lru_trace(accesses(s, d).drop("hash"), 20, evict_on_overwrite=True)


@query("tabs_after_close", """WITH t AS (SELECT s_nationkey AS "user", s_suppkey AS ord, s_name AS tab, s_suppkey = max(s_suppkey) FILTER (s_suppkey % 5 < 3) OVER (PARTITION BY s_nationkey) AS active, s_suppkey % 3 = 0 AS gone FROM supplier),
 w AS (SELECT *, max(CASE WHEN active THEN ord END) OVER (PARTITION BY "user") AS at_, coalesce(bool_or(active AND gone) OVER (PARTITION BY "user"), false) AS lost FROM t), l AS (SELECT *, min(CASE WHEN ord > at_ THEN ord END) OVER (PARTITION BY "user") AS a, max(CASE WHEN ord < at_ THEN ord END) OVER (PARTITION BY "user") AS b FROM w WHERE NOT gone)
 SELECT "user", ord, tab, CASE WHEN lost THEN coalesce(ord = coalesce(a, b), false) ELSE coalesce(active, false) END AS active FROM l""")
def _(s, d):
    own = R.Window.partitionBy("s_nationkey")
    x = table(s, d, "supplier").withColumn("m", F.max(F.when(F.col("s_suppkey") % 5 < 3, F.col("s_suppkey"))).over(own))
    tabs = x.select(F.col("s_nationkey").alias("user"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("tab"), F.coalesce(F.col("s_suppkey") == F.col("m"), F.lit(False)).alias("active"))
    return views.tabs_after_close(tabs, tabs.where("ord % 3 = 0").select("user", "tab"))


# -- diffs, trees, exports --------------------------------------------------------------------------------------------
@query("diff_stats", "WITH o AS (SELECT conv_id, turn // 2 AS line, text FROM conversations WHERE turn % 2 = 0), n AS (SELECT conv_id, turn // 2 AS line, text FROM conversations WHERE turn % 2 = 1), b AS (SELECT o.text AS o, n.text AS n FROM o FULL JOIN n ON o.conv_id = n.conv_id AND o.line = n.line) SELECT count(*) FILTER (n IS NOT NULL AND o IS DISTINCT FROM n) AS added, count(*) FILTER (o IS NOT NULL AND o IS DISTINCT FROM n) AS removed FROM b")
def _(s, d):
    c = table(s, d, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("line"), "turn", "text")
    return R.diff_stats(R.line_diff(c.where("turn % 2 = 0"), c.where("turn % 2 = 1"), ["conv_id", "line"]))


@query("first_paths", _TREE + "SELECT root, array_to_string(arg_min(path, array_to_string(path, chr(1))), '/') AS path FROM t WHERE node IN ('s3', 's7') GROUP BY root, node")
def _(s, d):
    t = nation_tree(s, d)
    return G.first_path(t, "s3").union(G.first_path(t, "s7")).withColumn("path", F.array_join("path", "/"))


@query("flow_lines", _TREE + f"""SELECT 'r1' AS name, repeat('  ', depth) || node || '()' AS text FROM t WHERE root = 'r1' UNION ALL SELECT 'n3', 'n3()' UNION ALL SELECT 'n3', '  └── ' || dst || '()' FROM {NATION_EDGES} WHERE src = 'n3' UNION ALL SELECT 'zz', 'Function ''zz'' not found'""")
def _(s, d):
    t, e = nation_tree(s, d), nation_edges(s, d)
    known = e.select(F.col("src").alias("name")).distinct()
    return R.reduce_union([G.flow_lines(t, e, known, n).select(F.lit(n).alias("name"), "text") for n in ("r1", "n3", "zz")])


@query("known_functions", _TREE + "SELECT node AS name FROM t UNION SELECT p_name FROM part WHERE p_size % 5 > 2")
def _(s, d):
    o = table(s, d, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 5 > 2, "function").otherwise("struct").alias("kind"))
    return views.known_functions(o, nation_tree(s, d))


@query("tree_json", _TREE + """SELECT root, '{"node":"' || node || '",' || CASE WHEN parent IS NULL THEN '' ELSE '"parent":"' || parent || '",' END || '"depth":' || depth || ',"node_type":"' || node_type || '","path":"' || array_to_string(path, '/') || '"}' AS text FROM t""")
def _(s, d):
    return G.as_json(nation_tree(s, d)).select("root", "text")


@query("tree_folding", _TREE + """, n AS (SELECT root, parent AS node, count(*) AS n FROM t WHERE parent IS NOT NULL GROUP BY ALL) SELECT t.root, t.node, CASE WHEN coalesce(n, 0) = 0 THEN 'leaf' WHEN t.depth + 1 >= 5 OR n > 10 THEN 'folded' WHEN n < 3 THEN 'open' ELSE 'shown' END AS state FROM t LEFT JOIN n ON t.root = n.root AND t.node = n.node""")
def _(s, d):
    return G.folding(nation_tree(s, d)).select("root", "node", "state")


@query("tree_drawing", _TREE + """, l AS (SELECT root, node, max(depth) AS rank, min(array_to_string(path, chr(1))) AS trail FROM t GROUP BY root, node)
 SELECT root, node, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY root, rank ORDER BY trail) - 1 AS INTEGER) AS place, CAST(0 AS INTEGER) AS crossings FROM l""")
def _(s, d):
    """A tree is drawn without crossings, the children of each node side by side."""
    return drawing(nation_tree(s, d)).select("root", "node", "rank", "place", "crossings")


_LAYOUT = _TREE + ", l AS (SELECT root, node, min(depth) AS rank, row_number() OVER (PARTITION BY root, min(depth) ORDER BY node) - 1 AS place FROM t GROUP BY root, node) "


@query("tree_layout", _LAYOUT + "SELECT root, node, CAST(rank AS INTEGER) AS rank, CAST(place AS INTEGER) AS place, CAST(rank * 260 AS INTEGER) AS x, CAST(place * 60 AS INTEGER) AS y FROM l")
def _(s, d):
    return G.layered_layout(nation_tree(s, d))


@query("tree_svg", _LAYOUT + """SELECT l.root, '<g><rect x="' || rank * 260 || '" y="' || place * 60 || '" width="180" height="40"/><text x="' || rank * 260 + 8 || '" y="' || place * 60 + 20 || '">' || node || '</text></g>' AS text FROM l
 UNION ALL SELECT a.root, '<line x1="' || a.rank * 260 + 180 || '" y1="' || a.place * 60 + 20 || '" x2="' || b.rank * 260 || '" y2="' || b.place * 60 + 20 || '"/>' FROM (SELECT DISTINCT root, parent, node FROM t WHERE parent IS NOT NULL) e JOIN l a ON a.root = e.root AND a.node = e.parent JOIN l b ON b.root = e.root AND b.node = e.node""")
def _(s, d):
    t = nation_tree(s, d)
    return G.svg(G.layered_layout(t), t.where("parent is not null").select("root", "parent", "node")).select("root", "text")


@query("cytoscape", _TREE + """, n AS (SELECT node, min(depth) AS depth, min(node_type) AS node_type FROM t WHERE depth < 2 GROUP BY node ORDER BY 2, 1 LIMIT 12) SELECT '{"group":"nodes","data":{"id":"' || node || '","class":"' || CASE node_type WHEN 'KernelApi' THEN 'kernel' ELSE 'function' END || '"}}' AS text FROM n
 UNION ALL SELECT DISTINCT '{"group":"edges","data":{"source":"' || parent || '","target":"' || t.node || '"}}' FROM t WHERE parent IN (SELECT node FROM n) AND t.node IN (SELECT node FROM n) AND t.depth < 2""")
def _(s, d):
    return G.cytoscape(nation_tree(s, d), 12, include_collapsed=False, shown_depth=2).select("text")


@query("dot_lines", f"SELECT DISTINCT '  \"' || src || '\" -> \"' || dst || '\";' AS text FROM {NATION_EDGES}")
def _(s, d):
    return G.dot(nation_edges(s, d))


@query("exported_text", _TREE + "SELECT root || ' ' || node AS text FROM t")
def _(s, d):
    folder = new_path(s, "export")
    D.export_text(nation_tree(s, d).select("ord", F.concat_ws(" ", "root", "node").alias("text")), folder, ["ord"])
    return s.read.text(folder).withColumnRenamed("value", "text")


@query("knowledge_getters", f"SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'usb_driver.probe' WHEN 1 THEN 'file_operations.open' END AS chain_id, {picked('n_nationkey % 3', 'int (*)(struct usb_interface *, const struct usb_device_id *)', 'int (*)(struct inode *, struct file *)', 'ssize_t (*)(struct file *, char __user *, size_t, loff_t *)')} AS signature FROM nation")
def _(s, d):
    x = table(s, d, "nation").select("n_nationkey", pick(F.col("n_nationkey") % 3, "usb_driver", "file_operations", "file_operations").alias("framework"), pick(F.col("n_nationkey") % 3, "probe", "open", "read").alias("callback"))
    return x.join(F.broadcast(knowledge(s)["callbacks"]), ["framework", "callback"]).select("n_nationkey", "chain_id", "signature")


@query("saved_samples", "SELECT CASE conv_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS task, '<think>' || chr(10) || md5(text) || chr(10) || '</think>' || chr(10) || chr(10) || role AS output FROM conversations")
def _(s, d):
    rows = table(s, d, "conversations").select(pick(F.col("conv_id") % 3, "a", "b", "c").alias("task"), F.md5(F.col("text").cast("binary")).alias("thinking"), F.col("role").alias("answer"))
    folder = new_path(s, "samples")
    samples.save(samples.with_thinking(rows), folder, by_task=True)
    return s.read.schema("output string, task string").json(folder).select("task", "output")


@query("internal_symbols", "SELECT p_partkey AS id FROM part WHERE p_size % 4 <> 0")
def _(s, d):
    return R.not_internal(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.when(F.col("p_size") % 4 == 0, "__").otherwise("_"), "p_name").alias("name"))).select("id")


@query("variable_names", "SELECT DISTINCT role AS name FROM conversations")
def _(s, d):
    return R.variables(table(s, d, "conversations").select(F.col("turn").alias("step"), F.create_map("role", "text").alias("variables")))


@query("type_database", "SELECT 'f' || p_partkey AS name FROM part WHERE p_size % 6 IN (1, 2)")
def _(s, d):
    """Types and functions are added twice; the later ones count."""
    k = F.col("p_size") % 6
    params = F.when(k == 1, F.array(F.lit("size_t"), F.lit("struct b *"))).when(k == 2, F.array(F.lit("unsigned long"), F.lit("const struct b *"))).when(k == 3, F.array(F.lit("int"))).otherwise(F.array(F.lit("int"), F.lit("char *")))
    f = table(s, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.lit("long").alias("return_type"), params.alias("params"))
    one = lambda *p: s.range(1).select(F.lit("cb").alias("name"), F.lit("int").alias("return_type"), F.array(*map(F.lit, p)).alias("params"))
    db = TypeDatabase.empty(s).add_types(one("int", "char *")).add_types(one("int", "struct b *")).add_functions(f.withColumn("params", F.array(F.lit("int"), F.lit("char *")))).add_functions(f)
    return db.compatible_with("cb")


@query("merged_results", "SELECT user_id, event_type, arg_max(ts, event_id) AS ts, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def _(s, d):
    """Of the results for one name the last counts, with all that it holds."""
    e = table(s, d, "events").select("user_id", "event_type", "event_id", "ts")
    return R.last_wins(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "ts", "event_id")


# -- values and scenarios ---------------------------------------------------------------------------------------------
@query("branches", """WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_suppkey AS lo, l_suppkey + l_linenumber * 2 AS hi, l_returnflag = 'R' AS nul FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN q > 25 THEN 'AlwaysTrue' ELSE 'AlwaysFalse' END AS a, CASE WHEN nul THEN 'AlwaysTrue' ELSE 'AlwaysFalse' END AS b, 'Unknown' AS c, CASE WHEN (lo + hi) // 2 >= 50 THEN 'AlwaysTrue' ELSE 'AlwaysFalse' END AS d,
 CASE WHEN q % 7 = 0 THEN 'AlwaysFalse' ELSE 'Unknown' END AS e, (lo + hi) // 2 + 1 AS f, CASE WHEN q = 10 THEN 'AlwaysTrue' ELSE 'AlwaysFalse' END AS g FROM v""")
def _(s, d):
    li = table(s, d, "lineitem")
    env = {"q": V.value("Integer", i=F.col("l_quantity").cast("bigint")), "r": V.value("Range", lo=F.col("l_suppkey"), hi=F.col("l_suppkey") + F.col("l_linenumber") * 2), "dev->ptr": V.value("Pointer", is_null=F.col("l_returnflag") == "R")}
    b = lambda e: V.branch(e, env)
    return li.select("l_orderkey", "l_linenumber", b("q > 25").alias("a"), b("ptr == NULL").alias("b"), b("unknown < 3").alias("c"), b("r >= 50").alias("d"), b("q % 7 && unknown").alias("e"), V.evaluate("r + 1", env)["i"].alias("f"), b("q == 0b1010").alias("g"))


@query("null_checks", "SELECT p_partkey, CASE WHEN p_size % 6 IN (3, 4) THEN 'Unknown' WHEN (p_size % 6 IN (0, 2)) = (p_partkey % 2 = 0) THEN 'AlwaysTrue' ELSE 'AlwaysFalse' END AS result FROM part")
def _(s, d):
    # null pointer, valid pointer, the integer 0, an integer by its last member, a name that is not bound, an integer by its name
    env = {"p0": V.value("Pointer", is_null=True), "p1": V.value("Pointer", is_null=False), "dev->z": V.value("Integer", i=F.lit(0)), "dev.five": V.value("Integer", i=F.lit(5)), "six": V.value("Integer", i=F.lit(6))}
    x = table(s, d, "part").select("p_partkey", pick(F.col("p_size") % 6, "p0", "p1", "dev.z", "five", "other", "six").alias("name"), (F.col("p_partkey") % 2 == 1).alias("n"))
    return x.select("p_partkey", V.null_check(F.col("name"), F.col("n"), env).alias("result"))


def condition_tree(s: SparkSession, d: str) -> DataFrame:
    """Regions over nations over suppliers; every other nation's name states a condition on a pointer of its number."""
    n, u, r = table(s, d, "nation"), table(s, d, "supplier"), table(s, d, "region")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, F.concat(text("if_ptr", "n_nationkey"), F.lit("_null"))).when(k % 3 == 1, F.concat(text("ptr", "n_nationkey"), F.lit("_valid_check"))).otherwise(text("n", "n_nationkey"))
    mid = n.select(text("r", "n_regionkey").alias("root"), name.alias("node"), "n_nationkey")
    low = u.join(mid, F.col("s_nationkey") == F.col("n_nationkey")).select("root", text("s", "s_suppkey").alias("node"), F.col("node").alias("up"))
    rows = r.select(text("r", "r_regionkey").alias("root"), text("r", "r_regionkey").alias("node"), F.lit(0).alias("depth"), F.array(text("r", "r_regionkey")).alias("trail"), F.lit("Function").alias("node_type"))
    rows = rows.union(mid.select("root", "node", F.lit(1), F.array("root", "node"), F.lit("Function"))).union(low.select("root", "node", F.lit(2), F.array("root", "up", "node"), F.lit("KernelApi")))
    return rows.withColumn("ord", G.order_key(F.col("trail")))


@query("scenario_run", """WITH m AS (SELECT 'r' || n_regionkey AS root, n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'if_ptr' || n_nationkey || '_null' WHEN 1 THEN 'ptr' || n_nationkey || '_valid_check' ELSE 'n' || n_nationkey END AS node,
  n_nationkey % 3 = 0 AND n_nationkey < 12 AND n_nationkey % 2 = 1 OR n_nationkey % 3 = 1 AND n_nationkey < 12 AND n_nationkey % 2 = 0 AS off FROM nation),
 a AS (SELECT root, [root] AS trail, root AS node, 0 AS depth, false AS off FROM (SELECT 'r' || r_regionkey AS root FROM region) UNION ALL SELECT root, [root, node], node, 1, off FROM m UNION ALL SELECT root, [root, node, 's' || s_suppkey], 's' || s_suppkey, 2, off FROM m JOIN supplier ON s_nationkey = k),
 b AS (SELECT *, row_number() OVER (ORDER BY array_to_string(trail, chr(1))) AS step FROM a WHERE root = 'r1')
 SELECT CAST(step AS INTEGER) AS step, node AS function, CAST(depth AS INTEGER) AS depth, NOT off AS reachable, CASE WHEN off THEN '[unreachable] | ' ELSE '' END || 'n=0x12c | ' || (SELECT string_agg('ptr' || i || '=' || CASE WHEN i % 2 = 0 THEN 'NULL' ELSE '<valid ptr>' END, ' | ' ORDER BY 'ptr' || i) FROM range(12) r(i)) AS description FROM b""")
def _(s, d):
    sc = Scenario("s", "r1").bind("n", "300")
    for i in range(12):
        sc = sc.bind(f"ptr{i}", "null" if i % 2 == 0 else "valid", "pointer")
    return run_scenario(condition_tree(s, d), sc).drop("variables")


@query("scenario_without_api", """SELECT 'r2' AS function, CAST(0 AS INTEGER) AS depth FROM region WHERE r_regionkey = 2
 UNION ALL SELECT CASE n_nationkey % 3 WHEN 0 THEN 'if_ptr' || n_nationkey || '_null' WHEN 1 THEN 'ptr' || n_nationkey || '_valid_check' ELSE 'n' || n_nationkey END, 1 FROM nation WHERE n_regionkey = 2""")
def _(s, d):
    return run_scenario(condition_tree(s, d), Scenario("s", "r2", show_kernel_api=False)).select("function", "depth")


@query("scenario_files", "SELECT n_name AS name, 'f' || n_nationkey AS entry_function, CASE WHEN n_nationkey % 2 = 0 THEN 'x=' || n_regionkey || ':integer' ELSE '' END AS bindings, CASE WHEN n_nationkey % 3 = 0 THEN 4 ELSE 10 END AS max_depth, n_nationkey % 5 > 0 AS show_kernel_api FROM nation WHERE n_nationkey <> 7")
def _(s, d):
    n = F.col("n_nationkey").cast("string")
    text = F.concat(
        F.lit('{"name":"'), "n_name", F.lit('"'), F.when(F.col("n_nationkey") == 7, "").otherwise(F.concat(F.lit(',"entry_function":"f'), n, F.lit('"'))), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(',"bindings":{"x":{"text":"'), F.col("n_regionkey").cast("string"), F.lit('","hint":"integer"}}'))).otherwise(""),
        F.when(F.col("n_nationkey") % 3 == 0, ',"max_depth":4').otherwise(""), F.when(F.col("n_nationkey") % 5 == 0, ',"show_kernel_api":false').otherwise(""), F.lit("}"),
    )
    rows = parse_scenarios(table(s, d, "nation").select(text.alias("text")))
    shown = F.array_join(F.transform(F.map_entries("bindings"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["text"], F.lit(":"), e["value"]["hint"])), ",")
    return rows.select("name", "entry_function", shown.alias("bindings"), "max_depth", "show_kernel_api")


@query("state_snapshots", "SELECT c.conv_id, c.turn AS step, CASE WHEN c.turn = 3 THEN o.role ELSE c.role END AS name, CASE WHEN c.turn = 3 THEN md5(o.text) ELSE md5(c.text) END AS value FROM conversations c LEFT JOIN (SELECT * FROM conversations WHERE turn = 1) o USING (conv_id) WHERE c.turn < 3 OR (c.turn = 3 AND o.conv_id IS NOT NULL)")
def _(s, d):
    """Every conversation goes back, at its turn 3, to what it was after turn 1."""
    states = table(s, d, "conversations").select("conv_id", F.col("turn").alias("step"), F.create_map("role", F.md5(F.col("text").cast("binary"))).alias("variables"))
    back = restore(states, snapshot(states, 1, ("conv_id",)), 3, ("conv_id",))
    return back.select("conv_id", "step", F.explode("variables").alias("name", "value"))


@query("set_values", "SELECT p_partkey, CASE WHEN p_size > 255 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS a, 'NULL' AS b, CASE WHEN p_partkey > 255 THEN '0x' || lower(hex(p_partkey)) ELSE CAST(p_partkey AS VARCHAR) END AS c FROM part")
def _(s, d):
    i = lambda c: V.value("Integer", i=c)
    state = F.create_map(F.lit("a"), i(F.col("p_size").cast("bigint")), F.lit("b"), V.value("Pointer", is_null=False))
    new = V.set_values(state, {"b": V.value("Pointer", is_null=True), "c": i(F.col("p_partkey"))})
    get = lambda k: V.display(F.try_element_at(F.col("m"), F.lit(k))).alias(k)
    return table(s, d, "part").select("p_partkey", new.alias("m")).select("p_partkey", get("a"), get("b"), get("c"))


@query("project_info", "SELECT count(DISTINCT p_brand) AS files_count, count(*) FILTER (p_size % 5 > 2) AS functions_count, count(*) FILTER (p_size % 5 = 0) AS structs_count, count(*) > 0 AS indexed FROM part")
def _(s, d):
    x = table(s, d, "part")
    return views.project_info(x.where("p_size % 5 > 2"), x.where("p_size % 5 = 0"), x.select("p_brand").distinct())


@query("unified_call_kinds", f"SELECT o_orderkey, {picked('o_custkey % 5', 'Method', 'VirtualMethod', 'Goroutine', 'Promise', 'Generic')} AS call_kind, CASE WHEN o_custkey % 5 < 2 THEN 'sync' ELSE 'async' END AS call_group, o_custkey % 5 <> 1 AS is_direct FROM orders")
def _(s, d):
    return G.unify_edges(table(s, d, "orders").select("o_orderkey", pick(F.col("o_custkey") % 5, "Method", "VirtualMethod", "Goroutine", "Promise", "mystery").alias("call_type"))).drop("call_type")


@query("edge_counts", "SELECT src, count(*) AS n FROM (SELECT DISTINCT 's' || l_suppkey AS src, CASE WHEN l_partkey % 3 = 0 THEN 'x' || l_partkey % 50 ELSE 's' || l_partkey % 120 END AS dst FROM lineitem) GROUP BY src")
def _(s, d):
    calls = edges(s, d).groupBy(F.col("src").alias("name")).agg(F.collect_list("dst").alias("calls"))
    return G.call_edges(calls).groupBy("src").agg(F.count("*").alias("n"))


@query("parameter_flow", "SELECT DISTINCT 'Copy' AS kind, 'p' || l_linenumber || '_' || l_suppkey % 20 AS dest, 'a' || l_partkey % 30 AS src FROM lineitem WHERE l_linenumber <= 4")
def _(s, d):
    callee = F.concat(F.lit("f"), (F.col("l_suppkey") % 20).cast("string"))
    calls = table(s, d, "lineitem").select(callee.alias("callee"), F.col("l_linenumber").alias("position"), F.concat(F.lit("a"), (F.col("l_partkey") % 30).cast("string")).alias("argument"))
    pars = calls.where("position <= 4").select(F.col("callee").alias("function"), "position", F.concat(F.lit("p"), F.col("position").cast("string"), F.lit("_"), F.substring("callee", 2, 9)).alias("name")).distinct()
    return D.parameter_flow(calls, pars).drop("field")


# -- streams ----------------------------------------------------------------------------------------------------------
def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table, one file or a folder of them, as a stream; a pattern is taken for either."""
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query("debounce_stream", """WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a)
 SELECT user_id, max(ts) AS ts, count(*) AS burst FROM b GROUP BY user_id, g HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(s, d):
    """Bursts that have ended by the watermark, an hour behind the last event."""
    events = _stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks are on instants
    bursts = intake.run_to_table(intake.debounced(events, "user_id", "ts", "6 hours", "1 hour"), new_path(s, "bursts"), new_path(s, "state"))
    return bursts.withColumn("ts", F.col("ts").cast(table(s, d, "events").schema["ts"].dataType))


@query("question_stream", "SELECT a.conv_id AS \"user\", CAST(a.turn AS BIGINT) AS question, CAST(b.turn AS BIGINT) AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role <> 'user'")
def _(s, d):
    turns = _stream(s, d, "conversations").select(F.col("conv_id").cast("long").alias("user"), F.col("turn").cast("long").alias("number"), (F.col("role") == "user").alias("asks"))
    return intake.run_to_table(intake.answered(turns), new_path(s, "answers"), new_path(s, "state"))


@query("new_ids", "SELECT count(*) AS n, count(*) AS distinct_ids, true AS well_formed FROM part")
def _(s, d):
    ids = checkpoint(table(s, d, "part").select(T.new_id("tab").alias("id")))  # written once, as they are new each time
    return ids.agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"), F.bool_and(F.col("id").rlike("^tab-[0-9]{13}-[0-9a-f]{6}$")).alias("well_formed"))


@query("scenario_yaml", "SELECT s_name AS name, 'f' || s_nationkey AS entry_function, CASE WHEN s_suppkey % 2 = 0 THEN 'dev.n=' || s_suppkey || ':integer' ELSE '' END AS bindings, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 10 END AS max_depth, s_suppkey % 5 > 0 AS show_kernel_api FROM supplier WHERE s_suppkey % 7 > 0")
def _(s, d):
    """Scenarios as YAML texts; some of them are no YAML, or no mapping."""
    k, t = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    line = lambda test, *parts: F.when(F.expr(test), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))).otherwise("")
    good = F.concat(F.lit("name: '"), "s_name", F.lit("'\nentry_function: f"), F.col("s_nationkey").cast("string"), F.lit("\n"), line("s_suppkey % 2 = 0", "bindings:\n  dev.n: {text: '", t, "', hint: integer}\n"), line("s_suppkey % 3 = 0", "max_depth: 4\n"), line("s_suppkey % 5 = 0", "show_kernel_api: no\n"))
    bad = F.when(k % 14 == 0, F.lit("- a\n- b\n")).otherwise(F.lit("name: [unclosed"))
    rows = parse_scenarios(yaml_to_json(table(s, d, "supplier").select(F.when(k % 7 == 0, bad).otherwise(good).alias("text"))))
    shown = F.array_join(F.transform(F.map_entries("bindings"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["text"], F.lit(":"), e["value"]["hint"])), ",")
    return rows.select("name", "entry_function", shown.alias("bindings"), "max_depth", "show_kernel_api")


@query("recent_state", """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY epoch_ms(CAST(o_orderdate AS TIMESTAMP)) DESC, o_orderkey DESC) AS r FROM orders)
 SELECT o_custkey AS "user", 'p/' || o_orderkey AS path, CAST(r AS INTEGER) AS place FROM o WHERE r <= 10""")
def _(s, d):
    """The lists of recent files that users' states hold as JSON, most recent first, ten of each."""
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    item = F.struct(F.concat(F.lit("p/"), F.col("o_orderkey").cast("string")).alias("path"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("name"), at.alias("timestamp"), (F.col("o_orderkey") % 2 == 0).alias("isProject"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("order"))
    states = table(s, d, "orders").groupBy(F.col("o_custkey").alias("user")).agg(F.to_json(F.collect_list(item)).alias("state"))
    return views.recent_state(states).select("user", "path", "place")


@query("pack_texts", r"""WITH t AS (SELECT n_nationkey AS k, n_name AS n FROM nation)
 SELECT 'packs/' || n || '.yaml' AS path, n AS pack, 'work' AS mechanism, 'bind' AS role, 0 AS nth, 'INIT_' || n || '\s*\((?P<var>\w+)' AS pattern, 'fn' AS handler, 'var' AS variable, NULL AS scope, false AS failed FROM t WHERE k % 5 > 0
 UNION ALL SELECT 'packs/' || n || '.yaml', n, 'work', 'trigger', i, 'queue_' || i, NULL, NULL, CASE WHEN i = 1 THEN 'file' END, false FROM t, unnest([0, 1]) u(i) WHERE k % 5 > 0
 UNION ALL SELECT 'packs/' || n || '.yaml', n, 'delayed', 'bind', 0, 'INIT_' || n || '\s*\((?P<var>\w+)', 'fn', 'var', NULL, false FROM t WHERE k % 5 > 0 AND k % 2 = 0
 UNION ALL SELECT 'packs/' || n || '.yaml', n, 'delayed', 'trigger', 0, 'mod_' || k, NULL, NULL, NULL, false FROM t WHERE k % 5 > 0 AND k % 2 = 0
 UNION ALL SELECT 'packs/' || n || '.yaml', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM t WHERE k % 5 = 0""")
def _(s, d):
    """Packs as YAML texts: a mechanism, one that extends it, and texts that are no pack."""
    k, n = F.col("n_nationkey"), F.col("n_name")
    work = F.concat(F.lit("work:\n  bind_patterns:\n    - {pattern: 'INIT_"), n, F.lit("\\s*\\((?P<var>\\w+)', handler_group: fn, variable_capture: var}\n  trigger_patterns: [queue_0, {pattern: queue_1, scope: file}]\n"))
    more = F.when(k % 2 == 0, F.concat(F.lit("delayed:\n  extends: work\n  trigger_patterns:\n    - mod_"), k.cast("string"), F.lit("\n"))).otherwise("")
    text = F.when(k % 5 > 0, F.concat(work, more)).when(k % 10 == 0, "- no\n- mapping\n").otherwise("work: {")
    rows = packs.rules_of(table(s, d, "nation").select(F.concat(F.lit("packs/"), n, F.lit(".yaml")).alias("path"), text.alias("text")))
    return rows.select("path", "pack", "mechanism", "role", "nth", "pattern", "handler", "variable", "scope", F.col("error").isNotNull().alias("failed"))
