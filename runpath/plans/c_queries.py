"""Registered queries over C code: each part is one file written from its row, so SQL knows what the front end must find.

FILE holds the text of a file; {k} is the part's key, {z} its size, {h} its key modulo 7.  Some lines are there for some
sizes only and empty otherwise, so every fact has a fixed line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runpath import fixed
from runpath.functions import text as T
from runpath.operators import design as D
from runpath.operators import graph as G
from runpath.operators import learning as L
from runpath.operators import patterns as P
from runpath.operators import points_to as PT
from runpath.operators import relational as R
from runpath.operators import views
from runpath.operators.index import DefinitionIndex, SymbolIndex
from runpath.operators.storage import checkpoint, new_path, store
from runpath.plans import samples
from runpath.plans.registry import query, table
from runpath.plans.session import AnalysisSession
from runpath.sources import c_front
from runpath.sources.files import knowledge
from runpath.streaming import intake

FILE = """#include <linux/module.h>
/* unit {k} has { braces } in a comment */
struct dev_{k} {
	struct work_struct work;
	struct timer_list tick;
	char *name;
	int level[4];
	int (*handler)(struct dev_{k} *d, int to);
};
typedef int (*cb_{k})(struct dev_{k} *d, int n);
static void work_{k}(struct work_struct *w)
{
	printk("work }");
	mod_timer(&d{k}->tick, jiffies);
}
static void tick_{k}(struct timer_list *t)
{
	schedule_work(&d{k}->work);
}
int dim_{k}(struct dev_{k} *d, int to)
{
	return helper_{h}(d, to);
}
static int irq_{k}(int irq, void *data)
{
	wake_up_process(task);
	return 0;
}
static int probe_{k}(struct usb_interface *intf, const struct usb_device_id *id)
{
	struct dev_{k} *d{k} = kzalloc(sizeof(*d{k}), GFP_KERNEL);
	INIT_WORK(&d{k}->work, work_{k});
	timer_setup(&d{k}->tick, tick_{k}, 0);
{assign}
	d{k}->handler(d{k}, {z});
{irq}
	return dim_{k}(d{k}, {z});
}
static void gone_{k}(struct usb_interface *intf)
{
	kfree(intf);
}
static struct usb_driver drv_{k} = {
	.name = "x",
	.driver = { .owner = THIS_MODULE, },
	.probe = probe_{k},
{gone}
};
static int __init init_{k}(void)
{
	return usb_register(&drv_{k});
}
static void __exit exit_{k}(void)
{
	usb_deregister(&drv_{k});
}
{entry}
{leave}
{broken}
"""
#: Lines that are there for some sizes: (name, SQL condition on z, text).
SOMETIMES = [
    ("assign", "z % 7 = 0", "\td{k}->handler = dim_{k};"),
    ("irq", "z % 2 = 0", '\trequest_irq(d{k}->irq, irq_{k}, 0, "x", d{k});'),
    ("gone", "z % 3 = 0", "\t.disconnect = gone_{k},"),
    ("entry", "z % 5 = 0", "module_init(init_{k});"),
    ("leave", "z % 5 = 0", "module_exit(exit_{k});"),
    ("broken", "z % 11 = 0", "int broken_{k}(void) {"),
]
IS = {name: test for name, test, _ in SOMETIMES}
#: Rows of the SQL twins.
P_SQL = "(SELECT p_partkey AS k, p_size AS z, 'f' || p_partkey || '.c' AS path FROM part)"


def filled(text: str, values: dict[str, Column]) -> Column:
    """text with {name} replaced by columns."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def c_files(s: SparkSession, d: str) -> DataFrame:
    """files(path, content, k, z); rows are dealt out before they become texts, as a small table comes in one partition."""
    x = c_front.dealt(table(s, d, "part")).select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    text = FILE
    lines = {name: F.when(F.expr(test), F.lit(line)).otherwise(F.lit("")) for name, test, line in SOMETIMES}
    return x.select(F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(".c")).alias("path"), filled(text, lines | {"k": F.col("k"), "z": F.col("z"), "h": F.col("k") % 7}).alias("content"), "k", "z")


def session(s: SparkSession, d: str) -> AnalysisSession:
    return AnalysisSession(s, c_files(s, d))


def values(*rows: tuple) -> str:
    """SQL VALUES of Python rows."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


def sql_fill(column: str) -> str:
    """SQL: {k}, {z} and {h} of a text column replaced."""
    return f"replace(replace(replace({column}, '{{k}}', CAST(k AS VARCHAR)), '{{z}}', CAST(z AS VARCHAR)), '{{h}}', CAST(k % 7 AS VARCHAR))"


#: What the functions of a file are: (name, first line, last line, return type, parameters, attributes, callees); a callee in brackets is there with its line.
FUNCTIONS = [
    ("work_{k}", 11, 15, "void", "w:struct work_struct *", "static", "mod_timer,printk"),
    ("tick_{k}", 16, 19, "void", "t:struct timer_list *", "static", "schedule_work"),
    ("dim_{k}", 20, 23, "int", "d:struct dev_{k} *,to:int", "", "helper_{h}"),
    ("irq_{k}", 24, 28, "int", "irq:int,data:void *", "static", "wake_up_process"),
    ("probe_{k}", 29, 38, "int", "intf:struct usb_interface *,id:const struct usb_device_id *", "static", "INIT_WORK,dim_{k},kzalloc{irq},timer_setup"),
    ("gone_{k}", 39, 42, "void", "intf:struct usb_interface *", "static", "kfree"),
    ("init_{k}", 49, 52, "int", "", "static,__init", "usb_register"),
    ("exit_{k}", 53, 56, "void", "", "static,__exit", "usb_deregister"),
]
_F = values(*FUNCTIONS)
_CALLS = f"replace({sql_fill('calls')}, '{{irq}}', CASE WHEN {IS['irq']} THEN ',request_irq' ELSE '' END)"
#: functions(path, k, z, name, line, end_line, ret, params, attrs, calls) in SQL.
FUNCTIONS_SQL = f"(SELECT path, k, z, {sql_fill('v.name')} AS name, line, end_line, ret, {sql_fill('params')} AS params, attrs, {_CALLS} AS calls FROM {P_SQL}, {_F} v(name, line, end_line, ret, params, attrs, calls))"


@query("c_functions", f"SELECT path, name, CAST(line AS INTEGER) AS line, CAST(end_line AS INTEGER) AS end_line, ret, params, attrs, calls FROM {FUNCTIONS_SQL}")
def _(s, d):
    f = session(s, d).defined
    params = F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["name"], p["type_name"])), ",")
    return f.select("path", "name", "line", "end_line", F.col("return_type").alias("ret"), params.alias("params"), F.array_join("attributes", ",").alias("attrs"), F.array_join("calls", ",").alias("calls"))


@query("c_structs", f"""SELECT path, 'dev_' || k AS name, 3 AS line, 9 AS end_line, 'timer_list,work_struct' AS refs,
 'work|struct work_struct|false|false|,tick|struct timer_list|false|false|,name|char *|true|false|,level|int[4]|false|false|,handler|int|true|true|int (*)(struct dev_' || k || ' *d, int to)' AS fields FROM {P_SQL}""")
def _(s, d):
    show = F.transform("fields", lambda f: F.concat_ws("|", f["name"], f["type_name"], f["is_pointer"].cast("string"), f["is_function_ptr"].cast("string"), F.coalesce(f["signature"], F.lit(""))))
    return session(s, d).structs.select("path", "name", "line", "end_line", F.array_join("referenced_structs", ",").alias("refs"), F.array_join(show, ",").alias("fields"))


@query("c_errors", f"SELECT path, 'unbalanced brace at line 59' AS error FROM {P_SQL} WHERE {IS['broken']}")
def _(s, d):
    return session(s, d).errors


@query("c_lines", f"SELECT path, CAST(59 + CAST({IS['broken']} AS INTEGER) - 1 AS BIGINT) AS n, CAST(59 + CAST({IS['broken']} AS INTEGER) - 1 AS INTEGER) AS last_line FROM {P_SQL}")
def _(s, d):
    return session(s, d).lines.groupBy("path").agg(F.sum((F.col("line") <= 58).cast("long") + ((F.col("line") == 59) & (F.col("text") != "")).cast("long")).alias("n"), F.max(F.when((F.col("line") <= 58) | (F.col("text") != ""), F.col("line"))).alias("last_line"))


@query("c_outline", f"""WITH i AS (SELECT path, 'function' AS kind, name, line, ret || ' ' || name || '(' || array_to_string(list_transform(string_split(params, ','), lambda p: split_part(p, ':', 2)), ', ') || ')' AS signature FROM {FUNCTIONS_SQL}
 UNION ALL SELECT path, 'struct', 'dev_' || k, 3, 'struct dev_' || k FROM {P_SQL})
 SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY line, name) AS INTEGER) AS place, kind, name, CAST(line AS INTEGER) AS line, signature, CASE kind WHEN 'struct' THEN 'Structures' ELSE 'Functions' END AS section FROM i""")
def _(s, d):
    x = session(s, d)
    return views.outline(x.defined, x.structs)


# -- asynchronous mechanisms ------------------------------------------------------------------------------------------
#: Bindings of a file: (pattern, mechanism, flag, context, variable, handler, line, condition, trigger lines, icon, mechanism in full, context in words).
BINDINGS_SQL = f"""(SELECT path, k, z, b.mechanism, b.context, {sql_fill('variable')} AS variable, {sql_fill('handler')} AS handler, CAST(line AS INTEGER) AS line, trig, icon, full_name, words FROM {P_SQL}, {values(
    ("WorkQueue", "Process", "d{k}->work", "work_{k}", 32, "18", "⚙️", "WorkQueue { delayed: false }", "can sleep"),
    ("Timer", "SoftIrq", "d{k}->tick", "tick_{k}", 33, "14", "⏲️", "Timer { high_resolution: false }", "cannot sleep"),
    ("Interrupt", "HardIrq", "", "irq_{k}", 36, "", "⚡", "Interrupt { threaded: false }", "cannot sleep"),
)} b(mechanism, context, variable, handler, line, trig, icon, full_name, words) WHERE b.line <> 36 OR {IS['irq']})"""


@query("c_bindings", f"SELECT path, mechanism, false AS flag, context, variable, handler, line, trig AS trigger_lines FROM {BINDINGS_SQL}")
def _(s, d):
    return session(s, d).bindings.select("path", "mechanism", "flag", "context", "variable", "handler", "line", F.array_join("trigger_lines", ",").alias("trigger_lines"))


@query("c_triggers", f"SELECT path, CAST(p AS INTEGER) AS pattern_id, {sql_fill('variable')} AS variable, has_variable, CAST(line AS INTEGER) AS line FROM {P_SQL}, {values((0, 'd{k}->work', True, 18), (2, 'd{k}->tick', True, 14), (7, '', False, 26))} t(p, variable, has_variable, line)")
def _(s, d):
    return session(s, d).triggers.drop("nth")


@query("c_matched_triggers", f"SELECT path, handler, CAST(trig AS INTEGER) AS trigger_line FROM {BINDINGS_SQL} WHERE trig <> ''")
def _(s, d):
    return session(s, d).matched.select("path", "handler", "trigger_line")


@query("c_async_listing", f"SELECT path, handler, icon, full_name AS mechanism, words AS context, variable, line FROM {BINDINGS_SQL}")
def _(s, d):
    return session(s, d).async_listing()


#: One line for each asynchronous pattern: ({v} a variable, {h} a handler, {s} a name); bind patterns first, then trigger patterns.
BIND_TEXTS = {
    0: ["INIT_WORK(&{v}, {h});"], 1: ["INIT_DELAYED_WORK(&{v}, {h});"], 2: ["timer_setup(&{v}, {h}, 0);", "DEFINE_TIMER({s}, {h});"], 3: ["{v}.function = {h};"],
    4: ["request_irq(irq, {h}, 0);", "devm_request_irq(dev, irq, {h}, 0);"], 5: ["request_threaded_irq(irq, fast, {h}, 0);"], 6: ["tasklet_init(&{v}, {h}, 0);", "DECLARE_TASKLET({s}, {h});"],
    7: ["kthread_run({h}, data, n);", "kthread_create({h}, data, n);"], 8: ["call_rcu(&{v}, {h});", "call_rcu_sched(&{v}, {h});"],
    9: ["register_reboot_notifier(&{h});", "register_netdevice_notifier(&{h});", "blocking_notifier_chain_register(&chain, &{h});", "atomic_notifier_chain_register(&chain, &{h});"],
    10: ["open_softirq(NR, {h});"], 11: ["init_completion(&{h});", "DECLARE_COMPLETION({h});", "reinit_completion(&{h});"], 12: ["init_waitqueue_head(&{h});", "DECLARE_WAIT_QUEUE_HEAD({h});"],
    13: ["INIT_WORK_ONSTACK(&{v}, {h});"], 14: ["init_irq_work(&{v}, {h});"],
}
TRIGGER_TEXTS = {
    0: ["schedule_work(&{v});", "queue_work(wq, &{v});"], 1: ["schedule_delayed_work(&{v}, 5);"], 2: ["mod_timer(&{v}, 9);", "add_timer(&{v});"], 3: ["hrtimer_start(&{v}, t, m);"], 6: ["tasklet_schedule(&{v});"],
    7: ["wake_up_process(task);"], 10: ["raise_softirq(nr);", "raise_softirq_irqoff(nr);"], 11: ["complete(&{v});", "complete_all(&{v});"], 12: ["wake_up(&{v});", "wake_up_interruptible(&{v});", "wake_up_all(&{v});"],
    13: ["schedule_work_on(1, &{v});", "queue_work_on(1, wq, &{v});", "flush_work(&{v});"], 14: ["irq_work_queue(&{v});"],
}
TEXTS = [(role, i, n, t) for role, all_ in (("bind", BIND_TEXTS), ("trigger", TRIGGER_TEXTS)) for i, texts in all_.items() for n, t in enumerate(texts)]


def pattern_lines(s: SparkSession, d: str) -> DataFrame:
    """lines(path, line, text) of every pattern in turn."""
    x = table(s, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("line"), F.col("p_size").alias("z"))
    text = F.element_at(F.array(*(F.lit("\tx; " + t) for *_, t in TEXTS)), (F.col("line") % len(TEXTS) + 1).cast("int"))
    z = F.col("z").cast("string")
    return x.select("path", "line", filled("{t}", {"t": text, "v": F.concat(F.lit("dev->w"), z), "h": F.concat(F.lit("h"), z), "s": F.concat(F.lit("s"), z)}).alias("text"))


def _pattern_rows(role: str) -> str:
    """SQL: what each line of a role must give, (i, pattern, nth, mechanism, flag, context, variable); some lines give more than one row."""
    rows = []
    for at, (r, i, n, t) in enumerate(TEXTS):
        m, f, c, *_ = fixed.ASYNC_PATTERNS[i]
        if r == role:
            variable = "dev->w" if "{v}" in t else "s" if "{s}" in t else ""
            rows.append((at, i, n, m, f, c, variable))
            if t.startswith("reinit_completion"):  # holds the name of another pattern
                rows.append((at, i, 0, m, f, c, variable))
    return values(*rows)


@query("pattern_bindings", f"""WITH l AS (SELECT p_brand AS path, p_partkey AS line, p_size AS z, p_partkey % {len(TEXTS)} AS i FROM part), f AS (SELECT DISTINCT p_brand AS path, p_size AS z FROM part WHERE p_size % 3 > 0)
 SELECT path, line, CAST(pattern AS INTEGER) AS pattern_id, CAST(nth AS INTEGER) AS nth, mechanism, flag, context, CASE WHEN variable <> '' THEN variable || z ELSE '' END AS variable, 'h' || z AS handler
 FROM l SEMI JOIN f USING (path, z) JOIN {_pattern_rows('bind')} v(idx, pattern, nth, mechanism, flag, context, variable) ON idx = i""")
def _(s, d):
    known = table(s, d, "part").where("p_size % 3 > 0").select(F.col("p_brand").alias("path"), F.concat(F.lit("h"), F.col("p_size").cast("string")).alias("name")).distinct()
    return P.bindings(pattern_lines(s, d), known).select("path", "line", "pattern_id", "nth", "mechanism", "flag", "context", "variable", "handler")


@query("pattern_triggers", f"""WITH l AS (SELECT p_brand AS path, p_partkey AS line, p_size AS z, p_partkey % {len(TEXTS)} AS i FROM part)
 SELECT path, line, CAST(pattern AS INTEGER) AS pattern_id, CAST(nth AS INTEGER) AS nth, CASE WHEN variable <> '' THEN variable || z ELSE '' END AS variable, variable <> '' AS has_variable
 FROM l JOIN {_pattern_rows('trigger')} v(idx, pattern, nth, mechanism, flag, context, variable) ON idx = i""")
def _(s, d):
    return P.triggers(pattern_lines(s, d)).select("path", "line", "pattern_id", "nth", "variable", "has_variable")


@query("match_triggers", f"""WITH l AS (SELECT p_brand AS path, p_partkey AS line, p_size AS z, p_partkey % {len(TEXTS)} AS i FROM part), f AS (SELECT DISTINCT p_brand AS path, p_size AS z FROM part WHERE p_size % 3 > 0),
 b AS (SELECT path, line, pattern, CASE WHEN variable <> '' THEN variable || z ELSE '' END AS variable, 'h' || z AS handler FROM l SEMI JOIN f USING (path, z) JOIN {_pattern_rows('bind')} v(idx, pattern, nth, mechanism, flag, context, variable) ON idx = i),
 t AS (SELECT path, line, pattern, CASE WHEN variable <> '' THEN variable || z ELSE '' END AS variable FROM l JOIN {_pattern_rows('trigger')} v(idx, pattern, nth, mechanism, flag, context, variable) ON idx = i)
 SELECT b.path, CAST(b.pattern AS INTEGER) AS pattern_id, b.variable, handler, b.line, t.line AS trigger_line FROM b JOIN t ON b.path = t.path AND b.pattern = t.pattern AND (b.variable = '' OR t.variable = '' OR b.variable = t.variable)""")
def _(s, d):
    known = table(s, d, "part").where("p_size % 3 > 0").select(F.col("p_brand").alias("path"), F.concat(F.lit("h"), F.col("p_size").cast("string")).alias("name")).distinct()
    found = checkpoint(P.async_scan(pattern_lines(s, d)))
    return P.match_triggers(P.bindings_in(found, known), P.triggers_in(found)).select("path", "pattern_id", "variable", "handler", "line", "trigger_line")


#: Rules of a pack with named groups, as loaded from a file.
PACK = [
    {"pack": "c", "mechanism": "work", "role": "bind", "nth": 0, "pattern": r"INIT_WORK\s*\(\s*&?(?P<var>[\w\.\->]+)\s*,\s*(?P<handler>\w+)\s*\)", "variable": "var", "handler": "handler"},
    {"pack": "c", "mechanism": "work", "role": "trigger", "nth": 0, "pattern": r"queue_work\s*\(\s*(?P<wq>[\w\.\->]+)\s*,\s*&?(?P<var>[\w\.\->]+)\s*\)", "variable": "var", "handler": None},
    {"pack": "c", "mechanism": "queue", "role": "destroy", "nth": 0, "pattern": r"flush_work\s*\(", "variable": None, "handler": None},
]


@query("pack_scan", f"""WITH l AS (SELECT p_brand AS path, p_partkey AS line, p_size AS z, p_partkey % {len(TEXTS)} AS i FROM part)
 SELECT path, line, 'c' AS pack, mechanism, role, 0 AS nth, CASE WHEN v.variable THEN 'dev->w' || z ELSE '' END AS variable, CASE WHEN v.handler THEN 'h' || z ELSE '' END AS handler FROM l JOIN {values(
    ([t for *_, t in TEXTS].index("INIT_WORK(&{v}, {h});"), "work", "bind", True, True), ([t for *_, t in TEXTS].index("queue_work(wq, &{v});"), "work", "trigger", True, False),
    ([t for *_, t in TEXTS].index("flush_work(&{v});"), "queue", "destroy", False, False))} v(idx, mechanism, role, variable, handler) ON idx = i""")
def _(s, d):
    return P.pack_scan(pattern_lines(s, d), PACK)


# -- tables, edges, callbacks -----------------------------------------------------------------------------------------
OPS_SQL = f"(SELECT path, k, z, field, {sql_fill('function')} AS function, n FROM {P_SQL}, {values(('owner', 'THIS_MODULE', 0), ('probe', 'probe_{k}', 1), ('disconnect', 'gone_{k}', 2))} o(field, function, n) WHERE o.n < 2 OR {IS['gone']})"


@query("c_ops_initializers", f"SELECT path, 'usb_driver' AS struct_type, 'drv_' || k AS var_name, field, function FROM {OPS_SQL}")
def _(s, d):
    return P.ops_initializers(c_files(s, d)).drop("ord")


@query("c_ops_mappings", f"SELECT path, 'usb_driver' AS ops_type, 'drv_' || k AS var_name, field, function FROM {OPS_SQL} WHERE n > 0")
def _(s, d):
    return session(s, d).ops.select("path", "ops_type", "var_name", "field", "function")


@query("c_pointer_bindings", f"SELECT path, 'drv_' || k AS source, field, function, 'High' AS confidence FROM {OPS_SQL} WHERE n > 0 UNION ALL SELECT path, 'd' || k || '-', 'handler', 'dim_' || k, 'Medium' FROM {P_SQL} WHERE {IS['assign']}")
def _(s, d):
    return session(s, d).pointer_bindings


@query("c_module_entries", f"SELECT path, name || k AS name, CAST(rank AS INTEGER) AS rank FROM {P_SQL}, {values(('init_', 0), ('exit_', 1))} m(name, rank) WHERE {IS['entry']}")
def _(s, d):
    return P.module_entries(c_files(s, d))


EDGES_SQL = f"""(SELECT path, name AS src, unnest(string_split(calls, ',')) AS dst, 'Direct' AS call_type, NULL AS line, NULL AS mechanism FROM {FUNCTIONS_SQL}
 UNION ALL SELECT path, 'tick_' || k, 'work_' || k, 'Async', 18, 'WorkQueue' FROM {P_SQL} UNION ALL SELECT path, 'work_' || k, 'tick_' || k, 'Async', 14, 'Timer' FROM {P_SQL})"""


@query("c_call_edges", f"SELECT path, src, dst, call_type, CAST(line AS INTEGER) AS line, mechanism FROM {EDGES_SQL}")
def _(s, d):
    return session(s, d).edges


@query("c_unified_edges", f"SELECT path, src, dst, CASE WHEN call_type = 'Direct' THEN 'Direct' WHEN mechanism = 'WorkQueue' THEN 'KernelWorkQueue' ELSE 'Generic' END AS call_kind, CASE WHEN call_type = 'Direct' THEN 'sync' ELSE 'async' END AS call_group, true AS is_direct FROM {EDGES_SQL}")
def _(s, d):
    return session(s, d).unified_edges().select("path", "src", "dst", "call_kind", "call_group", "is_direct")


CALLBACKS_SQL = f"""(SELECT path, handler AS name, 'async_' || full_name AS context FROM {BINDINGS_SQL} UNION ALL SELECT path, function, 'drv_' || k || '.' || field FROM {OPS_SQL} WHERE n > 0)"""
MARKED_SQL = f"(SELECT f.*, c.context, c.context IS NOT NULL AS is_callback FROM {FUNCTIONS_SQL} f LEFT JOIN {CALLBACKS_SQL} c ON f.path = c.path AND f.name = c.name)"


@query("c_callbacks", f"SELECT path, name, context AS callback_context FROM {MARKED_SQL} WHERE is_callback")
def _(s, d):
    return R.callbacks(session(s, d).functions).select("path", "name", "callback_context")


ENTRIES_SQL = f"""(SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY coalesce(rank, 10), line) AS INTEGER) AS ord, name FROM
 (SELECT path, name, line, is_callback, CASE WHEN {IS['entry']} AND name = 'init_' || k THEN 0 WHEN {IS['entry']} AND name = 'exit_' || k THEN 1 END AS rank FROM {MARKED_SQL}) WHERE is_callback OR rank IS NOT NULL)"""


@query("c_entry_points", f"SELECT path, ord, name FROM {ENTRIES_SQL}")
def _(s, d):
    return session(s, d).entry_points


@query("c_summary", f"""SELECT path, CAST(8 AS BIGINT) AS functions, CAST(1 AS BIGINT) AS structs, CAST(2 + CAST({IS['irq']} AS INTEGER) AS BIGINT) AS async_bindings, e.entries FROM {P_SQL} JOIN (SELECT path, string_agg(name, ',' ORDER BY ord) AS entries FROM {ENTRIES_SQL} GROUP BY path) e USING (path)""")
def _(s, d):
    return session(s, d).summary().withColumn("entries", F.array_join("entries", ","))


@query("c_function_details", f"""WITH b AS (SELECT path, dst AS name, array_to_string(list_sort(list(DISTINCT src)), ',') AS called_by FROM {EDGES_SQL} GROUP BY path, dst)
 SELECT f.path, f.name, ret AS return_type, CAST(line AS INTEGER) AS line, CAST(end_line AS INTEGER) AS end_line, is_callback, context AS callback_context, calls, coalesce(called_by, '') AS called_by FROM {MARKED_SQL} f LEFT JOIN b ON f.path = b.path AND f.name = b.name""")
def _(s, d):
    return session(s, d).details().drop("params").withColumns({"calls": F.array_join("calls", ","), "called_by": F.array_join("called_by", ",")})


@query("c_function_rows", f"SELECT path, name, ret AS return_type, CAST(line AS INTEGER) AS line, is_callback, context AS callback_context, calls FROM {MARKED_SQL}")
def _(s, d):
    return views.function_rows(session(s, d).functions).withColumn("calls", F.array_join("calls", ","))


@query("c_function_locations", f"SELECT path, name, CAST(line AS INTEGER) AS line, 0 AS \"column\", is_callback FROM {MARKED_SQL}")
def _(s, d):
    return views.function_locations(session(s, d).functions)


@query("c_caller_rows", f"SELECT name, path, CAST(line AS INTEGER) AS line, CASE WHEN is_callback THEN 'async' ELSE 'direct' END AS call_type, context AS mechanism FROM {MARKED_SQL} WHERE list_contains(string_split(calls, ','), 'helper_3') OR list_contains(string_split(calls, ','), 'kfree')")
def _(s, d):
    f = session(s, d).functions
    return views.caller_rows(f, "helper_3").union(views.caller_rows(f, "kfree"))


@query("c_lookup", f"SELECT path, name, CAST(line AS INTEGER) AS line FROM {FUNCTIONS_SQL} WHERE name = 'dim_7' OR path = 'f11.c'")
def _(s, d):
    f = session(s, d).defined
    return R.lookup(f, "dim_7").union(R.in_file(f, "f11.c")).select("path", "name", "line")


# -- trees ------------------------------------------------------------------------------------------------------------
TREES_SQL = f"""WITH RECURSIVE e AS (SELECT DISTINCT path, src, dst FROM {EDGES_SQL}), f AS (SELECT path, name FROM {FUNCTIONS_SQL}), t AS (
 SELECT path, name AS root, name AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, [name] AS trail, 'Function' AS node_type FROM {ENTRIES_SQL}
 UNION ALL SELECT t.path, t.root, e.dst, t.node, t.depth + 1, list_append(t.trail, e.dst), CASE WHEN list_contains(t.trail, e.dst) THEN 'Ref' WHEN f.name IS NULL THEN 'KernelApi' ELSE 'Function' END
 FROM t JOIN e ON t.path = e.path AND t.node = e.src LEFT JOIN f ON f.path = e.path AND f.name = e.dst WHERE t.node_type = 'Function' AND t.depth < 20)"""
_CHAIN_ROWS = values(*[(c, i, f) for c, trigger, _, nodes in fixed.CHAINS for i, f in enumerate([trigger, *(n for n, _ in nodes)])])
CHAINED_SQL = TREES_SQL + f""", ch AS (SELECT chain_id, ord, function FROM {_CHAIN_ROWS} c(chain_id, ord, function)), n AS (SELECT chain_id, max(ord) + 1 AS n, arg_max(function, ord) AS last FROM ch GROUP BY chain_id),
 en AS (SELECT path, function AS root, 'usb_driver.' || field AS chain_id FROM {OPS_SQL} WHERE n > 0 UNION ALL SELECT path, handler, CASE mechanism WHEN 'WorkQueue' THEN 'work_struct' ELSE 'timer_list' END FROM {BINDINGS_SQL} WHERE mechanism <> 'Interrupt'),
 ro AS (SELECT path, root, chain_id, n, last FROM en JOIN n USING (chain_id))
 """


@query("c_flow_trees", TREES_SQL + " SELECT path, root, node, parent, CAST(depth AS INTEGER) AS depth, array_to_string(trail, '/') AS trail, node_type FROM t")
def _(s, d):
    return session(s, d).user_trees.select("path", "root", "node", "parent", "depth", F.replace("ord", F.lit("\u0001"), F.lit("/")).alias("trail"), "node_type")


@query("c_tree_sizes", TREES_SQL + " SELECT path, root, node_type, CAST(count(*) AS BIGINT) AS places, CAST(max(depth) AS INTEGER) AS deepest FROM t GROUP BY path, root, node_type")
def _(s, d):
    return G.tree_sizes(session(s, d).shared_trees, ("path",)).withColumn("places", F.col("places").cast("long"))


@query("c_tree_paths", TREES_SQL + " SELECT path, root, node, CAST(count(*) AS BIGINT) AS paths, min(array_to_string(trail, chr(1))) AS first FROM t GROUP BY path, root, node")
def _(s, d):
    return G.shared_paths(session(s, d).shared_trees, ("path",)).withColumns({"paths": F.col("paths").cast("long"), "first": G.order_key(F.col("first"))})


@query("c_chained_trees", CHAINED_SQL + """SELECT t.path, t.root, t.node, CASE WHEN t.depth = 0 THEN ro.last ELSE t.parent END AS parent, CAST(t.depth + coalesce(ro.n, 0) AS INTEGER) AS depth, t.node_type, false AS kernel_internal FROM t LEFT JOIN ro ON t.path = ro.path AND t.root = ro.root
 UNION ALL SELECT ro.path, ro.root, a.function, b.function, CAST(a.ord AS INTEGER), CASE WHEN a.ord = 0 THEN 'External' ELSE 'KernelApi' END, true FROM ro JOIN ch a ON a.chain_id = ro.chain_id LEFT JOIN ch b ON b.chain_id = a.chain_id AND b.ord = a.ord - 1""")
def _(s, d):
    return session(s, d).trees.select("path", "root", "node", "parent", "depth", "node_type", "kernel_internal")


_LANES = values(*[(c, i, f, "user" if i == len(nodes) else "hardware" if ctx == "HardIrq" else "kernel") for c, _, ctx, nodes in fixed.CHAINS for i, (f, _) in enumerate(nodes, 1)])


@query("swim_lanes", CHAINED_SQL + f"SELECT path, root, CAST(v.ord AS INTEGER) AS ord, v.function, lane FROM en JOIN {_LANES} v(chain_id, ord, function, lane) USING (chain_id)")
def _(s, d):
    return session(s, d).swim_lanes()


@query("async_timeline", f"SELECT path, handler, CAST(phase AS INTEGER) AS phase, name, first_function, t.context FROM {BINDINGS_SQL} b, {values((1, 'interrupt', 'do_IRQ', 'HardIrq'), (2, 'work queue', 'kworker/xxx', 'Process'))} t(phase, name, first_function, context) WHERE mechanism = 'WorkQueue'")
def _(s, d):
    return session(s, d).timeline()


@query("knowledge_samples", f"""WITH k AS (SELECT * FROM {values(*[(f"{fw}.{cb}", description, signature) for fw, cb, description, signature, *_ in fixed.CALLBACKS])} k(framework, description, signature)), f AS (SELECT path, function AS input, 'usb_driver.' || field AS framework FROM {OPS_SQL} WHERE n > 0)
 SELECT path, 'callback_timing' AS task, input, description AS output FROM f JOIN k USING (framework) UNION ALL SELECT path, 'function_pointer_target', input, signature FROM f JOIN k USING (framework)""")
def _(s, d):
    return samples.of_functions(session(s, d).functions, knowledge(s)).select("path", "task", "input", "output")


@query("project_phases", f"""SELECT 'symbols' AS phase, 9 * count(*) + count(*) FILTER ({IS['broken']}) AS n FROM {P_SQL} UNION ALL SELECT 'types', 2 * count(*) FROM {P_SQL} UNION ALL SELECT 'signatures', count(*) FROM {FUNCTIONS_SQL} UNION ALL SELECT 'calls', count(*) FROM {EDGES_SQL}
 UNION ALL SELECT 'async', count(*) FROM {BINDINGS_SQL} UNION ALL SELECT 'natives', 0""")
def _(s, d):
    return session(s, d).phases()


def _streamed(s: SparkSession, d: str) -> tuple[DefinitionIndex, StreamingQuery]:
    """An index that a stream of all files has filled, some files at a time."""
    folder = new_path(s, "incoming")
    store(c_files(s, d).select("path", "content").repartition(4), folder)
    index = DefinitionIndex.temporary(s, 8)
    files = s.readStream.schema("path string, content string").option("maxFilesPerTrigger", 2).parquet(folder)
    done = intake.define_stream(files, index, new_path(s, "state"))
    done.awaitTermination()
    return index, done


@query("stream_index", f"SELECT path, name, CAST(line AS INTEGER) AS line, CAST(end_line AS INTEGER) AS end_line FROM {FUNCTIONS_SQL}")
def _(s, d):
    return _streamed(s, d)[0].symbols().where("kind = 'function'").select("path", "name", "line", "end_line")


@query("stream_progress", f"SELECT 'Parsing' AS phase, count(*) AS done, count(*) AS total, 'Parsing ' || count(*) || '/' || count(*) || ' (100%)' AS text FROM {P_SQL}")
def _(s, d):
    """The last line of progress of a stream that comes in several batches."""
    rows = intake.stream_progress(s, _streamed(s, d)[1], "Parsing", c_files(s, d).count())
    return rows.orderBy(F.desc("batch")).limit(1).drop("batch")


# -- pointers, types, facts -------------------------------------------------------------------------------------------
CONSTRAINTS = [
    ("AddressOf", "d{k}", "alloc:31", None, "true"), ("FieldStore", "d{k}->work", "work_{k}", "func", "true"), ("FieldStore", "d{k}->tick", "tick_{k}", "function", "true"),
    ("FieldStore", "d{k}", "dim_{k}", "handler", IS["assign"]), ("AddressOf", "irq_d{k}->irq", "irq_{k}", None, IS["irq"]), ("FieldStore", "drv_{k}", "probe_{k}", "probe", "true"),
    ("FieldStore", "drv_{k}", "gone_{k}", "disconnect", IS["gone"]), ("FieldStore", "driver", "THIS_MODULE", "owner", "true"),
]
CONSTRAINTS_SQL = "(" + " UNION ALL ".join(f"SELECT path, k, z, '{kind}' AS kind, {sql_fill(repr(dest))} AS dest, {sql_fill(repr(src))} AS src, {repr(field) if field else 'NULL'} AS field FROM {P_SQL} WHERE {test}" for kind, dest, src, field, test in CONSTRAINTS) + ")"


@query("c_constraints", f"SELECT path, kind, dest, src, field FROM {CONSTRAINTS_SQL}")
def _(s, d):
    return session(s, d).constraints()


@query("c_points_to", f"""SELECT path, name AS loc, name AS targets FROM {FUNCTIONS_SQL} UNION ALL SELECT path, 'irq_d' || k || '->irq', 'irq_' || k FROM {P_SQL} WHERE {IS['irq']} UNION ALL SELECT path, 'alloc:31.handler', 'dim_' || k FROM {P_SQL} WHERE {IS['assign']}""")
def _(s, d):
    return session(s, d).points_to().select("path", "loc", F.array_join("targets", ",").alias("targets"))


#: Arguments of calls: (caller, callee, position, argument, line, condition).
ARGUMENTS = [
    ("work_{k}", "printk", 0, '""', 13, "true"), ("work_{k}", "mod_timer", 0, "d{k}->tick", 14, "true"), ("work_{k}", "mod_timer", 1, "jiffies", 14, "true"), ("tick_{k}", "schedule_work", 0, "d{k}->work", 18, "true"),
    ("dim_{k}", "helper_{h}", 0, "d", 22, "true"), ("dim_{k}", "helper_{h}", 1, "to", 22, "true"), ("irq_{k}", "wake_up_process", 0, "task", 26, "true"), ("probe_{k}", "kzalloc", 0, "sizeof(*d{k})", 31, "true"),
    ("probe_{k}", "kzalloc", 1, "GFP_KERNEL", 31, "true"), ("probe_{k}", "INIT_WORK", 0, "d{k}->work", 32, "true"), ("probe_{k}", "INIT_WORK", 1, "work_{k}", 32, "true"), ("probe_{k}", "timer_setup", 0, "d{k}->tick", 33, "true"),
    ("probe_{k}", "timer_setup", 1, "tick_{k}", 33, "true"), ("probe_{k}", "timer_setup", 2, "0", 33, "true"), ("probe_{k}", "request_irq", 0, "d{k}->irq", 36, IS["irq"]), ("probe_{k}", "request_irq", 1, "irq_{k}", 36, IS["irq"]),
    ("probe_{k}", "request_irq", 2, "0", 36, IS["irq"]), ("probe_{k}", "request_irq", 3, '""', 36, IS["irq"]), ("probe_{k}", "request_irq", 4, "d{k}", 36, IS["irq"]), ("probe_{k}", "dim_{k}", 0, "d{k}", 37, "true"),
    ("probe_{k}", "dim_{k}", 1, "{z}", 37, "true"), ("gone_{k}", "kfree", 0, "intf", 41, "true"), ("init_{k}", "usb_register", 0, "drv_{k}", 51, "true"), ("exit_{k}", "usb_deregister", 0, "drv_{k}", 55, "true"),
]


@query("c_call_arguments", " UNION ALL ".join(f"SELECT path, {sql_fill(repr(a))} AS caller, {sql_fill(repr(b))} AS callee, CAST({n} AS INTEGER) AS position, {sql_fill(repr(x))} AS argument, CAST({line} AS INTEGER) AS line FROM {P_SQL} WHERE {test}" for a, b, n, x, line, test in ARGUMENTS))
def _(s, d):
    return c_front.call_arguments(c_files(s, d))


@query("c_parameter_flow", f"SELECT path, kind, dest, src, field FROM {CONSTRAINTS_SQL} UNION ALL SELECT path, 'Copy', 'd', 'd' || k, NULL FROM {P_SQL} UNION ALL SELECT path, 'Copy', 'to', CAST(z AS VARCHAR), NULL FROM {P_SQL}")
def _(s, d):
    return session(s, d).flow_of_arguments()


@query("c_argument_targets", f"SELECT path, unnest(['d', 'd' || k]) AS loc, 'alloc:31' AS target FROM {P_SQL} UNION ALL SELECT path, 'irq_d' || k || '->irq', 'irq_' || k FROM {P_SQL} WHERE {IS['irq']}")
def _(s, d):
    return PT.solve(session(s, d).flow_of_arguments(), by=("path",))


@query("c_target_confidence", f"""SELECT path, name AS loc, name AS target, 'High' AS confidence FROM {FUNCTIONS_SQL} UNION ALL SELECT path, 'irq_d' || k || '->irq', 'irq_' || k, 'High' FROM {P_SQL} WHERE {IS['irq']}
 UNION ALL SELECT path, 'alloc:31.handler', 'dim_' || k, 'Medium' FROM {P_SQL} WHERE {IS['assign']}""")
def _(s, d):
    return session(s, d).targets_with_confidence()


FACTS = [("binding", 34, "d{k}->handler", "dim_{k}", IS["assign"]), ("invocation", 35, "d{k}->handler", None, "true"), ("queue", 18, "schedule_work", "d{k}->work", "true")]


@query("c_callback_facts", " UNION ALL ".join(f"SELECT path, '{fact}' AS fact, CAST({line} AS INTEGER) AS line, {sql_fill(repr(t))} AS target, {sql_fill(repr(n)) if n else 'NULL'} AS name FROM {P_SQL} WHERE {test}" for fact, line, t, n, test in FACTS))
def _(s, d):
    return c_front.callback_facts(c_files(s, d))


@query("c_resolved_callbacks", f"SELECT 'd' || k || '->handler' AS expr, 'dim_' || k AS handlers FROM {P_SQL} WHERE {IS['assign']}")
def _(s, d):
    return session(s, d).resolved_callbacks().select("expr", F.array_join("handlers", ",").alias("handlers"))


TYPES_SQL = f"""(SELECT path, 'Typedef' AS kind, 'cb_' || k AS name, 'int' AS return_type, 'struct dev_' || k || ' *,int' AS params, 10 AS line FROM {P_SQL}
 UNION ALL SELECT path, 'StructField', 'dev_' || k || '.handler', 'int', 'struct dev_' || k || ' *,int', 3 FROM {P_SQL}
 UNION ALL SELECT path, 'Function', name, ret, CASE WHEN params = '' THEN '' ELSE array_to_string(list_transform(string_split(params, ','), lambda p: split_part(p, ':', 2)), ',') END, line FROM {FUNCTIONS_SQL})"""


@query("c_pointer_types", f"SELECT path, kind, name, return_type, params, CAST(line AS INTEGER) AS line FROM {TYPES_SQL}")
def _(s, d):
    return c_front.pointer_types(c_files(s, d)).withColumn("params", F.array_join("params", ","))


@query("c_compatible", f"SELECT name || k AS type_name, 'dim_' || k AS functions FROM (SELECT 'cb_' AS name, k FROM {P_SQL}) UNION ALL SELECT 'dev_' || k || '.handler', 'dim_' || k FROM {P_SQL}")
def _(s, d):
    return session(s, d).compatible().select("type_name", F.array_join("functions", ",").alias("functions"))


@query("c_best_candidates", f"""WITH t AS (SELECT DISTINCT return_type AS tr, string_split(params, ',') AS tp FROM {TYPES_SQL} WHERE kind = 'Function' AND params <> '' AND NOT contains(params, 'struct dev')), g AS (SELECT tr || '(' || array_to_string(tp, ',') || ')' AS type_name, tr, tp FROM t),
 f AS (SELECT name, return_type AS fr, string_split(params, ',') AS fp FROM {TYPES_SQL} WHERE kind = 'Function' AND params <> '' AND NOT contains(params, 'struct dev')),
 p AS (SELECT type_name, name AS function, CASE WHEN tr = fr THEN 40 ELSE 0 END + CASE WHEN len(tp) = len(fp) THEN 30 + len(list_filter(range(1, len(tp) + 1), lambda i: tp[i] = fp[i] OR (contains(tp[i], 'struct') AND fp[i] = 'void *') OR (contains(fp[i], 'struct') AND tp[i] = 'void *'))) * (30 // len(tp)) ELSE 0 END AS score FROM g, f),
 r AS (SELECT *, row_number() OVER (PARTITION BY type_name ORDER BY score DESC, function) AS rank FROM p WHERE score > 0) SELECT type_name, CAST(rank AS INTEGER) AS rank, function, CAST(score AS INTEGER) AS score FROM r WHERE rank <= 5""")
def _(s, d):
    f = c_front.pointer_types(c_files(s, d)).where("kind = 'Function' and size(params) > 0 and not exists(params, p -> p like '%struct dev%')").select("name", "return_type", "params")
    f = checkpoint(f)  # files are read once
    t = f.select(F.concat("return_type", F.lit("("), F.array_join("params", ","), F.lit(")")).alias("name"), "return_type", "params").distinct()
    return R.best_candidates(t, f, 5)


@query("c_registrations", f"SELECT 'reg' || k || '.c' AS path, CASE WHEN z % 2 = 0 THEN 'add_hook_' ELSE 'register_' END || k AS name FROM {P_SQL}")
def _(s, d):
    x = c_files(s, d).select(F.concat(F.lit("reg"), F.col("k").cast("string"), F.lit(".c")).alias("path"), filled("int {n}{k}({p})\n{\n\treturn 0;\n}\nint plain_{k}(int a)\n{\n\treturn a;\n}\n", {
        "n": F.when(F.col("z") % 2 == 0, "add_hook_").otherwise("register_"), "p": F.when(F.col("z") % 2 == 0, "int (*fn)(int a), void *data").otherwise("int a"), "k": F.col("k")}).alias("content"))
    return D.registrations(AnalysisSession(s, x).defined).select("path", "name")


@query("c_ops_calls", f"SELECT 'o' || k || '.c' AS path, 4 AS line, 'o' || CASE WHEN z % 2 = 0 THEN '->' ELSE '->x->' END || 'probe' AS target, CASE WHEN z % 2 = 0 THEN 'probe_' || k ELSE 'other_' || k || ',probe_' || k END AS handlers, CASE WHEN z % 2 = 0 THEN 'Certain' ELSE 'Possible' END AS confidence FROM {P_SQL}")
def _(s, d):
    text = "static struct usb_driver a = { .probe = probe_{k}, };\nstatic struct pci_driver b = { .probe = other_{k}, };\nint run_{k}(struct usb_driver *o) {\n\to{m}probe(1);\n}\n"
    x = c_files(s, d).select(F.concat(F.lit("o"), F.col("k").cast("string"), F.lit(".c")).alias("path"), filled(text, {"m": F.when(F.col("z") % 2 == 0, "->").otherwise("->x->"), "k": F.col("k")}).alias("content"))
    # Each file is a program of its own here.
    return P.resolve_ops_calls(c_front.member_calls(x), P.ops_initializers(x), ("path",)).withColumn("handlers", F.array_join("handlers", ","))


# -- index, learning --------------------------------------------------------------------------------------------------
@query("index_refresh", f"""SELECT path, name, CAST(line AS INTEGER) AS line FROM {FUNCTIONS_SQL} WHERE z % 4 <> 1 AND z % 4 <> 2 UNION ALL SELECT path, 'only_' || k, 1 FROM {P_SQL} WHERE z % 4 = 1""")
def _(s, d):
    """All files are indexed; then some are removed, some have a new text, all have a new time."""
    index = SymbolIndex.temporary(s, 8)
    first = c_files(s, d).select("path", F.lit("2024-01-01").cast("timestamp").alias("mtime"), F.length("content").cast("long").alias("size"), "content", "k", "z")
    index.refresh(first.drop("k", "z"))
    index.remove_files(first.where("z % 4 = 2").select("path"))
    new = filled("int only_{k}(void)\n{\n\treturn 0;\n}\n", {"k": F.col("k")})
    again = first.where("z % 4 <> 2").withColumns({"mtime": F.lit("2024-01-02").cast("timestamp"), "content": F.when(F.col("z") % 4 == 1, new).otherwise(F.col("content"))})
    index.refresh(again.drop("k", "z"))
    return index.read("functions").select("path", "name", "line")


@query("index_changed", f"SELECT path FROM {P_SQL} WHERE z % 4 = 1")
def _(s, d):
    """Only files whose text is new are read again."""
    index = SymbolIndex.temporary(s, 8)
    first = c_files(s, d).select("path", F.lit("2024-01-01").cast("timestamp").alias("mtime"), F.length("content").cast("long").alias("size"), "content", "z")
    index.refresh(first.drop("z"))
    return index.refresh(first.withColumns({"mtime": F.lit("2024-01-02").cast("timestamp"), "content": F.when(F.col("z") % 4 == 1, F.concat("content", F.lit("\n"))).otherwise(F.col("content"))}).drop("z"))


@query("index_upsert", f"SELECT path, name, CAST(CASE WHEN name = 'dim_' || k THEN 99 ELSE line END AS INTEGER) AS line FROM {FUNCTIONS_SQL} UNION ALL SELECT path, 'new_' || k, 99 FROM {P_SQL} WHERE z % 2 = 0")
def _(s, d):
    index = SymbolIndex.temporary(s, 8)
    f = session(s, d).defined.select("path", "name", "line", "end_line", "return_type", "calls")
    index.save("functions", f)
    moved = f.where("name like 'dim%'").withColumn("line", F.lit(99))
    new = c_files(s, d).where("z % 2 = 0").select("path", F.concat(F.lit("new_"), F.col("k").cast("string")).alias("name"), F.lit(99).alias("line"), F.lit(99).alias("end_line"), F.lit("int").alias("return_type"), F.array().cast("array<string>").alias("calls"))
    index.tables["functions"].upsert(moved.unionByName(new), ("path", "name"))
    return index.read("functions").select("path", "name", "line")


def _edited(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All files, and those of one size in four with one more line in one function."""
    files = c_files(s, d)
    edited = files.where("z % 4 = 1").withColumn("content", F.replace(F.col("content"), F.lit("\twake_up_process(task);\n"), F.lit("\tnote(irq);\n\twake_up_process(task);\n")))
    return files, edited


@query("index_edited_chunks", f"SELECT 'static int irq_' || k || '(int irq, void *data)' AS head, CAST(6 AS BIGINT) AS lines FROM {P_SQL} WHERE z % 4 = 1")
def _(s, d):
    """What is read again after an edit of one function of a file: that function."""
    index = DefinitionIndex.temporary(s, 8)
    files, edited = _edited(s, d)
    index.refresh(files)
    read = index.refresh(edited).withColumn("lines", F.split(F.rtrim(F.regexp_replace("content", r"\n\z", "")), "\n"))
    return read.select(F.get("lines", F.lit(0)).alias("head"), F.size("lines").cast("long").alias("lines"))


@query("index_edited_symbols", f"""SELECT path, 'function' AS kind, name, CAST(line + CASE WHEN z % 4 = 1 AND line > 24 THEN 1 ELSE 0 END AS INTEGER) AS line, CAST(end_line + CASE WHEN z % 4 = 1 AND line >= 24 THEN 1 ELSE 0 END AS INTEGER) AS end_line,
 CASE WHEN z % 4 = 1 AND line = 24 THEN 'note,' || calls ELSE calls END AS calls FROM {FUNCTIONS_SQL} UNION ALL SELECT path, 'struct', 'dev_' || k, 3, 9, '' FROM {P_SQL}
 UNION ALL SELECT path, 'error', 'unbalanced brace at line ' || (59 + CAST(z % 4 = 1 AS INTEGER)), NULL, NULL, '' FROM {P_SQL} WHERE {IS['broken']}""")
def _(s, d):
    """Symbols after the edit: lines behind it are shifted, chunks without a file are forgotten."""
    index = DefinitionIndex.temporary(s, 8)
    files, edited = _edited(s, d)
    index.refresh(files)
    index.refresh(edited)
    index.vacuum()
    return index.symbols().select("path", "kind", F.coalesce("name", "error").alias("name"), "line", "end_line", F.coalesce(F.array_join("calls", ","), F.lit("")).alias("calls"))


@query("learning_store", f"""SELECT 'pending' AS what, path || ':35:d' || k || '->handler' AS id, 'No assignment' AS value FROM {P_SQL} WHERE z % 7 > 0 AND z % 3 > 0
 UNION ALL SELECT 'annotation', path || ':35:d' || k || '->handler', 'dim_' || k FROM {P_SQL} WHERE z % 7 > 0 AND z % 3 = 0 UNION ALL SELECT 'stats', CAST(count(*) FILTER (z % 7 > 0) AS VARCHAR), CAST(count(*) FILTER (z % 7 > 0 AND z % 3 = 0) AS VARCHAR) FROM {P_SQL}""")
def _(s, d):
    """Calls through a member that nothing is assigned to are asked about; some are answered; the store is saved and loaded."""
    x = session(s, d)
    calls = x.facts.where("fact = 'invocation'").select(F.concat_ws(":", "path", F.col("line").cast("string")).alias("location"), F.col("target").alias("call_expr"), "path")
    bound = P.assignments(x.files, x.facts.where("fact = 'function'")).select("path").distinct()
    asked = checkpoint(L.question(calls.join(bound, "path", "left_anti").select("location", "call_expr", F.lit(None).alias("expected_signature"), F.lit("No assignment").alias("reason"))))
    answers = c_files(s, d).where("z % 3 = 0").select(T.query_id(F.concat(F.col("path"), F.lit(":35")), F.concat(F.lit("d"), F.col("k").cast("string"), F.lit("->handler"))).alias("id"), F.array(F.concat(F.lit("dim_"), F.col("k").cast("string"))).alias("targets"), F.lit(None).cast("string").alias("note"))
    store = L.LearningStore.empty(s).add_queries(asked).add_queries(asked)  # asked twice, kept once
    folder = new_path(s, "learning")
    store.answer(answers.join(store.pending.select("id"), "id", "left_semi")).save(folder)
    back = L.LearningStore.load(s, folder)
    n = back.stats().select(F.lit("stats").alias("what"), F.col("total").cast("string").alias("id"), F.col("answered").cast("string").alias("value"))
    return back.pending.select(F.lit("pending").alias("what"), "id", F.col("reason").alias("value")).union(back.annotations.select(F.lit("annotation"), "id", F.array_join("targets", ","))).union(n)


@query("learning_merge", f"SELECT 'f' || k AS id, CASE WHEN z % 2 = 0 THEN 'a' ELSE 'b' END AS targets FROM {P_SQL} WHERE z % 2 = 0 OR z % 3 = 0")
def _(s, d):
    x = c_files(s, d).select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("id"), "z")
    rows = lambda test, t: x.where(test).select("id", F.col("id").alias("call_site"), F.array(F.lit(t)).alias("targets"), F.lit(None).cast("string").alias("note"))
    a, b = L.LearningStore.empty(s).annotate(rows("z % 2 = 0", "a")), L.LearningStore.empty(s).annotate(rows("z % 3 = 0", "b"))
    return a.merge(b).annotations.select("id", F.array_join("targets", ",").alias("targets"))


@query("learning_apply", f"SELECT 'f' || k AS call_site, CASE WHEN z % 2 = 0 THEN 't' || z END AS user_targets, CASE WHEN z % 2 = 0 THEN CASE WHEN z % 4 = 0 THEN 'seen' ELSE 'User annotation' END END AS user_reason, CASE WHEN z % 2 = 0 THEN 'Certain' END AS user_confidence FROM {P_SQL}")
def _(s, d):
    x = c_files(s, d).select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("call_site"), "z")
    notes = x.where("z % 2 = 0").select(F.col("call_site").alias("id"), "call_site", F.array(F.concat(F.lit("t"), F.col("z").cast("string"))).alias("targets"), F.when(F.col("z") % 4 == 0, "seen").alias("note"))
    return L.LearningStore.empty(s).annotate(notes).apply(x.drop("z")).withColumn("user_targets", F.array_join("user_targets", ","))


@query("learning_pack", f"""SELECT text FROM (SELECT 'user:' || chr(10) || '  annotations:' AS text UNION ALL SELECT '    - call_site: "f' || k || '"' || chr(10) || '      targets: ["t' || z || '"]' || CASE WHEN z % 4 = 0 THEN chr(10) || '      note: "say \\"x\\""' ELSE '' END FROM {P_SQL})""")
def _(s, d):
    x = c_files(s, d).select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("call_site"), "z")
    notes = x.select(F.col("call_site").alias("id"), "call_site", F.array(F.concat(F.lit("t"), F.col("z").cast("string"))).alias("targets"), F.when(F.col("z") % 4 == 0, 'say "x"').alias("note"))
    return L.LearningStore.empty(s).annotate(notes).as_pack("user")
