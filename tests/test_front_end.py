"""The C front end and the session over a driver of our own."""

import pytest
from pyspark.sql import functions as F

from runpath.operators import patterns as P
from runpath.plans.session import AnalysisSession, run_scenario
from runpath.sources import c_front
from runpath.sources.files import Scenario, ScenarioError, listing

DRIVER = r'''
#include <linux/module.h>
/* a sample { with braces } in a comment */
struct lamp {
	struct work_struct work;
	struct timer_list tick;
	char *name;
	int level[4];
	int (*dim)(struct lamp *l, int to);
};

typedef void (*lamp_cb)(struct lamp *l);

static void lamp_work(struct work_struct *w)
{
	struct lamp *l = container_of(w, struct lamp, work);
	printk("work }\n");
	mod_timer(&l->tick, jiffies);
}

static void lamp_tick(struct timer_list *t)
{
	struct lamp *l = from_timer(l, t, tick);
	schedule_work(&l->work);
}

static int lamp_dim(struct lamp *l, int to)
{
	l->level[0] = to;
	return to;
}

static int lamp_probe(struct usb_interface *intf, const struct usb_device_id *id)
{
	struct lamp *l = kzalloc(sizeof(*l), GFP_KERNEL);
	if (!l)
		return -1;
	INIT_WORK(&l->work, lamp_work);
	timer_setup(&l->tick, lamp_tick, 0);
	l->dim = lamp_dim;
	l->dim(l, 3);
	mod_timer(&l->tick, jiffies + HZ);
	return 0;
}

static void lamp_gone(struct usb_interface *intf)
{
	kfree(intf);
}

static struct usb_driver lamp_driver = {
	.name = "lamp",
	.driver = { .owner = THIS_MODULE, },
	.probe = lamp_probe,
	.disconnect = lamp_gone,
};

static int __init lamp_init(void)
{
	return usb_register(&lamp_driver);
}

static void __exit lamp_exit(void)
{
	usb_deregister(&lamp_driver);
}
module_init(lamp_init);
module_exit(lamp_exit);
'''


@pytest.fixture(scope="module")
def session(spark):
    return AnalysisSession(spark, spark.createDataFrame([("lamp.c", DRIVER), ("bad.c", "int f(void) {"), ("empty.c", "")], "path string, content string"))


def test_functions(session):
    rows = {r.name: r for r in session.functions.collect()}
    assert set(rows) == {"lamp_work", "lamp_tick", "lamp_dim", "lamp_probe", "lamp_gone", "lamp_init", "lamp_exit"}
    assert rows["lamp_work"].calls == ["container_of", "mod_timer", "printk"]
    assert rows["lamp_dim"].return_type == "int" and [p.name for p in rows["lamp_dim"].params] == ["l", "to"]
    assert rows["lamp_probe"].callback_context == "lamp_driver.probe" and rows["lamp_work"].callback_context == "async_WorkQueue { delayed: false }"
    assert rows["lamp_init"].attributes == ["static", "__init"] and not rows["lamp_init"].is_callback
    assert rows["lamp_work"].end_line - rows["lamp_work"].line == 5


def test_structs_and_errors(session):
    s = session.structs.collect()
    assert [x.name for x in s] == ["lamp"] and s[0].referenced_structs == ["timer_list", "work_struct"]
    assert {f.name: (f.is_pointer, f.is_function_ptr) for f in s[0].fields} == {"work": (False, False), "tick": (False, False), "name": (True, False), "level": (False, False), "dim": (True, True)}
    assert [e.path for e in session.errors.collect()] == ["bad.c"]


def test_bindings_edges_entries(session):
    line = {t.strip(): i for i, t in enumerate(DRIVER.split("\n"), 1)}
    got = {(b.mechanism, b.variable, b.handler, tuple(b.trigger_lines)) for b in session.bindings.collect()}
    assert got == {
        ("WorkQueue", "l->work", "lamp_work", (line["schedule_work(&l->work);"],)),
        ("Timer", "l->tick", "lamp_tick", (line["mod_timer(&l->tick, jiffies);"], line["mod_timer(&l->tick, jiffies + HZ);"])),
    }
    asy = {(e.src, e.dst) for e in session.edges.where("call_type = 'Async'").collect()}
    assert asy == {("lamp_tick", "lamp_work"), ("lamp_work", "lamp_tick"), ("lamp_probe", "lamp_tick")}
    assert [r.name for r in session.entry_points.where("path = 'lamp.c'").orderBy("ord").collect()] == ["lamp_init", "lamp_exit", "lamp_work", "lamp_tick", "lamp_probe", "lamp_gone"]


def test_strict_mode(spark):
    s = AnalysisSession(spark, spark.createDataFrame([("lamp.c", DRIVER)], "path string, content string"), strict_ref=True)
    assert s.edges.where("call_type = 'Async'").count() == 0 and s.ops.count() == 0


def test_flow_trees(session):
    tree = session.flow_trees("lamp.c").collect()
    probe = {(r.node, r.depth) for r in tree if r.root == "lamp_probe"}
    assert ("usb_hub_port_connect", 1) in probe and ("drv->probe()", 9) in probe and ("lamp_probe", 10) in probe and ("USB device plugged in", 0) in probe
    kinds = {(r.root, r.node): r.node_type for r in tree}
    assert kinds["lamp_init", "usb_register"] == "KernelApi" and kinds["lamp_work", "lamp_tick"] in ("Function", "Ref")
    assert any(r.node_type == "Ref" for r in tree)


def test_points_to_and_callbacks(session):
    pts = {r["loc"]: r["targets"] for r in session.points_to().collect()}
    assert pts["lamp_work"] == ["lamp_work"]
    assert {r.expr: r.handlers for r in session.resolved_callbacks().collect()} == {"l->dim": ["lamp_dim"]}
    types = {r.type_name: r.functions for r in session.compatible().collect()}
    assert types["lamp.dim"] == ["lamp_dim"]


def test_constraint_forms():
    src = "void g(void) { int x; p = &x; q = p; r = *q; *p = q; a = s->f; s->f = h; t[0] = h; u = t[1]; v = kmalloc(4, 0); fp = h; }\nhandler_t tab[] = { h, k };\nrequest_irq(dev->irq, h, 0);"
    got = set(c_front.constraints_of(src, {"h", "k"}))
    assert {("AddressOf", "p", "x", None), ("Copy", "q", "p", None), ("Load", "r", "q", None), ("Store", "p", "q", None), ("FieldLoad", "a", "s", "f"), ("FieldStore", "s", "h", "f"), ("ArrayStore", "t", "h", None), ("ArrayLoad", "u", "t", None), ("AddressOf", "fp", "h", None), ("ArrayStore", "tab", "k", None), ("AddressOf", "irq_dev->irq", "h", None)} <= got
    assert any(k == "AddressOf" and d == "v" and s.startswith("alloc:") for k, d, s, _ in got)


def test_callback_facts():
    src = "void f(void) { dev->cb = h; arr[2] = h; register_thing(dev, h); while (run) { q->fn(q); } queue_work(wq, &w); g_signal_connect(btn, ev, h); arr[i](1); }"
    facts = {(x["fact"], x.get("target"), x.get("name")) for x in c_front.facts_of(src, {"h"})}
    assert {("binding", "dev->cb", "h"), ("binding", "arr[*]", "h"), ("registration", "register_thing", "h"), ("event_loop", "q->fn", None), ("queue", "queue_work", "w"), ("signal", "btn", "h"), ("invocation", "arr[i]", None)} <= facts


def test_scenario(spark, tmp_path):
    tree = spark.createDataFrame([("check", "check", None, 0, ["check"], "Function", "a"), ("check", "if_ptr_null", "check", 1, ["check", "if_ptr_null"], "Function", "a/b"), ("check", "kfree", "if_ptr_null", 2, ["check", "if_ptr_null", "kfree"], "KernelApi", "a/b/c")], "root string, node string, parent string, depth int, trail array<string>, node_type string, ord string")
    s = Scenario("s", "check").bind("ptr", "valid", "pointer").bind("n", "300")
    rows = run_scenario(tree, s).orderBy("step").collect()
    assert [(r.step, r.function, r.reachable) for r in rows] == [(1, "check", True), (2, "if_ptr_null", False), (3, "kfree", False)]
    assert rows[1].description == "[unreachable] | n=0x12c | ptr=<valid ptr>"
    s.save(str(tmp_path / "s.json"))
    s.save(str(tmp_path / "s.yaml"))
    assert Scenario.load(str(tmp_path / "s.json")) == Scenario.load(str(tmp_path / "s.yaml")) == s
    with pytest.raises(ScenarioError):
        s.save(str(tmp_path / "s.txt"))


def test_text_files(spark):
    lines = P.lines_of(spark.createDataFrame([("c", 'CONFIG_A=y\nCONFIG_B=m\r\nCONFIG_C=n\n# CONFIG_D is not set\nCONFIG_E="x y"\nOTHER=1\n')], "path string, content string"))
    assert {r.name: r.value for r in P.dot_config(lines).collect()} == {"CONFIG_A": "1", "CONFIG_B": "1", "CONFIG_C": "0", "CONFIG_D": "0", "CONFIG_E": "x y"}
    marks = P.lines_of(spark.createDataFrame([("i", '# 1 "a.h"\n# 1 "<built-in>"\n# 2 "a.h" 3\n# 7 "b.h"\nx warning: y')], "path string, content string"))
    assert sorted(r.included for r in P.included_files(marks).collect()) == ["a.h", "b.h"] and P.warnings(marks).count() == 1
    assert P.kernel_version(spark.createDataFrame([("Makefile", "VERSION = 6\nPATCHLEVEL = 1\nSUBLEVEL = 0\n")], "path string, content string").select("path", "content")).first().version == "6.1.0"
    got = {r.path: (r.depth, r.is_dir) for r in listing(spark.createDataFrame([("a/b/c.c",), (".git/x",)], "path string")).collect()}
    assert got == {"a": (0, True), "a/b": (1, True), "a/b/c.c": (2, False)}
    hits = P.find_in_lines(P.lines_of(spark.createDataFrame([("f", "a.b A.B\nxa.b")], "path string, content string")), "a.b", whole_word=True)
    assert sorted((r.line, r.column, r.match) for r in hits.collect()) == [(1, 1, "a.b"), (1, 5, "A.B")]
    rep = spark.range(1).select(F.lit(1)).count()
    assert rep == 1


def _counted(monkeypatch):
    """The names of the readers that were started."""
    started, rows_of = [], c_front.rows_of

    def noted(files, schema, read, *more):
        started.append(getattr(read, "__name__", "read"))
        return rows_of(files, schema, read, *more)

    monkeypatch.setattr(c_front, "rows_of", noted)
    return started


def test_phases_read_once(spark, monkeypatch):
    """Files were read for their symbols, and again for their types."""
    files = spark.createDataFrame([("a.c", DRIVER), ("b.c", "int f(void) {\n"), ("c.c", None)], "path string, content string")
    order = lambda df: sorted(map(repr, df.collect()))
    symbols, types = c_front.symbols_and_types(files)
    assert order(symbols) == order(c_front.symbols(files)) and order(types) == order(c_front.pointer_types(files))
    started = _counted(monkeypatch)
    s = AnalysisSession(spark, files)
    found = {r.phase: r.n for r in s.phases().collect()}
    assert started == ["symbols_and_types_of"] and found["symbols"] == symbols.count() and found["types"] + found["signatures"] == types.select("name").distinct().count()


def test_facts_and_functions(spark, monkeypatch):
    """learning_store read files for their facts, and again for their functions."""
    files = spark.createDataFrame([("a.c", DRIVER), ("b.c", None)], "path string, content string")
    order = lambda df: sorted(map(repr, df.collect()))
    facts = AnalysisSession(spark, files).facts
    assert order(facts.where("fact <> 'function'")) == order(c_front.callback_facts(files))
    assert order(facts.where("fact = 'function'").select("path", "name", "line")) == order(c_front.symbols(files).where("kind = 'function'").select("path", "name", "line"))
    from runpath.plans import c_queries, registry

    started = _counted(monkeypatch)
    monkeypatch.setattr(c_queries, "c_files", lambda s, d: files.selectExpr("path", "content", "1 AS k", "3 AS z"))
    registry.QUERIES["learning_store"](spark, "")
    assert started == ["facts_and_functions_of"]
