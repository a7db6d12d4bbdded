"""Operators against hand-made rows and brute force."""

import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runpath.functions import text as T
from runpath.functions import values as V
from runpath.operators import graph as G
from runpath.operators import points_to as PT
from runpath.operators import relational as R
from runpath.operators.index import SymbolIndex
from runpath.plans import samples
from runpath.sources.files import knowledge, scan
from runpath.sources.preprocess import clang_args
from runpath.streaming import intake


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_expressions(spark):
    i = lambda n: V.value("Integer", i=F.lit(n))
    env = {"a": i(5), "b": i(3), "id->vendor": i(0x1234), "ptr": V.value("Pointer", is_null=True), "q": V.value("Pointer", is_null=False), "r": V.value("Pointer", is_null=False), "x": V.value("Range", lo=0, hi=100)}
    cases = {
        "1 + 2": ("Integer", 3), "0xFF & 0x0F": ("Integer", 15), "(a + b) * 2": ("Integer", 16), "id->vendor == 0x1234": ("Bool", True), "!ptr": ("Bool", True), "3 * 5 / 2": ("Integer", 6),
        "1 << 2 < 5": ("Integer", 2), "7 / 0": ("Integer", 0), "x < 50": ("Bool", False), "3 * -5": ("Unknown", None), "q == r": ("Bool", True), "ptr == 0": ("Bool", True), "vendor": ("Integer", 0x1234),
        "-7 / 2": ("Integer", -3), "nope || 1": ("Bool", True), "nope && 1": ("Unknown", None), '"s" == "s"': ("Unknown", None), "": ("Unknown", None), "0b101 ^ 1": ("Integer", 4), "~0": ("Integer", -1),
    }
    row = one(spark, *(V.evaluate(e, env).alias(f"c{k}") for k, e in enumerate(cases)))
    for k, (e, (tag, want)) in enumerate(cases.items()):
        v = row[f"c{k}"]
        assert v.tag == tag and {"Integer": v.i, "Bool": v.b}.get(tag) == want, e
    assert one(spark, V.branch("x < 200", {"x": env["x"]}).alias("b")).b == "AlwaysTrue"
    assert one(spark, V.branch("nope < 1", env).alias("b")).b == "Unknown"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(0, 6), st.sampled_from(["<", "<=", ">", ">=", "==", "!="]), st.integers(-12, 12)), min_size=1, max_size=40))
def test_range_compare(cases):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(lo, lo + n, op, x) for lo, n, op, x in cases], "lo long, hi long, op string, x long")
    for r in rows.withColumn("got", V.range_compare(F.col("lo"), F.col("hi"), F.col("op"), F.col("x"))).collect():
        truth = {eval(f"{v} {r.op} {r.x}") for v in range(r.lo, r.hi + 1)}
        assert r.got == ("Unknown" if len(truth) > 1 else "AlwaysTrue" if True in truth else "AlwaysFalse")


def test_symbolic_values(spark):
    cases = [("42", "integer", "42"), ("0x1234", "integer", "0x1234"), ("null", "pointer", "NULL"), ("valid", "pointer", "<valid ptr>"), ("0..100", "integer", "0..100"), ("hey", "string", '"hey"'), ('"q"', "string", '"q"'), ("0b11", "integer", "3")]
    df = spark.createDataFrame(cases, "t string, h string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", V.display(V.parse_symbolic(F.col("t"), F.col("h")))).collect())


def fuzzy(q, t):
    q, t = q.lower(), t.lower()
    if q in t:
        return 100 - t.index(q) + (50 if q == t else 0)
    at = score = 0
    for i, c in enumerate(t):
        if at < len(q) and c == q[at]:
            at += 1
            score += 10
            if i > 0 and at >= 2 and t[i - 1] == q[at - 2]:
                score += 5
    return score if at == len(q) else None


def test_fuzzy(spark):
    names = ["open file", "Open", "reopen", "o p e n", "pen", "oopenn", "xoxpen", "opfen"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for q in ("open", "on", "opn"):
        assert {r.n: r.s for r in df.select("n", T.fuzzy_score(q, "n").alias("s")).collect()} == {n: fuzzy(q, n) for n in names}


def naive_points_to(cons, functions):
    pts = {f: {f} for f in functions}
    get = lambda k: pts.setdefault(k, set())
    while True:
        before = sum(map(len, pts.values()))
        for k, d, s, f in cons:
            if k == "AddressOf":
                get(d).add(s)
            elif k == "Copy":
                get(d).update(get(s))
            elif k == "Load":
                for o in list(get(s)):
                    get(d).update(get(o))
            elif k == "Store":
                for o in list(get(d)):
                    get(o).update(get(s))
            elif k == "FieldLoad":
                for o in list(get(s)):
                    get(d).update(get(f"{o}.{f}"))
            elif k == "FieldStore":
                for o in list(get(d)):
                    get(f"{o}.{f}").update(get(s))
            elif k == "ArrayStore":
                get(f"{d}[]").update(get(s))
            else:
                get(d).update(get(f"{s}[]"))
        if sum(map(len, pts.values())) == before:
            return {(k, t) for k, ts in pts.items() for t in ts}


def test_points_to(spark):
    r = random.Random(3)
    kinds = ["AddressOf", "Copy", "Load", "Store", "FieldLoad", "FieldStore", "ArrayStore", "ArrayLoad"]
    for n in (6, 14):
        v = [f"v{i}" for i in range(6)]
        cons = [(k, r.choice(v), r.choice([*v, "fn"]), "f" if "Field" in k else None) for k in (r.choice(kinds) for _ in range(n))]
        got = PT.solve(spark.createDataFrame(cons, "kind string, dest string, src string, field string"), spark.createDataFrame([("fn",)], "name string"))
        assert {(x["loc"], x["target"]) for x in got.collect()} == naive_points_to(cons, ["fn"])


def test_tree_cycles_and_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "ext"), ("a", "c")], "src string, dst string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    rows = {(tuple(r.trail), r.node_type) for r in G.flow_tree(spark, e, spark.createDataFrame([("a",), ("zz",)], "name string"), known).collect()}
    assert rows == {(("a",), "Function"), (("a", "b"), "Function"), (("a", "c"), "Function"), (("a", "b", "a"), "Ref"), (("a", "b", "ext"), "KernelApi"), (("zz",), "External")}
    tree = G.flow_tree(spark, e, known.where("name = 'a'"), known)
    assert [r.text for r in G.render(tree).orderBy("ord").collect()] == ["a", "├─ b", "   ├─ a", "   └─ ext", "└─ c"]
    assert [r.text.split("| ")[1] for r in G.render(tree, "trace").orderBy("ord").collect()] == ["a() {", "  b() {", "    a();", "    ext();", "  }", "  c();", "}"]
    assert G.flow_tree(spark, e, known.where("name = 'a'"), known, max_depth=1).count() == 3


def test_closure_and_path(spark):
    r = random.Random(5)
    pairs = {(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(18)}
    e = spark.createDataFrame(sorted(pairs), "src string, dst string")
    hops = {"n0": 0}
    for h in range(1, 13):
        hops |= {b: h for a, b in pairs if a in hops and hops[a] == h - 1 and b not in hops}
    got = {x.name: x.hops for x in G.closure(e, spark.createDataFrame([("n0",)], "name string")).collect()}
    assert got == hops
    far = max(hops, key=hops.get)
    assert G.shortest_path(e, "n0", far).first().hops == hops[far]


def test_entry_points(spark):
    f = spark.createDataFrame([("a", 9, False, True), ("b", 3, False, False), ("i", 5, False, True)], "name string, line int, is_callback boolean, is_static boolean")
    none = spark.createDataFrame([], "name string, rank int")
    assert [r.name for r in G.entry_points(f, none, ()).orderBy("ord").collect()] == ["b"]
    assert [r.name for r in G.entry_points(f.where("is_static"), none, ()).orderBy("ord").collect()] == ["i", "a"]
    assert [r.name for r in G.entry_points(f, spark.createDataFrame([("i", 0)], "name string, rank int"), ()).orderBy("ord").collect()] == ["i"]


def test_candidates_match_brute_force(spark):
    ts = [("t1", "int", ["struct f *", "void *"]), ("t2", "void *", ["int"]), ("t3", "void", [])]
    fs = [("f1", "long", ["void*", "struct x *"]), ("f2", "struct d *", ["long"]), ("f3", "void", ["int", "int"]), ("f4", "char", [])]
    s = "name string, return_type string, params array<string>"
    got = {(r.type_name, r.function): r.score for r in R.candidates(spark.createDataFrame(ts, s), spark.createDataFrame(fs, s)).collect()}
    ok = lambda a, b: a == b or (a in ("void *", "void*") and b in ("void *", "void*")) or ("struct" in a and "*" in a and b in ("void *", "void*")) or ("struct" in b and "*" in b and a in ("void *", "void*")) or {a, b} <= {"int", "long"}
    want = {}
    for (n, r, p), (m, q, o) in itertools.product(ts, fs):
        score = 40 * ok(r, q) + ((30 + sum(30 // max(len(p), 1) for x, y in zip(p, o, strict=True) if ok(x, y))) if len(p) == len(o) else 0)
        if score:
            want[n, m] = score
    assert got == want


def test_navigation_and_lru(spark):
    steps = [("u", 1, "push", "a"), ("u", 2, "push", "b"), ("u", 3, "back", None), ("u", 4, "push", "c"), ("u", 5, "forward", None), ("u", 6, "back", None)]
    rows = intake.navigation(spark.createDataFrame(steps, "user string, seq long, action string, place string")).orderBy("seq").collect()
    assert [r.place for r in rows] == ["a", "b", "a", "c", "c", "a"]
    acc = [("c", i, k, o) for i, (k, o) in enumerate([("a", "insert"), ("b", "insert"), ("a", "get"), ("c", "insert"), ("c", "insert")])]
    df = spark.createDataFrame(acc, "cache string, seq long, key string, op string")
    assert {r.key for r in intake.lru_trace(df, 2).collect()} == {"a", "c"}
    assert {r.key for r in intake.lru_trace(df, 2, evict_on_overwrite=True).collect()} == {"c"}
    assert [r.key for r in R.lru(df, "key", "seq", 2).collect()] == ["c", "a"]
    assert intake.progress([("parsing", 1, 3)]) == ["parsing 1/3 (33%)"]


def test_index_and_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.c").write_text("int f(void) { g(); }")
    (src / "b.c").write_text("struct s { int x; };\nvoid h(void) { }")
    (src / "skip.h").write_text("int x;")
    files = scan(spark, str(src), exclude=("skip*",), include=("*.c", "*.h"))
    assert {r.content for r in files.collect()} == {"int f(void) { g(); }", "struct s { int x; };\nvoid h(void) { }"}
    index = SymbolIndex(spark, str(tmp_path / "index"), buckets=4)
    intake.prepare(spark, index)
    intake.index_stream(spark, str(src), index, str(tmp_path / "state")).awaitTermination()
    assert {r.name for r in index.read("functions").collect()} == {"f", "h"} and index.read("structs").count() == 1
    (src / "c.c").write_text("int k(void) { f(); }")
    intake.index_stream(spark, str(src), index, str(tmp_path / "state")).awaitTermination()
    assert {r.name for r in index.read("functions").collect()} == {"f", "h", "k"}
    v = index.read("versions")
    assert index.changed(v).count() == 0 and index.changed(v.withColumn("size", F.col("size") + 1)).count() == 3
    gone = v.where("path like '%a.c'").select("path")
    index.replace_files("functions", gone, index.read("functions").where("false"))
    assert {r.name for r in index.read("functions").collect()} == {"h", "k"}


def test_knowledge_and_samples(spark):
    kb = knowledge(spark)
    assert {r.chain_id: r.n for r in kb["chains"].groupBy("chain_id").agg(F.count("*").alias("n")).collect()} == {"usb_driver.probe": 9, "usb_driver.disconnect": 6, "file_operations.open": 6, "work_struct": 5, "timer_list": 5, "work_struct.irq": 3}
    s = samples.samples(kb)
    assert {r.task: r.n for r in s.groupBy("task").agg(F.count("*").alias("n")).collect()} == {"callback_timing": 5, "function_pointer_target": 5, "call_chain": 12, "sync_mechanism": 5}
    macros = spark.createDataFrame([("A", "1", True, 0), ("A", "2", True, 1), ("B", None, False, 2)], "name string, value string, defined boolean, ord int")
    args = [r.arg for r in clang_args(macros, spark.createDataFrame([(0, "inc")], "ord int, path string"), "x86_64-linux-gnu").orderBy("ord").collect()]
    assert args == ["--target=x86_64-linux-gnu", "-DA=2", "-UB", "-Iinc"]
