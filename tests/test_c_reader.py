"""What is read from C of many shapes, and that nothing stops the reader."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runpath.sources import c_front
from runpath.sources.c_reader import Reader, tokens


def functions(text):
    return {d["name"]: d for d in c_front.definitions(text)[0] if d["kind"] == "function"}


def params(text, name):
    return [(p["name"], p["type_name"]) for p in functions(text)[name]["params"]]


REST = "\nint rest(void)\n{\n\treturn 0;\n}\n"


@pytest.mark.parametrize("text, want", [
    ("#ifdef A\nint f(int a) {\n#else\nint f(void) {\n#endif\n return 0; }", [("a", "int")]),
    ("#ifdef A\nint f(int a,\n#else\nint f(\n#endif\n int b) { }", [("a", "int"), ("b", "int")]),
    ("int f(int a,\n#ifdef B\n int b,\n#endif\n int c) { }", [("a", "int"), ("b", "int"), ("c", "int")]),
    ("static __attribute__((unused)) int f(void) { }", []),
    ("int __init __attribute__((section(\"x\"))) f(char **argv) __acquires(l) { }", [("argv", "char **")]),
    ("int f(a, b) int a; char *b; { }", [("a", "int"), ("b", "char *")]),
    ("int (*f(int a))(int b) { }", [("a", "int")]),
    ("struct x *f(const struct y __user *u, char buf[4], int (*cb)(void *d), size_t, ...) { }", [("u", "const struct y __user *"), ("buf", "char[4]"), ("cb", "int (*)(void *d)"), ("", "size_t"), ("", "...")]),
    ("MACRO(x)\nEXPORT_SYMBOL(g);\nstatic inline u32 f(__u32 a, enum e b) { }", [("a", "__u32"), ("b", "enum e")]),
    ("f(x) { }", [("", "x")]),
    ("extern \"C\" { int f(void) { } }", []),
    ("int x = 3, *y = &x; struct s { int a; } v = { 1 }; int g(void); int f(void) { }", []),
    ("int f(void) { if (x) { return 1; }\n", []),
    ("int f(void) { a(]; (b; }", []),
    ("int f(void)\n{\n#if A\n\tif (x) {\n#else\n\tif (y) {\n#endif\n\t}\n}", []),
    ("int f(void)\n{\n#ifdef A\n\tif (x) {\n#endif\n\t\tgo();\n#ifdef A\n\t}\n#endif\n}", []),
])
def test_functions(text, want):
    """Each function is found with its parameters, and so is the one behind it."""
    assert params(text + REST, "f") == want
    assert functions(text + REST)["rest"]["line"] == text.count("\n") + 2


def test_heads():
    f = functions("SYSCALL_DEFINE1(close, unsigned int, fd) { run(fd); }\nCOMPAT_SYSCALL_DEFINE0(now) { }\nIRQ_HANDLER(tick) { }\nmain() { }\nunsigned long long *g(void) { }")
    assert {n: d["return_type"] for n, d in f.items()} == {"sys_close": "long", "compat_sys_now": "long", "tick": "", "main": "", "g": "unsigned long long *"}
    assert params("SYSCALL_DEFINE1(close, unsigned int, fd) { }", "sys_close") == [("fd", "unsigned int")]
    assert functions("int (*f(int a))(int b) { }")["f"]["return_type"] == "int (*)(int b)"


def test_recovery():
    text = "int a(void) { if (x) { stop(); }\nint b(void) { }\n}\nstruct s {\n\tint x;\nint c(void)\n{\n}\nint d(void) {\n"
    found, errors = c_front.definitions(text)
    assert [(x["name"], x["line"], x["end_line"]) for x in found] == [("a", 1, 1), ("b", 2, 2), ("s", 4, 5), ("c", 6, 8)]
    assert errors == ["unbalanced brace at line 1", "unexpected brace at line 3", "unbalanced brace at line 4", "unbalanced brace at line 9"]


def test_fields():
    text = "struct m { int a, *b; unsigned x:3, :4; union { int u; struct q *v; }; struct { int w; } in; int (*ops[4])(int); struct t *(*get)(struct m *m, int n); struct inner { int k; } nn; char __user *buf; u8 d[N] __aligned(8); DECLARE_BITMAP(z, 3); };"
    found = {d["name"]: d for d in c_front.definitions(text)[0]}
    assert [(f["name"], f["type_name"], f["is_pointer"], f["signature"]) for f in found["m"]["fields"]] == [
        ("a", "int", False, None), ("b", "int *", True, None), ("x", "unsigned", False, None), ("u", "int", False, None), ("v", "struct q *", True, None), ("in", "struct", False, None),
        ("ops", "int", True, "int (*[4])(int)"), ("get", "struct t *", True, "struct t * (*)(struct m *m, int n)"), ("nn", "struct inner", False, None), ("buf", "char __user *", True, None), ("d", "u8[N]", False, None),
    ]
    assert found["m"]["refs"] == ["inner", "q", "t"] and [f["name"] for f in found["inner"]["fields"]] == ["k"]
    assert [d["name"] for d in c_front.definitions("typedef struct { int a; } t;\nstruct __packed p { int a; };\nstruct q { int a; } __attribute__((packed));\nunion u { int a; };")[0]] == ["p", "q"]


def body(text, known=()):
    return set(c_front.constraints_of("int f(void) { " + text + " }", {"f", *known}))


@pytest.mark.parametrize("text, want", [
    ("if (a) p = &y;", {("AddressOf", "p", "y", None)}),
    ("for (;;) p = r;", {("Copy", "p", "r", None)}),
    ("if (a) { } else p = r;", {("Copy", "p", "r", None)}),
    ("switch (x) { case 1: p = r; break; default: q = s; }", {("Copy", "p", "r", None), ("Copy", "q", "s", None)}),
    ("do p = r; while (x); out: q = s;", {("Copy", "p", "r", None), ("Copy", "q", "s", None)}),
    ("while ((p = next)) list_for_each(x, y) q = x;", {("Copy", "p", "next", None), ("Copy", "q", "x", None)}),
    ("for (int *i = a, *j = b; i; i = i) { }", {("Copy", "i", "a", None), ("Copy", "j", "b", None), ("Copy", "i", "i", None)}),
    ("struct x *a = kzalloc(sizeof(*a), G), *b = (struct x *)a;", {("AddressOf", "a", "alloc:1", None), ("Copy", "b", "a", None)}),
    ("p = c ? &a : q, r = s;", {("AddressOf", "p", "a", None), ("Copy", "p", "q", None), ("Copy", "r", "s", None)}),
    ("p = q = r;", {("Copy", "p", "r", None), ("Copy", "q", "r", None)}),
    ("r = *q; *q = s;", {("Load", "r", "q", None), ("Store", "q", "s", None)}),
    ("*q = &z;", {("AddressOf", "&z", "z", None), ("Store", "q", "&z", None)}),
    ("**pp = q;", {("Load", "*pp", "pp", None), ("Store", "*pp", "q", None)}),
    ("t = o->m; o->m = s;", {("FieldLoad", "t", "o", "m"), ("FieldStore", "o", "s", "m")}),
    ("a->b = c->d;", {("FieldLoad", "c->d", "c", "d"), ("FieldStore", "a", "c->d", "b")}),
    ("(*s).x = f;", {("FieldStore", "s", "f", "x")}),
    ("h[2] = s; u = h[i];", {("ArrayStore", "h", "s", None), ("ArrayLoad", "u", "h", None)}),
    ("a[i]->cb = f;", {("FieldStore", "a[]", "f", "cb")}),
    ("p = ({ q = r; q; });", {("Copy", "q", "r", None)}),
    ("x = NULL; p = a + b; n++; p == q; p += q;", set()),
    ("INIT_WORK(&d->w, f); timer_setup(t, f, 0); request_irq(n, f, 0);", {("FieldStore", "d->w", "f", "func"), ("FieldStore", "t", "f", "function"), ("AddressOf", "irq_n", "f", None)}),
])
def test_constraints(text, want):
    assert body(text) == want


def test_initialisers():
    text = "int (*tab[])(void) = { f, &f, [3] = f };\nstatic struct o x = { .a = f, b: f, .n = 3, .s = { .c = f } };\nstruct r rows[] = { { .cb = f }, [2] = { .cb = g } };\nstatic int *gp = &gv;\ntypedef int t;"
    assert set(c_front.constraints_of(text, {"f", "g"})) == {
        ("ArrayStore", "tab", "f", None), ("FieldStore", "x", "f", "a"), ("FieldStore", "x", "f", "b"), ("FieldStore", "s", "f", "c"), ("FieldStore", "rows", "f", "cb"), ("FieldStore", "rows", "g", "cb"),
        ("AddressOf", "gp", "gv", None),
    }


def test_facts():
    text = "int h(int a) {\n dev->cb = (cb_t)h;\n tab[2] = &h;\n tab[i](3);\n (*fp)(2);\n schedule_delayed_work(&d->work, HZ);\n g_signal_connect(b, \"c\", h, 0);\n while (x) y++;\n}\nint k(void) { for (;;) { o->run(); } while (1) { if (a) tab[e](); } while (n) o->step(); }"
    got = [(f["fact"], f["line"], f.get("target"), f.get("name")) for f in c_front.facts_of(text, {"h"})]
    assert sorted(got, key=repr) == sorted([
        ("binding", 2, "dev->cb", "h"), ("binding", 3, "tab[*]", "h"), ("invocation", 4, "tab[i]", None), ("invocation", 5, "fp", None), ("queue", 6, "schedule_delayed_work", "d->work"),
        ("registration", 7, "g_signal_connect", "h"), ("signal", 7, "b", "h"), ("invocation", 10, "o->run", None), ("invocation", 10, "tab[e]", None), ("invocation", 10, "o->step", None),
        ("event_loop", 10, "o->run", None), ("event_loop", 10, "tab[e]", None), ("event_loop", 10, "o->step", None),
    ], key=repr)


def test_member_calls_know_their_function():
    text = "struct a *g;\nint f(struct o *o) { o->run(1); o->x->run(2); g->stop(); }\nint k(struct p *o) { o->run(); }\nint l(void) { if (x) { struct p *q; } else { struct o *q; } q->go(); }"
    assert [(c["target"], c["line"], c["struct_type"]) for c in c_front.member_calls_of(text)] == [("o->run", 2, "o"), ("o->x->run", 2, None), ("g->stop", 2, "a"), ("o->run", 3, "p"), ("q->go", 4, None)]


def test_two_files_with_the_same_names(spark):
    from runpath.plans.session import AnalysisSession

    text = "void {h}(void) { }\nvoid set(struct d *dev) { dev->cb = {h}; t[1] = {h}; }\nvoid go(struct d *dev) { dev->cb(); t[i](); }"
    s = AnalysisSession(spark, spark.createDataFrame([(f"{h}.c", text.replace("{h}", h)) for h in ("one", "two")], "path string, content string"))
    assert {(r.path, r.expr): r.handlers for r in s.resolved_callbacks().collect()} == {(f"{h}.c", e): [h] for h in ("one", "two") for e in ("dev->cb", "t[i]")}


def test_directives():
    assert [t for t, _ in tokens("a\n#define X(y) \\\n  { { /* z\n */ b\n#if 1 // {\nb;\n#elif 2\nc;\n#else\nd;\n#endif\ne # x\n#endif\n#if 3\nf")] == ["a", "b", ";", "e", "f"]
    assert [t for t, _ in tokens("x;\n#if 1 // {\nb;\n#elif 2\nc;\n#else\nd;\n#endif\ne")] == ["x", ";", "b", ";", "c", ";", "d", ";", "e"]


ALL = [c_front.definitions, c_front.constraints_of, lambda t: c_front.facts_of(t, {"f", "h"}), c_front.types_of, c_front.arguments_of, c_front.member_calls_of]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("int f ( ) { } [ ] ; , = * & -> . a h struct typedef if while for ( x ) \n # #if\n #else\n #endif\n \" ' /* */ // case : ? sizeof ({ }) = { .b = [3] extern \"C\" { 3 ... + ++ __init".split(" ")), max_size=120).map(" ".join))
def test_any_tokens(text):
    for read in ALL:
        read(text)
    r = Reader(text)
    assert all(k < r.after[k] <= r.n and r.close[k] <= r.after[k] for k in r.after)


@pytest.mark.parametrize("text", ["(" * 4000 + ")" * 4000, "{" * 4000, "*" * 9000 + "p;", "a ? b : " * 4000 + "c;", "a = " * 4000 + "b;", "if (a) " * 3000 + "b();", "if (a) b(); else " * 3000 + "c();", "x = " + "a + " * 9000 + "b;", "[" * 4000, "a(" * 4000])
def test_deep_and_long(text):
    for read in ALL:
        read("int f(void) { " + text + " }" + REST)
    assert "rest" in functions("int f(void) { " + text + " }" + REST)


def test_texts_without_conditional_groups_are_cut_at_once(monkeypatch):
    """Each token of each text was a match of its own, though only conditional groups need that."""
    from types import SimpleNamespace

    from runpath.sources import c_reader

    text = "#include <a.h>\n/* { */ int f(int a) /* no #endif */\n{\n\treturn a->b + '}';\t\n}\n \n"
    before = c_reader.tokens(text.replace("no #endif", "no #if"))  # by single matches; of the same length where it counts
    monkeypatch.setattr(c_reader, "_MAYBE_GROUP", SimpleNamespace(search=lambda _: None))
    monkeypatch.setattr(c_reader, "_TOKEN", None)
    found = c_reader.tokens(text)
    assert [t for t, _ in found] == [t for t, _ in before] == ["int", "f", "(", "int", "a", ")", "{", "return", "a", "->", "b", "+", "'}'", ";", "}"]
    assert all(text[a : a + len(t)] == t for t, a in found)
