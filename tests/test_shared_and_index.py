"""Shared trees against whole ones, chunks against whole files, versions of tables."""

import random

import pytest
from pyspark.sql import functions as F

from runpath.errors import ConcurrentChangeError
from runpath.operators import graph as G
from runpath.operators.index import BucketedTable, DefinitionIndex
from runpath.plans import c_units
from runpath.sources import c_chunks, c_front


# -- trees ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(3))
def test_shared_tree(spark, seed):
    """Graphs with cycles, loops, diamonds and unknown functions, several at once: counts and first paths are those of the whole trees."""
    r = random.Random(seed)
    edges, known, roots = [], [], []
    for g in "ab":
        nodes = [f"n{i}" for i in range(9)]
        edges += {(g, x, y) for i, x in enumerate(nodes) for y in r.sample(nodes[i + 1 :] + ["api"], min(2, 9 - i))}
        edges += [(g, "n7", r.choice(nodes[3:])), (g, "n5", r.choice(nodes[2:6])), (g, "n8", "n8")][: seed + 1]
        known += [(g, n) for n in nodes]
        roots += [(g, "n0"), (g, "n4"), (g, "nowhere")]
    frame = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    args = frame(edges, "file", "src", "dst"), frame(roots, "file", "name"), frame(known, "file", "name")
    tree = G.flow_tree(spark, *args, max_depth=9, by=("file",)).collect()
    shared = G.shared_tree(spark, *args, max_depth=9, by=("file",))
    want, first, types = {}, {}, {}
    for t in tree:
        key = t.file, t.root, t.node
        want[key] = want.get(key, 0) + 1
        first[key] = min(first.get(key, t.ord), t.ord)
        kind = t.file, t.root, t.node_type
        n, deepest = types.get(kind, (0, 0))
        types[kind] = n + 1, max(deepest, t.depth)
    got = G.shared_paths(shared, ("file",)).collect()
    assert {(x.file, x.root, x.node): x.paths for x in got} == want
    assert {(x.file, x.root, x.node): "\u0001".join(x.first) for x in got} == first
    assert {(x.file, x.root, x.node_type): (x.places, x.deepest) for x in G.tree_sizes(shared, ("file",)).collect()} == types
    assert shared.count() <= len(tree)


def test_shared_tree_is_small(spark):
    edges = spark.createDataFrame([(f"{side}{i}", f"{to}{i + 1}") for i in range(20) for side in "lr" for to in "lr"], "src string, dst string")
    roots = spark.createDataFrame([("l0",)], "name string")
    shared = G.shared_tree(spark, edges, roots, edges.select(F.col("src").alias("name")).union(edges.select("dst")))
    assert shared.count() == 41 and G.tree_sizes(shared).first().places == 2**21 - 1


# -- chunks -----------------------------------------------------------------------------------------------------------
def read_by_chunks(text):
    out = []
    for i, (first, part) in enumerate(parts := c_chunks.cut(text)):
        found, errors = c_front.definitions(part)
        out += [(d["kind"], d["name"], d["line"] + first - 1, d["end_line"] + first - 1, d.get("calls"), [f["name"] for f in d.get("fields", [])]) for d in found]
        out += [("error", e.rsplit(" ", 1)[0], int(e.rsplit(" ", 1)[1]) + first - 1, None, None, []) for e in errors]
    assert "".join(p for _, p in parts) == text and [f for f, _ in parts] == [text[: sum(len(p) for _, p in parts[:i])].count("\n") + 1 for i in range(len(parts))]
    return sorted(out, key=repr)


def read_whole(text):
    found, errors = c_front.definitions(text)
    out = [(d["kind"], d["name"], d["line"], d["end_line"], d.get("calls"), [f["name"] for f in d.get("fields", [])]) for d in found]
    return sorted(out + [("error", e.rsplit(" ", 1)[0], int(e.rsplit(" ", 1)[1]), None, None, []) for e in errors], key=repr)


def test_chunks_read_like_files():
    r = random.Random(8)
    extra = ["int x = 3;\n", "typedef struct {\n\tint a;\n}\nfoo_t;\n", "/* } */\n#define A { \\\n }\n", "static struct o t = {\n\t.a = { 1 },\n\t.b = f,\n};\n", "\n", "module_init(x);\n", "struct a {\n\tint b;\n} *f(void)\n{\n}\n", "#if 0\n}\n#endif\n", "}\n"]
    for n in range(600):
        units = [r.choice(c_units.UNITS + extra * (n % 2)).replace("{k}", str(n)).replace("{j}", str(j)).replace("{z}", "7") for j in range(r.randrange(7))]
        text = "".join(units)[: None if n % 3 else r.randrange(900)]
        assert read_by_chunks(text) == read_whole(text), text
    assert len(c_chunks.cut("".join(c_units.UNITS[i] for i in (0, 3, 4, 0, 7, 1, 0)))) >= 6


def test_definition_index(spark):
    index = DefinitionIndex.temporary(spark, 4)
    one = "int a(void)\n{\n\treturn 1;\n}\n\nint b(void)\n{\n\treturn f();\n}\n\nint c(void)\n{\n}\n"
    frame = lambda **texts: spark.createDataFrame([(p + ".c", t) for p, t in texts.items()], "path string, content string")
    rows = lambda: sorted((r.path, r.name, r.line) for r in index.symbols().collect())
    assert index.refresh(frame(x=one, y=one)).count() == 3  # equal chunks are read once
    assert rows() == [(p, n, line) for p in ("x.c", "y.c") for n, line in (("a", 1), ("b", 6), ("c", 11))]
    two = one.replace("return f();", "g();\n\treturn f();")
    assert [r.content for r in index.refresh(frame(x=two)).collect()] == ["\nint b(void)\n{\n\tg();\n\treturn f();\n}\n"]
    assert rows() == [("x.c", "a", 1), ("x.c", "b", 6), ("x.c", "c", 12), ("y.c", "a", 1), ("y.c", "b", 6), ("y.c", "c", 11)]
    assert index.refresh(frame(x=one, z="", w=None)).count() == 1  # only the empty one is new
    index.remove_files(frame(y="").select("path"))
    index.vacuum()
    assert rows() == [("x.c", "a", 1), ("x.c", "b", 6), ("x.c", "c", 11)]
    assert index.refresh(frame(y=two)).count() == 1  # b with g() was forgotten


# -- versions ---------------------------------------------------------------------------------------------------------
def test_versions(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), "path string, n int", 4)
    frame = lambda *rows: spark.createDataFrame(rows, "path string, n int")
    rows = lambda v=None: sorted(map(tuple, t.read(v).collect()))
    assert rows() == []
    t.save(frame(("a", 1), ("b", 2), ("b", 3), ("c", 4)))
    before = t.read()
    t.replace(frame(("b", 0)).select("path"), frame(("b", 9), ("d", 5)))
    t.upsert(frame(("a", 7), ("e", 8)), ("path",))
    assert rows() == [("a", 7), ("b", 9), ("c", 4), ("d", 5), ("e", 8)] and t.versions() == [1, 2, 3]
    assert sorted(map(tuple, before.collect())) == [("a", 1), ("b", 2), ("b", 3), ("c", 4)]  # a reader keeps its version
    t.append(frame(("a", 7)))
    t.replace(t.read().select("path"), frame())
    assert rows() == [] and rows(4) == [("a", 7), ("a", 7), ("b", 9), ("c", 4), ("d", 5), ("e", 8)]
    t.vacuum(1)
    assert rows() == [] and t.versions() == [5] and not [*tmp_path.glob("t/data/*/bucket=*")]


def test_change_between(spark, tmp_path, monkeypatch):
    """A change that another one overtakes, and one that fails half way, leave the table as it was."""
    t, other = (BucketedTable(spark, str(tmp_path / "t"), "path string, n int", 2) for _ in "ab")
    frame = lambda *rows: spark.createDataFrame(rows, "path string, n int")
    t.save(frame(("a", 1)))
    written = t._written

    def overtaken(rows):
        out = written(rows)
        other.upsert(frame(("b", 2)), ("path",))
        return out

    monkeypatch.setattr(t, "_written", overtaken)
    with pytest.raises(ConcurrentChangeError):
        t.upsert(frame(("a", 3)), ("path",))
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 2)]

    def broken(rows):
        written(rows)
        raise RuntimeError("lost")

    monkeypatch.setattr(t, "_written", broken)
    with pytest.raises(RuntimeError):
        t.replace(frame(("a", 0), ("b", 0)).select("path"), frame(("c", 3)))
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 2)]
    assert not [*tmp_path.glob("t/drafts/*")]
