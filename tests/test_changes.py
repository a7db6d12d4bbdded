"""Range joins, closures kept up to date, confidences and drawings against brute force."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from runpath.operators import design as D
from runpath.operators import graph as G
from runpath.operators import points_to as PT
from runpath.operators import relational as R
from runpath.operators.drawing import arrange, crossings, drawing


def test_in_range(spark):
    """A hot key with intervals of all lengths, negative places, empty intervals, nulls, ends that touch."""
    r = random.Random(2)
    points = [(r.choice("aaab") if r.random() < 0.95 else None, r.choice([r.randrange(-2000, 2000), r.randrange(-5, 5), None]), i) for i in range(600)]
    spans = [(r.choice("aaac"), lo, lo + int(2 ** r.uniform(0, 11)) - 1 if r.random() < 0.9 else lo - 1, i) for i in range(300) for lo in [r.randrange(-2000, 2000)]] + [("a", None, 3, 900), ("a", 1, 1, 901)]
    p, i = spark.createDataFrame(points, "k string, at int, n int"), spark.createDataFrame(spans, "k string, lo int, hi int, i int")
    got = R.in_range(p, i, "k", "at", "lo", "hi")
    assert got.columns == ["k", "at", "n", "lo", "hi", "i"]
    want = sorted((n, j) for (a, x, n), (b, lo, hi, j) in itertools.product(points, spans) if a is not None and a == b and None not in (x, lo, hi) and lo <= x <= hi)
    assert sorted((x.n, x.i) for x in got.collect()) == want
    assert R.in_range(p, i.where("false"), "k", "at", "lo", "hi").count() == 0
    day = lambda n: datetime.date(1969, 12, 20) + datetime.timedelta(n)
    dates = R.in_range(spark.createDataFrame([("a", day(n)) for n in range(30)], "k string, at date"), spark.createDataFrame([("a", day(3), day(20)), ("a", day(8), day(8))], "k string, lo date, hi date"), "k", "at", "lo", "hi")
    assert sorted(x.at for x in dates.collect()) == sorted([*map(day, range(3, 21)), day(8)])


def test_active_lines(spark):
    lines = spark.createDataFrame([("f", n, "x") for n in (1, 2, 2, 3, 4)] + [(None, 2, "x")], "path string, line int, text string")
    regions = spark.createDataFrame([("f", 2, 3, "OFF"), ("f", 4, 9, "ON"), ("g", 1, 9, "OFF")], "path string, lo int, hi int, macro string")
    macros = spark.createDataFrame([("ON", "1"), ("OFF", "0")], "name string, value string")
    got = D.active_lines(lines, regions, macros)
    assert got.columns == lines.columns and sorted((r.path or "", r.line) for r in got.collect()) == [("", 2), ("f", 1), ("f", 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_maintained_closure(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(20)]
    old = {(r.choice(names), r.choice(names)) for _ in range(40)} | {(names[i], names[i + 1]) for i in range(7)}
    removed = set(r.sample(sorted(old), 9)) | {("n3", "n4")}
    added = {(r.choice(names), r.choice(names)) for _ in range(4 * (seed % 2))} - old
    frame = lambda rows: spark.createDataFrame(sorted(rows), "src string, dst string")
    start = spark.createDataFrame([("n0",), ("n15",)][: 1 + seed // 2], "name string")
    now = (old - removed) | added
    reverse = seed == 2
    got = G.maintain_closure(G.closure(frame(old), start, reverse), frame(now), frame(removed), frame(added), start, reverse)
    want, front = {r.name: 0 for r in start.collect()}, [r.name for r in start.collect()]
    for x in front:
        for a, b in now:
            a, b = (b, a) if reverse else (a, b)
            if a == x and b not in want:
                want[b] = want[x] + 1
                front.append(b)
    assert sorted(map(tuple, got.collect())) == sorted(want.items())


def test_confidence(spark):
    """The best way counts, and of a way its weakest constraint."""
    rows = [("AddressOf", "p", "f", None, None), ("Copy", "q", "p", None, None), ("Copy", "a", "p", None, "Medium"), ("AddressOf", "s", "o", None, None), ("FieldStore", "s", "p", "cb", None), ("FieldLoad", "b", "s", "cb", None),
            ("AddressOf", "pp", "p", None, None), ("Load", "c", "pp", None, None), ("Copy", "b2", "b", None, None), ("Copy", "c", "a", None, None), ("ArrayStore", "t", "p", None, None), ("ArrayLoad", "u", "t", None, None)]
    c = spark.createDataFrame(rows, "kind string, dest string, src string, field string, confidence string")
    got = {(r.loc, r.target): r.confidence for r in PT.solve_with_confidence(c).collect()}
    levels = ["High", "Medium", "Low"]
    best = {}
    for n in reversed(range(3)):
        some = PT.with_confidence(c).where(F.col("confidence").isin(levels[: n + 1])).drop("confidence")
        best |= {(r.loc, r.target): levels[n] for r in PT.solve(some).collect()}
    assert got == best
    assert (got["q", "f"], got["a", "f"], got["b2", "f"], got["c", "f"], got["u", "f"]) == ("High", "Medium", "Medium", "Medium", "Low")


def brute_crossings(layers, edges):
    at = {n: (r, i) for r, layer in enumerate(layers) for i, n in enumerate(layer)}
    return sum(at[a][0] == at[c][0] and at[b][0] == at[d][0] and (at[a][1] - at[c][1]) * (at[b][1] - at[d][1]) < 0 for (a, b), (c, d) in itertools.combinations(edges, 2))


def test_arrange():
    r = random.Random(3)
    better = 0
    for _ in range(60):
        ranks = {f"n{i}": min(i // 4, 4) for i in range(20)}
        edges = [(a, b) for a, b in ((f"n{r.randrange(20)}", f"n{r.randrange(20)}") for _ in range(25)) if a != b]
        by_name, links, start = arrange(ranks, edges, 0)
        layers, same, left = arrange(ranks, edges, 8)
        assert set(same) == set(links) and [sorted(x) for x in layers] == [sorted(x) for x in by_name]
        assert left == brute_crossings(layers, links) and start == brute_crossings(by_name, links) and left <= start
        better += left < start
        at = {n: k for k, layer in enumerate(layers) for n in layer}
        assert all(at[b] == at[a] + 1 for a, b in links) and {n for n in at if "\u0001" not in n} == set(ranks)
    assert better > 40
    assert arrange({"a": 0, "b": 0, "x": 1, "y": 1}, [("a", "y"), ("b", "x")], 2)[2] == 0
    assert arrange({}, [], 2) == ([], [], 0) and crossings([["a"]], []) == 0


def test_drawing(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "y"), ("b", "x"), ("r", "y"), ("x", "r"), ("x", "x")], "src string, dst string")
    tree = G.flow_tree(spark, edges, spark.createDataFrame([("r",), ("a",)], "name string"), edges.select(F.col("dst").alias("name")))
    rows = drawing(tree).collect()
    assert {(x.node, x.rank) for x in rows if x.root == "r" and not x.dummy} == {("r", 0), ("a", 1), ("b", 1), ("x", 2), ("y", 2)}
    assert [x.rank for x in rows if x.dummy] == [1, 1] and all(x.crossings == 0 for x in rows)  # r to y, and x back to r
    assert {x.node for x in drawing(tree, max_nodes=2).collect() if x.root == "r"} == {"r", "a"}
