"""Points-to sets by tasks and by joins against plain iteration over all constraints."""

import random

import pytest

from runpath.operators import points_to as PT

KINDS = ["AddressOf", "AddressOf", "Copy", "Load", "Store", "FieldLoad", "FieldStore", "ArrayLoad", "ArrayStore"]
SCHEMA = "file string, kind string, dest string, src string, field string"


def naive(constraints, functions=()):
    pts = {(f, f) for f in functions}
    while True:
        of = {}
        for loc, t in pts:
            of.setdefault(loc, set()).add(t)
        get = lambda n: of.get(n, set())  # noqa: B023, E731
        new = set()
        for kind, dest, src, field in constraints:
            match kind:
                case "AddressOf":
                    new.add((dest, src))
                case "Copy":
                    new |= {(dest, t) for t in get(src)}
                case "ArrayStore":
                    new |= {(dest + "[]", t) for t in get(src)}
                case "ArrayLoad":
                    new |= {(dest, t) for t in get(src + "[]")}
                case "Load":
                    new |= {(dest, t) for x in get(src) for t in get(x)}
                case "FieldLoad":
                    new |= {(dest, t) for x in get(src) for t in get(f"{x}.{field}")}
                case "Store":
                    new |= {(x, t) for x in get(dest) for t in get(src)}
                case "FieldStore":
                    new |= {(f"{x}.{field}", t) for x in get(dest) for t in get(src)}
        if new <= pts:
            return pts
        pts |= new


def made(seed, n, places):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        kind = r.choice(KINDS)
        dest, src = (f"v{r.randrange(places)}" + r.choice(["", "", "", "", "[]", ".f", ".f.g"]) for _ in "ab")
        out.append((kind, dest, src, r.choice("fg") if kind.startswith("Field") else None))
    return out


def solved(constraints, functions=()):
    w = PT.Worklist(lowered(constraints) + [("AddressOf", f, f, None) for f in functions])
    w.run()
    return {(w.names[n], w.names[t]) for n, found in w.pairs() for t in found}


def lowered(constraints):
    as_copy = {"ArrayStore": lambda d, s: ("Copy", d + "[]", s, None), "ArrayLoad": lambda d, s: ("Copy", d, s + "[]", None)}
    return [as_copy[k](d, s) if k in as_copy else (k, d, s, f) for k, d, s, f in constraints]


@pytest.mark.parametrize("seed", range(60))
def test_worklist(seed):
    c = made(seed, 10 + seed * 3, 4 + seed % 17)
    assert solved(c) == naive(c)
    assert solved(c, ["v1", "w"]) == naive(c, ["v1", "w"])


@pytest.mark.parametrize("seed", range(40))
def test_worklist_goes_on(seed):
    """Constraints that come later find what is known by then."""
    c = lowered(made(seed, 10 + seed * 3, 4 + seed % 17))
    w, seen, got = PT.Worklist(()), {}, []
    for lo in range(0, len(c), 20):
        w.add(c[lo : lo + 20])
        w.run()
        new = [(w.names[n], w.names[t]) for n, found in w.pairs(seen, False) for t in found]
        got += new
        assert set(got) == naive(c[: lo + 20])
    assert len(got) == len(set(got))


def test_confidence_in_one_task(spark, monkeypatch):
    """Each level was solved anew, by tables of its own; large groups still are."""
    files = {f: made(i, 25 if i % 2 else 8, 7) for i, f in enumerate(["a.c", "b.c", None])}
    rows = spark.createDataFrame([(f, *c) for f, cs in files.items() for c in cs], SCHEMA)
    names = spark.createDataFrame([("a.c", "v1"), ("b.c", "v2"), (None, "w")], "file string, name string")
    known = {"a.c": ["v1"], "b.c": ["v2"], None: ["w"]}
    expected = {}
    for level, kinds in reversed([(PT.CERTAINTY[n][0], [k for _, ks in PT.CERTAINTY[: n + 1] for k in ks]) for n in range(3)]):
        expected |= {(f, *p): level for f, cs in files.items() for p in naive([c for c in cs if c[0] in kinds], known[f])}
    found = lambda limit: {(r.file, r.loc, r.target): r.confidence for r in PT.solve_with_confidence(rows, names, by=("file",), group_limit=limit).collect()}
    assert found(12) == expected
    monkeypatch.setattr(PT, "solve", None)
    assert found(PT.GROUP_LIMIT) == expected


def test_worklist_collapses_cycles(monkeypatch):
    """Cycles that loads and stores close later on, with a pass for cycles after every edge."""
    ring = [("Copy", f"a{(i + 1) % 50}", f"a{i}", None) for i in range(49)] + [("AddressOf", "a3", "x", None), ("AddressOf", "p", "a0", None), ("Store", "p", "a49", None), ("Load", "q", "p", None), ("FieldStore", "a7", "a9", "f"), ("FieldLoad", "z", "q", "f")]
    assert solved(ring) == naive(ring)
    collapse = PT.Worklist.collapse

    def often(self):
        collapse(self)
        self.next_collapse = 0

    monkeypatch.setattr(PT.Worklist, "collapse", often)
    for seed in range(30):
        c = made(seed, 60, 9)
        assert solved(c) == naive(c)


@pytest.mark.parametrize("limit", [0, 12, PT.GROUP_LIMIT])
def test_ways_agree(spark, limit):
    """All groups by joins, some of each, all in tasks; whole and by file, where a file can be null."""
    files = {f: made(i, 25 if i % 2 else 8, 7) for i, f in enumerate(["a.c", "b.c", None])}
    rows = spark.createDataFrame([(f, *c) for f, cs in files.items() for c in cs], SCHEMA)
    names = spark.createDataFrame([("a.c", "v1"), ("b.c", "v2"), (None, "w")], "file string, name string")
    known = {"a.c": ["v1"], "b.c": ["v2"], None: ["w"]}
    got = PT.solve(rows, names, by=("file",), group_limit=limit).collect()
    assert sorted(map(repr, got)) == sorted({repr(r) for r in got})
    assert {(r.file, r.loc, r.target) for r in got} == {(f, *p) for f, cs in files.items() for p in naive(cs, known[f])}
    apart = [(k, f"{f}{d}", f"{f}{s}", x) for f, cs in files.items() for k, d, s, x in cs]
    whole = PT.solve(spark.createDataFrame([(None, *c) for c in apart], SCHEMA).drop("file"), group_limit=limit).collect()
    assert len(whole) == len(set(whole)) and {tuple(r) for r in whole} == naive(apart)


def test_large_groups_share_sets(spark, monkeypatch):
    """In a large group each location had rows of its own in every step, and function_targets() gathered all pairs again."""
    monkeypatch.setattr(PT, "TASK_PAIRS", 20_000)
    rows = [("AddressOf", "hub", f"f{i}", None) for i in range(300)] + [("Copy", f"d{i}", "hub", None) for i in range(1000)] + [("AddressOf", "p", "hub", None), ("Load", "q", "p", None), ("Store", "p", "s", None), ("AddressOf", "s", "alloc:1", None)]
    c = spark.createDataFrame(rows, "kind string, dest string, src string, field string")
    pairs, (locations, sets) = PT._solved(c, None, 100, (), 0)
    assert pairs.isEmpty() and locations.count() == 1004 and sets.count() == 3
    got = PT._of_locations(locations, sets).withColumn("task", PT.F.spark_partition_id()).where("loc like 'd%'").collect()
    assert len(got) == 1000 and {len(r.targets) for r in got} == {301} and len({r.task for r in got}) > 1
    found = {r.loc: r.targets for r in PT.solve_functions(c, group_limit=0).collect()}
    assert found == {r.loc: r.targets for r in PT.solve_functions(c).collect()} == {r.loc: r.targets for r in PT.function_targets(PT.solve(c)).collect()}


def test_large_groups_hold_few_tables(spark, monkeypatch):
    """Tables of all rounds lay on disk until the last, and a set had a copy for each 2 million pairs."""
    held, write = [], PT.Scratch.write

    def counted(self, df):
        out = write(self, df)
        held.append(len(self.paths))
        return out

    monkeypatch.setattr(PT.Scratch, "write", counted)
    chain = [("AddressOf", "c0", "t", None)] + [("Copy", f"c{i + 1}", f"c{i}", None) for i in range(9)]
    c = spark.createDataFrame(chain, "kind string, dest string, src string, field string").withColumn("file", PT.F.lit("a"))
    assert {(r.loc, r.target) for r in PT.solve(c, by=("file",), group_limit=0).collect()} == {(f"c{i}", "t") for i in range(10)}
    assert len(held) > 25 and max(held) < 12
    locations = spark.range(50).selectExpr("0L g", "'v' v", "string(id) loc", "10 size")
    monkeypatch.setattr(PT, "TASK_PAIRS", 1)
    assert [r.parts for r in PT._parts(locations, 2).collect()] == [2 * PT.PARTS]


def test_functions_as_text(spark):
    """Names were joined once more for each location that shares a set."""
    c = spark.createDataFrame([("AddressOf", "p", "f2", None), ("AddressOf", "p", "f1", None), ("AddressOf", "p", "alloc:3", None), ("Copy", "q", "p", None), ("AddressOf", "r", "alloc:3", None)], "kind string, dest string, src string, field string")
    for limit in (0, 100):
        assert {r.loc: r.targets for r in PT.solve_functions(c, group_limit=limit, joined=",").collect()} == {"p": "f1,f2", "q": "f1,f2"}


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert PT.solve(empty.drop("file")).collect() == [] and PT.solve(empty, by=("file",)).collect() == []


def test_components(spark, tmp_path):
    """Locations that only a field connects belong together; a long chain is one component."""
    rows = [("Copy", f"c{i}", f"c{i + 1}", None) for i in range(60)] + [("Copy", "x", "s.f.g", None), ("AddressOf", "y", "s", None), ("AddressOf", "lone", "t", None)]
    with PT.Scratch(spark) as scratch:
        got = PT._with_components(spark.createDataFrame(rows, "kind string, dest string, src string, field string"), scratch, 100)
        groups = {}
        for r in got.collect():
            groups.setdefault(r[PT.GROUP], set()).add(r.dest)
    assert sorted(map(sorted, groups.values())) == sorted([sorted({f"c{i}" for i in range(60)}), ["lone"], ["x", "y"]])
