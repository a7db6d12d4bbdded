"""Inclusion-based points-to analysis.

constraints(kind, dest, src, field): AddressOf, Copy, Load, Store, FieldLoad, FieldStore, ArrayLoad, ArrayStore.
Elements of an array share the location name[].  Where `by` names columns, each of their values (each file, say) is
analysed on its own.

Groups of constraints that no location connects are independent.  A group of at most ``group_limit`` constraints is
solved in one task, by a worklist over bitmaps; larger ones together by a fixpoint of joins over distinct sets.  Without `by` the groups are
the connected components of the constraints, found by joins, unless all of them together are within the limit.
"""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runpath import fixed
from runpath.functions import text as T
from runpath.operators.storage import Scratch, shuffles_go

Keys = tuple[str, ...]

#: Constraints of a group that one task solves; some hundred bytes of memory each, besides its result.
GROUP_LIMIT = 200_000

GROUP = "__group"

#: The bits set in each byte.
_BITS = [[bit for bit in range(8) if byte >> bit & 1] for byte in range(256)]

log = logging.getLogger(__name__)


def lower_arrays(constraints: DataFrame, by: Keys = ()) -> DataFrame:
    """Array loads and stores as copies of the element location (G6d, G6e)."""
    dest = F.when(F.col("kind") == "ArrayStore", F.concat("dest", F.lit("[]"))).otherwise(F.col("dest"))
    src = F.when(F.col("kind") == "ArrayLoad", F.concat("src", F.lit("[]"))).otherwise(F.col("src"))
    kind = F.when(F.col("kind").isin("ArrayStore", "ArrayLoad"), "Copy").otherwise(F.col("kind"))
    return constraints.select(*by, kind.alias("kind"), dest.alias("dest"), src.alias("src"), "field")


def solve(constraints: DataFrame, functions: DataFrame | None = None, max_rounds: int = fixed.SOLVER_ROUNDS, by: Keys = (), group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(*by, loc, target), all pairs that follow (G6, U5, D10); functions(*by, name), if given, point to themselves."""
    pairs, large = _solved(constraints, functions, max_rounds, by, group_limit)
    if large is None:
        return pairs
    return pairs.unionByName(_of_locations(*large).select(*_columns(by), "loc", F.explode("targets").alias("target")))


def solve_functions(constraints: DataFrame, functions: DataFrame | None = None, max_rounds: int = fixed.SOLVER_ROUNDS, by: Keys = (), group_limit: int = GROUP_LIMIT, joined: str | None = None) -> DataFrame:
    """(*by, loc, targets): function_targets() of solve(), with `joined` as texts of names with that between them; of large groups, each distinct set is looked at once."""
    whole = lambda rows: rows if joined is None else rows.withColumn("targets", F.array_join("targets", joined))
    pairs, large = _solved(constraints, functions, max_rounds, by, group_limit)
    found = whole(function_targets(pairs, by))
    if large is None:
        return found
    locations, sets = large
    kept = sets.withColumn("targets", F.array_sort(F.filter("targets", T.is_function_target))).where(F.size("targets") > 0)
    return found.unionByName(_of_locations(locations, whole(kept)).select(*_columns(by), "loc", "targets"))


def _columns(by: Keys) -> list:
    return [F.col(GROUP)[b].alias(b) for b in by]


def _solved(constraints: DataFrame, functions: DataFrame | None, max_rounds: int, by: Keys, group_limit: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(*by, loc, target) of groups that are within the limit, and locations and sets of larger ones, if there are any."""
    with Scratch(constraints.sparkSession) as scratch:
        rows = lower_arrays(constraints, by)
        if functions is not None:
            rows = rows.union(functions.select(*by, F.lit("AddressOf"), "name", "name", F.lit(None).cast("string")))
        c = scratch.write(rows.distinct())
        if by:  # in a struct, null is a value like others
            c = c.select(F.struct(*by).alias(GROUP), "kind", "dest", "src", "field")
        else:
            c = c.withColumn(GROUP, F.lit("")) if c.count() <= group_limit else scratch.write(_with_components(c, scratch, max_rounds))
        large = scratch.write(c.groupBy(GROUP).count().where(F.col("count") > group_limit).select(GROUP))
        kept = lambda found: scratch.keep(found.select(*_columns(by), "loc", "target"))
        if large.isEmpty():
            return kept(solve_in_tasks(c)), None
        with shuffles_go(constraints.sparkSession):
            return kept(solve_in_tasks(c.join(large, GROUP, "left_anti"))), _solve_by_sets(c.join(large, GROUP, "left_semi"), max_rounds, scratch)


# -- one task for each group ------------------------------------------------------------------------------------------
class Worklist:
    """Difference propagation over the constraints of one group.

    What a location may point to is a bitmap over numbered locations.  A location that has gained targets is worked on
    with these alone: loads and stores through it, each of which knows the targets it has met, add edges between
    locations, along which whole bitmaps go.  Whenever there are twice as many edges as before, the locations of each
    cycle become one, as they point to the same.
    """

    def __init__(self, constraints: Iterable[tuple[str, str, str, str | None]]):
        """constraints: (kind, dest, src, field)."""
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.parent: list[int] = []
        self.points: list[int] = []
        self.gained: list[int] = []
        self.edges: list[set[int]] = []
        #: Loads and stores through a location: (is a load, field, other side) -> targets met.
        self.through: list[dict[tuple[bool, str | None, int], int]] = []
        self.work: deque[int] = deque()
        self.n_edges, self.next_collapse = 0, 0
        self.add(constraints)

    def add(self, constraints: Iterable[tuple[str, str, str, str | None]]) -> None:
        """Constraints to go on with; what is known already goes along them, too."""
        for kind, dest_name, src_name, field in constraints:
            dest, src = self.find(self.at(dest_name)), self.find(self.at(src_name))
            if kind == "AddressOf":
                self.gain(dest, 1 << self.number[src_name])
            elif kind == "Copy":
                self.edges[src].add(dest)
                self.gain(dest, self.points[src])
            elif kind in ("Load", "FieldLoad"):
                self.meets(src, (True, field if kind == "FieldLoad" else None, dest))
            elif kind in ("Store", "FieldStore"):
                self.meets(dest, (False, field if kind == "FieldStore" else None, src))
        self.collapse()

    def meets(self, n: int, key: tuple[bool, str | None, int]) -> None:
        """A load or store through n, which has met no target."""
        if key not in self.through[n]:
            self.through[n][key] = 0
            if self.points[n]:
                if not self.gained[n]:
                    self.work.append(n)
                self.gained[n] |= self.points[n]

    def at(self, name: str) -> int:
        n = self.number.get(name)
        if n is None:
            n = self.number[name] = len(self.names)
            self.names.append(name)
            self.parent.append(n)
            self.points.append(0)
            self.gained.append(0)
            self.edges.append(set())
            self.through.append({})
        return n

    def find(self, n: int) -> int:
        while self.parent[n] != n:
            self.parent[n] = self.parent[self.parent[n]]
            n = self.parent[n]
        return n

    def gain(self, n: int, targets: int) -> bool:
        new = targets & ~self.points[n]
        if new:
            self.points[n] |= new
            if not self.gained[n]:
                self.work.append(n)
            self.gained[n] |= new
        return bool(new)

    def connect(self, src: int, dest: int) -> None:
        src, dest = self.find(src), self.find(dest)
        if src != dest and dest not in self.edges[src]:
            self.edges[src].add(dest)
            self.n_edges += 1
            self.gain(dest, self.points[src])

    def run(self) -> None:
        while self.work:
            n = self.work.popleft()
            if self.parent[n] != n or not self.gained[n]:
                continue
            new, self.gained[n] = self.gained[n], 0
            for key, met in [*self.through[n].items()]:
                load, field, other = key
                fresh = self.points[n] & ~met
                self.through[n][key] = met | fresh
                for t in bits(fresh):
                    place = t if field is None else self.at(f"{self.names[t]}.{field}")
                    if load:
                        self.connect(place, other)
                    else:
                        self.connect(other, place)
            for dest in list(self.edges[n]):
                to = self.find(dest)
                if to != n:
                    self.gain(to, new)
            if self.n_edges > self.next_collapse:
                self.collapse()

    def collapse(self) -> None:
        """Make one location of those of each strongly connected component of the edges (Tarjan's algorithm, without recursion)."""
        order: dict[int, int] = {}
        low: dict[int, int] = {}
        held: list[int] = []
        on: set[int] = set()
        for root in range(len(self.names)):
            if self.parent[root] != root or root in order:
                continue
            calls = [(root, iter(()))]
            while calls:
                n, successors = calls[-1]
                if n not in order:
                    order[n] = low[n] = len(order)
                    held.append(n)
                    on.add(n)
                    self.edges[n] = {to for e in self.edges[n] if (to := self.find(e)) != n}
                    successors = iter([*self.edges[n]])
                    calls[-1] = n, successors
                for to in successors:
                    if to not in order:
                        calls.append((to, iter(())))
                        break
                    if to in on:
                        low[n] = min(low[n], order[to])
                else:
                    calls.pop()
                    if calls:
                        low[calls[-1][0]] = min(low[calls[-1][0]], low[n])
                    if low[n] == order[n]:
                        same = [held.pop()]
                        while same[-1] != n:
                            same.append(held.pop())
                        on.difference_update(same)
                        if len(same) > 1:
                            self.merge(same)
        self.n_edges = sum(len(e) for e in self.edges)
        self.next_collapse = 2 * self.n_edges + 1000

    def merge(self, same: list[int]) -> None:
        """Make one of locations that point to the same in the end."""
        n = same[0]
        for at in same[1:]:
            self.parent[at] = n
            self.edges[n] |= self.edges[at]
            self.points[n] |= self.points[at]
            for key, met in self.through[at].items():
                self.through[n][key] = self.through[n].get(key, met) & met
            self.edges[at], self.through[at], self.gained[at] = set(), {}, 0
        self.edges[n] -= set(same)
        self.gained[n] = self.points[n]  # an edge of one may not have seen what the others have
        self.work.append(n)

    def pairs(self, seen: dict[int, int] | None = None, last: bool = True) -> Iterator[tuple[int, list[int]]]:
        """(location, targets) by number; with seen, what each location had at the last call, only those that came since."""
        known: dict[tuple[int, int], list[int]] = {}
        for n in range(len(self.names)):
            at, before = self.find(n), seen.get(n, 0) if seen else 0
            if (at, before) not in known:
                known[at, before] = [*bits(self.points[at] & ~before)]
            yield n, known[at, before]
            if not last:
                seen[n] = self.points[at]


def bits(mask: int) -> Iterator[int]:
    """The numbers of the bits that are set."""
    for at, byte in enumerate(mask.to_bytes((mask.bit_length() + 7) // 8, "little")):
        if byte:
            for bit in _BITS[byte]:
                yield at * 8 + bit


def solve_in_tasks(constraints: DataFrame) -> DataFrame:
    """(group, loc, target): each group in the task that holds it.  With a column `level`, also the level at which a pair comes, where each goes on from those below."""
    leveled = "level" in constraints.columns
    level = F.col("level") if leveled else F.lit(0).alias("level")
    lists = constraints.groupBy(GROUP).agg(F.collect_list(F.struct("kind", "dest", "src", "field", level)).alias("__c"))
    kind = constraints.schema[GROUP].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("__c")
            rows, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            parts = [rows.field(c).to_pylist() for c in ("kind", "dest", "src", "field", "level")]
            # Names of several groups back to back; a pair is two numbers of names.
            names, groups, locs, targets, levels = [], [], [], [], []
            for i in range(b.num_rows):
                by_level: dict[int, list[tuple]] = {}
                for *c, n in zip(*(p[ends[i] : ends[i + 1]] for p in parts), strict=True):
                    by_level.setdefault(n, []).append(tuple(c))
                w, base, seen = Worklist(()), len(names), {}
                for at in sorted(by_level):
                    w.add(by_level[at])
                    w.run()
                    last = at == max(by_level)
                    names += w.names[len(names) - base :]
                    for n, found in w.pairs(seen if leveled else None, last):
                        groups += [i] * len(found)
                        locs += [base + n] * len(found)
                        targets += [base + t for t in found]
                        levels += [at] * len(found)
                        if len(locs) > 200_000:
                            yield made(b, groups, names, locs, targets, levels)
                            groups, locs, targets, levels = [], [], [], []
            yield made(b, groups, names, locs, targets, levels)

    def made(b: pa.RecordBatch, groups: list[int], names: list[str], locs: list[int], targets: list[int], levels: list[int]) -> pa.RecordBatch:
        known = pa.array(names, pa.string())
        columns = [b.column(GROUP).take(pa.array(groups, pa.int32())), known.take(pa.array(locs, pa.int32())), known.take(pa.array(targets, pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(levels, pa.int32())] if leveled else columns, names=[GROUP, "loc", "target", "level"][: 3 + leveled])

    return lists.mapInArrow(run, f"{GROUP} {kind}, loc string, target string" + ", level int" * leveled)


# -- joins ------------------------------------------------------------------------------------------------------------
def _with_components(c: DataFrame, scratch: Scratch, max_rounds: int) -> DataFrame:
    """Constraints with their group, the least location that they are connected with; a field's location goes with what it is a field of.

    Labels only fall: each round takes the least label around a location, then the label of that label's location.
    """
    base = lambda n: F.when(F.col(n).contains("."), F.regexp_extract(n, r"^(.*)\.[^.]*$", 1))
    links = c.select(F.col("dest").alias("a"), F.col("src").alias("b"))
    names = links.select("a").union(links.select("b")).distinct()
    of_fields = names.where(F.col("a").contains(".")).select("a", base("a").alias("b"))
    # Fields of fields: every shorter name is a location too.
    chain = names.where(F.col("a").contains(".")).select(F.split("a", r"\.").alias("p")).select(F.explode(F.transform(F.sequence(F.lit(2), F.size("p")), lambda n: F.struct(F.array_join(F.slice("p", 1, n), ".").alias("a"), F.array_join(F.slice("p", 1, n - 1), ".").alias("b")))).alias("l")).select("l.a", "l.b")
    links = scratch.write(links.union(of_fields).union(chain).distinct())
    both = scratch.write(links.union(links.select("b", "a")).where("a <> b").distinct())
    label = scratch.write(both.select("a").union(names).distinct().select("a", F.col("a").alias("g")))
    for n in range(max_rounds):
        around = both.join(label.withColumnsRenamed({"a": "b"}), "b").groupBy("a").agg(F.min("g").alias("m"))
        lower = label.join(around, "a", "left").select("a", "g", F.least("g", F.coalesce("m", "g")).alias("m"))
        lower = scratch.write(lower)
        jump = lower.select(F.col("a").alias("m"), F.col("m").alias("j"))
        label = scratch.write(lower.join(jump, "m", "left").select("a", F.col("g").alias("old"), F.least("m", F.coalesce("j", "m")).alias("g")))
        moved = label.where("old <> g").count()
        log.info("components, round %d: %d labels fell", n + 1, moved)
        if not moved:
            break
        label = label.drop("old")
    return c.join(label.select(F.col("a").alias("dest"), F.col("g").alias(GROUP)), "dest")


#: Targets of one block: the pointers that hold some of them meet what these point to in one task.
BLOCK = 256
#: Pairs that one task makes of a set that many locations share, about, ...
TASK_PAIRS = 2_000_000
#: ... while there are at most so many parts of a set for each shuffle partition: each part has a copy of the set.
PARTS = 4


def _number(bits: bytes) -> int:
    return int.from_bytes(bits, "little")


def _bytes(mask: int) -> bytes:
    return mask.to_bytes((mask.bit_length() + 7) // 8, "little")


def _either(rows: DataFrame, *key: str, first: bool = False) -> DataFrame:
    """(*key, bits, size): the union of the sets of each key, with its number of targets; first: for keys of very many rows, each task unites what it has."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in key), "bits binary, size int"])

    def made(found: dict[tuple, int]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), arrow, strict=True)] if found else [pa.array([], t) for t in arrow]
        return pa.RecordBatch.from_arrays([*columns, pa.array(map(_bytes, found.values()), pa.binary()), pa.array([m.bit_count() for m in found.values()], pa.int32())], names=[*key, "bits", "size"])

    arrow = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[types[k]] for k in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys come in order, or in any order where a key may come again."""
        found: dict[tuple, int] = {}
        for b in batches:
            for *k, bits in zip(*(b.column(c).to_pylist() for c in (*key, "bits")), strict=True):
                at = tuple(k)
                found[at] = found.get(at, 0) | _number(bits)
            if len(found) > 2000:
                last = found.popitem() if at == next(reversed(found)) else None
                yield made(found)
                found = dict([last]) if last else {}
        yield made(found)

    rows = rows.select(*key, "bits")
    return (rows.mapInArrow(run, schema) if first else rows).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _in_blocks(sets: DataFrame) -> DataFrame:
    """sets(g, v, field, bits, given) to a row for each block of targets that a set has some of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BLOCK // 8
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                out = []
                for g, v, field, members, given in zip(*(c.to_pylist() for c in b.slice(lo, 200).columns), strict=True):
                    out += [(g, at // width, 1, None, v, field, part, given) for at in range(0, len(members), width) if any(part := members[at : at + width])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _BLOCK_TYPES, strict=True)], names=_BLOCK_NAMES)

    return sets.select("g", "v", "field", "bits", "given").mapInArrow(run, _BLOCK_ROW)


_BLOCK_ROW = "g bigint, block bigint, kind int, n bigint, v string, field string, bits binary, given binary"
_BLOCK_NAMES = ["g", "block", "kind", "n", "v", "field", "bits", "given"]
_BLOCK_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n, v, field, bits) of blocks that come in order, places (kind 0) before sets (kind 1).

    With v: what places of the set point to, of this block; with n: what is stored to a place.
    """
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["g", "n", "v", "field", "bits"]
    now, places, stored = None, {}, {}

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=names)

    def done() -> Iterator[pa.RecordBatch]:
        rows = [(now[0], n, None, field, _bytes(m)) for (field, n), m in stored.items()]
        for lo in range(0, len(rows), 2000):
            yield made(rows[lo : lo + 2000])

    for b in batches:
        out = []
        for g, block, kind, n, v, field, members, given in zip(*(b.column(c).to_pylist() for c in _BLOCK_NAMES), strict=True):
            if now != (g, block):
                if now:
                    yield from done()
                now, places, stored = (g, block), {}, {}
            if kind == 0:
                places[field, n] = _number(members)
                continue
            union, new = 0, _number(given) if given else 0
            for bit in bits(_number(members)):
                at = field, block * BLOCK + bit
                union |= places.get(at, 0)
                if new:
                    stored[at] = stored.get(at, 0) | new
            if union:
                out.append((g, None, v, field, _bytes(union)))
            if len(out) >= 2000:
                yield made(out)
                out = []
        yield made(out)
    if now:
        yield from done()


def _solve_by_sets(c: DataFrame, max_rounds: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Large groups: locations (group, loc, v, size) with the key v of their set, and sets (group, v, targets), by a fixpoint of joins.

    A location has a bitmap over the numbered targets of its group.  A load or store goes by the set of its pointer, so what
    all places of a set point to, and what is stored through a set, is found once for each distinct set, block by block of targets.
    """
    groups = scratch.write(c.select(GROUP).distinct().withColumn("g", F.monotonically_increasing_id()))
    c = scratch.write(c.join(groups, GROUP).drop(GROUP))
    there = c.where("kind = 'AddressOf'").select("g", F.col("src").alias("name")).distinct()
    dealt = there.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(64)))
    place_in = F.row_number().over(Window.partitionBy("g", "part").orderBy("name"))
    targets = scratch.write(dealt.select("g", "name", ((place_in - 1) * 64 + F.col("part")).alias("n")))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("loc"), pa.array([_bytes(1 << n) for n in b.column("n").to_pylist()], pa.binary())], names=["g", "loc", "bits"])

    named = c.where("kind = 'AddressOf'").select("g", F.col("dest").alias("loc"), F.col("src").alias("name")).join(targets, ["g", "name"]).select("g", "loc", "n")
    own = scratch.write(_either(named.mapInArrow(one, "g bigint, loc string, bits binary"), "g", "loc"))
    copies = c.where("kind = 'Copy'").select("g", F.col("src").alias("loc"), "dest")
    whole = lambda kind: F.when(F.col("kind") != kind, F.col("field"))
    loads = c.where("kind in ('Load', 'FieldLoad')").select("g", F.col("src").alias("loc"), whole("Load").alias("field"), "dest")
    stores = c.where("kind in ('Store', 'FieldStore')").select("g", F.col("dest").alias("loc"), whole("Store").alias("field"), "src")
    # A location is a place itself, and at each of its dots a field of one.
    words, last = F.split("loc", r"\."), F.size(F.split("loc", r"\."))
    joined = lambda lo, n: F.array_join(F.slice(words, lo, n), ".")
    parts = F.when(last > 1, F.transform(F.sequence(F.lit(1), last - 1), lambda n: F.struct(joined(F.lit(1), n).alias("name"), joined(n + 1, last - n).alias("field"))))
    itself = F.array(F.struct(F.col("loc").alias("name"), F.lit(None).cast("string").alias("field")))
    pairs, start = None, len(scratch.paths) - 1
    for n in range(max_rounds):
        keyed = own.select("g", "loc", "bits", F.md5("bits").alias("v"))
        by_load = scratch.write(keyed.join(loads, ["g", "loc"]).select("g", "v", "field", "dest").distinct())
        values = keyed.join(stores, ["g", "loc"]).select("g", "v", "field", "src").distinct().join(own.select("g", F.col("loc").alias("src"), "bits"), ["g", "src"])
        given = _either(values, "g", "v", "field", first=True).select("g", "v", "field", F.col("bits").alias("given"))
        asked = by_load.select("g", "v", "field").distinct().withColumn("given", F.lit(None).cast("binary")).unionByName(given)
        sets = asked.join(keyed.dropDuplicates(["g", "v"]).select("g", "v", "bits"), ["g", "v"])
        places = own.select("g", "bits", F.explode(F.concat(itself, F.coalesce(parts, F.array().cast("array<struct<name:string,field:string>>")))).alias("p")).select("g", "bits", "p.name", "p.field").join(targets, ["g", "name"])
        held = places.select("g", F.expr(f"n div {BLOCK}").alias("block"), F.lit(0).alias("kind"), F.col("n").cast("bigint").alias("n"), F.lit(None).cast("string").alias("v"), "field", "bits", F.lit(None).cast("binary").alias("given"))
        met = scratch.write(held.union(_in_blocks(sets)).repartition("g", "block").sortWithinPartitions("g", "block", "kind").mapInArrow(_meet, "g bigint, n bigint, v string, field string, bits binary"))
        loaded = _either(met.where("v is not null"), "g", "v", "field").withColumn("field", F.coalesce("field", F.lit(""))).join(by_load.withColumn("field", F.coalesce("field", F.lit(""))), ["g", "v", "field"])
        stored = met.where("v is null").join(targets, ["g", "n"]).select("g", F.concat_ws(".", "name", "field").alias("loc"), "bits")
        copied = own.join(copies, ["g", "loc"]).select("g", F.col("dest").alias("loc"), "bits")
        every = own.select("g", "loc", "bits").union(copied).union(loaded.select("g", F.col("dest").alias("loc"), "bits")).union(stored)
        own = scratch.write(_either(every, "g", "loc"))
        scratch.drop(start, len(scratch.paths) - 1)  # what led to it
        before, pairs = pairs, own.agg(F.sum(F.col("size").cast("bigint"))).first()[0]
        log.info("points-to, round %d: %s pairs", n + 1, pairs)
        if pairs == before:
            break

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BLOCK // 8
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                out = [(g, v, at // width, [*bits(_number(some))]) for g, v, x in zip(*(part.column(k).to_pylist() for k in ("g", "v", "bits")), strict=True) for at in range(0, len(x), width) if any(some := x[at : at + width])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["g", "v", "block", "at"])

    keyed = own.where("size > 0").select("g", "loc", "bits", "size", F.md5("bits").alias("v"))
    # The names of a block of targets go to all that a set has of it at once: a row for each target of each set would fill the disk.
    names = targets.groupBy("g", F.expr(f"n div {BLOCK}").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("n") % BLOCK).cast("int"), "name"))).alias("names"))
    slots = names.select("g", "block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.col("names")[i]).alias("names"))
    members = keyed.dropDuplicates(["g", "v"]).select("g", "v", "bits").mapInArrow(numbers, "g bigint, v string, block bigint, at array<int>").join(slots, ["g", "block"])
    named = members.select("g", "v", F.transform("at", lambda i: F.col("names")[i]).alias("part"))
    lists = named.groupBy("g", "v").agg(F.flatten(F.collect_list("part")).alias("targets")).join(groups, "g")
    return scratch.keep(keyed.select("g", "loc", "v", "size")), scratch.keep(lists)


def _parts(locations: DataFrame, width: int) -> DataFrame:
    """(g, v, parts): in how many parts the locations of a set are dealt out."""
    wanted = F.ceil(F.sum(F.col("size").cast("bigint")) / F.lit(TASK_PAIRS))
    return locations.groupBy("g", "v").agg(F.least(wanted, F.lit(PARTS * width)).cast("int").alias("parts"))


def _of_locations(locations: DataFrame, sets: DataFrame) -> DataFrame:
    """(group, loc, targets); a set that many locations share is dealt out to many tasks with them."""
    width = int(locations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = _parts(locations, width)
    part = F.pmod(F.xxhash64("loc"), F.col("parts")).cast("int").alias("part")
    dealt = locations.join(parts, ["g", "v"]).select("g", "v", part, "loc")
    copies = sets.join(parts, ["g", "v"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # A number of partitions holds: they are small before the join, and would be put together.
    key = ["g", "v", "part"]
    return dealt.repartition(width, *key).join(copies.repartition(width, *key).hint("shuffle_hash"), key).select(GROUP, "loc", "targets")


#: How sure a kind of constraint is, best first: values that are named, members of structs, what goes through memory.
CERTAINTY = (("High", ("AddressOf", "Copy")), ("Medium", ("FieldLoad", "FieldStore")), ("Low", ("Load", "Store", "ArrayLoad", "ArrayStore")))


def with_confidence(constraints: DataFrame) -> DataFrame:
    """constraints with the confidence of their kind, where they have none of their own."""
    by_kind = F.when(F.lit(False), F.lit(""))
    for name, kinds in CERTAINTY:
        by_kind = by_kind.when(F.col("kind").isin(*kinds), name)
    own = F.col("confidence") if "confidence" in constraints.columns else F.lit(None).cast("string")
    return constraints.withColumn("confidence", F.coalesce(own, by_kind))


def solve_with_confidence(constraints: DataFrame, functions: DataFrame | None = None, by: Keys = (), group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(*by, loc, target, confidence): each pair with the confidence of its best derivation, which is that of its weakest constraint.

    A pair has a derivation of at least some confidence if it follows from the constraints of that confidence and better
    ones alone; so the solution of each level is found, and the best level at which a pair is there counts.
    """
    levels = [name for name, _ in CERTAINTY]
    named = lambda rows: rows.select(*by, "loc", "target", F.element_at(F.array(*(F.lit(x) for x in levels)), F.col("level") + 1).alias("confidence"))
    with Scratch(constraints.sparkSession) as scratch:
        level = F.array_position(F.array(*(F.lit(x) for x in levels)), F.col("confidence")).cast("int") - 1
        rows = with_confidence(constraints).select(*by, "kind", "dest", "src", "field", level.alias("level")).where("level >= 0")
        if functions is not None:
            rows = rows.union(functions.select(*by, F.lit("AddressOf"), "name", "name", F.lit(None).cast("string"), F.lit(0)))
        given = scratch.write(rows)
        lowered = lower_arrays(given, (*by, "level"))
        c = lowered.groupBy(*by, "kind", "dest", "src", "field").agg(F.min("level").alias("level"))
        c = c.select(F.struct(*by).alias(GROUP) if by else F.lit("").alias(GROUP), "kind", "dest", "src", "field", "level")
        large = scratch.write(c.groupBy(GROUP).count().where(F.col("count") > group_limit).select(GROUP))
        few = large.isEmpty()
        small = solve_in_tasks(c if few else c.join(large, GROUP, "left_anti"))
        found = small.select(*_columns(by), "loc", "target", "level")
        if not few:  # each level anew, of the groups that no task holds
            rest = given.withColumn(GROUP, F.struct(*by) if by else F.lit("")).join(large, GROUP, "left_semi").drop(GROUP)
            every = [solve(rest.where(F.col("level") <= n).drop("level"), by=by, group_limit=group_limit).withColumn("level", F.lit(n)) for n in range(len(levels))]
            found = found.unionByName(reduce(DataFrame.unionByName, every).groupBy(*by, "loc", "target").agg(F.min("level").alias("level")))
        return scratch.keep(named(found))


def function_targets(pts: DataFrame, by: Keys = ()) -> DataFrame:
    """(*by, loc, targets): what may be called through each location."""
    kept = pts.where(T.is_function_target("target"))
    return kept.groupBy(*by, "loc").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def constraint(kind: str, dest: str, src: str, field: str | None = None) -> tuple[str, str, str, str | None]:
    """One constraint as a row (M17); its kind is checked."""
    if kind not in ("AddressOf", "Copy", "Load", "Store", "FieldLoad", "FieldStore", "ArrayLoad", "ArrayStore"):
        raise ValueError(f"unknown constraint: {kind}")
    return kind, dest, src, field


def points_to_of(pts: DataFrame, location: str) -> DataFrame:
    """What one location may point to."""
    return pts.where(F.col("loc") == location).select("target")
