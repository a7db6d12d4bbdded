"""Symbolic values, intervals and the compiler of C-like expressions to columns.

A value is struct<tag, i, b, s, is_null, min, max>; tag is one of Integer, Bool, String, Pointer, Range, Unknown.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<tag:string,i:bigint,b:boolean,s:string,is_null:boolean,min:bigint,max:bigint>"


def value(tag: Column | str, i=None, b=None, s=None, is_null=None, lo=None, hi=None) -> Column:
    """A value struct from its tag and payload columns."""
    put = lambda x, t: (F.lit(None) if x is None else x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        (F.lit(tag) if isinstance(tag, str) else tag).alias("tag"), put(i, "bigint").alias("i"), put(b, "boolean").alias("b"), put(s, "string").alias("s"),
        put(is_null, "boolean").alias("is_null"), put(lo, "bigint").alias("min"), put(hi, "bigint").alias("max"),
    )


def literal(row) -> Column:
    """A value that was computed before, as a constant."""
    return value(row.tag, i=row.i, b=row.b, s=row.s, is_null=row.is_null, lo=row.min, hi=row.max)


UNKNOWN = lambda: value("Unknown")


def parse_int(text: Column) -> Column:
    """Decimal, 0x and 0b integers; null for all else."""
    t = F.trim(text)
    digits = F.regexp_extract(t, r"^0[xXbB](.*)$", 1)
    return (
        F.when(t.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(digits, 16, 10).try_cast("bigint"))
        .when(t.rlike(r"^0[bB][01]{1,62}$"), F.conv(digits, 2, 10).try_cast("bigint"))
        .when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))
    )


def parse_symbolic(text: Column, hint: Column) -> Column:
    """Text of a binding to a value: pointers by hint, a..b, integers, strings."""
    t = F.trim(text)
    lo, hi = parse_int(F.substring_index(t, "..", 1)), parse_int(F.regexp_extract(t, r"^.*?\.\.(.*)$", 1))
    quoted = t.startswith('"') & t.endswith('"') & (F.length(t) >= 2)
    return (
        F.when(hint == "pointer", value("Pointer", is_null=F.lower(t).isin("null", "0", "nullptr")))
        .when(t.contains("..") & lo.isNotNull() & hi.isNotNull(), value("Range", lo=lo, hi=hi))
        .when(parse_int(t).isNotNull(), value("Integer", i=parse_int(t)))
        .otherwise(value("String", s=F.when(quoted, F.substring(t, 2, 2**31 - 1).substr(F.lit(1), F.length(t) - 2)).otherwise(t)))
    )


def display(v: Column) -> Column:
    """How a value is shown: integers over 255 in hex (E12). The value is computed once."""
    return F.get(F.transform(F.array(v), _shown), 0)


def _shown(v: Column) -> Column:
    return (
        F.when(v["tag"] == "Integer", F.when(v["i"] > 255, F.concat(F.lit("0x"), F.lower(F.hex(v["i"])))).otherwise(v["i"].cast("string")))
        .when(v["tag"] == "String", F.concat(F.lit('"'), v["s"], F.lit('"')))
        .when(v["tag"] == "Pointer", F.when(v["is_null"], "NULL").when(v["i"].isNotNull(), F.concat(F.lit("<ptr: "), v["i"].cast("string"), F.lit(" bytes>"))).otherwise("<valid ptr>"))
        .when(v["tag"] == "Range", F.concat(v["min"].cast("string"), F.lit(".."), v["max"].cast("string")))
        .when(v["tag"] == "Bool", v["b"].cast("string"))
        .otherwise(F.lit("?"))
    )


def range_compare(lo: Column, hi: Column, op: Column, x: Column) -> Column:
    """[lo, hi] op x: AlwaysTrue, AlwaysFalse or Unknown."""
    only, out = (lo == hi) & (lo == x), (x < lo) | (x > hi)
    cases = {"<": (hi < x, lo >= x), "<=": (hi <= x, lo > x), ">": (lo > x, hi <= x), ">=": (lo >= x, hi < x), "==": (only, out), "!=": (out, only)}
    r = F.lit("Unknown")
    for k, (yes, no) in cases.items():
        r = F.when(op == k, F.when(yes, "AlwaysTrue").when(no, "AlwaysFalse").otherwise("Unknown")).otherwise(r)
    return r


def truthy(v: Column) -> Column:
    """True, false, or null where unknown."""
    return _Payload.of(v).truth()


class _Payload:
    """A value under compilation: a column for each type it can have (null where it has another), None for the others.

    Types that are ruled out take no part in what is built on top, so a compiled expression grows with its text only.
    """

    def __init__(self, i: Column | None = None, b: Column | None = None, p: Column | None = None, s: Column | None = None):
        self.i, self.b, self.p, self.s = i, b, p, s

    @staticmethod
    def of(v: Column) -> _Payload:
        only = lambda tag, f: F.when(v["tag"] == tag, v[f])
        return _Payload(only("Integer", "i"), only("Bool", "b"), only("Pointer", "is_null"), only("String", "s"))

    def int(self) -> Column:
        parts = [] if self.i is None else [self.i]
        parts += [] if self.b is None else [self.b.cast("bigint")]
        return F.coalesce(*parts) if parts else F.lit(None).cast("bigint")

    def truth(self) -> Column:
        parts = [] if self.i is None else [self.i != 0]
        parts += [] if self.b is None else [self.b]
        parts += [] if self.p is None else [~self.p]
        parts += [] if self.s is None else [self.s != ""]
        return F.coalesce(*parts) if parts else F.lit(None).cast("boolean")

    def null_flag(self) -> Column | None:
        """Of a pointer, or true for the integer 0."""
        parts = [] if self.p is None else [self.p]
        parts += [] if self.i is None else [F.when(self.i == 0, F.lit(True))]
        return F.coalesce(*parts) if parts else None

    def value(self) -> Column:
        out = UNKNOWN()
        for tag, field, c in (("String", "s", self.s), ("Pointer", "is_null", self.p), ("Bool", "b", self.b), ("Integer", "i", self.i)):
            if c is not None:
                out = F.when(c.isNotNull(), value(tag, **{field: c})).otherwise(out)
        return out


def _compare(op: str, a: _Payload, b: _Payload) -> _Payload:
    """Integers by value, pointers by null flag with == and !=, a pointer against 0; all else is unknown."""
    x, y = a.int(), b.int()
    plain = {"==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    u, w = a.null_flag(), b.null_flag()
    if op not in ("==", "!=") or u is None or w is None or (a.p is None and b.p is None):
        return _Payload(b=plain)
    same = u == w
    return _Payload(b=F.coalesce(plain, same if op == "==" else ~same))


#: Binary operators, loosest first; each splits at its right-most place outside parentheses.
LEVELS = ["||", "&&", "==", "!=", "<=", ">=", "<<", ">>", "<", ">", "|", "^", "&", "+", "-", "*", "/", "%"]
_NAME = re.compile(r"[A-Za-z_](?:[A-Za-z0-9_.]|->)*$")


def _wrapped(e: str) -> bool:
    """One pair of parentheses spans the whole text."""
    depth = 0
    for i, ch in enumerate(e):
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if depth == 0 and i < len(e) - 1:
            return False
    return e.startswith("(") and e.endswith(")")


def _part_of_longer(e: str, i: int, op: str) -> bool:
    before, after = e[i - 1 : i], e[i + len(op) : i + len(op) + 1]
    if op in "|&" and len(op) == 1:
        return op in (before, after)
    if op == "<":
        return "<" in (before, after) or after == "="
    if op == ">":
        return ">" in (before, after) or before == "-" or after == "="
    return op == "-" and after == ">"


def _split(e: str, op: str) -> tuple[str, str] | None:
    depth = 0
    for i in range(len(e) - len(op), -1, -1):
        if e[i] == ")":
            depth += 1
        elif e[i] == "(":
            depth -= 1
        elif depth == 0 and e.startswith(op, i) and not _part_of_longer(e, i, op) and e[:i] and e[i + len(op) :]:
            return e[:i], e[i + len(op) :]
    return None


class Expression:
    """A C-like expression compiled to a column over bindings.

    bindings: name -> value column.  Names are looked up as written, with -> as a dot, and by their last members; of
    several of those the smallest name counts.
    """

    def __init__(self, bindings: dict[str, Column]):
        self.bindings = bindings

    def lookup(self, path: str) -> Column | None:
        dotted = path.replace("->", ".")
        for name in (path, dotted):
            if name in self.bindings:
                return self.bindings[name]
        near = sorted(k for k in self.bindings if (n := k.replace("->", ".")) == dotted or n.endswith(f".{path}"))
        return self.bindings[near[0]] if near else None

    def compile(self, text: str) -> _Payload:
        e = text.strip()
        if not e:
            return _Payload()
        if _wrapped(e):
            return self.compile(e[1:-1])
        if _NAME.match(e) and (v := self.lookup(e)) is not None:
            return self.bound(v)
        for op in LEVELS:
            if parts := _split(e, op):
                return self.binary(op, self.compile(parts[0]), self.compile(parts[1]))
        if e[0] in "!~-" and len(e) > 1 and not re.fullmatch(r"-\d+", e):
            v = self.compile(e[1:])
            if e[0] == "!":
                return _Payload(b=~v.truth())
            return _Payload(i=F.bitwise_not(v.int()) if e[0] == "~" else -v.int())
        return self.atom(e)

    @staticmethod
    def bound(v: Column) -> _Payload:
        out = _Payload.of(v)
        total = v["min"] + v["max"]
        middle = F.signum(total).cast("bigint") * F.floor(F.abs(total) / 2).cast("bigint")
        out.i = F.when(v["tag"] == "Range", middle).otherwise(out.i)
        return out

    def binary(self, op: str, a: _Payload, b: _Payload) -> _Payload:
        if op in ("||", "&&"):
            x, y = a.truth(), b.truth()
            return _Payload(b=(x | y) if op == "||" else (x & y))
        if op in ("==", "!=", "<=", ">=", "<", ">"):
            return _compare(op, a, b)
        x, y = a.int(), b.int()
        if op in ("<<", ">>"):
            return _Payload(i=F.call_function("shiftleft" if op == "<<" else "shiftright", x, y.cast("int")))
        if op in "/%":
            whole = F.call_function("div", x, F.nullif(y, F.lit(0))) if op == "/" else x % F.nullif(y, F.lit(0))
            return _Payload(i=F.when((y == 0) & x.isNotNull(), F.lit(0).cast("bigint")).otherwise(whole))
        return _Payload(i={"|": x.bitwiseOR(y), "^": x.bitwiseXOR(y), "&": x.bitwiseAND(y), "+": x + y, "-": x - y, "*": x * y}[op])

    def atom(self, e: str) -> _Payload:
        long = lambda n: _Payload(i=F.lit(n).cast("bigint"))
        if e.lower() == "null" or e == "nullptr":
            return _Payload(p=F.lit(True))
        if e in ("true", "false"):
            return _Payload(b=F.lit(e == "true"))
        for prefix, base in (("0x", 16), ("0b", 2)):
            if e.lower().startswith(prefix):
                try:
                    return long(int(e[2:], base))
                except ValueError:
                    break
        if re.fullmatch(r"[+-]?\d+", e):
            return long(int(e))
        if len(e) >= 2 and e[0] == e[-1] == '"':
            return _Payload(s=F.lit(e[1:-1]))
        v = self.lookup(e)
        return _Payload() if v is None else self.bound(v)


def evaluate(text: str, bindings: dict[str, Column]) -> Column:
    return Expression(bindings).compile(text).value()


def branch(text: str, bindings: dict[str, Column]) -> Column:
    """AlwaysTrue, AlwaysFalse or Unknown of a condition, with the checks for what can't be evaluated."""
    e = Expression(bindings)
    known = e.compile(text).truth()
    rest = F.lit("Unknown")
    if m := re.match(r"^(.*?)(<=|>=|==|!=|<|>)(.*)$", text):
        v, x = e.lookup(m[1].strip()), m[3].strip()
        if v is not None and re.fullmatch(r"-?\d+|0x[0-9a-fA-F]+", x):
            n = F.lit(int(x, 0) if x.startswith("0x") else int(x)).cast("bigint")
            rest = F.when(v["tag"] == "Range", range_compare(v["min"], v["max"], F.lit(m[2]), n)).otherwise(rest)
    return F.when(known, "AlwaysTrue").when(~known, "AlwaysFalse").otherwise(rest)


def _null_state(v: Column, exact: bool) -> Column:
    """1 for a value that is null, 0 for one that is not, 2 where that can't be told; of integers found by another form of their name only 0 can be told."""
    flag = Expression.bound(v).null_flag()
    if exact:
        flag = F.coalesce(flag, F.when(v["tag"] == "Integer", v["i"] == 0))
    return F.coalesce(flag.cast("int"), F.lit(2))


def null_check(path: Column, negated: Column, bindings: dict[str, Column]) -> Column:
    """AlwaysTrue, AlwaysFalse or Unknown of "path == NULL" (negated: !=) for a path in each row.

    The path is looked up as in expressions; the bindings are few and known, so each is one comparison.
    """
    dotted = F.replace(path, F.lit("->"), F.lit("."))
    suffix = F.concat(F.lit("."), path)
    names = {k: k.replace("->", ".") for k in bindings}
    found = [F.when(path == k, _null_state(v, True)) for k, v in bindings.items()] + [F.when(dotted == k, _null_state(v, False)) for k, v in bindings.items()]
    found += [F.when((dotted == names[k]) | F.lit(names[k]).endswith(suffix), _null_state(bindings[k], False)) for k in sorted(bindings)]
    if not found:
        return F.lit("Unknown")
    state = F.coalesce(*found, F.lit(2))
    holds = F.when(negated, F.lit(0)).otherwise(F.lit(1))
    return F.when(state == 2, "Unknown").when(state == holds, "AlwaysTrue").otherwise("AlwaysFalse")


def set_values(state: Column, changes: dict[str, Column]) -> Column:
    """A state (map of values) with some variables set."""
    new = F.map_from_arrays(F.array(*(F.lit(k) for k in changes)), F.array(*changes.values()))
    kept = F.map_filter(state, lambda k, _: ~k.isin(list(changes)))
    return F.map_concat(kept, new)


def condition_of_name(name: Column) -> Column:
    """Condition that a node's name stands for, null if none."""
    strip = lambda parts: reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), parts, name)
    hinted = name.contains("if_") | name.contains("_check")
    return (
        F.when(~hinted, F.lit(None).cast("string"))
        .when(name.contains("_null"), F.concat(strip(["if_", "_null", "_check"]), F.lit(" == NULL")))
        .when(name.contains("_valid"), F.concat(strip(["if_", "_valid", "_not_null", "_check"]), F.lit(" != NULL")))
    )
