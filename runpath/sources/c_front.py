"""The C front end: files(path, content) to symbol and fact rows.

Each file is read by one task (mapInArrow over files, some at a time), as everything here is local to a file; whatever
relates files is a DataFrame operator.  How C is read, and what becomes of text that is no C, is told in c_reader.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runpath import fixed
from runpath.operators.storage import checkpoint
from runpath.sources.c_reader import NOT_CALLED, STORAGE, TAGS, Declared, Reader, is_attribute, is_word, walk


def _struct_body(r: Reader, brace: int) -> tuple[int, str] | None:
    """(struct word, name) of the body that a brace opens."""
    tag = r.tag_before(brace)
    if tag is None or r.tok[tag] != "struct":
        return None
    name = next((r.tok[k] for k in range(tag + 1, brace) if is_word(r.tok[k]) and not is_attribute(r.tok[k]) and r.tok[k] != "__attribute__"), "")
    return tag, name


def pointer_of(r: Reader, x: Declared) -> dict | None:
    """return_type and params (types) of a declared pointer to functions."""
    if not x.declarator.is_function_pointer:
        return None
    words = [w for w in x.words if w not in STORAGE and not is_attribute(w)]
    return {"return_type": r.pointed(" ".join(words), x.declarator.stars), "params": [t for _, t in r.parameters(x.declarator.params)]}


def fields(r: Reader, lo: int, hi: int) -> list[dict]:
    """Members of a struct body, those of unions and structs without a name among them."""
    out = []
    for a, b in r.parts(lo, hi, ";"):
        words, k, body = r.specifiers(a, b)
        if body and k >= b:
            if len(words) == 1 and words[0] in TAGS - {"enum"}:
                out += fields(r, *body)
            continue
        for x in r.declared(a, b)[0] if words else []:
            pointer, t = pointer_of(r, x), r.type_text(x.words, x.declarator)
            out.append({"name": x.declarator.named.name, "type_name": pointer["return_type"] if pointer else t, "is_pointer": "*" in t, "is_function_ptr": pointer is not None, "signature": t if pointer else None, "pointer": pointer})
    return out


def _functions(r: Reader) -> Iterator[tuple[dict, int, int]]:
    """(head, brace, token after the body) of functions; one that runs to the end of the file is an error instead."""
    for kind, first, brace, after in r.items():
        if kind == "function" and brace not in r.unclosed and (head := r.function_head(first, brace)):
            yield head, brace, after


def _names(r: Reader) -> set[str]:
    return {head["name"] for head, *_ in _functions(r)}


def definitions(text: str) -> tuple[list[dict], list[str]]:
    """Functions and structs with bodies, and what could not be read."""
    r = Reader(text)
    return read_definitions(r), r.errors


def read_definitions(r: Reader) -> list[dict]:
    found = []
    for brace in [k for k, t in enumerate(r.tok) if t == "{"]:
        s = _struct_body(r, brace)
        if s and s[1] and brace not in r.unclosed:
            first, end = s[0], r.close[brace]
            while first and r.tok[first - 1] in STORAGE | {"const"}:
                first -= 1
            refs = {r.tok[k + 1] for k in range(brace + 1, end - 1) if r.tok[k] == "struct" and is_word(r.tok[k + 1])}
            found.append({"kind": "struct", "name": s[1], "line": r.line(first), "end_line": r.line(r.after[brace] - 1), "fields": fields(r, brace + 1, end), "refs": sorted(refs - {s[1]})})
    for head, brace, after in _functions(r):
        end = min(r.close[brace], r.n - 1)
        brackets = [k for k, t in enumerate(r.tok[brace + 2 : end + 1], brace + 1) if t == "("]
        calls = {r.tok[k] for k in brackets if is_word(r.tok[k]) and r.tok[k] not in NOT_CALLED and r.tok[k - 1] not in (".", "->")}
        found.append({
            "kind": "function", "name": head["name"], "line": r.line(head["first"]), "end_line": r.line(after - 1), "return_type": head["return_type"],
            "params": [{"name": n, "type_name": t} for n, t in head["params"]], "attributes": head["attributes"], "calls": sorted(calls),
        })
    return sorted(found, key=lambda d: d["line"])


SYMBOLS = (
    "path string, kind string, name string, line int, end_line int, return_type string, params array<struct<name:string,type_name:string>>, attributes array<string>, calls array<string>, "
    "fields array<struct<name:string,type_name:string,is_pointer:boolean,is_function_ptr:boolean,signature:string>>, refs array<string>, error string"
)
_PARAMS = pa.list_(pa.struct([("name", pa.string()), ("type_name", pa.string())]))
_FIELDS = pa.list_(pa.struct([("name", pa.string()), ("type_name", pa.string()), ("is_pointer", pa.bool_()), ("is_function_ptr", pa.bool_()), ("signature", pa.string())]))
#: Arrow types of the columns that are neither texts nor numbers.
_TYPES = {"ord": pa.int32(), "first_line": pa.int32(), "line": pa.int32(), "end_line": pa.int32(), "position": pa.int32(), "attributes": pa.list_(pa.string()), "calls": pa.list_(pa.string()), "refs": pa.list_(pa.string()), "param_types": pa.list_(pa.string()), "fields": _FIELDS}
#: Files read before their rows go on, and code points of their texts: what a task holds as Python objects.
PIECE, PIECE_LENGTH = 200, 4_000_000


def dealt(files: DataFrame) -> DataFrame:
    """files in as many partitions as there are cores, at least: reading takes long, and few and small input files come in few partitions."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files if files.rdd.getNumPartitions() >= cores else files.repartition(cores)


def _pieces(b: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Rows of a batch, some at a time."""
    rows, length = [], 0
    for row in zip(*b.columns, strict=True):  # one at a time: 200 texts at once can be all of a batch, 64 MB
        rows.append(tuple(v.as_py() for v in row))
        length += len(rows[-1][1] or "")
        if len(rows) == PIECE or length > PIECE_LENGTH:
            yield rows
            rows, length = [], 0
    if rows:
        yield rows


def rows_of(files: DataFrame, schema: str, read: Callable[..., list[dict]], *more: str) -> DataFrame:
    """Rows that read(content, *more columns) gives for each file, with its path."""
    columns = [c.split(" ", 1)[0] for c in re.split(r", (?=\w+ )", schema)]
    params = pa.list_(pa.string()) if "params array<string>" in schema else _PARAMS
    types = [params if c == "params" else _TYPES.get(c, pa.string()) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _pieces(b):
                rows = [(path, x) for path, content, *rest in piece for x in read(content or "", *rest)]
                values = [[path for path, _ in rows] if c == "path" else [x.get(c) for _, x in rows] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=columns)

    return files.select("path", "content", *more).mapInArrow(run, schema)


def symbols_of(text: str) -> list[dict]:
    found, errors = definitions(text)
    return found + [{"kind": "error", "error": e} for e in errors]


def symbols(files: DataFrame) -> DataFrame:
    """Functions, structs and errors of files (S5, X8, X9); derive tables from it by kind."""
    return rows_of(files, SYMBOLS, symbols_of)


# -- nodes of whole files ---------------------------------------------------------------------------------------------
def _statements(r: Reader, lo: int, hi: int) -> Iterator[tuple[str, int, object]]:
    """Statements of a body, with those of statement expressions."""
    for kind, at, x in r.statements(lo, hi):
        yield kind, at, x
        node = x.init if kind == "declared" else x if kind == "expression" else None
        for n in walk(node) if node else ():
            if n[0] == "block":
                yield from _statements(r, n[3] + 1, min(r.close[n[3]], hi))


def bodies(r: Reader) -> Iterator[tuple[dict | None, list[tuple[str, int, object]]]]:
    """(head, statements) of each function, and last (None, declarations and loose statements) of the top level."""
    top = []
    for kind, first, brace, _ in r.items():
        if kind == "declaration":
            top += _statements(r, first, brace)
        else:
            yield r.function_head(first, brace), [*_statements(r, brace + 1, r.close[brace])]
    yield None, top


def _nodes(statements: list[tuple[str, int, object]]) -> Iterator[tuple]:
    for kind, _, x in statements:
        node = x.init if kind == "declared" else x if kind == "expression" else None
        if node:
            yield from walk(node)


def _bare(node: tuple) -> tuple:
    """A node without casts, and the last of commas."""
    while node[0] in ("cast", "comma"):
        node = node[3] if node[0] == "cast" else node[3][-1]
    return node


def _flat(r: Reader, node: tuple) -> str:
    return re.sub(r"\s+", "", r.raw(node[1], node[2]))


def _place(text: str) -> str:
    return re.sub(r"\s+", "", text).lstrip("&")


# -- constraints ------------------------------------------------------------------------------------------------------
_SPECIAL = {"INIT_WORK": "func", "INIT_DELAYED_WORK": "func", "timer_setup": "function"}
_ALLOC = re.compile(r"^(?:k[mzc]alloc|vmalloc|vzalloc|malloc|calloc|devm_k[mzc]alloc)$")
_NO_PLACE = frozenset(("NULL", "true", "false", "nullptr"))


class _Collector:
    """Constraints of a file.

    A value that has to be loaded before it is stored goes by a location named like its text.  Elements of an array share
    a location, base[]; p->a.b is the field a.b of p, as is (*p).a.b.
    """

    def __init__(self, r: Reader, known: set[str]):
        self.r, self.known, self.out = r, known, []

    def add(self, kind: str, dest: str, src: str, field: str | None = None) -> None:
        self.out.append((kind, dest, src, field))

    def location(self, node: tuple) -> str:
        return re.sub(r"\[[^\]]*\]", "[]", _place(_flat(self.r, node)))

    def member(self, node: tuple) -> tuple[str, str]:
        """(base, field) of a member: the first arrow parts them, else the last dot."""
        base = node
        while base[0] == "member":
            base = base[3]
        base, text = _bare(base), self.location(node)
        if base[0] == "unary" and base[3] == "*":
            return self.value(base[4]) or self.location(base[4]), re.sub(r"->", ".", text[text.rindex(")") + 1 :].lstrip(".>-")) if ")" in text else text
        if ")" in text and base[0] != "call":  # a cast or brackets around the base
            return self.location(base), text[text.rindex(")") + 1 :].lstrip(".>-")
        first, last = re.split(r"->|\.(?=[^.]*$)", text, maxsplit=1)
        return first, last

    def value(self, node: tuple) -> str | None:
        """The location that holds the value of a node."""
        node = _bare(node)
        kind = node[0]
        if kind == "id":
            return None if node[3] in _NO_PLACE else node[3]
        if kind == "assign":
            return self.value(node[5])
        if kind == "index":
            return f"{self.location(node[3])}[]"
        if kind == "unary" and node[3] == "&":
            place = self.location(node[4])
            if place in self.known:
                return place
            self.add("AddressOf", f"&{place}", place)
            return f"&{place}"
        if kind == "unary" and node[3] == "*" and (src := self.value(node[4])):
            self.add("Load", f"*{src}", src)
            return f"*{src}"
        if kind == "member":
            base, field = self.member(node)
            name = self.location(node)
            self.add("FieldLoad", name, base, field)
            return name
        if alloc := self.allocated(node):
            self.add("AddressOf", f"&{alloc}", alloc)
            return f"&{alloc}"
        return None

    def allocated(self, node: tuple) -> str | None:
        if node[0] == "call" and node[3][0] == "id" and _ALLOC.match(node[3][3]):
            return f"alloc:{self.r.line(node[1])}"
        return None

    def assign(self, left: tuple, right: tuple) -> None:
        left, right = _bare(left), _bare(right)
        if right[0] == "cond":
            for side in right[4:6]:
                self.assign(left, side)
            return
        if right[0] == "assign":
            self.assign(left, right[5])
            return
        if left[0] == "id":
            self.into(left[3], right)
        elif left[0] == "unary" and left[3] == "*":
            if (dest := self.value(left[4])) and (src := self.value(right)):
                self.add("Store", dest, src)
        elif left[0] == "index":
            if src := self.value(right):
                self.add("ArrayStore", self.location(left[3]), src)
        elif left[0] == "member" and (src := self.value(right)):
            base, field = self.member(left)
            self.add("FieldStore", base, src, field)

    def into(self, name: str, right: tuple) -> None:
        kind = right[0]
        if kind == "unary" and right[3] == "&":
            self.add("AddressOf", name, self.location(right[4]))
        elif kind == "unary" and right[3] == "*":
            if src := self.value(right[4]):
                self.add("Load", name, src)
        elif kind == "index":
            self.add("ArrayLoad", name, self.location(right[3]))
        elif alloc := self.allocated(right):
            self.add("AddressOf", name, alloc)
        elif kind == "member":
            base, field = self.member(right)
            self.add("FieldLoad", name, base, field)
        elif kind == "id" and right[3] not in _NO_PLACE:
            self.add("AddressOf" if right[3] in self.known else "Copy", name, right[3])

    def filled(self, name: str, array: bool, items: list[tuple[str, tuple]]) -> None:
        """An initialiser in braces: designated members of name, or elements of an array."""
        for designator, node in items:
            node = _bare(node)
            if node[0] == "list":
                self.filled(designator[1:] if designator.startswith(".") else name, designator == "[]" or (array and any(d == "" for d, _ in node[3])), node[3])
            elif node[0] == "id" or (node[0] == "unary" and node[3] == "&"):
                if designator.startswith("."):
                    self.add("FieldStore", name, self.location(node), designator[1:])
                elif array or designator == "[]":
                    self.add("ArrayStore", name, self.location(node))

    def call(self, node: tuple) -> None:
        name, args = node[3][3], node[4]
        if name in ("INIT_WORK", "INIT_DELAYED_WORK", "timer_setup", "request_irq", "request_threaded_irq") and len(args) >= 2 and (handler := self.location(args[1])) in self.known:
            if name in _SPECIAL:
                self.add("FieldStore", self.location(args[0]), handler, _SPECIAL[name])
            else:
                self.add("AddressOf", f"irq_{_flat(self.r, args[0])}", handler)


def constraints_of(text: str, known: set[str] | None = None) -> list[tuple[str, str, str, str | None]]:
    """(kind, dest, src, field) of the statements in function bodies and initialisers (X6); without known the functions of the text are known."""
    r = Reader(text)
    return _constraints(r, _names(r) if known is None else known, bodies(r))


def _constraints(r: Reader, known: set[str], parts: Iterable[tuple]) -> list[tuple[str, str, str, str | None]]:
    c = _Collector(r, known)
    for _, statements in parts:
        for kind, _, x in statements:
            if kind == "declared" and x.init and "typedef" not in x.words:
                d, init = x.declarator.named, _bare(x.init)
                if init[0] == "list":
                    c.filled(d.name, "[" in d.arrays, init[3])
                else:
                    c.assign(("id", x.init[1], x.init[1], d.name), x.init)
        for n in _nodes(statements):
            if n[0] == "assign" and n[3] == "=":
                c.assign(n[4], n[5])
            elif n[0] == "call" and n[3][0] == "id":
                c.call(n)
    return c.out


# -- callback facts ---------------------------------------------------------------------------------------------------
def facts_of(text: str, known: set[str] | None = None) -> list[dict]:
    """Callback facts: binding, invocation, registration, event_loop, queue, signal (X5); without known the functions of the text are known."""
    r = Reader(text)
    return _facts(r, _names(r) if known is None else known)


def facts_and_functions_of(text: str) -> list[dict]:
    """Callback facts, and functions as facts of their own (line, name), of a text that is read once."""
    r = Reader(text)
    heads = [head for head, *_ in _functions(r)]
    return [{"fact": "function", "line": r.line(h["first"]), "name": h["name"]} for h in heads] + _facts(r, {h["name"] for h in heads})


def _facts(r: Reader, known: set[str]) -> list[dict]:
    out = []
    low = lambda name, parts: any(p in name.lower() for p in parts)
    target = lambda node: re.sub(r"\[\d+\]", "[*]", _flat(r, node))
    handler = lambda node: h if (h := _place(r.raw(node[1], node[2]))) in known else None

    def add(fact: str, at: int, **k: str | None) -> None:
        out.append({"fact": fact, "line": r.line(at), **k})

    def through(callee: tuple) -> str | None:
        """What an indirect call goes through."""
        callee = _bare(callee)
        if callee[0] in ("member", "index"):
            return target(callee)
        return _flat(r, callee[4]) if callee[0] == "unary" and callee[3] == "*" else None

    def called(name: str, args: list[tuple], at: int) -> None:
        first = next((h for a in args if (h := handler(a))), None)
        if first and low(name, fixed.REGISTER_NAMES):
            add("registration", at, target=name, name=first)
        if low(name, fixed.QUEUE_NAMES):
            last = _place(r.raw(args[-1][1], args[-1][2])) if args else None
            add("queue", at, target=name, name=next((_place(t) for a in args if "->" in (t := _flat(r, a)) and "work" in t), last))
        if low(name, fixed.SIGNAL_NAMES) and len(args) >= 2 and (h := handler(args[-1]) or (handler(args[-2]) if len(args) >= 3 else None)):
            add("signal", at, target=_flat(r, args[0]), name=h)

    for _, statements in bodies(r):
        for n in _nodes(statements):
            if n[0] == "assign" and n[3] == "=" and n[4][0] in ("member", "index") and (h := handler(_bare(n[5]))):
                add("binding", n[4][1], target=target(n[4]), name=h)
            elif n[0] == "call" and n[3][0] == "id":
                called(n[3][3], n[4], n[1])
            elif n[0] == "call" and (expr := through(n[3])):
                add("invocation", n[1], target=expr)
        for kind, at, x in statements:
            if kind == "while":
                for dispatch in dict.fromkeys(target(n[3]) for n in _nodes([*_statements(r, *x[1])]) if n[0] == "call" and n[3][0] in ("member", "index")):
                    add("event_loop", at, target=dispatch)
    return out


# -- calls and types --------------------------------------------------------------------------------------------------
def arguments_of(text: str) -> list[dict]:
    """Calls by name within function bodies, with each argument, literals empty: caller, callee, position, argument, line."""
    r = Reader(text)
    return _arguments(r, bodies(r))


def _arguments(r: Reader, parts: Iterable[tuple], callees: set[str] | None = None) -> list[dict]:
    """Arguments of all calls, or of calls of callees."""
    out = []
    argument = lambda a: "".join(t[0] * 2 if t[0] in "\"'" else t for t in r.tok[a[1] : a[2]]).lstrip("&")
    for head, statements in parts:
        for n in _nodes(statements) if head else ():
            if n[0] == "call" and n[3][0] == "id" and n[3][3] not in NOT_CALLED and (callees is None or n[3][3] in callees):
                out += [{"caller": head["name"], "callee": n[3][3], "position": i, "argument": argument(a), "line": r.line(n[1])} for i, a in enumerate(n[4])]
    return out


FLOW = "path string, kind string, name string, params array<struct<name:string,type_name:string>>, dest string, src string, field string, callee string, position int, argument string"


def flow_of(text: str) -> list[dict]:
    """Functions with their parameters, constraints, and arguments of calls of these functions, of a text that is read once."""
    r = Reader(text)
    parts, heads = [*bodies(r)], [head for head, *_ in _functions(r)]
    names = {head["name"] for head in heads}
    out = [{"kind": "function", "name": h["name"], "params": [{"name": n, "type_name": t} for n, t in h["params"]]} for h in heads]
    out += [dict(zip(("kind", "dest", "src", "field"), c, strict=True)) for c in _constraints(r, names, parts)]
    return out + [{"kind": "argument", **x} for x in _arguments(r, parts, names)]


def _struct_of(words: list[str]) -> str | None:
    return next((b for a, b in zip(words, words[1:], strict=False) if a == "struct"), None)


def member_calls_of(text: str) -> list[dict]:
    """Calls through a member: target, line, and the struct its base was declared as, in the function, else in the file, if the declarations agree."""
    r, out = Reader(text), []
    parts = [*bodies(r)]

    def declared(head: dict | None, statements: list) -> dict[str, set[str]]:
        types: dict[str, set[str]] = {}
        for name, words in [(n, t.replace("*", " ").split()) for n, t in (head or {}).get("params", ())] + [(x.declarator.named.name, x.words) for kind, _, x in statements if kind == "declared"]:
            if s := _struct_of(words):
                types.setdefault(name, set()).add(s)
        return types

    everywhere = declared(*parts[-1])
    for head, statements in parts[:-1]:
        types = everywhere | declared(head, statements)
        for n in _nodes(statements):
            if n[0] == "call" and n[3][0] == "member":
                base = n[3]
                while base[0] == "member":
                    base = base[3]
                if base[0] == "id":
                    # Of a member of a member only the field is known.
                    found = types.get(base[3], set()) if n[3][3] is base else set()
                    out.append({"target": _flat(r, n[3]), "line": r.line(n[1]), "struct_type": next(iter(found)) if len(found) == 1 else None})
    return out


def types_of(text: str) -> list[dict]:
    """Function-pointer types (typedef, struct field, param) and function signatures."""
    r = Reader(text)
    return _types(r, read_definitions(r))


def symbols_and_types_of(text: str) -> list[dict]:
    """symbols_of() and types_of(), with the parameters of types as param_types, of a text that is read once."""
    r = Reader(text)
    found = read_definitions(r)
    errors = [{"kind": "error", "error": e} for e in r.errors]
    return found + errors + [{**{k: v for k, v in t.items() if k != "params"}, "param_types": t["params"]} for t in _types(r, found)]


def _types(r: Reader, definitions: list[dict]) -> list[dict]:
    out = []
    for kind, first, end, _ in r.items():
        if kind == "declaration" and r.tok[first] == "typedef":
            out += [{"kind": "Typedef", "name": x.declarator.named.name, "line": r.line(first), **p} for x in r.declared(first, end)[0] if (p := pointer_of(r, x))]
        elif kind == "function" and end not in r.unclosed and (head := r.function_head(first, end)):
            out.append({"kind": "Function", "name": head["name"], "return_type": head["return_type"], "params": [t for _, t in head["params"]], "line": r.line(head["first"])})
            for a, b in r.parts(*head["span"], ","):
                if b > a and (found := r.declared(a, b)[0]) and (p := pointer_of(r, found[0])):
                    out.append({"kind": "Param", "name": f"{head['name']}.{found[0].declarator.named.name}", "line": r.line(head["first"]), **p})
    for d in definitions:
        if d["kind"] == "struct":
            out += [{"kind": "StructField", "name": f"{d['name']}.{f['name']}", "line": d["line"], **f["pointer"]} for f in d["fields"] if f["pointer"]]
    return out


# -- tables -----------------------------------------------------------------------------------------------------------
def _with_functions(files: DataFrame, functions: DataFrame | None) -> DataFrame:
    """files and the names that count as functions: those given for the path, else those defined in it, for which no text is shuffled."""
    if functions is None:
        return files.select("path", "content", F.lit(None).cast("array<string>").alias("known"))
    return files.select("path", "content").join(functions.groupBy("path").agg(F.collect_set("name").alias("known")), "path", "left")


def _known(known) -> set[str] | None:
    return set(known) if known is not None else None


def constraints(files: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """(path, kind, dest, src, field) for the points-to solver."""
    read = lambda text, known: [dict(zip(("kind", "dest", "src", "field"), c, strict=True)) for c in constraints_of(text, _known(known))]
    return rows_of(_with_functions(files, functions), "path string, kind string, dest string, src string, field string", read, "known")


def callback_facts(files: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """(path, fact, line, target, name)."""
    return rows_of(_with_functions(files, functions), "path string, fact string, line int, target string, name string", lambda text, known: facts_of(text, _known(known)), "known")


def facts_and_functions(files: DataFrame) -> DataFrame:
    """(path, fact, line, target, name): callback_facts(), and rows of fact "function" (line, name)."""
    return rows_of(files, "path string, fact string, line int, target string, name string", facts_and_functions_of)


def symbols_and_types(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """symbols() and pointer_types(), for which each file is read once; what is read is stored."""
    both = checkpoint(rows_of(files, f"{SYMBOLS}, param_types array<string>", symbols_and_types_of))
    is_symbol = F.col("kind").isin("function", "struct", "error")
    return both.where(is_symbol).drop("param_types"), both.where(~is_symbol).select("path", "kind", "name", "return_type", F.col("param_types").alias("params"), "line")


def pointer_types(files: DataFrame) -> DataFrame:
    """(path, kind, name, return_type, params, line)."""
    return rows_of(files, "path string, kind string, name string, return_type string, params array<string>, line int", types_of)


def call_arguments(files: DataFrame) -> DataFrame:
    """(path, caller, callee, position, argument, line)."""
    return rows_of(files, "path string, caller string, callee string, position int, argument string, line int", arguments_of)


def flow(files: DataFrame) -> DataFrame:
    """Rows of kind "function" (name, params), "argument" (callee, position, argument) of calls of functions of the same file, and of the kinds of constraints (dest, src, field)."""
    return rows_of(files, FLOW, flow_of)


def member_calls(files: DataFrame) -> DataFrame:
    """(path, target, line, struct_type)."""
    return rows_of(files, "path string, target string, line int, struct_type string", member_calls_of)
