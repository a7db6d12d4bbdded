"""String, type-name and label functions as columns."""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from runpath import fixed


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def contains_any(name: Column | str, parts: list[str]) -> Column:
    """The name holds one of the parts, in any case."""
    return F.lower(col(name)).rlike("|".join(parts))


def is_register_function(name: Column | str) -> Column:
    return contains_any(name, fixed.REGISTER_NAMES)


def is_queue_function(name: Column | str) -> Column:
    return contains_any(name, fixed.QUEUE_NAMES)


def is_signal_connect_function(name: Column | str) -> Column:
    return contains_any(name, fixed.SIGNAL_NAMES)


def looks_like_callback_field(name: Column | str) -> Column:
    return contains_any(name, fixed.CALLBACK_FIELDS)


def is_callback_target(expr: Column | str) -> Column:
    """The target is a member or an element."""
    return col(expr).rlike(r"->|\.|\[")


def is_kernel_api(name: Column | str) -> Column:
    return col(name).rlike("^(" + "|".join(fixed.KERNEL_PREFIXES) + ")")


def is_function_target(key: Column | str) -> Column:
    """A points-to target that is a function and no allocation or member."""
    return ~col(key).startswith("alloc:") & ~col(key).contains(".")


def glob_match(name: Column | str, pattern: str) -> Column:
    """File-name globs: *suffix, prefix*, or the exact name."""
    if pattern.startswith("*"):
        return col(name).endswith(pattern[1:])
    if pattern.endswith("*"):
        return col(name).startswith(pattern[:-1])
    return col(name) == pattern


def normalize_target(expr: Column | str) -> Column:
    """Without spaces, numeric subscripts as [*] (F2)."""
    return F.regexp_replace(F.replace(col(expr), F.lit(" "), F.lit("")), r"\[\d+\]", "[*]")


def normalize_type(t: Column | str) -> Column:
    """Without const, volatile and struct, double blanks squeezed once."""
    out = F.trim(col(t))
    for part, new in (("const ", ""), ("volatile ", ""), ("struct ", ""), ("  ", " ")):
        out = F.replace(out, F.lit(part), F.lit(new))
    return F.trim(out)


def types_compatible(a: Column | str, b: Column | str) -> Column:
    """Equal, void* against a pointer, or interchangeable integers, after normalising."""
    x, y = normalize_type(a), normalize_type(b)
    pointer = ((x == "void*") & y.endswith("*")) | ((y == "void*") & x.endswith("*"))
    return (x == y) | pointer | (x.isin(fixed.INTEGER_TYPES) & y.isin(fixed.INTEGER_TYPES))


def candidate_types_compatible(a: Column | str, b: Column | str) -> Column:
    """The narrower rules for ranking candidates: struct pointers against void*, int against long."""
    x, y = F.trim(col(a)), F.trim(col(b))
    void = lambda t: t.isin("void *", "void*")
    struct = lambda t: t.contains("struct") & t.contains("*")
    return (x == y) | (void(x) & void(y)) | (struct(x) & void(y)) | (struct(y) & void(x)) | (x.isin("int", "long") & y.isin("int", "long"))


def simplify_type(param: Column | str) -> Column:
    """A parameter without its name."""
    p = F.trim(col(param))
    named = p.rlike(r"\s\w+$")
    return F.when(named, F.regexp_replace(F.regexp_replace(p, r"\s+\w+$", ""), r"\s+", " ")).otherwise(p)


def normalize_variable(v: Column | str) -> Column:
    """Without & and spaces, -> as a dot."""
    out = col(v)
    for part, new in (("&", ""), ("->", "."), (" ", "")):
        out = F.replace(out, F.lit(part), F.lit(new))
    return out


def field_base(expr: Column | str) -> Column:
    """What stands before the first ->, else before the last dot, else all (F8)."""
    e = col(expr)
    arrow, dot = F.instr(e, "->"), F.instr(e, ".")
    return F.when(arrow > 0, F.substring_index(e, "->", 1)).when(dot > 0, F.regexp_extract(e, r"^(.*)\.[^.]*$", 1)).otherwise(e)


def field_name(expr: Column | str) -> Column:
    """The member, or null (F8)."""
    e = col(expr)
    arrow, dot = F.instr(e, "->"), F.instr(e, ".")
    return F.when(arrow > 0, F.regexp_extract(e, r"^[^>]*?->(.*)$", 1)).when(dot > 0, F.substring_index(e, ".", -1))


def location_key(kind: Column | str, name: Column | str, field: Column | str | None = None) -> Column:
    """Key of a memory location: variables and functions by name, base.field, alloc:site, name[] (G6e)."""
    k, n = col(kind), col(name)
    f = F.lit(None).cast("string") if field is None else col(field)
    return F.when(k == "field", F.concat_ws(".", n, f)).when(k == "alloc", F.concat(F.lit("alloc:"), n)).when(k == "array", F.concat(n, F.lit("[]"))).otherwise(n)


def signature_return(sig: Column | str) -> Column:
    """Return type of "ret (a, b)" (F10)."""
    return F.trim(F.substring_index(F.trim(col(sig)), "(", 1))


def signature_params(sig: Column | str) -> Column:
    """Parameter types of "ret (a, b)", empty without parentheses."""
    s = F.trim(col(sig))
    inner = F.regexp_extract(s, r"^[^(]*\((.*).$", 1)
    parts = F.transform(F.split(inner, ","), lambda p: F.trim(p))
    return F.when(F.instr(s, "(") > 0, F.filter(parts, lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def format_signature(ret: Column | str, name: Column | str, params: Column | str) -> Column:
    return F.concat(col(ret), F.lit(" "), col(name), F.lit("("), F.array_join(col(params), ", "), F.lit(")"))


def format_location(file: Column | str, line: Column | str, column: Column | str) -> Column:
    return F.concat_ws(":", col(file), col(line).cast("string"), col(column).cast("string"))


def fuzzy_score(query: str, text: Column | str) -> Column:
    """Palette score, null where nothing matches.

    A text that contains the query scores 100 less the place it is found at, and 50 more if equal; else each character of
    the query in order scores 10, and 5 more where the character before it is the query's previous one.
    """
    q, t = query.lower(), F.lower(col(text))
    exact = F.lit(100) - (F.instr(t, q) - 1) + F.when(t == q, 50).otherwise(0)
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"), F.lit("").alias("last"))

    def step(acc: Column, c: Column) -> Column:
        want = F.substr(F.lit(q + "\0"), acc["at"] + 1, F.lit(1))
        before = F.when(acc["at"] > 0, F.substr(F.lit(q), acc["at"], F.lit(1))).otherwise(F.lit("\0"))
        hit = c == want
        gain = F.when(hit, F.when(acc["last"] == before, 15).otherwise(10)).otherwise(0)
        return F.struct((acc["at"] + hit.cast("int")).alias("at"), (acc["score"] + gain).alias("score"), c.alias("last"))

    loose = F.aggregate(chars, start, step)
    return F.when(F.instr(t, q) > 0, exact).when(loose["at"] == len(q), loose["score"])


def match_score(ret_a: Column, params_a: Column, ret_b: Column, params_b: Column) -> Column:
    """Candidate score: 40 for the return type, 30 for the number of parameters, 30 shared among matching ones."""
    each = F.floor(F.lit(30) / F.greatest(F.size(params_a), F.lit(1))).cast("int")
    agree = F.aggregate(F.zip_with(params_a, params_b, lambda x, y: candidate_types_compatible(x, y).cast("int")), F.lit(0), lambda t, v: t + v)
    return F.when(candidate_types_compatible(ret_a, ret_b), 40).otherwise(0) + F.when(F.size(params_a) == F.size(params_b), 30 + agree * each).otherwise(0)


def can_sleep(context: Column | str) -> Column:
    return col(context).isin("Process", "User")


def core_context(context: Column | str) -> Column:
    """The knowledge base's User is Process elsewhere."""
    return F.when(col(context) == "User", F.lit("Process")).otherwise(col(context))


def confidence_rank(c: Column | str) -> Column:
    return F.when(col(c) == "Certain", 0).when(col(c) == "Possible", 1).otherwise(2)


def confidence_of_rank(r: Column | str) -> Column:
    return F.when(col(r) == 0, "Certain").when(col(r) == 1, "Possible").otherwise("Unknown")


def from_rows(key: Column, rows: list[tuple], at: int, other: str | None = None) -> Column:
    """Field `at` of the fixed row whose first field is key."""
    out = F.lit(other)
    for r in reversed(rows):
        out = F.when(key == r[0], F.lit(r[at])).otherwise(out)
    return out


def confidence_symbol(c: Column | str) -> Column:
    """How a confidence is shown; anything else counts as unknown."""
    return from_rows(col(c), fixed.CONFIDENCES, 1, "❓")


def confidence_class(c: Column | str) -> Column:
    return from_rows(col(c), fixed.CONFIDENCES, 2, "result-unknown")


def confidence_arrow(c: Column | str) -> Column:
    return from_rows(col(c), fixed.CONFIDENCES, 3, "dotted")


def reason_confidence(reason: Column | str) -> Column:
    """Default confidence of a reason."""
    return from_rows(col(reason), fixed.REASONS, 1)


def reason_text(reason: Column | str, detail: Column | str | None = None) -> Column:
    """Description of a reason; those that name something end with the detail."""
    text = from_rows(col(reason), fixed.REASONS, 2)
    extra = F.lit("") if detail is None else F.coalesce(col(detail), F.lit(""))
    return F.when(text.endswith(": "), F.concat(text, extra)).otherwise(text)


def _mechanism(kind: Column | str, flag: Column | str, at: int, other: Column) -> Column:
    out = other
    for k, f, *rest in reversed(fixed.MECHANISMS):
        same = (col(kind) == k) & (F.lit(True) if rest[0] is None else F.coalesce(col(flag), F.lit(False)) == f)
        out = F.when(same, F.lit(rest[at])).otherwise(out)
    return out


def mechanism_icon(kind: Column | str, flag: Column | str) -> Column:
    """Icon of an asynchronous mechanism."""
    return _mechanism(kind, flag, 1, F.lit(fixed.OTHER_MECHANISM_ICON))


def mechanism_name(kind: Column | str, flag: Column | str) -> Column:
    return _mechanism(kind, flag, 2, col(kind))


def mechanism_tag(kind: Column | str, flag: Column | str) -> Column:
    """Short tag: for others the first three letters of the kind."""
    return _mechanism(kind, flag, 3, F.upper(F.substring(col(kind), 1, 3)))


def mechanism_text(kind: Column | str, flag: Column | str) -> Column:
    """A mechanism with its flag, as "Timer { high_resolution: false }"; custom ones as Custom("kind")."""
    out = F.concat(F.lit('Custom("'), col(kind), F.lit('")'))
    for k, name in {(k, n) for k, _, n, *_ in fixed.MECHANISMS}:
        text = F.lit(k) if name is None else F.concat(F.lit(f"{k} {{ {name}: "), F.coalesce(col(flag), F.lit(False)).cast("string"), F.lit(" }"))
        out = F.when(col(kind) == k, text).otherwise(out)
    return out


def node_icon(node_type: Column | str) -> Column:
    return from_rows(col(node_type), fixed.NODES, 1, "📦")


def node_class(node_type: Column | str) -> Column:
    return from_rows(col(node_type), fixed.NODES, 2, "function")


def info_column(node_type: Column | str, line: Column | str, tag: Column | str | None = None) -> Column:
    """Left column of a trace, 14 wide: the tag of a mechanism, else the line, else [K] or [E]."""
    mark = F.lit(None).cast("string") if tag is None else col(tag)
    text = (
        F.when(mark.isNotNull(), F.concat(F.lit("   ["), mark, F.lit("]")))
        .when(col(line).isNotNull() & (col(line) > 0), F.concat(F.lit("   :"), col(line).cast("string")))
        .when(col(node_type) == "KernelApi", "   [K]")
        .when(col(node_type) == "External", "   [E]")
        .otherwise("")
    )
    return pad_end(text, 14)


def context_text(context: Column | str) -> Column:
    return F.when(can_sleep(context), "can sleep").otherwise("cannot sleep")


def content_hash(text: Column | str) -> Column:
    """60 bits of the text's digest as a long (F13); a null text is an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(col(text).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def options_hash(target: Column | str, defines: Column | str, includes: Column | str) -> Column:
    """Hash of target, macro definitions and include folders in their order; further arguments do not count."""
    return content_hash(F.concat_ws("\n", col(target), F.array_join(col(defines), "\u0001", "\u0002"), F.array_join(col(includes), "\u0001", "\u0002")))


def query_id(location: Column | str, expr: Column | str) -> Column:
    """Id of a question about a call."""
    return F.concat_ws(":", col(location), col(expr))


def percent(done: Column | str, total: Column | str) -> Column:
    """Whole percentage, halves up, 0 of nothing."""
    return F.when(col(total) > 0, F.floor(col(done) * 100 / col(total) + 0.5)).otherwise(F.lit(0)).cast("int")


def native_types(signature: Column | str) -> Column:
    """Types named in a native-method signature in their order, the last being the result: arrays with [], classes by their last name."""
    parts = F.regexp_extract_all(col(signature), F.lit(r"(\[*(?:[ZBCSIJFDV]|L[\w/$]+;))"), F.lit(1))

    def named(t: Column) -> Column:
        core = F.regexp_replace(t, r"^\[+", "")
        base = F.lit(None).cast("string")
        for letter, name in fixed.NATIVE_TYPES.items():
            base = F.when(core == letter, F.lit(name)).otherwise(base)
        base = F.when(core.startswith("L"), F.regexp_extract(core, r"([^/;]+);$", 1)).otherwise(base)
        return F.concat(base, F.repeat(F.lit("[]"), F.length(t) - F.length(core)))

    return F.transform(parts, named)


def native_signature(method: Column | str, signature: Column | str) -> Column:
    """A native method as "boolean method(String, int)" (X12)."""
    types = native_types(signature)
    n = F.size(types)
    return F.concat(F.element_at(types, -1), F.lit(" "), col(method), F.lit("("), F.array_join(F.slice(types, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(")"))


def tooltip(name: Column | str, node_type: Column | str, file: Column | str, line: Column | str, description: Column | str) -> Column:
    """Lines shown for a node: what is known of it."""
    where = F.when(col(file).isNotNull(), F.concat_ws(":", col(file), F.when(col(line) > 0, col(line).cast("string"))))
    return F.concat_ws("\n", F.concat(col(name), F.lit("()")), col(node_type), where, F.nullif(col(description), F.lit("")))


def clang_arg(name: Column | str, value: Column | str, defined: Column) -> Column:
    """-Dname, -Dname=value or -Uname (F16)."""
    return F.when(~defined, F.concat(F.lit("-U"), col(name))).when(col(value).isNull(), F.concat(F.lit("-D"), col(name))).otherwise(F.concat(F.lit("-D"), col(name), F.lit("="), col(value)))


def hex_name(h: Column | str, ending: str = ".i") -> Column:
    """A 64-bit hash as a file name of 16 digits."""
    return F.concat(F.lpad(F.lower(F.hex(col(h))), 16, "0"), F.lit(ending))


def pad_end(text: Column | str, width: int) -> Column:
    """Padded, never cut."""
    t = col(text)
    return F.when(F.length(t) < width, F.rpad(t, width, " ")).otherwise(t)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def parent_path(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def depth(path: Column | str) -> Column:
    return F.size(F.split(col(path), "/")) - 1


def relative_time(minutes: Column | str) -> Column:
    """How long ago, from whole minutes."""
    m = col(minutes)
    return (
        F.when(m < 1, "just now")
        .when(m < 60, F.concat(m.cast("string"), F.lit("m ago")))
        .when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit("d ago")))
    )


def elapsed(seconds: Column | str) -> Column:
    s = col(seconds)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def human_size(n: Column | str) -> Column:
    """Bytes with two decimals of the largest unit that fits."""
    x = col(n).cast("double")
    step = lambda power, unit: F.format_string(f"%.2f {unit}", F.bround(x / 1024.0**power, 2))
    return F.when(x < 1024, F.concat(col(n).cast("string"), F.lit(" bytes"))).when(x < 1024.0**2, step(1, "KB")).when(x < 1024.0**3, step(2, "MB")).otherwise(step(3, "GB"))


def markdown_to_html(text: Column | str) -> Column:
    """Headings, bold, code, list items and line breaks."""
    rules = [("(?m)^### (.+)$", "<h3>$1</h3>"), ("(?m)^## (.+)$", "<h2>$1</h2>"), ("(?m)^# (.+)$", "<h1>$1</h1>"), (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), ("`([^`]+)`", "<code>$1</code>"), ("(?m)^- (.+)$", "<li>$1</li>")]
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, col(text))


def numbered(items: Column | str) -> Column:
    """"1. a" lines."""
    return F.array_join(F.transform(col(items), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def bulleted(items: Column | str) -> Column:
    return F.array_join(F.transform(col(items), lambda x: F.concat(F.lit("- "), x)), "\n")


def nested_chain(items: Column | str) -> Column:
    """Each item one step deeper than the one before."""
    return F.array_join(F.transform(col(items), lambda x, i: F.concat(F.repeat(F.lit("  "), i), F.when(i > 0, F.lit("-> ")).otherwise(F.lit("")), x)), "\n")


def guess_value_type(c_type: Column | str) -> Column:
    """Kind of value that a C type holds."""
    t = F.lower(col(c_type))
    return F.when(t.contains("*"), "pointer").when(t.rlike("int|long|short|size_t|u8|u16|u32|u64"), "integer").when(t.contains("char"), "string").otherwise("integer")


def language_of(path: Column | str) -> Column:
    """Language by file ending."""
    end = F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end.isin("c", "h"), "C").when(end.isin("cpp", "hpp", "cc"), "C++").when(end == "rs", "Rust").when(end == "py", "Python").when(end.isin("ts", "tsx"), "TypeScript").when(end.isin("js", "jsx"), "JavaScript").otherwise("Text")


def jni_name(class_and_method: Column | str) -> Column:
    """C name of a native method: $ and dots rewritten, Java_ before it (D3)."""
    c = F.replace(col(class_and_method), F.lit("_"), F.lit("_1"))
    return F.concat(F.lit("Java_"), F.replace(F.replace(c, F.lit("$"), F.lit("_00024")), F.lit("."), F.lit("_")))


def new_id(prefix: str) -> Column:
    """A name for something new: the prefix, the time in milliseconds and six characters, as in tab-1700000000000-3f09ac.

    The ids of one query differ: partitions count on from its time, a millisecond each, and the six characters are the
    row's number there, by a bijection that each call draws.  A partition of more than 16 777 216 rows goes on 2^20 ms later.
    """
    row, key = F.monotonically_increasing_id(), F.lit(secrets.randbelow(1 << 24))
    n = row.bitwiseAND((1 << 33) - 1)
    at = F.unix_millis(F.current_timestamp()) + F.shiftright(row, 33) + F.shiftright(n, 24) * (1 << 20)
    mixed = (n.bitwiseAND(0xFFFFFF) * 0x9E3779 + key).bitwiseAND(0xFFFFFF)
    mixed = mixed.bitwiseXOR(F.shiftright(mixed, 12))
    return F.concat_ws("-", F.lit(prefix), at.cast("string"), F.lpad(F.lower(F.hex((mixed * 0x85EBCB).bitwiseAND(0xFFFFFF))), 6, "0"))
