"""Offset-preserving deobfuscation of personal data.

A text is searched as it is (base spans) and, where it holds anything a
transducer rewrites, once more in normalised form.  Two transducers run one
after the other, and each keeps for every character it writes the source range
it came from:

1. characters: zero-width characters go; homoglyphs, full-width forms and
   digits of other scripts become ASCII;
2. words: bracketed or spelled "at" and "dot" become ``@`` and ``.``, and runs of
   three or more spelled digits become digits.

Identifiers found in the normalised text are mapped back through both, and those
that no base span of their kind covers are added: a base span may be a fragment
of a partly disguised identifier.  Base spans always stay.

Only texts that hold a digit, an ``@`` or a trigger of a transducer are decoded
and searched; the triggers are found in the raw bytes.

Defined results: a null or empty text has no spans; rows of a repeated id, and equal
rows, are treated each on its own; offsets are code points, ends exclusive; texts of any
length are searched whole; spans that tie stand by kind, then start, then end; an empty
table gives no rows; columns besides the text pass through whatever their names, but for
one named like the column of spans that is added, which that replaces.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runpath.llm import kernel

KINDS = ("email", "ip", "card", "phone")

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot start inside a run of digits: whatever follows the run fails or succeeds from its start.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end), by kind as in KINDS, then start."""
    found: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            found.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(_small(x) for x in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if len(m[0]) >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


# Letters of other scripts that look like an ASCII letter.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ℓ": "l", "․": ".", "。": ".", "﹒": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ",
}
ZERO_WIDTH = frozenset("​‌‍⁠﻿­")
SPELLED = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "dev", "co", "uk", "de", "fr", "es", "it", "eu")


@lru_cache(maxsize=65536)
def _plain(ch: str) -> str:
    """ASCII for a look-alike, nothing for a zero-width character, else the character."""
    if ch in ZERO_WIDTH:
        return ""
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    digit = unicodedata.decimal(ch, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", ch)
    return folded if len(folded) == 1 and folded.isascii() else ch


BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
_DIGIT = "(?:" + "|".join(SPELLED) + ")"
_DOT = r"(?:\s{0,3}[\[({<]\s{0,3}dot\s{0,3}[\])}>]\s{0,3}|\s{1,3}dot\s{1,3})"
DIGIT_WORD = re.compile(_DIGIT, re.I)
DISGUISED = re.compile(
    rf"(?P<at>\s{{0,3}}[\[({{<]\s{{0,3}}(?:at|@)\s{{0,3}}[\])}}>]\s{{0,3}}|(?<=[A-Za-z0-9])\s{{1,3}}at\s{{1,3}}(?=[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)*(?:{_DOT}|\.)(?:{'|'.join(TOP_DOMAINS)})\b))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9]))"
    rf"|(?P<digits>\b{_DIGIT}(?:[\s-]+{_DIGIT}){{2,}}\b)",
    re.I,
)

Mapped = tuple[str, np.ndarray, np.ndarray]


def _rewrite(text: str, edits: list[tuple[int, int, str]]) -> Mapped:
    """text with edits (start, end, one character or none) applied, and the source range of each character."""
    parts, starts, ends, at = [], [], [], 0
    for s, e, new in edits:
        parts += (text[at:s], new)
        starts += (np.arange(at, s), np.full(len(new), s))
        ends += (np.arange(at + 1, s + 1), np.full(len(new), e))
        at = e
    parts.append(text[at:])
    starts.append(np.arange(at, len(text)))
    ends.append(np.arange(at + 1, len(text) + 1))
    return "".join(parts), np.concatenate(starts), np.concatenate(ends)


def plain_characters(text: str) -> Mapped:
    """First transducer."""
    return _rewrite(text, [(m.start(), m.end(), new) for m in BEYOND_ASCII.finditer(text) if (new := _plain(m[0])) != m[0]])


def plain_words(text: str) -> Mapped:
    """Second transducer."""
    edits: list[tuple[int, int, str]] = []
    for m in DISGUISED.finditer(text):
        if m["digits"] is None:
            edits.append((m.start(), m.end(), "@" if m["at"] is not None else "."))
            continue
        at = m.start()
        for w in DIGIT_WORD.finditer(text, m.start(), m.end()):
            if w.start() > at:
                edits.append((at, w.start(), ""))
            edits.append((w.start(), w.end(), SPELLED[w[0].lower()]))
            at = w.end()
    return _rewrite(text, edits)


def normalise(text: str) -> Mapped:
    """Both transducers, with source ranges in text."""
    first, s1, e1 = plain_characters(text)
    second, s2, e2 = plain_words(first)
    return second, s1[s2], e1[e2 - 1]


def all_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """Spans (kind, start, end, base), by kind as in KINDS, then start."""
    base = identifiers(text)
    spans = [(*s, True) for s in base]
    plain, start, end = normalise(text)
    if plain != text:
        for kind, s, e in identifiers(plain):
            a, b = int(start[s]), int(end[e - 1])
            if not any(k == kind and x <= a and b <= y for k, x, y in base):
                spans.append((kind, a, b, False))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


_WORDS = tuple(w.encode() for w in SPELLED)
#: What \s matches in an ASCII text.
_BLANK = rb"[\s\x1c-\x1f]"


def _triggers(raw: bytes) -> bool:
    """Something that the word transducer may rewrite stands in the (folded) bytes of an ASCII text without "@"."""
    low = raw.lower()
    if b"dot" in low or b"at" in low and BRACKET_AT.search(low):
        return True
    if sum(low.count(w) for w in _WORDS) >= 3:
        return True
    return any(m for m in BARE_AT.finditer(low))


BRACKET_AT = re.compile(rb"[\[({<]" + _BLANK + rb"{0,3}at" + _BLANK + rb"{0,3}[\])}>]")
BARE_AT = re.compile(_BLANK + rb"at" + _BLANK + rb"{1,3}[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:" + b"|".join(t.encode() for t in TOP_DOMAINS) + rb")\b")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])

_HOT = np.zeros(256, dtype=bool)
_HOT[ord("0") : ord("9") + 1] = True
_HOT[ord("@")] = True
_HOT[0xC2:] = True  # first bytes of all characters beyond ASCII


def find_in(column: pa.Array) -> list[list[tuple[str, int, int, bool]]]:
    """Spans of each text of a binary column."""
    data, off = kernel.flat(column)
    hot = np.zeros(len(off) - 1, dtype=bool)
    at = np.searchsorted(off, np.flatnonzero(_HOT[data]), side="right") - 1
    hot[at] = True
    raw = data.tobytes()
    out: list[list[tuple[str, int, int, bool]]] = []
    for i in range(len(off) - 1):
        text = raw[off[i] : off[i + 1]]
        out.append(all_spans(text.decode("utf-8", "replace")) if hot[i] or _triggers(text) else [])
    return out


@F.arrow_udf(T.ArrayType(SPAN))
def _spans(text: pa.Array) -> pa.Array:
    kinds, starts, ends, base, cut = [], [], [], [], [0]
    for lo in range(0, len(text), 1000):
        for spans in find_in(text.slice(lo, 1000)):
            for k, s, e, b in spans:
                kinds.append(k)
                starts.append(s)
                ends.append(e)
                base.append(b)
            cut.append(len(kinds))
    items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(base, pa.bool_())], names=SPAN.names)
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), items)


def spans_column(text: str = "text") -> Column:
    """array<struct<kind, start, end, base>> of a text column."""
    return _spans(F.col(text).cast("binary"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(documents: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """documents and the spans of each text."""
    return documents.withColumn(spans_col, spans_column(text_col))


def redact(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with each span replaced by its kind in brackets, spans that overlap by the kind of the first (of these, the longest); columns are those of documents."""

    @F.arrow_udf(T.StringType())
    def masked(text: pa.Array) -> pa.Array:
        out = []
        for lo in range(0, len(text), 1000):
            part = text.slice(lo, 1000)
            for raw, spans in zip(part.to_pylist(), find_in(part), strict=True):
                t, at, pieces = (raw or b"").decode("utf-8", "replace"), 0, []
                for k, s, e, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if s >= at:
                        pieces += (t[at:s], f"[{k.upper()}]")
                    at = max(at, e)
                out.append(None if raw is None else "".join([*pieces, t[at:]]))
        return pa.array(out, pa.string())

    return documents.withColumn(text_col, masked(F.col(text_col).cast("binary"))).select(*documents.columns)


def op2_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.withColumn("base", base).select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
