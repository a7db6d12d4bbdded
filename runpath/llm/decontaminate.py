"""Benchmark decontamination by a generalised suffix automaton of the test items.

The words of the items (A-Z folded, runs of ASCII letters, digits and all beyond
ASCII) are numbered and inserted, item by item, into one generalised suffix
automaton.  A document's words stream through it; the automaton state and the
matching length say at each word how long a stretch ending there also occurs in
some item.  A matching length of at least ``window`` words is a hit, as is a
whole item that is shorter than the window.

Streaming starts only where it can lead to a hit: a word pair that follows one
another in no item resets the matching length to at most one, so stretches
between such pairs that are too short for any window are passed over, with the
same result as streaming them.

Items are taken in blocks of at most ``block_words`` words, or of one longer item.
However many items exist, the driver builds one automaton at a time and a task
holds one at a time: with several blocks it takes texts of up to ``HELD_BYTES``
together and loads the blocks for them one after the other.

Defined results: null texts and texts without words have no hit; a null item
has no window; items of a repeated id count once; a null item_id is written as
an empty string; with no items nothing is hit; an empty table gives no rows;
texts are read whole, however long; rows of a repeated id are texts of their own;
a text with exactly the share max_coverage of its words hit stays; columns besides
the text, and n_chars with it, pass through whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runpath.llm import kernel
from runpath.llm.storage import small_batches


@dataclass(frozen=True)
class DecontaminationParams:
    """Spans of window words and more are cut; a text with more than max_coverage of its words hit goes entirely."""

    window: int = 10
    max_coverage: float = 0.5
    block_words: int = 100_000


PARAMS = DecontaminationParams()


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers, with what a hit needs to know of each state."""

    window: int
    next: dict[tuple[int, int], int] = field(default_factory=dict)
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    out: list[list[int]] = field(default_factory=lambda: [[]])  # words that leave a state
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    at_window: list[int] = field(default_factory=list)  # suffix state that stands for the last `window` words
    items: dict[int, set[str]] = field(default_factory=dict)  # by that state
    short: dict[int, list[tuple[int, set[str]]]] = field(default_factory=dict)  # whole short items that end in a state
    shortest: int = 0

    def _state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(-1)
        self.out.append([])
        return len(self.length) - 1

    def _clone(self, p: int, q: int, word: int) -> int:
        c = self._state(self.length[p] + 1)
        self.link[c], self.out[c] = self.link[q], list(self.out[q])
        for w in self.out[q]:
            self.next[c, w] = self.next[q, w]
        self.link[q] = c
        while p >= 0 and self.next.get((p, word)) == q:
            self.next[p, word] = c
            p = self.link[p]
        return c

    def extend(self, last: int, word: int) -> int:
        """State of the current item's prefix after one more word."""
        q = self.next.get((last, word))
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        cur, p = self._state(self.length[last] + 1), last
        while p >= 0 and (p, word) not in self.next:
            self.next[p, word] = cur
            self.out[p].append(word)
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p, word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return cur

    def finish(self, numbered: list[tuple[str, list[int]]]) -> None:
        """Mark the states of windows and of whole short items."""
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.at_window = [0] * len(self.length)
        for v in order[1:]:
            up = self.link[v]
            self.at_window[v] = v if self.length[up] < self.window <= self.length[v] else self.at_window[up]
        ends: dict[int, list[tuple[int, set[str]]]] = {}
        sizes = [self.window]
        for item, ws in numbered:
            v = 0
            for n, w in enumerate(ws, 1):
                v = self.next[v, w]
                if n >= self.window:
                    self.items.setdefault(self.at_window[v], set()).add(item)
            if 0 < len(ws) < self.window:
                sizes.append(len(ws))
                known = next((x for m, x in ends.setdefault(v, []) if m == len(ws)), None)
                if known is None:
                    ends[v].append((len(ws), known := set()))
                known.add(item)
        self.shortest = min(sizes)
        if ends:
            for v in order[1:]:
                found = self.short.get(self.link[v], []) + sorted(ends.get(v, []), key=lambda x: x[0])
                if found:
                    self.short[v] = found
        self.out = []

    def stream(self, ws: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (end exclusive, ascending ends) and the ids of their items."""
        spans: list[tuple[int, int]] = []
        met: set[int] = set()
        items: set[str] = set()
        v = size = 0
        step, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        for i, w in enumerate(ws, 1):
            while (q := step.get((v, w))) is None and v:
                v = link[v]
                size = length[v]
            if q is None:
                size = 0
                continue
            v, size = q, size + 1
            if size >= window:
                spans.append((i - window, i))
                met.add(self.at_window[v])
            if short and v in short:
                for m, whole in short[v]:
                    if m <= size:
                        spans.append((i - m, i))
                        items |= whole
        for u in met:
            items |= self.items[u]
        return spans, items


def item_words(text: str | None) -> np.ndarray:
    h, _ = kernel.word_hashes(pa.array([(text or "").encode()]), kernel.NON_ALNUM)
    return h


def build(items: list[tuple[str, np.ndarray]], window: int) -> Automaton:
    """Automaton of items (id, word hashes)."""
    a = Automaton(window)
    hashes = [h for _, h in items if len(h)]
    a.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    numbered, pairs = [], []
    for item, h in items:
        ids = np.searchsorted(a.vocabulary, h).astype(np.int64)
        pairs.append(ids[:-1] * len(a.vocabulary) + ids[1:])
        numbered.append((item, ids.tolist()))
        last = 0
        for w in ids.tolist():
            last = a.extend(last, w)
    a.pairs = np.unique(np.concatenate(pairs)) if pairs else a.pairs
    a.finish(numbered)
    return a


def automata(items: DataFrame, p: DecontaminationParams = PARAMS, id_col: str = "item_id", text_col: str = "text") -> list[Broadcast]:
    """Broadcast automata of blocks of items; items stream to the driver one partition at a time."""
    small_batches(items.sparkSession)
    sc = items.sparkSession.sparkContext
    out: list[Broadcast] = []
    block: list[tuple[str, np.ndarray]] = []
    size = 0
    for row in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        h = item_words(row.t)
        if not len(h):
            continue
        if block and size + len(h) > p.block_words:
            out.append(sc.broadcast(build(block, p.window)))
            block, size = [], 0
        block.append((row.i, h))
        size += len(h)
    if block:
        out.append(sc.broadcast(build(block, p.window)))
    return out


def _lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, -1 where it is absent."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _stretches(a: Automaton, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers and the word ranges that can hold a hit (none crosses a text)."""
    number = _lookup(a.vocabulary, h)
    if a.shortest <= 1:
        inside = number >= 0
        joined = inside[1:] & inside[:-1]
    else:
        both = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
        joined = np.zeros(max(len(h) - 1, 0), dtype=bool)
        joined[both] = _lookup(a.pairs, number[both] * len(a.vocabulary) + number[both + 1]) >= 0
    cut = first[(first > 0) & (first < len(h))]
    joined[cut - 1] = False
    edge = np.flatnonzero(~joined) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(h)]])
    long = hi - lo >= a.shortest
    if a.shortest <= 1:
        long &= number[np.minimum(lo, len(h) - 1)] >= 0
    return number, lo[long], hi[long]


def each_block(shared: list[Broadcast]) -> Iterator[Automaton]:
    """The automata one after the other; of several, only one is held at a time."""
    for b in shared:
        yield b.value
        if len(shared) > 1 and getattr(b, "_path", None):
            b.__dict__.pop("_value", None)  # value reads it again from its file


def find(columns: list[pa.Array], shared: list[Broadcast]) -> list[tuple[np.ndarray, list[np.ndarray], list[set[str]]]]:
    """For each column of texts, and each text of it: number of words, hit flag of each word, ids of items with windows in it."""
    hashed = [kernel.word_hashes(c, kernel.NON_ALNUM) for c in columns]
    hits = [np.zeros(len(h), dtype=bool) for h, _ in hashed]
    items: list[list[set[str]]] = [[set() for _ in range(len(c))] for c in columns]
    for a in each_block(shared):
        for (h, first), hit, met in zip(hashed, hits, items, strict=True):
            if not len(h):
                continue
            number, lo, hi = _stretches(a, h, first)
            own = np.searchsorted(first, lo, side="right") - 1
            for i, j, d in zip(lo.tolist(), hi.tolist(), own.tolist(), strict=True):
                spans, found = a.stream(number[i:j].tolist())
                for x, y in spans:
                    hit[i + x : i + y] = True
                met[d] |= found
    return [(np.diff(first), np.split(hit, first[1:-1]) if len(c) else [], met) for c, (_, first), hit, met in zip(columns, hashed, hits, items, strict=True)]


FOUND = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("items_sha256", T.StringType())]
)

#: Texts that meet a block of items together: with several blocks many, as each block is loaded anew for them.
CHUNK_ROWS, CHUNK_BYTES, HELD_BYTES = 1000, 4 << 20, 32 << 20


def _groups(arrays: Iterator[pa.Array], shared: list[Broadcast]) -> Iterator[list[pa.Array]]:
    """Arrays that are searched together: one at a time with one block, up to HELD_BYTES of text with several."""
    held, size = [], 0
    for text in arrays:
        held.append(text)
        size += text.nbytes
        if len(shared) <= 1 or size > HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _parts(text: pa.Array) -> list[pa.Array]:
    return [b.column("text") for b in kernel.chunks(iter([pa.RecordBatch.from_arrays([text], names=["text"])]), CHUNK_ROWS, CHUNK_BYTES)]


def searched(arrays: Iterator[pa.Array], shared: list[Broadcast]) -> Iterator[list[tuple[pa.Array, tuple]]]:
    """For each array its parts of bounded size, each with what find() says of it."""
    for group in _groups(arrays, shared):
        parts = [_parts(text) for text in group]
        found = iter(find([p for ps in parts for p in ps], shared))
        for ps in parts:
            yield [(p, next(found)) for p in ps]
        kernel.trim()


def match_column(shared: list[Broadcast]):
    """Column function text -> struct(n_words, n_hit, items, items_sha256)."""

    @F.arrow_udf(FOUND)
    def match(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for parts in searched(texts, shared):
            n_words, n_hit, lists = [], [], []
            for _, (n, hits, items) in parts:
                n_words += n.tolist()
                n_hit += [int(x.sum()) for x in hits]
                lists += [sorted(x) for x in items]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(lists, pa.list_(pa.string())), pa.array(digests, pa.string())], names=FOUND.names)

    return lambda column: match(F.col(column).cast("binary"))


def _cut(raw: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words and what stands between adjacent hit words; a line break marks each cut."""
    data = np.frombuffer(raw, dtype=np.uint8)
    st, en, _ = kernel.words(data, np.array([0, len(data)]), kernel.NON_ALNUM)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    parts, at = [], 0
    for x, y in zip(edge[::2], edge[1::2], strict=True):
        parts.append(raw[at : st[x]])
        at = int(en[y - 1])
    return b"\n".join([*parts, raw[at:]])


def clean_texts(texts: list[tuple[bytes, np.ndarray]], shared: list[Broadcast], max_coverage: float) -> list[bytes | None]:
    """The texts, given with their hit words, without contaminated spans; None for those of which too much is hit.

    Where a cut joins words to a new hit, it is cut again: all texts cut in one round are searched together.
    """
    out: list[bytes | None] = [None] * len(texts)
    left = [(i, raw, hit, len(hit)) for i, (raw, hit) in enumerate(texts)]
    while left:
        cut = [(i, _cut(raw, hit), total) for i, raw, hit, total in left if hit.sum() <= max_coverage * total]
        left = []
        if cut:
            [(_, hits, _)] = find([pa.array([raw for _, raw, _ in cut], pa.binary())], shared)
            for (i, raw, total), hit in zip(cut, hits, strict=True):
                if hit.any():
                    left.append((i, raw, hit, total))
                else:
                    out[i] = raw
    return out


def decontaminate(documents: DataFrame, items: DataFrame, p: DecontaminationParams = PARAMS, text_col: str = "text") -> DataFrame:
    """documents with contaminated spans cut from the text; rows over the coverage limit go.

    Columns are those of documents; n_chars, if it is one of them, follows the new text.
    """
    shared = automata(items, p)
    limit = p.max_coverage
    result = T.StructType([T.StructField("keep", T.BooleanType()), T.StructField("text", T.StringType())])

    @F.arrow_udf(result)
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for parts in searched(texts, shared):
            keep, new = [], []
            for part, (_, hits, _) in parts:
                touched = [i for i, hit in enumerate(hits) if hit.any()]
                done = dict(zip(touched, clean_texts([(part[i].as_py(), hits[i]) for i in touched], shared, limit), strict=True))
                keep += [i not in done or done[i] is not None for i in range(len(part))]
                new += [text.decode("utf-8", "replace") if (text := done.get(i)) is not None else None for i in range(len(part))]
            yield pa.StructArray.from_arrays([pa.array(keep, pa.bool_()), pa.array(new, pa.string())], names=["keep", "text"])

    # Marked as not deterministic, so that the filter doesn't run it a second time.
    clean = clean.asNondeterministic()
    # Rows go whole, in one column, so that no name of theirs meets one of ours.
    row, new = F.col("row"), F.col("done.text")
    out = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), clean(F.col(text_col).cast("binary")).alias("done")).where("done.keep")
    columns = {c: row[c] for c in documents.columns} | {text_col: F.coalesce(new, row[text_col])}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(new.isNotNull(), F.length(new).cast(documents.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return out.select(*(columns[c].alias(c) for c in documents.columns))


def op3_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    match = match_column(automata(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    found = documents.select("doc_id", match("text").alias("m"))
    return found.select("doc_id", "m.n_words", "m.n_hit", F.size("m.items").cast("long").alias("n_items"), "m.items_sha256", (F.col("m.n_hit") > 0).alias("contaminated"))
