"""Removal of repeated long byte strings by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else
too.  Shorter repeats are only told of: ``has_repeat`` is 1 if a string of
``report`` bytes (a passage of about 50 words) occurs anywhere else.

A string of ``report`` bytes has one anchor: its ``gram``-byte string of least
hash (the first of equal ones), and a longer string has that of its first
``report`` bytes.  Equal strings have equal anchors at equal places, so only
strings around equal anchors need comparison.

1. Each text gives the hashes of its anchors; those of an anchor that no other
   text or place has are done with (counts are summed before the shuffle).
2. Around the other anchors the strings that own them are cut out and dealt by
   anchor hash.  In each bucket the suffixes that start at the anchors are put
   in order by a mergesort whose comparisons look for the first difference by
   binary search over prefix polynomial hashes (a logarithmic number of steps),
   and the common extension of each suffix with its neighbours is found the same
   way to both sides and verified byte by byte.
3. Anchors whose strings are not all explained by a neighbour are settled with
   the whole group of their anchor: equal strings have equal prefix hashes, and
   are verified byte by byte as well.
4. Strings that contain the same anchor cover one unbroken stretch, so the first
   and the last repeated one say what goes.

Copies cost nothing: equal texts are found by their digest, go entirely from
``length`` bytes on, and one row of them is cut.  Texts without a shared anchor
are not shuffled: a bit map of bounded size tells them.  Equal pieces of one task
collapse before they leave it, and so does a stretch that repeats itself.

Defined results: a null or empty text has no bytes and nothing to remove; texts
shorter than ``length`` stay; matches never cross texts; rows of a repeated id
are texts of their own; equal strings are all removed, so there are no ties to
break; texts are worked on whole, however long; an empty table gives no rows;
columns besides id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath.llm import filters, kernel
from runpath.llm.storage import Tables, small_batches


@dataclass(frozen=True)
class RepeatParams:
    """length of strings that must be unique; report: length of those that are told of; gram: bytes of an anchor; bucket_bytes dealt to one group, about."""

    length: int = 400
    report: int = 250
    gram: int = 125
    bucket_bytes: int = 4 << 20

    def __post_init__(self) -> None:
        if not 0 < self.gram <= self.report <= self.length:
            raise ValueError("gram, report and length must ascend")


PARAMS = RepeatParams()
U8 = np.uint64


def _raw_codes() -> np.ndarray:
    return np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.uint64) * U8(2) + U8(1)


CODES = _raw_codes()


def prefix_hashes(x: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: entry i covers x[:i]."""
    pw, _ = kernel.powers(len(x) + 1)
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(CODES[x] * pw[: len(x)], out=out[1:])
    return out


#: Low bits of an ordered hash that hold a place; places within a step of windows fit in.
PLACE_BITS = 20
STEP = 1 << 18


def anchors(x: np.ndarray, p: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first string, number of strings) of each anchor of one text; strings of `report` bytes are numbered by their start.

    A string's anchor is its gram of least hash (high bits), the first of equal ones.
    """
    n, k, w = len(x), p.gram, p.report - p.gram + 1
    none = np.zeros(0, np.int64)
    if n < p.report:
        return none.astype(np.uint64), none, none, none
    out: list[tuple[np.ndarray, ...]] = []
    mask = U8((1 << PLACE_BITS) - 1)
    last = n - p.report + 1
    for lo in range(0, last, STEP):  # so that a very long text takes bounded memory
        hi = min(lo + STEP, last)
        part = x[lo : hi + p.report - 1]
        sums = prefix_hashes(part)
        m = len(part) - k + 1
        h = kernel.mix((sums[k:] - sums[:-k]) * kernel.powers(m)[1][:m])
        ranked = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        ranked[:m] = (h & ~mask) | np.arange(m, dtype=np.uint64)
        rows = ranked.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[: hi - lo], ahead[w - 1 : w - 1 + hi - lo]) & mask).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out.append((h[place[at]], lo + place[at], lo + at, np.diff(np.append(at, hi - lo))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


#: Texts, and bytes of them, that are worked on at a time.
CHUNK_ROWS, CHUNK_BYTES = 500, 4 << 20


def _anchor_rows(p: RepeatParams):
    """Distinct anchor hashes of each text, with their numbers of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernel.chunks(batches, CHUNK_ROWS, CHUNK_BYTES):
            data, off = kernel.flat(b.column("text"))
            found = [np.unique(anchors(data[off[i] : off[i + 1]], p)[0], return_counts=True) for i in range(b.num_rows)]
            rows = pa.array(np.repeat(np.arange(b.num_rows), [len(f[0]) for f in found]))
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), b.column("ka").take(rows), b.column("kb").take(rows), pa.array(np.concatenate([f[1] for f in found]), pa.int64())],
                    names=["anchor", "ka", "kb", "n"],
                )

    return kernel.trimmed(run)


def _self_repeats(raw: bytes, h: np.ndarray, start: np.ndarray, count: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each piece of a text the number of the piece whose stretch it belongs to (its own if to none): pieces that follow at equal distance and repeat one another."""
    head = np.arange(len(h))
    if len(h) < 4:
        return head
    same = (h[1:] == h[:-1]) & (count[1:] == count[:-1]) & (at[1:] == at[:-1]) & (size[1:] == size[:-1])
    step = np.diff(start)
    joined = same & np.concatenate([[True], (step[1:] == step[:-1]) | ~same[:-1]])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # pieces i to j
        if j - i < 3:
            continue
        lo, hi, d = int(start[i]), int(start[j] + size[j]), int(step[i])
        if raw[lo : hi - d] == raw[lo + d : hi]:
            head[i : j + 1] = i
    return head


def _cut_rows(p: RepeatParams, buckets: int):
    """The strings around the anchors of interest of each text, packed by bucket of the anchor hash.

    numbers: (anchor, ka, kb, first string, strings, place of the anchor, bytes, 1 if the piece came more than once) of
    each distinct piece of a task.  A piece that comes twice is explained: its other owners go to `done` at once, as
    (ka, kb, from, to) of what goes; a piece shorter than `length` is only told of, by an empty stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, bytes], list[int]] = {}
        done: list[tuple[int, int, int, int]] = []
        size_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            by: dict[int, list[tuple[list[int], bytes]]] = {}
            for (key, _, piece), numbers in held.items():
                by.setdefault(key % buckets, []).append((numbers, piece))
            rows = [(bucket, np.array([n for n, _ in items], np.int64).tobytes(), b"".join(x for _, x in items), b"") for bucket, items in by.items()]
            if done:
                rows.append((done[0][0] % buckets, b"", b"", np.array(done, np.int64).tobytes()))
            if rows:
                types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "numbers", "bytes", "done"])

        for b in kernel.chunks(batches, CHUNK_ROWS, CHUNK_BYTES):
            data, off = kernel.flat(b.column("text"))
            ka, kb, lists = b.column("ka").to_pylist(), b.column("kb").to_pylist(), b.column("anchors")
            for i in range(b.num_rows):
                x = data[off[i] : off[i + 1]]
                h, place, start, count = anchors(x, p)
                raw = x.tobytes()
                wanted = np.flatnonzero(np.isin(h.view(np.int64), lists[i].values.to_numpy()))
                h, start, count, at = h.view(np.int64)[wanted], start[wanted], count[wanted], (place - start)[wanted]
                size = np.minimum(start + count + p.length - 1, len(x)) - start
                head = _self_repeats(raw, h, start, count, at, size)
                for j, (key, s, c, a, z, first) in enumerate(zip(*(v.tolist() for v in (h, start, count, at, size, head)), strict=True)):
                    if first != j:  # told of by the piece at the head of its stretch
                        continue
                    last = j
                    if j + 1 < len(head) and head[j + 1] == j:
                        last = int(np.searchsorted(head, j, side="right")) - 1
                    piece = raw[s : s + z]
                    known = held.get((key, a, piece))
                    if known is None:
                        held[key, a, piece] = [key, ka[i], kb[i], s, c, a, z, int(last > j)]
                        size_held += z + 200
                    else:
                        known[-1] = 1
                    if known is not None or last > j:
                        done.append((ka[i], kb[i], s, int(start[last] + size[last]) if z >= p.length else s))
                        size_held += 100
                if size_held > 24 << 20:
                    yield from flush()
                    held.clear()
                    done.clear()
                    size_held = 0
        yield from flush()

    return kernel.trimmed(run)


class Pieces:
    """Cut-out pieces of texts with prefix hashes that start anew in each."""

    def __init__(self, pieces: list[np.ndarray]):
        self.size = np.array([len(x) for x in pieces], np.int64)
        self.first = np.cumsum(self.size + 1) - self.size - 1
        self.data = np.concatenate([np.append(x, np.uint8(0)) for x in pieces]) if pieces else np.zeros(0, np.uint8)
        self.sums = np.concatenate([prefix_hashes(x) for x in pieces]) if pieces else np.zeros(0, np.uint64)
        self.raw = self.data.tobytes()
        self.inverse = kernel.powers(int(self.size.max(initial=0)) + 1)[1]

    def hash(self, i: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hash of n bytes from place at of piece i."""
        g = self.first[i] + at
        return (self.sums[g + n] - self.sums[g]) * self.inverse[at]

    def forward(self, i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the right, by binary search."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i] - a, self.size[j] - b)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hash(i, a, mid) == self.hash(j, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def backward(self, i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same to the left of both places."""
        low, high = np.zeros(len(i), np.int64), np.minimum(a, b)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hash(i, a - mid, mid) == self.hash(j, b - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """The suffix at a of piece i sorts before that at b of piece j; equal ones do if ties."""
        n = self.forward(i, a, j, b)
        end_i, end_j = n == self.size[i] - a, n == self.size[j] - b
        x, y = self.data[self.first[i] + a + n].astype(np.int16), self.data[self.first[j] + b + n].astype(np.int16)
        x[end_i], y[end_j] = -1, -1
        return (x < y) | ((x == y) & ties)

    def equal(self, i: int, a: int, j: int, b: int, n: int) -> bool:
        s, t = self.first[i] + a, self.first[j] + b
        return self.raw[s : s + n] == self.raw[t : t + n]


def suffix_sort(t: Pieces, at: np.ndarray) -> np.ndarray:
    """Order of the suffixes at place at[i] of piece i: bottom-up mergesort, all merges of a level at once.

    A suffix's rank in the opposite run is found by binary search with hash comparisons.
    """
    n = len(at)
    order = np.arange(n)
    width = 1
    while width < n:
        place = np.arange(n)
        own = place // width
        other = own ^ 1
        lo, hi = np.minimum(other * width, n), np.minimum((other + 1) * width, n)
        left = own % 2 == 0
        low, high = lo.copy(), hi.copy()
        me = order[place]
        while (open_ := low < high).any():
            q = np.flatnonzero(open_)
            mid = (low[q] + high[q]) // 2
            them = order[mid]
            # Equal suffixes of the left run come first.
            theirs_first = np.empty(len(q), bool)
            for side in (True, False):
                s = left[q] == side
                theirs_first[s] = t.before(them[s], at[them[s]], me[q[s]], at[me[q[s]]], ties=not side)
            low[q], high[q] = np.where(theirs_first, mid + 1, low[q]), np.where(theirs_first, high[q], mid)
        start = np.minimum(own, other) * width
        merged = np.empty(n, np.int64)
        merged[start + (place - own * width) + (low - lo)] = me
        order = merged
        width *= 2
    return order


def _group_hits(t: Pieces, key: np.ndarray, pieces: np.ndarray, count: np.ndarray, length: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, string) of strings of so many bytes that some other string of the same anchor equals, among pieces; those of two known pieces need no proof and are left out."""
    piece = np.repeat(pieces, count[pieces])
    string = np.concatenate([np.arange(c) for c in count[pieces]]) if len(pieces) else np.zeros(0, np.int64)
    if not len(piece):
        return piece, string
    h = t.hash(piece, string, length)
    by = np.lexsort((h, key[piece]))
    same = np.flatnonzero((h[by][1:] == h[by][:-1]) & (key[piece[by]][1:] == key[piece[by]][:-1]))
    hit = np.zeros(len(by), bool)
    for s in same.tolist():
        x, y = by[s], by[s + 1]
        a, b = int(piece[x]), int(piece[y])
        if (known[a] and known[b]) or (hit[x] and hit[y]):
            continue
        if t.equal(a, int(string[x]), b, int(string[y]), length):
            hit[x] = hit[y] = True
    return piece[hit], string[hit]


def _settle(p: RepeatParams):
    """One bucket: for each cut-out piece with a repeated string of `length` bytes, the stretch that goes; an empty stretch for one that is only told of."""
    length = p.length

    def run(table: pa.Table) -> pa.Table:
        packed = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 8) for x in table.column("numbers")]
        pieces: list[np.ndarray] = []
        for d, s in zip(table.column("bytes"), packed, strict=True):
            if len(s):
                pieces += np.split(np.frombuffer(d.as_buffer(), np.uint8), np.cumsum(s[:, 6])[:-1])
        spans = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 4) for x in table.column("done")]
        numbers = np.concatenate(packed)
        # Pieces that are equal throughout, of other texts or places, explain one another; one of them goes on.
        kinds: dict[tuple[int, int, bytes], int] = {}
        same = np.array([kinds.setdefault((n[0], n[5], piece.tobytes()), i) for i, (n, piece) in enumerate(zip(numbers.tolist(), pieces, strict=True))], np.int64)
        other = same != np.arange(len(same))
        twice = numbers[:, 7] == 1
        twice[same[other]] = True
        done = numbers[twice | other]
        spans.append(np.stack([done[:, 1], done[:, 2], done[:, 3], done[:, 3] + np.where(done[:, 6] >= length, done[:, 6], 0)], axis=1))
        keep = np.flatnonzero(~other)
        key = numbers[keep, 0]
        k, c = np.unique(key, return_counts=True)
        keep = keep[np.isin(key, k[c > 1])]
        before = twice[keep]
        key, ka, kb, start, count, at, size = numbers[keep, :7].T
        long = np.clip(size - length + 1, 0, count)  # strings of `length` bytes
        first, last = np.full(len(keep), np.iinfo(np.int64).max), np.full(len(keep), -1)
        told = before.copy()
        if len(keep):
            t = Pieces([pieces[i] for i in keep])
            order = suffix_sort(t, at)
            for a, b in ((order[:-1], order[1:]), (order[1:], order[:-1])):
                near = key[a] == key[b]
                a, b = a[near], b[near]
                right, left = t.forward(a, at[a], b, at[b]), t.backward(a, at[a], b, at[b])
                common = right + left >= p.report
                a, b, right, left = a[common], b[common], right[common], left[common]
                ok = np.array([t.equal(x, m - l, y, n - l, l + r) for x, y, m, n, l, r in zip(a.tolist(), b.tolist(), at[a].tolist(), at[b].tolist(), left.tolist(), right.tolist(), strict=True)], bool)
                a, right, left = a[ok], right[ok], left[ok]
                told[a] = True
                lo, hi = np.maximum(at[a] - left, 0), np.minimum(at[a] + right - length, long[a] - 1)
                whole = hi >= lo
                np.minimum.at(first, a[whole], lo[whole])
                np.maximum.at(last, a[whole], hi[whole])
            # Everything between the first and the last string goes anyway, so a piece is settled once both ends are reached.
            resolved = before | (long == 0) | ((first == 0) & (last == long - 1))
            piece, string = _group_hits(t, key, np.flatnonzero(np.isin(key, key[~resolved])), long, length, resolved)
            np.minimum.at(first, piece, string)
            np.maximum.at(last, piece, string)
            told[last >= 0] = True
            piece, _ = _group_hits(t, key, np.flatnonzero(np.isin(key, key[~told])), count, p.report, told)
            told[piece] = True
        some = last >= 0
        spans.append(np.stack([ka[some], kb[some], start[some] + first[some], start[some] + last[some] + length], axis=1))
        only = told & ~some & ~before
        spans.append(np.stack([ka[only], kb[only], start[only], start[only]], axis=1))
        ka, kb, lo, hi = np.concatenate(spans).T
        return pa.table({"ka": pa.array(ka), "kb": pa.array(kb), "from": pa.array(lo), "to": pa.array(hi)})

    return run


REMOVAL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in kernel.chunks(batches, CHUNK_ROWS, CHUNK_BYTES):
        removed, runs, digest, kept = [], [], [], []
        for raw, spans, all_ in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "whole")), strict=True):
            merged: list[list[int]] = []
            for s in [{"from": 0, "to": len(raw)}] if all_ else sorted(spans or (), key=lambda s: s["from"]):
                if s["from"] == s["to"]:
                    continue
                if merged and s["from"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["to"])
                else:
                    merged.append([s["from"], s["to"]])
            parts, at = [], 0
            for s, e in merged:
                parts.append(raw[at:s])
                at = e
            left = b"".join([*parts, raw[at:]])
            removed.append(len(raw) - len(left))
            runs.append(len(merged))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        n = pa.array([len(k) + r for k, r in zip(kept, removed, strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    kernel.trim()


def remove_repeats(documents: DataFrame, p: RepeatParams = PARAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeat, kept) of each row of documents; kept: the remaining bytes."""
    spark = documents.sparkSession
    small_batches(spark)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("text"), F.xxhash64(raw).alias("ka"), F.xxhash64(F.lit(1), raw).alias("kb"))
    # One row of each group of copies is cut; a repeated row of one id is as good as another.
    long = texts.where(F.octet_length("text") >= p.report).withColumn("row", F.xxhash64("doc_id"))
    key = ["ka", "kb"]
    with Tables(spark) as tables:
        groups = tables.write(long.groupBy(*key).agg(F.count("*").alias("n"), F.min("row").alias("row"), F.max(F.octet_length("text")).alias("bytes")), "texts")
        copies = groups.where("n > 1")
        found = tables.write(long.select("text", *key).mapInArrow(_anchor_rows(p), "anchor long, ka long, kb long, n long"), "anchors")
        text = F.struct(*key)
        shared = found.groupBy("anchor").agg(F.min(text).alias("a"), F.max(text).alias("b"), F.max("n").alias("n")).where("a <> b or n > 1").select("anchor")
        wanted = found.join(shared, "anchor").groupBy(*key).agg(F.collect_set("anchor").alias("anchors"), F.sum("n").alias("n"))
        wanted = tables.write(wanted.join(groups.select(*key, "row"), key).select(*key, "row", F.xxhash64(*key, "row").alias("cut"), "anchors", "n"), "wanted")
        total = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) * (p.length + p.report - p.gram) // p.bucket_bytes + 1)
        maybe, _ = filters.split(long.withColumn("cut", F.xxhash64(*key, "row")), "cut", filters.bit_map(wanted, "cut"))
        whole = maybe.join(wanted.select(*key, "row", "anchors"), [*key, "row"]).select(*key, "anchors", "text").dropDuplicates(key)
        cut = whole.mapInArrow(_cut_rows(p, buckets), "bucket int, numbers binary, bytes binary, done binary")
        spans = cut.groupBy("bucket").applyInArrow(_settle(p), "ka long, kb long, from long, to long")
        lists = spans.groupBy(*key).agg(F.collect_set(F.struct("from", "to")).alias("spans"))
        gone = lists.join(groups.withColumnRenamed("row", "__row"), key, "full_outer").where("spans is not null or n > 1")
        gone = tables.keep(gone.select(*key, F.col("spans"), (F.coalesce("n", F.lit(0)) > 1).alias("copied"), ((F.coalesce("n", F.lit(0)) > 1) & (F.col("bytes") >= p.length)).alias("whole")), "repeats")
        # What is lazy from here on reads the texts and this one table.
        hit, clean = filters.split(texts, "ka", filters.bit_map(gone, "ka"))
        marked = hit.join(gone, key, "left")
        untouched = clean.select("doc_id", "text").union(marked.where("whole is null").select("doc_id", "text"))
        plain = untouched.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.lit(0).alias("has_repeat"), F.col("text").alias("kept"))
        done = marked.where("whole is not null").select("doc_id", "text", "spans", "whole").mapInArrow(_apply, REMOVAL)
        done = done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.lit(1).alias("has_repeat"), "kept")
        return plain.union(done)


def op6_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
