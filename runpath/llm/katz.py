"""Katz backoff language model over word pairs.

Training counts words and pairs (a text starts after one start mark and ends
with an end word, which is counted), discounts counts up to ``top`` by
Good-Turing, keeps pairs seen at least ``min_pairs`` times and gives every
history the backoff weight that makes its distribution sum to exactly one over
the known words and one unknown word:

    P(w | h) = d(c) c(h, w) / c(h)                  if the pair is kept
             = alpha(h) P(w)                        otherwise
    P(w)     = d(c) c(w) / N                        if w is known
             = what the known words leave           otherwise

Evaluation is this recursion per token, unrolled: every token contributes
log P(w) + log alpha(h), and a token whose pair is kept moreover the gain
log P(w | h) - log alpha(h) - log P(w), which is stored with the pair.

The model's tables are Parquet in the shared folder, partitioned by ``part``; pairs
are packed as arrays by bucket of their key when they are stored.
Pairs are joined with their histories, and texts with the model, one slice after
the other, so that the shuffle files of one slice only are on disk at a time.
Their most frequent rows, at most ``hot`` of each, are broadcast; all other
lookups are dealt out by key together with the rest of the model, packed as
arrays, so no key's rows meet in one task.  A task of the evaluation holds its
part of the model, of about ``task_tokens`` at most, and streams the lookups, which
come sorted after it; there are never more packed lookups than tokens.  Counts
are summed within each task before they are shuffled, and pairs of very frequent
words are dealt by pair instead of by word.

Defined results: a null or empty text is the end word alone; rows of a repeated
id are scored each on its own, and each is learnt from; a null id is hashed as an
empty string by the split; without training rows every token is unknown with
probability one and base probability one; an empty table gives no rows; texts are
read whole, however long; words of equal counts are all treated alike, so there
are no ties to break; columns besides id and text are not looked at.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath.llm import kernel
from runpath.llm.storage import discard, materialize, shuffles_go


@dataclass(frozen=True)
class KatzParams:
    """top: counts discounted; min_pairs: least count of a kept pair; hot: rows of a table that are broadcast at most."""

    top: int = 5
    min_pairs: int = 2
    hot: int = 1 << 17
    #: Tokens whose packed lookups one task of the evaluation gets, about.
    task_tokens: int = 4_000_000
    #: Texts and bytes of one chunk of results.
    chunk_rows: int = 4096
    chunk_bytes: int = 4 << 20
    #: Distinct pairs that a counting task, and rows that a packing task, holds before it hands them on.
    held_pairs: int = 1_200_000
    parts: int = 8
    #: Slices of the histories and of the texts that are worked on one after the other.
    slices: int = 4
    text_slices: int = 2


PARAMS = KatzParams()
#: Of the query: all pairs are kept.
OP1 = KatzParams(min_pairs=1)

END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
I8, F8, F4 = np.dtype("<i8"), np.dtype("<f8"), np.dtype("<f4")


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before it, number of the text) of every token; each text ends with the end word."""
    h, first = kernel.word_hashes(column)
    n = len(first) - 1
    last = first[1:] + np.arange(n)
    word = np.empty(len(h) + n, dtype=np.uint64)
    inner = np.ones(len(word), dtype=bool)
    inner[last] = False
    word[inner], word[last] = h, END
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.append(0, last[:-1] + 1)[: n]] = START
    return word, before, np.repeat(np.arange(n), np.diff(first) + 1)


def _summed(key: np.ndarray, n: np.ndarray, *other: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys with their sums of n and any of their other values."""
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order], at).astype(n.dtype) if len(key) else n[:0]
    return key[at], total, *(x[order[at]] for x in other)


def _count_words(p: KatzParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in kernel.chunks(batches, p.chunk_rows, p.chunk_bytes):
            word, _, _ = tokens(b.column("text"))
            k, n = np.unique(word, return_counts=True)
            keys, sums = _summed(np.concatenate([keys, k]), np.concatenate([sums, n]))
            if len(keys) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["key", "n"])
                keys, sums = keys[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["key", "n"])

    return run


def _deal(bucket: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Order that brings buckets together and keeps the order within, and the place of each bucket that has something."""
    order = np.argsort(bucket.astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first[1:], len(bucket))[: len(first)]
    return order, [(b, slice(i, j)) for b, i, j in zip(there.tolist(), first.tolist(), ends.tolist(), strict=True)]


def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index in sorted_keys and whether the key is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    order = np.argsort(keys)  # keys in order go through a large table from front to back
    keys = keys[order]
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    at, there = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    at[order], there[order] = place, sorted_keys[place] == keys
    return at, there


def _blob(x: np.ndarray) -> bytes:
    return x.tobytes()


def _count_pairs(p: KatzParams, buckets: int, frequent: np.ndarray):
    """Packed (history, word, count) by bucket of the word; of frequent words by bucket of the pair."""

    def packed(before: np.ndarray, word: np.ndarray, n: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        dealt = np.where(_in(frequent, word)[1], key, word).view(np.int64) % buckets
        order = np.lexsort((before, dealt))
        there, first = np.unique(dealt[order], return_index=True)
        parts = np.split(order, first[1:]) if len(there) else []
        rows = [(b, _blob(before[i]), _blob(word[i]), _blob(n[i])) for b, i in zip(there.tolist(), parts, strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "a", "b", "c"])

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        key, n, before, word = _summed(*columns)
        del columns
        yield from packed(before, word, n, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in kernel.chunks(batches, p.chunk_rows, p.chunk_bytes):
            word, before, _ = tokens(b.column("text"))
            got = _summed(kernel.combine(before, word), np.ones(len(word), np.uint32), before, word)
            held.append(got)
            size += len(got[0])
            if size > p.held_pairs:
                yield from flush(held)
                size = 0
        if held:
            yield from flush(held)

    return run


def _unpack(table: pa.Table | pa.RecordBatch, column: str, dtype: str) -> np.ndarray:
    data = [x.as_buffer() for x in table.column(column) if x.is_valid] if table.num_rows else []
    return np.concatenate([np.frombuffer(x, dtype=dtype) for x in data]) if data else np.zeros(0, dtype)


def _sum_pairs(p: KatzParams, frequent: np.ndarray, frequent_p: np.ndarray):
    """Kept pairs of one bucket with P(word) and the slice of their history; and rows of null history, in a slice of their own, that say how many pairs were seen key times."""

    def run(pairs: pa.Table, words: pa.Table) -> pa.Table:
        before, word, n = _unpack(pairs, "a", "<u8"), _unpack(pairs, "b", "<u8"), _unpack(pairs, "c", "<u4").astype(np.int64)
        both, n, before, word = _summed(kernel.combine(before, word), n, before, word)
        seen = np.bincount(np.minimum(n, p.top + 2), minlength=p.top + 3)[1 : p.top + 2]
        kept = n >= p.min_pairs
        both, before, word, n = both[kept], before[kept], word[kept], n[kept]
        key, prob = words.column("key").to_numpy().view(np.uint64), words.column("p").to_numpy()
        order = np.argsort(key)
        low = np.zeros(len(word))
        for k, v in ((key[order], prob[order]), (frequent, frequent_p)):
            at, there = _in(k, word)
            low[there] = v[at[there]]
        none = pa.nulls(len(seen), pa.int64())
        return pa.table(
            {
                "hist": pa.concat_arrays([pa.array(before.view(np.int64)), none]),
                "key": pa.concat_arrays([pa.array(both.view(np.int64)), pa.array(np.arange(1, len(seen) + 1), pa.int64())]),
                "n": pa.concat_arrays([pa.array(n, pa.int64()), pa.array(seen, pa.int64())]),
                "p": pa.concat_arrays([pa.array(low, pa.float64()), pa.nulls(len(seen), pa.float64())]),
                "slice": pa.concat_arrays([pa.array(before.view(np.int64) % p.slices, pa.int32()), pa.array(np.full(len(seen), p.slices), pa.int32())]),
            }
        )

    return run


def discounts(seen: dict[int, int], top: int) -> dict[int, float]:
    """Katz's Good-Turing discount of each count up to top; absolute discounting by one half where the counts of counts don't allow it."""
    out = {}
    n1 = seen.get(1, 0)
    over = (top + 1) * seen.get(top + 1, 0) / n1 if n1 else 1.0
    for r in range(1, top + 1):
        d = -1.0
        if seen.get(r) and seen.get(r + 1) and over < 1:
            d = ((r + 1) * seen[r + 1] / (r * seen[r]) - over) / (1 - over)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _discounted(n: str, d: dict[int, float]) -> Column:
    out = F.col(n).cast("double")
    for r, v in d.items():
        out = F.when(F.col(n) == r, F.lit(v * r)).otherwise(out)
    return out


def _frequent_from(table: DataFrame, most: int) -> int:
    """Least count such that at most `most` rows have it or more."""
    steps = table.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int").alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()  # at most 16 for each doubling
    total, least = 0, 1 << 62
    for s in steps:
        total += s.rows
        if total > most:
            break
        least = s.n
    return least


def _release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of tables that are written and read back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@dataclass
class KatzModel:
    """words (key, n, base, value), pairs (packed rows of keys and gains by bucket) and the most frequent pairs (key, gain), all stored tables; and what is true of all tokens."""

    words: DataFrame
    pairs: DataFrame
    hot_pairs: DataFrame
    buckets: int
    tokens: int
    distinct: int
    unknown: float  # log10 P of the unknown word
    start: float  # log10 alpha of the start mark
    base_unknown: float


def held_out(doc_id: str = "doc_id") -> Column:
    """The row is not learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _narrow(documents: DataFrame, text_col: str) -> DataFrame:
    return documents.select(F.col(text_col).cast("binary").alias("text"))


def train(documents: DataFrame, p: KatzParams = PARAMS, text_col: str = "text") -> KatzModel:
    """The model of all rows of documents."""
    with shuffles_go(documents.sparkSession):
        return _train(documents, p, text_col)


def _train(documents: DataFrame, p: KatzParams, text_col: str) -> KatzModel:
    spark = documents.sparkSession
    texts = _narrow(documents, text_col)
    counted = materialize(texts.mapInArrow(_count_words(p), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "word-counts")
    rows = texts.count()
    seen = {r.r: r.k for r in counted.groupBy(F.least("n", F.lit(p.top + 2)).alias("r")).agg(F.count("*").alias("k")).collect()}
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    d1 = discounts(seen, p.top)
    known = counted.agg(F.sum(_discounted("n", d1))).first()[0] or 0.0
    mass = known / total if total else 0.0
    scale = 1.0 if not total or 1 - mass >= 0.5 / (total + 1) else total / (total + 1) / mass
    prob = _discounted("n", d1) * scale / max(total, 1)
    unknown = math.log10(1 - mass * scale) if total else 0.0

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * width, total // 1_000_000 + 1)
    # Words of more than a quarter of a bucket's share, at most p.hot of them, are dealt out by pair.
    dealt_from = max(total // (4 * buckets) + 1, _frequent_from(counted, p.hot))
    often = counted.where(F.col("n") >= dealt_from).select("key", prob.alias("p")).toPandas()  # at most p.hot rows
    often = often.sort_values("key", key=lambda k: k.to_numpy(np.int64).view(np.uint64))
    frequent, frequent_p = often["key"].to_numpy(np.int64).view(np.uint64), often["p"].to_numpy(np.float64)
    pairs = texts.mapInArrow(_count_pairs(p, buckets, frequent), "bucket int, a binary, b binary, c binary")
    words = counted.where((F.col("n") >= p.min_pairs) & (F.col("n") < dealt_from)).select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key", prob.alias("p"))
    summed = materialize(pairs.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_sum_pairs(p, frequent, frequent_p), "hist long, key long, n long, p double, slice int"), "pair-counts", ["slice"])
    _release(spark)
    seen2 = {int(r.r): r.k for r in summed.where(F.col("slice") == p.slices).groupBy(F.col("key").alias("r")).agg(F.sum("n").alias("k")).collect()}
    d2 = discounts(seen2, p.top)

    start = int(START.view(np.int64))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(p.parts)).cast("int").alias("part")
    times = counted.select(F.col("key").alias("hist"), F.col("n").alias("times")).union(spark.range(1).select(F.lit(start).alias("hist"), F.lit(rows).cast("long").alias("times")))
    share = F.col("m") / F.col("times")
    # A history all of whose followers are frequent would leave nothing for the others.
    shrink = F.when(1 - share < 0.5 / (F.col("times") + 1), F.col("times") / (F.col("times") + 1) / share).otherwise(F.lit(1.0))
    gain = F.log10(_discounted("n", d2) * F.col("shrink") / F.col("times")) - F.col("alpha") - F.log10("p")
    # A bucket is a partition of the evaluation: keys are hashes, so buckets are even without more of them than tasks.
    model_buckets = max(width, total // p.task_tokens + 1)
    pairs_from = _frequent_from(summed.where(F.col("slice") < p.slices), p.hot)
    hists, pair_models, hot_models = [], [], []
    for i in range(p.slices):
        kept = summed.where(F.col("slice") == i).drop("slice")
        per = kept.groupBy("hist").agg(F.sum(_discounted("n", d2)).alias("m"), F.sum("p").alias("low")).join(times.where(F.pmod("hist", F.lit(p.slices)) == i), "hist")
        per = per.withColumn("shrink", shrink).withColumn("alpha", F.log10((1 - share * F.col("shrink")) / (1 - F.col("low"))))
        hists.append(materialize(per.select("hist", "times", "shrink", "alpha"), "histories"))
        del per
        _release(spark)
        gains = lambda rows: rows.join(hists[-1], "hist").select("key", gain.cast("float").alias("gain"))
        packed = gains(kept.where(F.col("n") < pairs_from)).mapInArrow(_pack_model(PAIRS, model_buckets, p.held_pairs), ROW)
        pair_models.append(materialize(packed.withColumn("part", F.lit(i)), "pairs", ["part"]))
        hot_models.append(materialize(gains(kept.where(F.col("n") >= pairs_from)), "hot-pairs"))
        _release(spark)
    discard(spark, summed)
    pair_model = reduce(DataFrame.union, pair_models)
    base = F.log10((F.col("n") + 1) / F.lit(float(total + distinct + 1)))
    every = reduce(DataFrame.union, hists)
    alphas = every.select(F.col("hist").alias("key"), "alpha")
    value = F.log10(prob) + F.coalesce("alpha", F.lit(0.0))
    word_model = materialize(counted.join(alphas, "key", "left").select("key", "n", base.alias("base"), value.alias("value"), part("key")), "words", ["part"])
    begin = every.where(F.col("hist") == start).select("alpha").first()
    for used in (counted, *hists):
        discard(spark, used)
    _release(spark)
    return KatzModel(word_model, pair_model, reduce(DataFrame.union, hot_models), model_buckets, int(total), int(distinct), unknown, begin[0] if begin else 0.0, -math.log10(total + distinct + 1))


# Kinds of packed rows: the model's words and pairs, lookups of both, and what a chunk knows without them.
WORDS, PAIRS, ASK_WORDS, ASK_PAIRS, CHUNK = range(5)
ROW = "bucket int, kind int, chunk long, a binary, b binary, c binary, d binary"


def _rows(items: list[tuple]) -> Iterator[pa.RecordBatch]:
    if items:
        types = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*items, strict=True), types, strict=True)], names=["bucket", "kind", "chunk", "a", "b", "c", "d"])


def _pack_model(kind: int, buckets: int, held_rows: int):
    """Model rows (key; one or two values) to packed rows by key, many batches at a time."""

    def packed(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, *values = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        key, values = key.view(np.uint64), [v.astype(F4 if kind == PAIRS else F8) for v in values]
        order, places = _deal(key.view(np.int64) % buckets, buckets)
        key, values = key[order], [v[order] for v in values]
        out = []
        for i, s in places:
            out.append((i, kind, None, _blob(key[s]), _blob(values[0][s]), _blob(values[1][s]) if len(values) > 1 else None, None))
        yield from _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            if b.num_rows:
                held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)])
                size += b.num_rows
            if size > held_rows:
                yield from packed(held)
                size = 0
        if held:
            yield from packed(held)

    return run


def _ask(p: KatzParams, model: KatzModel, hot_words, hot_pairs, buckets: int):
    unknown, start, base_unknown = model.unknown, model.start, model.base_unknown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wk, wbase, wvalue = hot_words.value
        pk, pgain = hot_pairs.value
        number = TaskContext.get().partitionId() << 32
        for batch in kernel.chunks(batches, p.chunk_rows, p.chunk_bytes):
            word, before, doc = tokens(batch.column("text"))
            n = batch.num_rows
            at, hot = _in(wk, word)
            rest = ~hot
            every = np.bincount(doc, minlength=n)
            known = np.bincount(doc[hot], minlength=n)
            base = np.bincount(doc, weights=np.where(hot, wbase[at] if len(wk) else 0.0, base_unknown), minlength=n)
            score = np.bincount(doc, weights=np.where(hot, wvalue[at] if len(wk) else 0.0, unknown), minlength=n) + start
            key = kernel.combine(before, word)
            at, paired = _in(pk, key)
            if paired.any():
                score += np.bincount(doc[paired], weights=pgain[at[paired]], minlength=n)
            items = []
            for kind, keys, own in ((ASK_WORDS, word[rest], doc[rest]), (ASK_PAIRS, key[~paired], doc[~paired])):
                dealt = keys.view(np.int64) % buckets
                order, places = _deal(dealt, buckets)
                keys, own = keys[order], own[order].astype("<u2" if p.chunk_rows <= 1 << 16 else "<u4")
                for i, s in places:
                    items.append((i, kind, number, _blob(keys[s]), _blob(own[s]), None, None))
            ids = batch.column("doc_id")
            info = np.stack([every, known], axis=1).astype(I8)
            flags = np.stack([np.array(ids.is_valid().to_numpy(zero_copy_only=False)), batch.column("held").to_numpy(zero_copy_only=False)], axis=1).astype("u1")
            items.append((number % buckets, CHUNK, number, _blob(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(I8)), _blob(flags), _blob(info), _blob(np.stack([base, score], axis=1).astype(F8))))
            yield from _rows(items)
            number += 1

    return run


def _grouped(place: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct places, ascending, with the sums of their values."""
    order = np.argsort(place, kind="stable")
    place = place[order]
    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    return place[at], *(np.add.reduceat(v[order], at) if len(place) else v for v in values)


def _answer(p: KatzParams, model: KatzModel):
    """One task's lookups: sums by chunk and text; what chunks know passes through.

    The partition is sorted: first the model's rows, which are held, then the lookups by chunk, which stream through.
    """
    unknown, base_unknown = model.unknown, model.base_unknown
    small = "<u2" if p.chunk_rows <= 1 << 16 else "<u4"

    def table(held: list[tuple[bytes, bytes, bytes | None]], kind: int) -> tuple[np.ndarray, ...]:
        get = lambda i, t: np.concatenate([np.frombuffer(r[i], t) for r in held]) if held else np.zeros(0, t)
        key = get(0, "<u8")
        order = np.argsort(key)
        values = (get(1, F8)[order], get(2, F8)[order]) if kind == WORDS else (get(1, F4)[order],)
        held.clear()
        return key[order], *values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORDS: [], PAIRS: []}
        words = pairs = None
        for b in batches:
            through, asked = [], {ASK_WORDS: [], ASK_PAIRS: []}
            for row in zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "chunk", "a", "b", "c", "d")), strict=True):
                kind = row[0]
                if kind in held:
                    held[kind].append(row[3:6])
                elif kind == CHUNK:
                    through.append((row[1], kind, *row[2:]))
                else:
                    asked[kind].append(row[2:5])
            yield from _rows(through)
            if not any(asked.values()):
                continue
            if words is None:
                words, pairs = table(held[WORDS], WORDS), table(held[PAIRS], PAIRS)
            chunk = np.unique([r[0] for rows in asked.values() for r in rows])
            places, sums = [], []
            for kind, model_rows in ((ASK_WORDS, words), (ASK_PAIRS, pairs)):
                rows = asked[kind]
                if not rows:
                    continue
                keys = [np.frombuffer(r[1], "<u8") for r in rows]
                place = np.concatenate([np.frombuffer(r[2], small) for r in rows]).astype(np.int64)
                place += np.repeat(np.searchsorted(chunk, [r[0] for r in rows]), [len(k) for k in keys]) * p.chunk_rows
                at, there = _in(model_rows[0], np.concatenate(keys))
                place, at = place[there], at[there]
                places.append(place)
                if kind == ASK_WORDS:
                    sums.append((np.ones(len(at), np.uint32), words[1][at] - base_unknown, words[2][at] - unknown))
                else:
                    sums.append((np.zeros(len(at), np.uint32), np.zeros(len(at)), pairs[1][at].astype(F8)))
            place, known, base, gain = _grouped(np.concatenate(places), *(np.concatenate(x) for x in zip(*sums, strict=True)))
            cut = np.searchsorted(place, np.arange(len(chunk) + 1) * p.chunk_rows)
            out = []
            for i, c in enumerate(chunk.tolist()):
                s = slice(cut[i], cut[i + 1])
                if cut[i] < cut[i + 1]:
                    out.append((0, ASK_PAIRS, c, _blob((place[s] - i * p.chunk_rows).astype(small)), _blob(known[s].astype("<u4")), _blob(base[s].astype(F8)), _blob(gain[s].astype(F8))))
            yield from _rows(out)

    return kernel.trimmed(run)


def _finish(p: KatzParams, total: int):
    small = "<u2" if p.chunk_rows <= 1 << 16 else "<u4"

    def run(rows: pa.Table) -> pa.Table:
        parts = rows.to_pylist()
        whole = next(r for r in parts if r["kind"] == CHUNK)
        ids, flags = np.frombuffer(whole["a"], I8), np.frombuffer(whole["b"], "u1").reshape(-1, 2)
        info, scores = np.frombuffer(whole["c"], I8).reshape(-1, 2).copy(), np.frombuffer(whole["d"], F8).reshape(-1, 2).copy()
        for r in sorted((r for r in parts if r["kind"] != CHUNK), key=lambda r: r["a"] + r["d"]):
            doc = np.frombuffer(r["a"], small)
            info[doc, 1] += np.frombuffer(r["b"], "<u4")
            scores[doc, 0] += np.frombuffer(r["c"], F8)
            scores[doc, 1] += np.frombuffer(r["d"], F8)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=flags[:, 0] == 0),
                "held_out": pa.array(flags[:, 1] == 1),
                "n_tokens": pa.array(info[:, 0]),
                "n_known": pa.array(info[:, 1]),
                "train_tokens": pa.array(np.full(len(ids), total, np.int64)),
                "base_score": pa.array(scores[:, 0]),
                "score": pa.array(scores[:, 1]),
            }
        )

    return run


def score(documents: DataFrame, model: KatzModel, p: KatzParams = PARAMS, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of documents."""
    with shuffles_go(documents.sparkSession):
        return _score(documents, model, p, id_col, text_col, held)


def _score(documents: DataFrame, model: KatzModel, p: KatzParams, id_col: str, text_col: str, held: Column | None) -> DataFrame:
    spark = documents.sparkSession
    sc = spark.sparkContext
    buckets = width = model.buckets
    words_from = _frequent_from(model.words, p.hot)
    w = model.words.where(F.col("n") >= words_from).select("key", "base", "value").toPandas()  # at most p.hot rows
    w = w.iloc[np.argsort(w["key"].to_numpy(np.int64).view(np.uint64))]
    hot_words = sc.broadcast((w["key"].to_numpy(np.int64).view(np.uint64), w["base"].to_numpy(np.float64), w["value"].to_numpy(np.float64)))
    q = model.hot_pairs.toPandas()  # at most p.hot rows
    key = q["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    hot_pairs = sc.broadcast((key[order], q["gain"].to_numpy(np.float64)[order]))

    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(False) if held is None else held).alias("held"), F.col(text_col).cast("binary").alias("text"))
    told = model.words.where(F.col("n") < words_from).select("key", "base", "value").mapInArrow(_pack_model(WORDS, buckets, p.held_pairs), ROW)
    paired = model.pairs.drop("part")
    out = []
    for i in range(p.text_slices):
        mine = texts.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(p.text_slices)) == i)
        asked = mine.mapInArrow(_ask(p, model, hot_words, hot_pairs, buckets), ROW)
        every = asked.union(told).union(paired).repartitionById(width, "bucket")
        answered = every.sortWithinPartitions(F.col("kind") >= ASK_WORDS, "chunk", "kind").mapInArrow(_answer(p, model), ROW)
        scored = answered.groupBy("chunk").applyInArrow(
            _finish(p, model.tokens), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        )
        out.append(materialize(scored, "scores"))
        del mine, asked, answered, scored
        _release(spark)
    return reduce(DataFrame.union, out)


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(documents.where(~held_out()), OP1)
    return score(documents, model, OP1, held=held_out())
