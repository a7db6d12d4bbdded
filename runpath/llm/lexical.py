"""Ranked lexical search by Fagin's threshold algorithm over an index dealt by documents.

The items' terms (of ``pass_terms`` pairs of item and term at a time, about) are
broadcast; one scan of the documents stores, for each, its number of terms and how
often the items' terms occur in it.  That table is the forward index; sums over it give
the statistics of all documents.  Each task then takes its documents in blocks, sorts a
list of impacts for each term, highest first, and runs the threshold algorithm for each
item: all lists of the item are read in turn to the same depth, the score of every
document met is looked up in the forward index, and the item stops when the sum of the
impacts last read, which no document not met can exceed, lies strictly below the k-th
best score so far.  Reading goes in steps of growing depth.  The k best of each task are
ranked by item.  No list of a term is ever gathered in one place, however common the
term; a first search among ``seed_rows`` documents, about, gives scores that k documents
reach, from which all tasks start.

An impact is the weight of the term times a saturating share of its occurrences; all is
integer arithmetic of 64 bits but for the logarithm in the weight.

Defined results: a null or empty text has no terms; it counts nowhere.  Documents without
an id count in the statistics and are not returned; rows of one id are documents each.
An item without terms, without an id, or whose terms occur nowhere gives no rows; of
items of one id the one of the smallest text counts.  Equal scores go by ascending id.
Texts are read whole, however long; words equal by hash are compared byte by byte.
An empty table gives no rows.  Columns besides ids and texts are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runpath.llm import kernel
from runpath.llm.storage import Tables, discard, materialize, small_batches


@dataclass(frozen=True)
class LexicalParams:
    k: int = 10
    #: Pairs of item and term that one pass over the documents takes, about.
    pass_terms: int = 200_000
    #: Documents, and their postings, in which a task runs the algorithm at a time.
    block_docs: int = 16_384
    block_postings: int = 1_000_000
    #: Depth of the first step of reading; each further step is as deep as all before.
    step: int = 16
    #: Documents, about, of the search that gives each item a floor; none for tables of less than four times as many.
    seed_rows: int = 8192
    #: Texts, and bytes of them, whose words are held at a time.
    chunk_rows: int = 512
    chunk_bytes: int = 2 << 20


PARAMS = LexicalParams()

#: Maximal runs of ASCII letters and digits and of all beyond ASCII.
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_INDEX = "doc_id long, n long, terms array<int>, tf array<int>"
_FOUND = "item_id string, doc_id long, score long"


class Dictionary:
    """The terms of a pass, by hash."""

    def __init__(self, terms: list[bytes]):
        length = np.array([len(t) for t in terms], np.int64)
        end = np.cumsum(length)
        data = np.frombuffer(b"".join(terms), np.uint8)
        hashes = kernel.hash_spans(data, end - length, end) if len(terms) else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")  # place by hash -> number of the term
        self.hashes, self.size = hashes[self.order], len(terms)
        self.data, self.start, self.length = data, end - length, length
        self.alike = int(np.unique(hashes, return_counts=True)[1].max(initial=1))  # terms of one hash at most

    def find(self, data: np.ndarray, st: np.ndarray, en: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, number of its term) of the words that are terms."""
        h = kernel.hash_spans(data, st, en)
        at = np.searchsorted(self.hashes, h)
        words, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for more in range(self.alike):
            place = np.minimum(at + more, max(self.size - 1, 0))
            same = np.flatnonzero(self.hashes[place] == h) if self.size else np.zeros(0, np.int64)
            term = self.order[place[same]] if self.size else same
            fit = en[same] - st[same] == self.length[term]
            same, term = same[fit], term[fit]
            if len(same):
                size = self.length[term]
                to = np.cumsum(size) - size
                within = np.arange(int(size.sum())) - np.repeat(to, size)
                differ = kernel.LOWER[data[np.repeat(st[same], size) + within]] != self.data[np.repeat(self.start[term], size) + within]
                good = np.add.reduceat(differ, to, dtype=np.int64) == 0
                words.append(same[good])
                terms.append(term[good])
        return np.concatenate(words), np.concatenate(terms)


def _index(shared, p: LexicalParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Dictionary = shared.value
        for b in kernel.chunks(batches, p.chunk_rows, p.chunk_bytes):
            data, off = kernel.flat(b.column("text"))
            st, en, first = kernel.words(data, off, kernel.NON_ALNUM)
            word, term = known.find(data, st, en)
            keys, tf = np.unique(kernel.owner(first)[word] * max(known.size, 1) + term, return_counts=True)
            cut = pa.array(np.searchsorted(keys // max(known.size, 1), np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (keys % max(known.size, 1), tf)]
            rows = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first), pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])
            yield rows.filter(pa.array(np.diff(first) > 0))

    return kernel.trimmed(run)


@dataclass(frozen=True)
class Search:
    """What tasks need: items with their terms and how often, the weight of each term, and the statistics."""

    items: list[tuple[str, np.ndarray, np.ndarray]]
    weight: np.ndarray
    n_docs: int
    n_terms: int
    floors: dict[str, int]


def impacts(s: Search, n: np.ndarray, term: np.ndarray, tf: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Impact of each posting (term, tf) of a document of n[doc] terms."""
    if 75 * int(n.max(initial=0)) * s.n_docs < 2**63:
        m = 25 + 75 * n * s.n_docs // s.n_terms
    else:
        m = np.array([25 + 75 * x * s.n_docs // s.n_terms for x in n.tolist()], np.int64)
    return s.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))


class Block:
    """Documents with their forward index and a list of impacts, highest first, for each term."""

    def __init__(self, s: Search, ids: np.ndarray, n: np.ndarray, cut: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.ids, self.cut, self.term = ids, cut, term
        doc = np.repeat(np.arange(len(ids)), np.diff(cut))
        self.impact = impacts(s, n, term, tf, doc)
        order = np.lexsort((-self.impact, term))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(s.weight) + 1))

    def scores(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Random access: the whole scores of documents (with at least one posting), from the forward index."""
        size = self.cut[docs + 1] - self.cut[docs]
        to = np.cumsum(size) - size
        at = np.repeat(self.cut[docs] - to, size) + np.arange(int(size.sum()))
        return np.add.reduceat(self.impact[at] * times[self.term[at]], to)


def threshold_search(b: Block, terms: np.ndarray, n: np.ndarray, times: np.ndarray, best: tuple[np.ndarray, np.ndarray], floor: int, p: LexicalParams) -> tuple[np.ndarray, np.ndarray]:
    """best (scores, ids), improved by the documents of a block; times[t]: how often term t is in the item (terms, n)."""
    start, end = b.first[terms], b.first[terms + 1]
    there = end > start
    start, end, n = start[there], end[there], n[there]
    scores, ids = best
    seen = np.zeros(len(b.ids), bool)
    depth, step = 0, p.step
    while len(start):
        # No document that is not met yet scores more than this: it stands in each list at this depth or below.
        bound = int((n * b.list_impact[start + depth]).sum())
        least = max(floor, int(scores[-1]) if len(scores) >= p.k else 1)
        if bound < least:
            break
        to = np.minimum(start + depth + step, end)
        size = to - start - depth
        at = np.repeat(start + depth - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        met = np.unique(b.list_doc[at])
        met = met[~seen[met]]
        seen[met] = True
        if len(met):
            found = b.scores(met, times)
            good = found >= least
            s, i = np.concatenate([scores, found[good]]), np.concatenate([ids, b.ids[met[good]]])
            top = np.lexsort((i, -s))[: p.k]
            scores, ids = s[top], i[top]
        depth, step = depth + step, depth + step
        more = start + depth < end
        start, end, n = start[more], end[more], n[more]
    return scores, ids


def _search(shared, p: LexicalParams):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, docs, postings = [], 0, 0
        for batch in batches:
            lists = batch.column("terms")
            ends = lists.offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                fit = int(np.searchsorted(ends, ends[at] + p.block_postings - postings, side="right")) - 1
                to = min(batch.num_rows, at + p.block_docs - docs, max(fit, at + (not held)))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    docs, postings = docs + to - at, postings + int(ends[to] - ends[at])
                    at = to
                if at < batch.num_rows:
                    yield pa.Table.from_batches(held)
                    held, docs, postings = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Search = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(s.items)
        times = np.zeros(len(s.weight), np.int64)
        for table in blocks(batches):
            lists = table.column("terms").combine_chunks()
            off = lists.offsets.to_numpy().astype(np.int64)
            column = lambda x: x.to_numpy().astype(np.int64)
            b = Block(s, column(table.column("doc_id")), column(table.column("n")), off - off[0], column(lists.flatten()), column(table.column("tf").combine_chunks().flatten()))
            for i, (item, terms, n) in enumerate(s.items):
                times[terms] = n
                best[i] = threshold_search(b, terms, n, times, best[i], s.floors.get(item, 1), p)
                times[terms] = 0
        count = [len(scores) for scores, _ in best]
        if sum(count):
            ids = [item for (item, *_), c in zip(s.items, count, strict=True) for _ in range(c)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([x for x, _ in best]))], names=["item_id", "doc_id", "score"])

    return kernel.trimmed(run)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id string, term, n): the terms of each item."""
    text = F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER)
    one = items.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), text.alias("t")).where("item_id is not null").groupBy("item_id").agg(F.min("t").alias("t"))
    return one.select("item_id", F.explode(F.regexp_extract_all("t", F.lit(TERMS), F.lit(0))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


def rank(documents: DataFrame, items: DataFrame, p: LexicalParams = PARAMS, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = documents.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    kind = items.schema[item_col].dataType
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("item_id", "rank", "doc_id", "score")
    results = []
    with Tables(spark) as tables:
        wanted = tables.write(item_terms(items, item_col, text_col), "items")
        passes = max(1, -(-wanted.count() // p.pass_terms))
        for number in range(passes):
            rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number).collect()  # about pass_terms of them
            terms = sorted({r.term for r in rows})
            known = sc.broadcast(Dictionary([t.encode() for t in terms]))
            index = tables.write(docs.mapInArrow(_index(known, p), _INDEX), "index")
            known.destroy()
            n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            df = np.zeros(len(terms), np.int64)
            for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the pass
                df[r["t"]] = r["count"]
            weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
            place = {t: i for i, t in enumerate(terms)}
            by_item: dict[str, list[tuple[int, int]]] = {}
            for r in rows:
                by_item.setdefault(r.item_id, []).append((place[r.term], r.n))
            each = [(i, *np.array(sorted(pairs), np.int64).T) for i, pairs in sorted(by_item.items())]

            def searched(among: DataFrame, floors: dict[str, int], name: str, each=each, weight=weight, n_docs=n_docs, n_terms=n_terms) -> DataFrame:
                shared = sc.broadcast(Search(each, weight, n_docs, n_terms, floors))
                out = materialize(ranked(among.mapInArrow(_search(shared, p), _FOUND)), name)
                shared.destroy()
                return out

            named = index.where("doc_id is not null")
            floors = {}
            if n_docs >= 4 * p.seed_rows:
                first = searched(named.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(n_docs // p.seed_rows)) == 0), {}, "seeds")
                floors = {r.item_id: r.score for r in first.where(F.col("rank") == p.k).collect()}  # a row for each item of the pass
                discard(spark, first)
            results.append(searched(named, floors, "ranked").table_path)
    found = spark.read.schema("item_id string, rank int, doc_id long, score long").parquet(*results)
    return found.withColumn("item_id", F.col("item_id").cast(kind))


def op13_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB: the same scores, all of them.
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERMS}')) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERMS}')) AS term FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
dl AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM dl),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
m AS (SELECT doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM dl, s),
r AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
