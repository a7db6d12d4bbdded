"""Whitening, BPE and ranked search against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, extra columns."""

import collections
import math
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runpath.llm import bpe, lexical, queries, whitening


# -- 11 ---------------------------------------------------------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, x string, d int")


def brute(rows, k=16):
    """vec_id -> (n, deviation, whitened up to sign), shares; of the rows of one length."""
    xs = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, turns = np.linalg.eigh(centred.T @ centred / n)
    values, turns = values[::-1], turns[:, ::-1]
    there = [j for j in range(min(k, len(values))) if values[j] > values[0] * 1e-11]
    out = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)]) @ turns[:, there] / np.sqrt(values[there])) for i, x in xs]
    return n, out, values[there] / values.sum()


def check(got, rows):
    n, want, shares = brute(rows)
    by = collections.defaultdict(dict)
    for r in got:
        assert r.n == n and r.identity_error < 1e-4 and abs(r.explained / shares[r.component - 1] - 1) < 1e-4
        by[r.component].setdefault(r.vec_id, []).append((r.deviation, r.whitened))
    assert sorted(by) == [*range(1, len(shares) + 1)]
    for j, found in by.items():
        sign = np.sign(sum(found[i][0][1] * w[j - 1] for i, _, w in want))
        assert sum(map(len, found.values())) == len(want)
        for i, deviation, w in want:
            assert all(d == deviation and abs(sign * x - w[j - 1]) < 1e-9 for d, x in found[i])


def test_whitening(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((300, 20)) * np.linspace(3, 0.2, 20)
    good = [(i, v.tolist()) for i, v in enumerate(base)] + [(500 + i, base[7].tolist()) for i in range(200)] + [(3, base[3].tolist())]
    short = [(900 + i, v.tolist()) for i, v in enumerate(r.standard_normal((40, 3)))]
    odd = [(700, None), (701, []), (702, [float("nan")] * 20), (703, [None] * 20), (704, [float("inf")] * 20), (705, [2.0**60] * 20)]
    got = whitening.whiten(vectors(spark, [(*x, "a", "b", 1) for x in good + short + odd])).collect()
    check([x for x in got if x.vec_id < 700], good)
    check([x for x in got if x.vec_id >= 900], short)
    assert not {x.vec_id for x in got} & set(range(700, 706))


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0], "", "", 0) for i in range(5)])).collect() == []  # no variance
    r = np.random.default_rng(6)
    low = r.standard_normal((80, 2)) @ np.array([[1.0, 1, 0, 0], [0, 0, 2, 2]])
    low = np.floor(low * 8) / 8  # rank 2 stays rank 2 in whole numbers
    rows = [(None if i == 3 else i, v.tolist(), "", "", 0) for i, v in enumerate(low)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {x.component for x in got} == {1, 2} and sum(x.vec_id is None for x in got) == 2
    far = [(i, [2.0**40 * (i + 1), float(i)], "", "", 0) for i in range(4)]
    got = whitening.whiten(vectors(spark, far)).collect()
    assert {x.vec_id for x in got} == {0, 1, 2, 3} and all(x.deviation is None for x in got)


@pytest.mark.parametrize("spectrum", [np.ones(40), np.repeat([9.0, 4, 1, 0], 10), 0.5 ** np.arange(40), np.zeros(40)])
@pytest.mark.parametrize("basis", [512, 64])
def test_block_lanczos(spectrum, basis):
    """Repeated eigenvalues, an invariant first block, fast decay, nothing at all; with and without cutting the basis back."""
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((40, 40)))[0]
    a = q * spectrum @ q.T
    values, turns = whitening.block_lanczos(lambda b: a @ b, 40, replace(whitening.PARAMS, max_basis=basis, block=4, components=6))
    assert np.allclose(values, np.sort(spectrum)[::-1][:6], atol=1e-12)
    assert np.allclose(a @ turns, turns * values, atol=1e-12) and np.allclose(turns.T @ turns, np.eye(6), atol=1e-12)


# -- 12 ---------------------------------------------------------------------------------------------------------------
LIBRARY = Tokenizer.from_file(bpe.PARAMS.path)
ENCODER = bpe.Encoder(bpe.read_vocabulary(bpe.PARAMS.path))


def ids_of(texts, p=bpe.PARAMS):
    ids, off = bpe.encode_texts(ENCODER, bpe.Words(p), texts)
    return [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aabcdeth 's'll\t\n\r 0127éпри中あ🙂ͅ՘aA!-=<|>") | st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_bpe_is_the_library(texts):
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(texts) == want


def test_bpe_classes_of_code_points():
    """Where a text is cut without the library, its classes are the library's, for each code point."""
    pre = LIBRARY.pre_tokenizer.pre_tokenize_str
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if not bpe.OTHER.search(c):
            s = f"a{c}1{c}!{c} {c}"
            assert [m.span() for m in ENCODER.pattern.finditer(s)] == [o for _, o in pre(s)], hex(ord(c))


def test_bpe_every_token_and_long_words():
    assert all(ENCODER.is_own(i) for i in ENCODER.halves)
    texts = ["a" * 40_000, "ab" * 9000, " " * 3000, "ÃÂ" * 900, "=-" * 800, "<|endoftext|>" * 3 + "x<|endoftext|>", "<|endoftext", "", "\x00"]
    assert ids_of(texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    few = replace(bpe.PARAMS, max_words=3)
    known = bpe.Words(few)
    for t in ("one two three four", "five six", "one two six"):
        assert bpe.encode_texts(ENCODER, known, [t])[0].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_bpe_columns(spark):
    texts = [None, "", "Hello world's end", "same", "same", "é<|endoftext|>中文", "x " * 50_000]
    docs = spark.createDataFrame([(i % 4, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, tokens string, key string")
    got = bpe.decode(bpe.encode(docs)).collect()
    assert collections.Counter((r.doc_id, r.text, tuple(r.ids), r.decoded, r.tokens) for r in got) == collections.Counter(
        (i % 4, t, tuple(LIBRARY.encode(t or "", add_special_tokens=False).ids), t or "", "a") for i, t in enumerate(texts)
    )
    assert bpe.encode(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([(0, None), (1, []), (2, [50256, 70000, -1, None, 15496])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(odd).collect()} == {0: None, 1: "", 2: "<|endoftext|>Hello"}


def test_bpe_vocabulary_of_another_kind():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.read_vocabulary("/opt/tokenizers/word_bpe_49k.json")


def test_bpe_query(spark):
    """The registered query against the library on the smallest tables."""
    import hashlib

    data = "/root/testdata/sf0.001"
    want = {}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op12_prefix_trie"](spark, data).collect()} == want


# -- 13 ---------------------------------------------------------------------------------------------------------------
def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def ranked(docs, items, k=10):
    tf = [(i, collections.Counter(words(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = collections.Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items.items():
        scores = []
        for i, c in tf:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "ÄB", "x-y", "THE", "the", "中文"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.choice([1, 5, 30, 200])))) for i in range(400)]
    docs += [(1000 + i, "copy w1 w2 the THE") for i in range(120)]  # ties
    docs += [(7, "w3 w4 w5"), (7, "w3 w4 w5"), (None, "w3 w9 lonely"), (2000, None), (2001, ""), (2002, " .. "), (2003, "w1 " * 60_000 + "rare")]
    items = {i: " ".join(r.choices(vocabulary, k=r.choice([1, 3, 12, 40]))) for i in range(30)}
    items |= {50: "copy", 51: "the", 52: "nowhere", 53: "w3 w3 w3 w4", 54: "rare lonely", 55: "w9 " * 5000}
    return docs, items


@pytest.mark.parametrize("p", [lexical.PARAMS, replace(lexical.PARAMS, pass_terms=40, block_docs=50, block_postings=300, step=2, seed_rows=60, chunk_rows=9)])
def test_ranked_search(spark, corpus, p):
    docs, items = corpus
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({c: F.lit("x") for c in ("score", "n", "terms", "tf", "rank", "item_id")})
    wanted = spark.createDataFrame([*items.items(), (53, "w3 w3 w3 w4"), (55, "zz"), (60, None), (61, ""), (None, "the")], "item_id long, text string").withColumn("t", F.lit(1))
    got = lexical.rank(table, wanted, p)
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"
    assert sorted(map(tuple, got.collect())) == ranked(docs, items)


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert lexical.rank(docs.limit(0), items).collect() == []
    assert lexical.rank(docs, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in lexical.rank(docs, items).collect()] == [("i", 1, 1)]


def test_search_stops_early():
    """Lists of which only the top matters are not read to the end, and a tie with the bound is read on."""
    n = 5000
    ids, tf = np.arange(n), np.where(np.arange(n) < 20, 50, 1)
    s = lexical.Search([], np.array([1000]), n, int(tf.sum()) * 10, {})
    b = lexical.Block(s, ids, np.full(n, 10), np.arange(n + 1), np.zeros(n, np.int64), tf)
    looked = []
    scores = b.scores
    b.scores = lambda docs, times: looked.extend(docs) or scores(docs, times)
    best = lexical.threshold_search(b, np.array([0]), np.array([1]), np.array([1]), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 1, lexical.PARAMS)
    assert best[1].tolist() == [*range(10)] and len(looked) < 100
    best = lexical.threshold_search(b, np.array([0]), np.array([1]), np.array([1]), (best[0], np.arange(10_000, 10_010)), 1, lexical.PARAMS)
    assert best[1].tolist() == [*range(10)]  # documents of the same score and smaller ids
