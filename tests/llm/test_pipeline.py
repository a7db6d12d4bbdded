"""The pipeline on the smallest tables against the operators' own results."""

import collections
import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runpath.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from test_ops import frame, naive_components

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        seen[name] = docs
        if name != "shard":
            assert docs.columns == columns
    kept = near_dedup.near_duplicates(seen["toxicity"], near_dedup.PIPELINE).where("kept").count()
    assert seen["near_dedup"].count() == kept == seen["near_dedup"].select("doc_id").distinct().count()
    match = decontaminate.match_column(decontaminate.automata(spark.read.parquet(f"{DATA}/benchmark.parquet")))
    assert seen["decontaminate"].select(F.sum(match("text")["n_hit"])).first()[0] == 0
    assert seen["mix"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert seen["shard"].count() == seen["mix"].count()


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def naive_clean(text, items):
    """text without test passages, or None if too much of it is one."""
    window, total = decontaminate.PARAMS.window, 0
    low = lambda t: [w.lower() for w in WORD.findall(t)]
    grams = {tuple(w[i : i + min(window, len(w))]) for w in map(low, items) if w for i in range(max(len(w) - window, 0) + 1)}
    while True:
        at = [m.span() for m in WORD.finditer(text)]
        w, hit = low(text), set()
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
        if not hit:
            return text
        total = total or len(w)
        if len(hit) > decontaminate.PARAMS.max_coverage * total:
            return None
        parts, end = [], 0
        for i in sorted(hit):
            if i - 1 not in hit:
                parts.append(text[end : at[i][0]])
            end = at[i][1]
        text = "\n".join([*parts, text[end:]])


def naive_mix(rows, p=mixing.PARAMS):
    """Copies of each (doc_id, text, source)."""
    size, by = collections.Counter(), collections.defaultdict(list)
    for i, t, s in rows:
        n = len(t.split())
        digest = hashlib.md5(t.encode()).hexdigest()
        u = (int(hashlib.md5(f"{p.seed}|{i}|{n}|{digest}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by[s].append((u, n, i, digest))
        size[s] += n
    weight = {s: p.weights[k % len(p.weights)] for k, s in enumerate(sorted(size))}
    total, free, target = sum(size.values()) * p.percent / 100, set(size), {}
    while True:
        unit = total / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > p.most_copies * size[s]]
        if not over:
            break
        for s in over:
            target[s] = float(p.most_copies * size[s])
            total -= target[s]
            free.remove(s)
    target |= {s: unit * weight[s] for s in free}
    copies = {}
    for s, docs in by.items():
        sure = int(target[s] // size[s])
        f, rest = target[s] / size[s] - sure, target[s] - sure * size[s]
        copies |= {i: sure for _, _, i, _ in docs}
        if f <= 0:
            continue
        for _, n, i, _ in sorted((u / (1 - u) / (f / (1 - f)), n, i, d) for u, n, i, d in docs):
            if n <= rest:
                rest -= n
                copies[i] += 1
    return copies


def naive_map(bytes_of, p):
    """Shard of each slot: the fullest shard gives to the emptiest while that narrows the gap."""
    out, load = [s % p.shards for s in range(p.slots)], [0] * p.shards
    for v, b in enumerate(bytes_of):
        load[out[v]] += b
    while True:
        a, b = load.index(max(load)), load.index(min(load))
        gap = load[a] - load[b]
        fit = [(abs(gap - 2 * x), v, x) for v, x in enumerate(bytes_of) if out[v] == a and 0 < x < gap]
        if not fit:
            return out
        _, v, x = min(fit)
        out[v] = b
        load[a] -= x
        load[b] += x


def test_run_is_brute_force(spark, tmp_path):
    r = random.Random(23)
    text = lambda n: " ".join(f"v{r.randrange(800)}" for _ in range(n))
    items = [text(14), text(25), text(4)]
    texts = [text(r.randrange(30, 90)) for _ in range(240)]
    for i in range(0, 60):
        texts[i] += " vile scum"
    texts[100:112] = [t + " tail" for t in texts[80:92]]
    texts[112:118] = texts[92:98]
    for i in range(120, 135):
        texts[i] += ", " + items[i % 3].upper() + "! " + text(5)
    texts[135:138] = [items[0], items[1] + " end", "x " + items[2]]
    sources = ["a", "b", "c", "d"]
    frame(spark, texts, sources=sources).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60)) for i in range(240) if i % 8], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")

    scores = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, labels).collect()}
    left = [i for i in range(240) if scores[i] < toxicity.PARAMS.threshold]
    assert sum(i < 60 for i in left) < 10 and sum(i >= 60 for i in left) > 170
    top, _ = naive_components([texts[i] for i in left], left, near_dedup.PIPELINE.words, near_dedup.PIPELINE.percent)
    single = [i for i in left if top[i] == i]
    assert len(left) - len(single) >= 15
    clean = {i: c for i in single if (c := naive_clean(texts[i], items)) is not None}
    assert len(clean) < len(single) and sum(clean[i] != texts[i] for i in clean) >= 10
    copies = naive_mix([(i, c, sources[i % 4]) for i, c in clean.items()])

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    p = sharding.PARAMS
    want = collections.Counter({(i, len(clean[i].encode()) + p.overhead, zlib.crc32(clean[i].encode())): n for i, n in copies.items() if n})
    assert collections.Counter((x.doc_id, x.size, x.text_crc32) for x in rows) == want
    bytes_of, place = [0] * p.slots, collections.Counter()
    for x in rows:
        bytes_of[x.vslot] += x.size
    shard_of = naive_map(bytes_of, p)
    for x in sorted(rows, key=lambda x: (x.vslot, x.doc_id, x.text_crc32, x.size, x.slot)):
        assert (x.shard, x.slot) == (shard_of[x.vslot], place[x.shard])
        place[x.shard] += 1
