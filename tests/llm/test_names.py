"""Columns whose names operators might use inside pass every stage; two runs that edit one slot map."""

import threading

import pytest
from pyspark.sql import functions as F

from runpath.llm import bpe, decontaminate, mixing, near_dedup, pii, sharding, toxicity

NAMES = "__id __bits __bucket __key __row __copy __clean __toxicity __twin __h __s __x key row id done mark text2 n first a.b rep kept component score spans_ bin q u f rest sure edge last more vslot shard version rank start".split() + ["x y", "tick`"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["some words here that stand for a text of their own number %d and more of it" % i for i in range(12)]
    texts += [texts[0], texts[1] + " tail", None, "", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen and some other words that are left " * 2]
    rows = [(i, t, "en", "s%d" % (i % 2), len(t or ""), f"v{i}") for i, t in enumerate(texts)] + [(3, "another text under an id that is there already", "en", "s0", 46, "v3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, v string")
    return df.select("*", *(F.col("v").alias(n) for n in NAMES if "`" not in n), F.col("v").alias("x``y".replace("``", "'")))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")


def check(out, docs):
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows
    for r in rows:
        assert len({r[c] for c in docs.columns[5:]}) == 1 and r["v"] == f"v{r['doc_id']}"
    return rows


def test_stages_keep_columns(spark, docs, items):
    labels = spark.createDataFrame([(i, int(i == 5)) for i in range(12)], "doc_id long, toxic int")
    assert len(check(toxicity.reject_toxic(docs, labels), docs)) >= 10
    kept = check(near_dedup.keep_one(docs), docs)
    assert sum(r["doc_id"] == 3 for r in kept) == 2 and not any(r["doc_id"] == 12 for r in kept)
    cleaned = check(decontaminate.decontaminate(docs, items), docs)
    assert all(r["n_chars"] == len(r["text"] or "") for r in cleaned)
    check(mixing.take(docs), docs)
    assert sharding.shard(docs).count() == docs.count()


def test_operators_keep_columns(docs):
    assert pii.find_pii(docs).columns == [*docs.columns, "spans"] and len(pii.find_pii(docs).collect()) == docs.count()
    assert bpe.decode(bpe.encode(docs)).columns == [*docs.columns, "ids", "decoded"]


def test_maps_of_runs_at_once(spark, tmp_path):
    """Each version is written by one run; the other goes on from it, and no draft is left."""
    path, p = f"file://{tmp_path}/map", sharding.ShardParams(shards=4, slots=64)
    rows = [sharding.records(spark.createDataFrame([(i, "x" * (i * k % 97)) for i in range(300)], "doc_id long, text string"), p) for k in (3, 7)]
    found = [None, None]

    def run(i):
        found[i] = sharding.slot_map(rows[i], p, path).collect()

    threads = [threading.Thread(target=run, args=(i,)) for i in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(len(f) == 64 and len({r.version for r in f}) == 1 for f in found)
    versions = sorted(x.name for x in (tmp_path / "map").iterdir() if not x.name.startswith("."))
    assert versions == [f"version={i + 1}" for i in range(len(versions))] and len(versions) <= 3
    assert not sharding._write_version(spark, path, 1, [0] * 64, [0] * 64)
    again = sharding.slot_map(rows[0], p, path).collect()
    assert {r.vslot: r.shard for r in again} == {r.vslot: r.shard for r in sharding.slot_map(rows[0], p, path).collect()}


def test_shard_follows_from_rows(spark, docs):
    one, two = ([tuple(r) for r in sharding.shard(docs).orderBy("shard", "slot").collect()] for _ in "ab")
    assert one == two
