"""Lookups of the Katz model."""

from __future__ import annotations

import gc
import time

import numpy as np

from runpath.llm import katz


def test_keys_are_looked_up_in_order(monkeypatch):
    """Keys were looked up in a table of millions in the order of the text, each far from the one before."""
    table, keys = np.array([2, 5, 7, 1 << 63], np.uint64), np.array([7, 1 << 63, 1, 5, 9, 5, (1 << 64) - 1], np.uint64)
    plain, seen = np.searchsorted, []
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *r: seen.append(v) or plain(a, v, *r))
    at, there = katz._in(table, keys)
    assert there.tolist() == [True, True, False, True, False, True, False] and at[there].tolist() == [2, 3, 1, 1]
    assert all((np.diff(v.astype(object)) >= 0).all() for v in seen) and at.tolist() == np.minimum(plain(table, keys), 3).tolist()
    assert [len(x) for x in katz._in(table[:0], keys)] == [7, 7] and [len(x) for x in katz._in(table, keys[:0])] == [0, 0]


def test_shuffle_files_go_slice_by_slice(spark, monkeypatch):
    """The shuffle files of a slice stayed on disk, whatever the garbage collector was told, while the next one's were written."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(b.startswith("shuffle_") for b in blocks.getAllBlocks().mkString("\n").split("\n"))

    def left(before):
        end = time.time() + 5
        while files() > before and time.time() < end:
            time.sleep(0.05)
        return files() - before

    plain, over = katz.materialize, []

    def write(df, name="table", *rest):
        gc.collect()
        before = files()
        out = plain(df, name, *rest)
        if name in ("pair-counts", "scores"):
            over.append((name, left(before)))
        return out

    monkeypatch.setattr(katz, "materialize", write)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i % 5} a b{i % 3}") for i in range(200)], "doc_id long, text string")
    scored = katz.score(docs, katz.train(docs, katz.OP1), katz.OP1)
    assert scored.count() == 200 and spark.conf.get(name) == setting
    assert [n for n, _ in over] == ["pair-counts", "scores", "scores"] and all(n <= 0 for _, n in over)
