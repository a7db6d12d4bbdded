"""File changes as a stream: each micro-batch is read by the front end and merged into the index (ST4, ST5)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runpath import fixed
from runpath.operators.index import DefinitionIndex, SymbolIndex
from runpath.operators.storage import Scratch

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def index_stream(spark: SparkSession, folder: str, index: SymbolIndex, state: str, glob: str = "*.c") -> StreamingQuery:
    """Index new and changed files below folder; available files are processed and the query ends, and a rerun goes on from `state`."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)

    def merge(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "path"]), "modificationTime").alias("f")).select("path", "f.*")
        index.refresh(last.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content")))

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()


def prepare(spark: SparkSession, index: SymbolIndex) -> None:
    """Empty tables of an index that a stream fills."""
    index.clear()


def restarted(snapshot: DataFrame, index: SymbolIndex) -> DataFrame:
    """Paths of snapshot(path) that the index does not track yet (ST4)."""
    return snapshot.join(index.read("versions").select("path"), "path", "left_anti").select("path")


def debounced(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Bursts of a key as a stream: one row when a burst has ended (ST6)."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("burst"), F.max(ts).alias(ts)).select(key, ts, "burst")


def define_stream(files: DataFrame, index: DefinitionIndex, state: str) -> StreamingQuery:
    """Take a stream of files(path, content) into an index, batch by batch; of a file that comes twice in a batch the last text by size, then text, counts."""

    def merge(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max(F.struct(F.length("content").alias("n"), "content")).alias("f"))
        with Scratch(batch.sparkSession) as scratch:  # the source is read once for each batch
            index.refresh(scratch.write(last.select("path", "f.content")))

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()


def stream_progress(spark: SparkSession, query: StreamingQuery, phase: str, total: int) -> DataFrame:
    """(phase, batch, done, total, text): how far a stream had come after each of its last batches (A17, ST5)."""
    rows, done = [], 0
    for p in query.recentProgress:  # as many as the session keeps
        done += p["numInputRows"]
        rows.append((phase, p["batchId"], done, total))
    return progress_text(spark.createDataFrame(rows, "phase string, batch long, done long, total long"))


def progress_text(rows: DataFrame) -> DataFrame:
    """rows(phase, done, total) with the text "parsing 3/10 (30%)"."""
    percent = F.when(F.col("total") > 0, F.floor(F.col("done") * 100 / F.col("total") + 0.5)).otherwise(0).cast("long")
    return rows.withColumn("text", F.format_string("%s %d/%d (%d%%)", "phase", "done", "total", percent))


def answered(turns: DataFrame) -> DataFrame:
    """(user, question, answer) as a stream: each question once its answer has come, whichever comes first (ST7).

    turns(user, number, asks): the answer to a question is the next number of its user that doesn't ask.  The state of a
    user is what still waits for its other half.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked, given = (set(x) for x in (state.get if state.exists else ([], [])))
        for b in batches:
            asked |= set(b["number"][b["asks"]].tolist())
            given |= set(b["number"][~b["asks"]].tolist())
        pairs = sorted(n for n in asked if n + 1 in given)
        state.update((sorted(asked - set(pairs)), sorted(given - {n + 1 for n in pairs})))
        yield pd.DataFrame({"user": [key[0]] * len(pairs), "question": pairs, "answer": [n + 1 for n in pairs]})

    waiting = "asked array<bigint>, given array<bigint>"
    return turns.groupBy("user").applyInPandasWithState(step, "user long, question long, answer long", waiting, "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, folder: str, state: str) -> DataFrame:
    """Run a stream over what is there, and read what it wrote."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def _replayed(rows: DataFrame, key: str, start, step, end, schema: str) -> DataFrame:
    """Rows of each key in order of seq through step(state, row) -> rows; end(key, state) -> rows when the key is over.

    The partitions are sorted by key and seq and stream through, so a task holds the state of one key, however many rows
    the key has.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = state = None
        begun = False
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                k = getattr(r, key)
                if not begun or k != now:
                    if begun:
                        out += end(now, state)
                    now, state, begun = k, start(), True
                out += step(state, r)
            yield pd.DataFrame(out, columns=names, dtype=object)
        if begun:
            yield pd.DataFrame(end(now, state), columns=names, dtype=object)

    return rows.repartition(key).sortWithinPartitions(key, "seq").mapInPandas(run, schema)


def navigation(steps: DataFrame, keep: int = fixed.NAVIGATION_STEPS) -> DataFrame:
    """Histories with a cursor (ST3): steps(user, seq, action, place); actions push, back, forward.

    A push after going back drops what lay ahead, an equal push does nothing, the oldest of more than `keep` entries
    goes.  Returns (user, seq, place) where the cursor stands after each step.
    """

    def step(state: dict, r) -> list[tuple]:
        stack, at = state["stack"], state["at"]
        if r.action == "push":
            if not (0 <= at < len(stack) and stack[at] == r.place):
                stack = [*stack[: at + 1], r.place][-keep:]
                at = len(stack) - 1
        elif r.action == "back":
            at = max(at - 1, 0) if stack else -1
        else:
            at = min(at + 1, len(stack) - 1)
        state["stack"], state["at"] = stack, at
        return [(r.user, r.seq, stack[at] if stack else None)]

    return _replayed(steps.select("user", "seq", "action", "place"), "user", lambda: {"stack": [], "at": -1}, step, lambda *_: [], "user string, seq long, place string")


def lru_trace(accesses: DataFrame, capacity: int = fixed.CACHE_ENTRIES, evict_on_overwrite: bool = False) -> DataFrame:
    """(cache, key) left after accesses(cache, seq, key, op[, hash]): get, insert, remove, replayed for each cache (ST1, ST2).

    evict_on_overwrite: an insert at capacity evicts even if its key is there already.  With a hash, a get whose hash is
    not that of the entry misses, and does not count as a use.
    """
    hashed = "hash" in accesses.columns

    def step(held: dict, r) -> list[tuple]:
        if r.op == "remove":
            held.pop(r.key, None)
        elif r.op == "insert":
            while len(held) >= capacity and (evict_on_overwrite or r.key not in held):
                held.pop(next(iter(held)))
            held.pop(r.key, None)
            held[r.key] = r.hash if hashed else None
        elif r.key in held and (not hashed or held[r.key] == r.hash):
            held[r.key] = held.pop(r.key)
        return []

    rows = accesses.select("cache", "seq", "key", "op", *(["hash"] if hashed else []))
    return _replayed(rows, "cache", dict, step, lambda cache, held: [(cache, k) for k in held], "cache string, key string")


def progress(batches: Iterator[tuple[str, int, int]]) -> list[str]:
    """Phase lines "parsing 3/10 (30%)" (A17, ST5)."""
    return [f"{phase} {done}/{total} ({int(done / total * 100 + 0.5) if total else 0}%)" for phase, done, total in batches]
