"""Work that grows with its input: how it is dealt out, and what one task or group holds."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from runpath.functions import text as T
from runpath.operators import learning as L
from runpath.operators import patterns as P
from runpath.operators import relational as R
from runpath.operators import storage
from runpath.operators.drawing import drawing
from runpath.operators.index import SymbolIndex
from runpath.plans import c_queries, c_units
from runpath.plans.session import AnalysisSession
from runpath.sources import c_chunks, c_front

SF = "/root/testdata/sf0.001"


def test_files_of_a_small_table_are_read_by_all_cores(spark):
    """A table in one partition gave one task that read all files."""
    cores = spark.sparkContext.defaultParallelism
    for files in (c_queries.c_files(spark, SF), c_units.unit_files(spark, SF)):
        assert files.rdd.getNumPartitions() >= cores
    assert c_front.call_arguments(c_queries.c_files(spark, SF)).rdd.getNumPartitions() >= cores


def test_files_are_read_some_at_a_time(spark):
    """A task held the rows of all files of a batch."""
    files = spark.range(1000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit("int f(int a)\n{\n\treturn a;\n}\n").alias("content")).coalesce(1)
    batch = files.toArrow().to_batches()[0]
    sizes = [len(p) for p in c_front._pieces(batch)]
    assert sum(sizes) == batch.num_rows and max(sizes) <= c_front.PIECE
    assert c_front.symbols(files).where("kind = 'function' and params[0].type_name = 'int'").select("path").distinct().count() == 1000


def test_large_files_are_not_all_held_at_a_time():
    """200 texts of a batch became Python texts before their length counted, and again for each piece."""
    batch = pa.RecordBatch.from_pydict({"path": [f"f{n}" for n in range(50)], "content": [None] + ["x" * 1_000_000] * 49})
    tracemalloc.start()
    try:
        sizes, pieces = [], c_front._pieces(batch)
        while piece := next(pieces, None):
            sizes.append(len(piece))
            del piece
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) == 50 and max(sizes) <= 6 and most < 3 * c_front.PIECE_LENGTH


def test_best_candidates_cut_functions_before_they_meet(spark):
    """All functions of a signature were put in one set, of which k are needed."""
    types = spark.createDataFrame([("t", "int", ["int"])], "name string, return_type string, params array<string>")
    many = spark.range(300).select(F.format_string("f%03d", F.col("id") % 100).alias("name"), F.lit("int").alias("return_type"), F.array(F.lit("int")).alias("params"))
    best = R.best_candidates(types, many, 3)
    assert [(r.rank, r.function) for r in best.orderBy("rank").collect()] == [(1, "f000"), (2, "f001"), (3, "f002")]
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()


def test_drawings_hold_all_nodes(spark):
    """Of a root's nodes 2000 were drawn."""
    tree = spark.range(3000).select(F.lit("r").alias("root"), F.format_string("n%04d", "id").alias("node"), F.when(F.col("id") > 0, "n0000").alias("parent"), F.least("id", F.lit(1)).cast("int").alias("depth"), F.lit("Function").alias("node_type"))
    rows = drawing(tree).collect()
    assert sorted((r.place, r.node) for r in rows if r["rank"] == 1) == [(n - 1, f"n{n:04d}") for n in range(1, 3000)] and {r.crossings for r in rows} == {0}


def test_many_new_ids(spark):
    """Six random characters repeat among many ids of one millisecond."""
    ids = spark.range(0, 300_000, 1, 3).select(T.new_id("tab").alias("id"))
    assert ids.distinct().count() == 300_000 and ids.where(~F.col("id").rlike("^tab-[0-9]{13}-[0-9a-f]{6}$")).isEmpty()


def test_what_a_store_takes_in_is_worked_out_once(spark):
    """Each change of a store and each reading worked out all questions again."""
    calls = spark.createDataFrame([("a.c:1", "x->f", None, None)], "location string, call_expr string, expected_signature string, reason string")
    asked = L.question(calls.mapInArrow(lambda batches: batches, calls.schema))
    store = L.LearningStore.empty(spark).add_queries(asked)
    done = store.answer(asked.select("id", F.array(F.lit("t")).alias("targets"), F.lit(None).cast("string").alias("note")))
    for rows in (store.pending, done.annotations):
        assert "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 1


def test_arguments_and_constraints_come_from_one_reading(spark, monkeypatch):
    """Files were read once for symbols, once for constraints and once for arguments."""
    def read_again(*_):
        raise AssertionError("files are read again")

    text = "int g(int *a)\n{\n\treturn h(a);\n}\nint f(int *b)\n{\n\tb = &x;\n\treturn g(b);\n}\n"
    files = spark.createDataFrame([("a.c", text), ("b.c", "int f(int *b)\n{\n\treturn g(b);\n}\n")], "path string, content string")
    for reader in ("symbols", "constraints", "call_arguments"):
        monkeypatch.setattr(c_front, reader, read_again)
    rows = sorted((r.path, r.kind, r.dest, r.src) for r in AnalysisSession(spark, files).flow_of_arguments().collect())
    assert rows == [("a.c", "AddressOf", "b", "x"), ("a.c", "Copy", "a", "b")]


def test_chunks_of_few_input_files_are_read_by_all_cores(spark):
    """A batch of a stream in two partitions gave two tasks."""
    cores = spark.sparkContext.defaultParallelism
    files = spark.range(40).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.format_string("int f%d(int a)\n{\n\treturn a;\n}\n", "id").alias("content")).coalesce(1)
    found = c_chunks.chunks(files)
    assert found.rdd.getNumPartitions() >= cores and found.count() == 40
    assert c_chunks.symbols(found.select("hash", "content").coalesce(1)).where("kind = 'function'").select("name").distinct().count() == 40


def test_pairs_of_one_file_are_made_by_many_tasks(spark):
    """All pairs of a file and a mechanism were made by one task."""
    bound = spark.range(3000).select(F.lit("p").alias("path"), F.lit(7).alias("pattern_id"), F.lit(0).alias("nth"), F.lit("").alias("variable"), F.lit("h").alias("handler"), F.col("id").alias("line"))
    found = spark.range(20).select(F.lit("p").alias("path"), F.lit(7).alias("pattern_id"), F.lit("").alias("variable"), F.lit(False).alias("has_variable"), F.col("id").alias("line"))
    pairs = P.match_triggers(bound, found).withColumn("task", F.spark_partition_id())
    assert pairs.select("line", "trigger_line").distinct().count() == pairs.count() == 60_000
    assert pairs.select("task").distinct().count() > 1


def test_patterns_search_only_lines_that_hold_their_words(spark):
    """Each line was searched by all patterns, however few hold a word that a match needs."""
    words = {r"INIT_WORK\s*\(": "INIT_WORK", r"([\w.]+)\.function\s*=": ".function", "abc*d": "ab", "ab{2}cd": "cd", "a|bc": "", "(?i)abc": "", "(ab|cd)ef": "ef", r"\bxyz": "xyz", "[ab]?": ""}
    assert {p: P.literal_of(p) for p in words} == words
    lines = spark.createDataFrame([("p", 1, "INIT_WORK (&w, h);"), ("p", 2, "x = abd;"), ("p", 3, None), ("p", 4, "q;"), ("p", 5, "abccd")], "path string, line int, text string")
    found = P.async_scan(lines)
    assert "Contains" in found._jdf.queryExecution().optimizedPlan().toString() and [r.line for r in found.collect()] == [1]
    rules = [("abc*d", {"n": 1}), ("q|z", {"n": 2})]  # the second needs no one word: all lines are searched
    assert sorted((r.line, r.n) for r in P.scan(lines, rules).collect()) == [(2, 1), (4, 2), (5, 1)]


def test_an_index_takes_in_stored_rows_as_they_are(spark, tmp_path, monkeypatch):
    """Keys and rows of each of the three tables were written once more before a change."""
    files = spark.range(200).select(F.format_string("f%d.c", "id").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("mtime"), F.lit(9).cast("long").alias("size"), F.format_string("struct s%d { int a; };\nint f%d(int a)\n{\n\treturn g(a);\n}\n", "id", "id").alias("content"))
    written = []
    plain = storage.Scratch.write
    monkeypatch.setattr(storage.Scratch, "write", lambda self, df: written.append(df.columns) or plain(self, df))
    index = SymbolIndex(spark, str(tmp_path), 2)
    assert index.refresh(files).count() == 200 and len(written) == 2  # what is known of the files, and what was read
    assert index.read("functions").count() == index.read("structs").count() == index.read("versions").count() == 200
    index.remove_files(files.where("path < 'f2'").select("path"))
    left = files.where("path >= 'f2'").count()
    assert {t: index.read(t).count() for t in ("functions", "structs", "versions")} == dict.fromkeys(("functions", "structs", "versions"), left)
    assert index.refresh(files).count() == 200 - left and index.read("functions").select("path").distinct().count() == 200
    assert index.refresh(files).count() == 0
