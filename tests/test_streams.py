"""Streams in several batches, ids, states and texts of users."""

import re

from pyspark.sql import functions as F

from runpath.functions import text as T
from runpath.operators import views
from runpath.operators.index import DefinitionIndex
from runpath.plans.session import restore, snapshot
from runpath.sources.files import parse_scenarios, yaml_to_json
from runpath.streaming import intake


def test_index_follows_a_stream(spark, tmp_path):
    """Files that come later take the place of earlier ones; a rerun goes on; progress counts each file once."""
    index, source, state = DefinitionIndex.temporary(spark, 4), f"{tmp_path}/in", f"{tmp_path}/state"

    def arrive(**texts):
        spark.createDataFrame([(p + ".c", t) for p, t in texts.items()], "path string, content string").coalesce(1).write.mode("append").parquet(source)

    def run():
        files = spark.readStream.schema("path string, content string").option("maxFilesPerTrigger", 1).parquet(source)
        q = intake.define_stream(files, index, state)
        q.awaitTermination()
        return intake.stream_progress(spark, q, "Parsing", 4).orderBy("batch").collect()

    rows = lambda: sorted((r.path, r.name, r.line) for r in index.symbols().collect())
    arrive(a="int f(void)\n{\n}\n", b="int g(void)\n{\n}\n")
    arrive(c="int f(void)\n{\n}\n")
    first = [r for r in run() if r.done]
    assert first[-1].text == "Parsing 3/4 (75%)" and rows() == [("a.c", "f", 1), ("b.c", "g", 1), ("c.c", "f", 1)]
    arrive(a="\nint f(void)\n{\n}\nint h(void)\n{\n}\n")
    assert [r.done for r in run()][-1:] == [1]
    assert rows() == [("a.c", "f", 2), ("a.c", "h", 5), ("b.c", "g", 1), ("c.c", "f", 1)]


def test_progress_of_nothing(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("b", 1, 3), ("c", 2, 3)], "phase string, done long, total long")
    assert [r.text for r in intake.progress_text(rows).orderBy("phase").collect()] == ["a 0/0 (0%)", "b 1/3 (33%)", "c 2/3 (67%)"]


def test_answers_in_any_order(spark, tmp_path):
    """An answer may come in an earlier batch than its question; what waits is kept from run to run."""
    schema, source = "user long, number long, asks boolean", f"{tmp_path}/in"

    def come(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        return sorted(map(tuple, intake.run_to_table(intake.answered(stream), f"{tmp_path}/out", f"{tmp_path}/state").collect()))

    assert come((1, 4, False), (1, 0, True), (2, 0, True), (2, 1, True)) == []
    assert come((1, 3, True), (2, 2, False)) == [(1, 3, 4), (2, 1, 2)]
    assert come((1, 1, False)) == [(1, 0, 1), (1, 3, 4), (2, 1, 2)]


def test_new_ids(spark):
    ids = [r[0] for r in spark.range(500).select(T.new_id("tab")).collect()]
    assert len(set(ids)) == 500 and all(re.fullmatch(r"tab-\d{13}-[0-9a-f]{6}", i) for i in ids)


def test_recent_state(spark):
    states = [("a", '[{"path":"x","name":"X","timestamp":5,"isProject":true},{"path":"y","name":"Y","timestamp":9},{"path":"x","name":"Z","timestamp":11},{"name":"n"}]'), ("b", "no json"), ("c", None), ("d", "[]")]
    got = views.recent_state(spark.createDataFrame(states, "user string, state string"), keep=2).orderBy("user", "place").collect()
    assert [(r.user, r.place, r.path, r.name, r.is_project) for r in got] == [("a", 1, "x", "Z", None), ("a", 2, "y", "Y", None)]


def test_yaml_texts(spark):
    texts = ["name: a\nentry_function: f\nbindings: {x: {text: '1', hint: integer}}\n", "name: [", "- 1", None, "name: b\n", '{"name": "c", "entry_function": "g"}']
    rows = parse_scenarios(yaml_to_json(spark.createDataFrame([(t,) for t in texts], "text string"))).orderBy("name").collect()
    assert [(r.name, r.entry_function, r.max_depth, {k: tuple(v) for k, v in r.bindings.items()}) for r in rows] == [("a", "f", 10, {"x": ("1", "integer")}), ("c", "g", 10, {})]


def test_snapshots_by_run(spark):
    states = spark.createDataFrame([(r, s, {"v": f"{r}{s}"}) for r in "ab" for s in range(4) if (r, s) != ("b", 1)], "run string, step int, variables map<string,string>")
    back = restore(states, snapshot(states, 1, ("run",)), 2, ("run",)).collect()
    assert {(r.run, r.step): r.variables for r in back} == {("a", 0): {"v": "a0"}, ("a", 1): {"v": "a1"}, ("a", 2): {"v": "a1"}, ("b", 0): {"v": "b0"}, ("b", 2): {}}
    one = states.where("run = 'a'").drop("run")
    assert restore(one, snapshot(one, 1), 2).where("step = 2").select(F.col("variables")["v"]).first()[0] == "a1"
