"""Operators of caches, packs, the preprocessor, learning and settings that no SQL twin covers."""

import json

import pytest
from pyspark.sql import functions as F

from runpath import config
from runpath.errors import EngineError, LearningError, PackError, PreprocessError
from runpath.operators import patterns as P
from runpath.operators import points_to as PT
from runpath.operators import storage
from runpath.operators.learning import LearningStore
from runpath.plans.c_queries import pattern_lines
from runpath.sources import packs
from runpath.sources import preprocess as PP
from runpath.sources.files import Scenario, find_scenario, scenario_rows


def test_scratch_tables_go(spark):
    df = spark.range(5)
    with storage.Scratch(spark) as scratch:
        scratch.write(df)
        path = scratch.paths[0]
        assert storage.exists(spark, path)
        kept = scratch.keep(df)
    assert not storage.exists(spark, path) and kept.count() == 5
    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    storage.remove(spark, folder)
    assert not storage.exists(spark, folder)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace as N

    session = lambda folder, master: N(conf=N(get=lambda *_: folder), sparkContext=N(master=master))
    assert storage.shared_folder(session("file:///s/", "spark://host:7077")) == "file:///s"
    assert storage.shared_folder(session(None, "local[4]")) == storage.LOCAL_FOLDER
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            storage.shared_folder(session(None, master))


PACK = """
work_item:
  bind_patterns:
    - pattern: 'INIT_WORK\\s*\\(\\s*&?(?P<var>[\\w\\.\\->]+)\\s*,\\s*(?P<handler>\\w+)\\s*\\)'
      handler_capture: "handler"
      variable_capture: "var"
      scope: "struct_field"
  trigger_patterns:
    - pattern: 'schedule_work\\s*\\(\\s*&?(?P<var>[\\w\\.\\->]+)\\s*\\)'
late_item:
  extends: "work_item"
  trigger_patterns:
    - 'mod_timer\\s*\\(\\s*&?(?P<var>[\\w\\.\\->]+)'
driver:
  callbacks:
    probe: {description: "found", trigger: "plugged", context: "Process context, can sleep", signature: "int (*)(void)"}
    irq: {description: "irq", context: "Hard IRQ"}
"""


def test_packs(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(PACK)
    (tmp_path / "j.json").write_text(json.dumps({"x": {"destroy_patterns": [{"pattern": "flush_work\\("}]}}))
    (tmp_path / "skip.txt").write_text("no")
    found = packs.read(spark, str(tmp_path))
    assert set(found) == {"c", "j"}
    rules = packs.rules(found)
    assert [(r["pack"], r["mechanism"], r["role"], r["variable"]) for r in rules] == [("c", "work_item", "bind", "var"), ("c", "work_item", "trigger", None), ("c", "late_item", "bind", "var"), ("c", "late_item", "trigger", None), ("j", "x", "destroy", None)]
    assert all("(?P<" not in r.regex for r in packs.rule_rows(spark, rules).collect())
    cb = {r.callback: r.can_sleep for r in packs.callback_rows(spark, found).collect()}
    assert cb == {"probe": True, "irq": False} and packs.getter(packs.callback_rows(spark, found), callback="irq").count() == 1
    lines = spark.createDataFrame([("a", 1, "INIT_WORK(&d->w, fn);"), ("a", 2, "mod_timer(&d->t, 3); flush_work(x)"), ("a", 3, "schedule_work(&d->w);")], "path string, line int, text string")
    got = {(r.line, r.mechanism, r.role, r.variable, r.handler) for r in P.pack_scan(lines, rules).collect()}
    assert got == {(1, "work_item", "bind", "d->w", "fn"), (1, "late_item", "bind", "d->w", "fn"), (2, "late_item", "trigger", "d->t", ""), (2, "x", "destroy", "", ""), (3, "work_item", "trigger", "d->w", "")}
    for name, text in (("x.txt", "{}"), ("x.yaml", "- a")):
        with pytest.raises(PackError):
            packs.parse(name, text)


def test_preprocessor(spark):
    options = PP.Options.for_kernel("/k", "AMD64")
    assert options.arguments("clang")[:2] == ["-E", "--target=x86_64-linux-gnu"] and "-D__GNUC__=12" in options.arguments("gcc") and options.arguments("gcc")[-2:] == ["-nostdinc", "-fno-builtin"]
    assert PP.Options(defines=(("A", "1"), ("A", "2")), keep_comments=True, line_markers=False).arguments("gcc") == ["-E", "-DA=2", "-C", "-P"]
    with pytest.raises(PreprocessError):
        PP.architecture("vax")
    files = spark.createDataFrame([("a.c", "#define N 4\nint x = N;\n#warning slow\n"), ("b.c", "#error no\n"), ("c.c", None)], "path string, content string")
    missing = {r.path: r.error for r in PP.preprocess(files, compiler="no-such-compiler").collect()}
    assert len(missing) == 3 and all(missing.values())
    compiler = PP.find_compiler()
    if compiler is None or PP.preprocess(files.where("path = 'c.c'"), compiler=compiler).first().error:
        pytest.skip("no compiler that works here")
    assert PP.compiler_version(compiler) and PP.compiler_version("no-such-compiler") is None
    rows = {r.path: r for r in PP.preprocess(files, PP.Options(line_markers=False), compiler).collect()}
    assert "int x = 4;" in rows["a.c"].text and len(rows["a.c"].warnings) == 1 and rows["a.c"].error is None
    assert rows["b.c"].text is None and "error" in rows["b.c"].error and rows["c.c"].error is None


def test_learning_store_errors(spark, tmp_path):
    with pytest.raises(LearningError):
        LearningStore.load(spark, str(tmp_path / "none"))
    store = LearningStore.empty(spark)
    assert store.stats().collect()[0].asDict() == {"total": 0, "answered": 0, "auto_applied": 0} and store.clear_pending().pending.count() == 0
    store.save(str(tmp_path / "s"))
    assert LearningStore.load(spark, str(tmp_path / "s")).annotations.count() == 0


def test_settings():
    c = config.Config()
    assert c.parser.extensions == ("c", "h") and c.analysis.max_call_depth == 20 and c.index.max_memory_mb == 2048
    assert str(config.Location("a.c", 3)) == "a.c:3:0" and config.Location("a.c", 3).last_line == 3 and config.Location("a.c", 3, 0, 9).last_line == 9
    assert issubclass(PackError, EngineError)
    with pytest.raises(ValueError):
        PT.constraint("Jump", "a", "b")
    assert PT.constraint("Copy", "a", "b") == ("Copy", "a", "b", None)


def test_scenarios(spark):
    rows = scenario_rows(spark, [Scenario("one", "f").bind("x", "1"), Scenario("two", "g")])
    assert find_scenario(rows, "two").first().entry_function == "g" and find_scenario(rows, "one").first().bindings["x"].text == "1"


def test_search_of_one_long_line(spark):
    """The work is in proportion to the hits of a line."""
    text = "ab " * 200_000
    lines = P.lines_of(spark.createDataFrame([("f", text)], "path string, content string"))
    hits = P.find_in_lines(lines, "AB").drop("text")
    assert hits.agg(F.count("*"), F.max("column"), F.sum("column")).first() == (200_000, 599_998, sum(range(1, 600_000, 3)))


def test_patterns_read_lines_once(spark):
    """All patterns stand in one projection over one scan."""
    if not __import__("os").path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    plan = P.async_scan(pattern_lines(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
