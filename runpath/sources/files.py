"""Scans of source trees, listings, knowledge tables, scenarios and stores."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath import fixed
from runpath.errors import ScenarioError
from runpath.functions import text as T

# Directories that no scan enters.
SKIPPED_DIRECTORIES = ["target", "node_modules", "build", "dist", "__pycache__"]


def scan(spark: SparkSession, folder: str, endings: tuple[str, ...] = ("c", "h"), exclude: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> DataFrame:
    """files(path, mtime, size, content) below folder (S1-S4): by ending, then without names that match an exclude glob, then with an include glob."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(folder)
    name = T.base_name("path")
    any_of = lambda globs: reduce(lambda a, b: a | b, (T.glob_match(name, g) for g in globs))
    kept = raw if not exclude else raw.where(~any_of(exclude))
    kept = kept if not include else kept.where(any_of(include))
    return kept.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def listing(paths: DataFrame, max_depth: int = fixed.DIRECTORY_DEPTH) -> DataFrame:
    """(path, name, parent, depth, is_dir) of files and the directories above them (S13, G12); hidden and build directories skipped."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), (n < F.size(parts)).alias("is_dir")))
    every = paths.select(F.explode(ups).alias("u")).select("u.path", "u.is_dir").where("path <> ''").groupBy("path").agg(F.max("is_dir").alias("is_dir"))
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith(".") | p.isin(SKIPPED_DIRECTORIES))
    out = every.where(~hidden).select("path", T.base_name("path").alias("name"), T.parent_path("path").alias("parent"), T.depth("path").alias("depth"), "is_dir")
    return out.where(F.col("depth") <= max_depth)


def driver_files(files: DataFrame, most: int = fixed.DRIVER_FILES) -> DataFrame:
    """The first C files below drivers/ by path."""
    return files.where(F.col("path").rlike(r"(?:^|/)drivers/.*\.c$")).orderBy("path").limit(most)


def children(listed: DataFrame, parent: str) -> DataFrame:
    """One directory of a listing, directories first, then by name in any case; with the ending of files."""
    own = listed.where(F.col("parent") == parent)
    ending = F.when(~F.col("is_dir"), F.nullif(F.regexp_extract("name", r"\.([^.]+)$", 1), F.lit("")))
    return own.withColumn("extension", ending).orderBy(F.desc("is_dir"), F.lower("name"), "name")


def is_kernel_source(paths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, is_kernel): some marker file is there (P17); one row, or one for each tree where `by` names its columns."""
    return paths.groupBy(*by).agg(F.coalesce(F.max(F.col("path").isin(fixed.KERNEL_MARKERS)), F.lit(False)).alias("is_kernel"))


def knowledge(spark: SparkSession) -> dict[str, DataFrame]:
    """The built-in knowledge tables (S9, G13): chains, callbacks, apis, timeline, architectures, reasons. Each is a few fixed rows."""
    chains = [(c, i, fn, file, ctx, trigger, i == len(nodes)) for c, trigger, ctx, nodes in fixed.CHAINS for i, (fn, file) in enumerate(nodes, 1)]
    return {
        "chains": spark.createDataFrame(chains, "chain_id string, ord int, function string, file string, context string, trigger string, is_user_entry boolean"),
        "callbacks": spark.createDataFrame(fixed.CALLBACKS, "framework string, callback string, description string, signature string, chain_id string"),
        "apis": spark.createDataFrame(fixed.KERNEL_APIS, "name string, description string, can_sleep boolean, can_fail boolean, params array<string>"),
        "timeline": spark.createDataFrame([("work_struct", 1, "interrupt", "HardIrq", "work_struct.irq"), ("work_struct", 2, "work queue", "Process", "work_struct")], "pattern string, phase int, name string, context string, chain_id string"),
        "architectures": spark.createDataFrame(fixed.ARCHITECTURES, "name string, triple string, directory string, macros array<string>, aliases array<string>"),
        "reasons": spark.createDataFrame(fixed.REASONS, "reason string, confidence string, description string"),
    }


def scenario_rows(spark: SparkSession, scenarios: list[Scenario]) -> DataFrame:
    """A collection as rows (E17): (name, entry_function, bindings map<string,struct<text,hint>>, max_depth, show_kernel_api, follow_async)."""
    rows = [(s.name, s.entry_function, {k: tuple(v) for k, v in s.bindings.items()}, s.max_depth, s.show_kernel_api, s.follow_async) for s in scenarios]
    return spark.createDataFrame(rows, "name string, entry_function string, bindings map<string,struct<text:string,hint:string>>, max_depth int, show_kernel_api boolean, follow_async boolean")


SCENARIO = "name string, entry_function string, bindings map<string,struct<text:string,hint:string>>, max_depth int, show_kernel_api boolean, follow_async boolean"


def parse_scenarios(texts: DataFrame, column: str = "text") -> DataFrame:
    """Scenario rows from JSON texts, with the defaults of what they leave out; texts that name no entry function are dropped."""
    s = texts.select(F.from_json(column, SCENARIO).alias("s")).select("s.*").where("entry_function is not null")
    none = F.expr("cast(map() as map<string,struct<text:string,hint:string>>)")
    return s.select("name", "entry_function", F.coalesce("bindings", none).alias("bindings"), F.coalesce("max_depth", F.lit(fixed.SCENARIO_DEPTH)).alias("max_depth"), F.coalesce("show_kernel_api", F.lit(True)).alias("show_kernel_api"), F.coalesce("follow_async", F.lit(True)).alias("follow_async"))


def yaml_to_json(texts: DataFrame, column: str = "text") -> DataFrame:
    """texts with a column of YAML as JSON; what is no YAML becomes null."""

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        import yaml

        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(yaml.safe_load(text), default=str)
            except yaml.YAMLError:
                return None

        return values.map(one)

    return texts.withColumn(column, convert(F.col(column)))


def find_scenario(collection: DataFrame, name: str) -> DataFrame:
    return collection.where(F.col("name") == name)


@dataclass
class Scenario:
    """Entry function, bindings path -> (text, hint), and options of a run."""

    name: str
    entry_function: str
    bindings: dict[str, tuple[str, str]] = field(default_factory=dict)
    max_depth: int = fixed.SCENARIO_DEPTH
    show_kernel_api: bool = True
    follow_async: bool = True

    def bind(self, path: str, text: str, hint: str = "integer") -> Scenario:
        return Scenario(self.name, self.entry_function, {**self.bindings, path: (text, hint)}, self.max_depth, self.show_kernel_api, self.follow_async)

    @staticmethod
    def load(path: str) -> Scenario:
        """From a .json, .yaml or .yml file."""
        with open(path) as f:
            text = f.read()
        if path.endswith(".json"):
            data = json.loads(text)
        elif path.endswith((".yaml", ".yml")):
            import yaml

            data = yaml.safe_load(text)
        else:
            raise ScenarioError(f"unknown format: {path}")
        return Scenario(data["name"], data["entry_function"], {k: tuple(v) for k, v in data.get("bindings", {}).items()}, data.get("max_depth", fixed.SCENARIO_DEPTH), data.get("show_kernel_api", True), data.get("follow_async", True))

    def save(self, path: str) -> None:
        """To a .json, .yaml or .yml file (K5)."""
        data = {**self.__dict__, "bindings": {k: list(v) for k, v in self.bindings.items()}}
        if path.endswith(".json"):
            text = json.dumps(data)
        elif path.endswith((".yaml", ".yml")):
            import yaml

            text = yaml.safe_dump(data)
        else:
            raise ScenarioError(f"unknown format: {path}")
        with open(path, "w") as f:
            f.write(text)
