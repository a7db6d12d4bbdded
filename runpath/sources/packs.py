"""Knowledge packs from YAML and JSON files: patterns of mechanisms and callbacks of frameworks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath.errors import PackError

ROLES = ("bind", "trigger", "cancel", "creation", "destroy")


def parse(path: str, text: str) -> dict:
    """The mapping of a .json, .yaml or .yml text."""
    if path.endswith(".json"):
        data = json.loads(text)
    elif path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text)
    else:
        raise PackError(f"unknown format: {path}")
    if not isinstance(data, dict):
        raise PackError(f"no mapping: {path}")
    return data


def read(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Name -> mapping of the pack files below a folder. Packs are written by hand and few, so they are read by the driver."""
    glob = "*.{yaml,yml,json}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return {r.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]: parse(r.path, bytes(r.content).decode()) for r in files.select("path", "content").orderBy("path").toLocalIterator()}


def _patterns(entry: dict) -> Iterator[tuple[str, int, dict]]:
    for role in ROLES:
        for i, p in enumerate(entry.get(f"{role}_patterns") or ()):
            yield role, i, p if isinstance(p, dict) else {"pattern": p}


def rules(packs: dict[str, dict]) -> list[dict]:
    """Patterns of all mechanisms of packs: pack, mechanism, role, nth, pattern, handler and variable group, scope, behavior.

    A mechanism that extends another one of its pack also has the other's patterns of the roles it has none of.
    """
    out = []
    for pack, entries in packs.items():
        for name, entry in entries.items():
            if not isinstance(entry, dict):
                continue
            base = entries.get(entry.get("extends")) or {}
            whole = {**{k: v for k, v in base.items() if k.endswith("_patterns")}, **entry}
            for role, i, p in _patterns(whole):
                out.append({
                    "pack": pack, "mechanism": name, "role": role, "nth": i, "pattern": p["pattern"], "handler": p.get("handler_group") or p.get("handler_capture"),
                    "variable": p.get("variable_group") or p.get("variable_capture"), "scope": p.get("scope"), "behavior": p.get("behavior"),
                })
    return out


RULE = "array<struct<pack:string,mechanism:string,role:string,nth:int,pattern:string,handler:string,variable:string,scope:string,behavior:string>>"


def rules_of(texts: DataFrame) -> DataFrame:
    """The rules of pack texts(path, text), one row each, with their path; error where a text is no pack.

    The name of a pack is that of its file.  Texts are parsed where they lie, so packs may be many.
    """

    @F.pandas_udf(f"struct<rules:{RULE},error:string>")
    def read_text(paths: pd.Series, values: pd.Series) -> pd.DataFrame:
        import yaml

        out = []
        for path, text in zip(paths, values, strict=True):
            try:
                out.append((rules({path.rsplit("/", 1)[-1].rsplit(".", 1)[0]: parse(path, text or "")}), None))
            except (PackError, yaml.YAMLError, json.JSONDecodeError) as e:
                out.append(([], str(e).split("\n", 1)[0]))
        return pd.DataFrame(out, columns=["rules", "error"])

    parsed = texts.select("path", read_text("path", "text").alias("p"))
    return parsed.select("path", F.explode_outer("p.rules").alias("r"), "p.error").select("path", "r.*", "error")


def rule_rows(spark: SparkSession, found: list[dict]) -> DataFrame:
    """The patterns as a table, in Java's form."""
    rows = [(r["pack"], r["mechanism"], r["role"], r["nth"], r["pattern"].replace("(?P<", "(?<"), r["handler"], r["variable"], r["scope"], r["behavior"]) for r in found]
    return spark.createDataFrame(rows, "pack string, mechanism string, role string, nth int, regex string, handler_group string, variable_group string, scope string, behavior string")


def callback_rows(spark: SparkSession, packs: dict[str, dict]) -> DataFrame:
    """(pack, framework, callback, description, trigger, context, signature, can_sleep) of the frameworks of packs."""
    rows = []
    for pack, entries in packs.items():
        for framework, entry in entries.items():
            for name, c in (entry.get("callbacks") or {}).items() if isinstance(entry, dict) else ():
                context = c.get("context") or ""
                rows.append((pack, framework, name, c.get("description"), c.get("trigger"), context, c.get("signature"), "can sleep" in context or context.startswith("Process")))
    return spark.createDataFrame(rows, "pack string, framework string, callback string, description string, trigger string, context string, signature string, can_sleep boolean")


def getter(table: DataFrame, **key: str) -> DataFrame:
    """Rows of a knowledge table by the values of columns."""
    for k, v in key.items():
        table = table.where(F.col(k) == v)
    return table
