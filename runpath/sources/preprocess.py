"""The C preprocessor: options of a run, its command line, and runs over files.

The compiler is an external program of the executors' machines, so a run is gated: files are returned with an error
where it is missing or fails.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath import fixed
from runpath.errors import PreprocessError
from runpath.functions import text as T

#: Programs that are tried in this order.
COMPILERS = ("clang", "gcc", "cc")


@dataclass(frozen=True)
class Options:
    """Target architecture, macros (name, value or None) in order, include folders, further arguments."""

    target: str = "x86_64"
    defines: tuple[tuple[str, str | None], ...] = ()
    includes: tuple[str, ...] = ()
    system_includes: tuple[str, ...] = ()
    extra: tuple[str, ...] = field(default=())
    keep_comments: bool = False
    line_markers: bool = True

    @staticmethod
    def for_kernel(root: str, arch: str) -> Options:
        """Include folders, macros and arguments for a kernel tree (M8)."""
        name, _, directory, macros, _ = architecture(arch)
        defines = [(m.split("=")[0], m.split("=")[1] if "=" in m else None) for m in macros] + fixed.KERNEL_MACROS
        return Options(name, tuple(defines), tuple(f"{root}/{p.format(arch=directory)}" for p in fixed.KERNEL_INCLUDES), extra=tuple(fixed.KERNEL_ARGUMENTS))

    @property
    def triple(self) -> str:
        return architecture(self.target)[1]

    def arguments(self, compiler: str = "clang") -> list[str]:
        """Command line (F16). Only clang takes a target."""
        last = dict(self.defines)  # a later definition takes the place of an earlier one (M10)
        args = ["-E", *([f"--target={self.triple}"] if "clang" in compiler else [])]
        args += [f"-D{k}" if v is None else f"-D{k}={v}" for k, v in last.items()]
        args += [f"-I{p}" for p in self.includes] + [f"-isystem{p}" for p in self.system_includes] + list(self.extra)
        return args + ["-C"] * self.keep_comments + ["-P"] * (not self.line_markers)


def architecture(name: str) -> tuple[str, str, str, list[str], list[str]]:
    """The fixed row of an architecture, by any of its names."""
    for row in fixed.ARCHITECTURES:
        if name.lower() in row[4] or name == row[0]:
            return row
    raise PreprocessError(f"unknown architecture: {name}")


def find_compiler() -> str | None:
    """First program that is there (M9)."""
    return next((c for c in COMPILERS if shutil.which(c)), None)


def compiler_version(compiler: str) -> str | None:
    """First line of the program's own answer (M9)."""
    try:
        out = subprocess.run([compiler, "--version"], capture_output=True, text=True, timeout=20)
    except (OSError, subprocess.SubprocessError):
        return None
    return out.stdout.split("\n")[0] if out.returncode == 0 else None


def preprocess(files: DataFrame, options: Options = Options(), compiler: str | None = None, timeout: int = 60) -> DataFrame:
    """(path, text, warnings, error) of files(path, content): one run for each file, from its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program = compiler or find_compiler()
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    if program is None:
                        raise PreprocessError("no compiler found")
                    done = subprocess.run([program, *options.arguments(program), "-x", "c", "-"], input=content or "", capture_output=True, text=True, timeout=timeout)
                    warned = [x for x in done.stderr.split("\n") if "warning:" in x]
                    rows.append((path, done.stdout if done.returncode == 0 else None, warned, None if done.returncode == 0 else done.stderr[-2000:]))
                except (OSError, subprocess.SubprocessError, PreprocessError) as e:
                    rows.append((path, None, [], str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "warnings", "error"], dtype=object)

    return files.select("path", "content").mapInPandas(run, "path string, text string, warnings array<string>, error string")


def clang_args(macros: DataFrame, includes: DataFrame, triple: str) -> DataFrame:
    """(ord, arg): target, macros and include paths, the last definition of a macro counting."""
    last = macros.groupBy("name").agg(F.max_by(F.struct("value", "defined"), "ord").alias("m"), F.max("ord").alias("ord"))
    return (
        macros.sparkSession.range(1).select(F.lit(-1).cast("long").alias("ord"), F.lit(f"--target={triple}").alias("arg"))
        .union(last.select(F.col("ord").cast("long"), T.clang_arg("name", "m.value", F.col("m.defined"))))
        .union(includes.select((F.col("ord") + 1_000_000).cast("long"), F.concat(F.lit("-I"), "path")))
    )


def with_macros(macros: DataFrame, added: list[tuple[str, str | None]]) -> DataFrame:
    """macros(name, value) with fixed ones, which take the place of those of their name."""
    new = macros.sparkSession.createDataFrame(added, "name string, value string")
    return new.unionByName(macros.select("name", "value").join(F.broadcast(new.select("name")), "name", "left_anti").select("name", "value"))


def include_paths(spark: SparkSession, root: str, arch: str) -> DataFrame:
    """(ord, path) of a kernel tree's include folders."""
    directory = architecture(arch)[2]
    return spark.createDataFrame([(i, f"{root}/{p.format(arch=directory)}") for i, p in enumerate(fixed.KERNEL_INCLUDES)], "ord int, path string")


def add_include_path(paths: DataFrame, path: str) -> DataFrame:
    """paths(ord, path) with one more at the end, unless it is there (U8)."""
    row = paths.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).cast("int").alias("ord")).withColumn("path", F.lit(path))
    return paths.unionByName(row.join(paths.select("path"), "path", "left_anti").select(*paths.columns))


def existing_paths(paths: DataFrame, directories: DataFrame) -> DataFrame:
    """paths that are among directories(path)."""
    return paths.join(directories.select("path").distinct(), "path", "left_semi").select(*paths.columns)


def subsystem_paths(spark: SparkSession, root: str) -> DataFrame:
    """(name, path) of the kernel's subsystems."""
    return spark.createDataFrame([(n, f"{root}/{n}") for n in fixed.KERNEL_SUBSYSTEMS], "name string, path string")
