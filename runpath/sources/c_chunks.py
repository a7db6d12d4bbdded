"""Files cut into chunks that are read on their own, so that a changed file is read again only where it has changed.

A chunk ends behind the line that closes a function's body, or a body with its semicolon, at the top level and outside
conditional groups; what stands before a definition belongs to its chunk.  Where braces don't match, the rest of the file
is one chunk.  Reading the chunks gives what reading the file gives.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runpath.sources import c_front

_MARK = re.compile(
    r"""//(?:[^\n\\]|\\.|\\\n)*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?
    |(?P<directive>\#(?:[^\n\\/"]|\\\n|\\.|"(?:\\.|[^"\\\n])*"?|/(?!\*)|/\*.*?(?:\*/|\Z))*)|(?P<brace>[{}])|(?P<line>\n)""",
    re.S | re.X,
)
_WORD = re.compile(r"#\s*(if|elif|else|endif)")
_CLOSED = re.compile(r"\}[^\n;{}()=]*;")


def cut(text: str) -> list[tuple[int, str]]:
    """(first line, text) of the chunks of a file, in order."""
    out, start, first, line = [], 0, 1, 1
    depth, groups = 0, []  # groups: depth before each open conditional group, and behind its first branch
    body = ended = False
    for m in _MARK.finditer(text):
        if m["line"]:
            line += 1
            if ended and depth == 0 and not groups:
                out.append((first, text[start : m.end()]))
                start, first = m.end(), line
            ended = False
            continue
        if m["brace"] == "{":
            if depth == 0:
                body = text[start : m.start()].rstrip().endswith(")")
            depth += 1
        elif m["brace"] == "}":
            depth -= 1
            ended = depth == 0 and (body or _CLOSED.match(text, m.start()) is not None)
            if depth < 0:
                break  # the rest is one chunk
        elif m["directive"] and (w := _WORD.match(m["directive"])):
            if w[1] == "if":
                groups.append([depth, None])
            elif groups and w[1] == "endif":
                before, behind = groups.pop()
                depth = depth if behind is None else behind
            elif groups:
                if groups[-1][1] is None and depth != groups[-1][0]:
                    groups[-1][1] = depth
                depth = groups[-1][0]
        line += m[0].count("\n")
    if start < len(text) or not out:
        out.append((first, text[start:]))
    return out


CHUNKS = "path string, ord int, first_line int, hash string, content string"


def chunks(files: DataFrame) -> DataFrame:
    """(path, ord, first_line, hash, content) of files(path, content); the last chunk of a file is never equal to one that is not the last."""

    def read(text: str) -> list[dict]:
        parts = cut(text)
        return [{"ord": i, "first_line": first, "hash": str(int(i + 1 == len(parts))), "content": part} for i, (first, part) in enumerate(parts)]

    found = c_front.rows_of(c_front.dealt(files), CHUNKS, read)
    return found.withColumn("hash", F.concat(F.md5(F.col("content").cast("binary")), F.lit("-"), "hash"))


def symbols(distinct: DataFrame) -> DataFrame:
    """(hash, and the columns of c_front.symbols but the path) of chunks(hash, content), lines counted from the chunk's first; one row of kind "none" more for each."""
    read = c_front.symbols(c_front.dealt(distinct.select(F.col("hash").alias("path"), "content")))
    none = distinct.select(F.col("hash").alias("path"), F.lit("none").alias("kind"))
    return read.unionByName(none, allowMissingColumns=True).withColumnRenamed("path", "hash")


def placed(places: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of symbols() at all places(path, first_line, hash) of their chunk, with the lines of the file."""
    shift = F.col("first_line") - 1
    at = r"line (\d+)$"
    moved = F.concat(F.regexp_replace("error", at, "line "), (F.regexp_extract("error", at, 1).try_cast("int") + shift).cast("string"))
    found = places.select("path", "first_line", "hash").join(rows.where("kind <> 'none'"), "hash")
    shifted = {"line": (F.col("line") + shift).cast("int"), "end_line": (F.col("end_line") + shift).cast("int"), "error": F.when(F.col("error").rlike(at), moved).otherwise(F.col("error"))}
    return found.withColumns(shifted).drop("first_line", "hash")
