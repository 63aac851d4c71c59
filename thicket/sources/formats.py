"""Texts in formats of their own: diffs, captions, conflict marks, front matter; and sections of pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str) -> list[tuple[str | None, str | None, int, str, int | None, int | None, str]]:
    """(old_path, new_path, hunk, kind, old_line, new_line, text) of each line of a unified diff; kind is added, removed or context."""
    out, old, new, hunk, a, b, left_a, left_b = [], None, None, 0, 0, 0, 0, 0
    name = lambda x: None if x == "/dev/null" else re.sub(r"^[ab]/", "", x.split("\t")[0])
    for line in text.split("\n"):
        m = HUNK.match(line)
        if m:
            hunk += 1
            a, b = int(m[1]), int(m[3])
            left_a, left_b = int(m[2] or 1), int(m[4] or 1)
        elif left_a > 0 or left_b > 0:
            if line.startswith("\\"):
                continue
            kind = {"+": "added", "-": "removed"}.get(line[:1], "context")
            out.append((old, new, hunk, kind, a if kind != "added" else None, b if kind != "removed" else None, line[1:]))
            a, left_a = (a + 1, left_a - 1) if kind != "added" else (a, left_a)
            b, left_b = (b + 1, left_b - 1) if kind != "removed" else (b, left_b)
        elif line.startswith("--- "):
            old, hunk = name(line[4:]), 0
        elif line.startswith("+++ "):
            new = name(line[4:])
    return out


def diff_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *r) for k, t in zip(pdf[key], pdf[text]) for r in parse_diff(t or "")]
            out = pd.DataFrame(rows, columns=[key, "old_path", "new_path", "hunk", "kind", "old_line", "new_line", "line"])
            yield out.astype({"old_line": "Int32", "new_line": "Int32", "hunk": "int32"})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, old_path string, new_path string, hunk int, kind string, old_line int, new_line int, line string")


def captions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, minute, text): a WebVTT file's captions by minute, a line that repeats the one before it left out."""
    cues = df.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n[ \t]*\n")).alias("at", "cue"))
    start = F.regexp_extract("cue", r"(?m)^(?:(\d+):)?(\d\d):(\d\d)\.\d+ --> ", 0)
    timed = cues.withColumn("s", start).filter("s <> ''")
    part = lambda i: F.coalesce(F.regexp_extract("cue", r"(?m)^(?:(\d+):)?(\d\d):(\d\d)\.\d+ --> ", i).try_cast("int"), F.lit(0))
    said = timed.withColumn("minute", part(1) * 60 + part(2)).select("*", F.posexplode(F.split(F.regexp_replace("cue", r"(?s)^.*? --> [^\n]*\n?", ""), "\n")).alias("place", "line")).withColumn("line", F.trim(F.regexp_replace("line", "<[^>]*>", ""))).filter("line <> ''")
    grouped = said.groupBy(key, "minute").agg(F.sort_array(F.collect_list(F.struct("at", "place", "line"))).alias("l"))
    kept = F.filter("l", lambda x, i: (i == 0) | (F.col("l")[F.greatest(i - 1, F.lit(0))]["line"] != x["line"]))
    return grouped.select(key, "minute", F.array_join(F.transform(kept, lambda x: x["line"]), " ").alias("text"))


def conflicts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block): merge conflict blocks left in texts."""
    return df.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"(?ms)^<<<<<<< .*?^>>>>>>> [^\n]*"), 0)).alias("block"))


def front_matter(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fields): the `name: value` lines of a text's leading block between --- lines, as a map."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[\w-]+:"))
    return df.select(key, F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda x: F.regexp_extract(x, r"^([\w-]+):", 1))), lambda n: F.struct(n, F.trim(F.regexp_extract(F.array_join(F.filter(pairs, lambda x: x.startswith(F.concat(n, F.lit(":")))), "\n"), r"^[\w-]+:([^\n]*)", 1))))).alias("fields"))
