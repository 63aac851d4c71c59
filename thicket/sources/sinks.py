"""Output formats as columns of lines, and writers that replace rows by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """(line): each row as a JSON object, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


def as_csv(df: DataFrame) -> DataFrame:
    """(line): each row as CSV, cells quoted only where they must be, quotes doubled; nulls are empty."""
    cell = lambda c: F.when(F.col(c).cast("string").rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("line"))


def as_markdown(df: DataFrame, title: str, link: str, note: Column) -> DataFrame:
    """(line): each row as a list item with a link and a note."""
    return df.select(F.concat(F.lit("- ["), F.coalesce(title, F.lit("untitled")), F.lit("]("), F.coalesce(link, F.lit("")), F.lit("): "), note).alias("line"))


def as_xml(df: DataFrame, docid: Column, name: str, title: str, body: str) -> DataFrame:
    """(line): each row as a file element with its short id, name and, if there is one, title; a null body makes a null line."""

    def escaped(c: str) -> Column:
        out = F.col(c)
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
            out = F.replace(out, F.lit(raw), F.lit(safe))
        return out

    head = F.when(F.coalesce(title, F.lit("")) == "", "").otherwise(F.concat(F.lit(' title="'), escaped(title), F.lit('"')))
    return df.select(F.concat(F.lit('<file docid="#'), docid, F.lit('" name="'), escaped(name), F.lit('"'), head, F.lit(">\n"), escaped(body), F.lit("\n</file>")).alias("line"))


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key; of rows alike in `order` one, the greatest by all its columns."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_o"), *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}") for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of new, and those of old whose keys it lacks."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def newest(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(order)))).filter(F.col("_r") <= n).drop("_r") if n < 2 else df.orderBy(F.desc(order)).limit(n)
