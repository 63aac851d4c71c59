"""Results per key where a handful of keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators.skew import heavy_keys
from thicket.session import cut


def states(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The compact states of both tables, joined: (id, file_path, links, symbols), a row for each id and file.

    links: rows of edges whose source the id is, null if none; symbols: rows of nodes with that id and file, null for sources that no
    node has. Null ids stay as rows that match nothing. No key has more than one row a task before the shuffle."""
    links = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    symbols = nodes.groupBy("id", "file_path").agg(F.count(F.lit(1)).alias("symbols"))
    return links.join(symbols, "id", "full")


def found_heavy(edges: DataFrame, nodes: DataFrame, percent: int = 2) -> DataFrame:
    """(field, key_value) for each edges.source and nodes.file_path that at least `percent` % of its table's rows hold, rolled up from the joined states.

    Rows count as stored, nulls among the rows but not as a value. Empty tables give nothing."""
    joined = cut(states(edges, nodes))
    n_edges, n_nodes = edges.count(), nodes.count()
    # An id in several files has its links in each of those states.
    by_source = joined.filter("id is not null and links is not null").groupBy(F.col("id").alias("key_value")).agg(F.max("links").alias("n"))
    by_file = joined.filter("file_path is not null").groupBy(F.col("file_path").alias("key_value")).agg(F.sum("symbols").alias("n"))
    sources = by_source.filter(F.col("n") * 100 >= n_edges * percent).select(F.lit("edges.source").alias("field"), "key_value")
    return sources.unionByName(by_file.filter(F.col("n") * 100 >= n_nodes * percent).select(F.lit("nodes.file_path").alias("field"), "key_value"))


def per_source(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of every source, by kind's number, with the file that holds the source: (source, file_path, n_links, n_kinds, n_distinct_links).

    Links are first reduced to (source, target, kind), then to sources: a heavy source reaches the last step as one row a task. Null
    sources come out as one row. Sources that no node has get a null file. A link stored again counts in n_links, not in n_distinct_links."""
    by_link = edges.groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("n"))
    by_kind = by_link.groupBy("source", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    by_source = by_kind.groupBy("source").agg(F.sum("n").alias("n_links"), F.count("kind").alias("n_kinds"), F.sum("d").alias("n_distinct_links"))
    where = nodes.groupBy(F.col("id").alias("source")).agg(F.min("file_path").alias("file_path"))
    return by_source.join(where, "source", "left").select("source", "file_path", "n_links", "n_kinds", "n_distinct_links")


def per_file(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Symbols and outgoing links of every file: (file_path, n_symbols, n_links), by eager aggregation through the join of links with nodes.

    Links are counted by source and nodes by (id, file) before they meet; the counts are multiplied, so repeated ids weigh as in the plain
    join, and summed by file. Files without links get 0; a null file_path comes out as one row."""
    joined = states(edges, nodes).filter("symbols is not null")
    joined = joined.groupBy("file_path").agg(F.sum("symbols").alias("n_symbols"), F.coalesce(F.sum(F.col("links") * F.col("symbols")), F.lit(0)).alias("n_links"))
    return joined.select("file_path", "n_symbols", "n_links")


def heavy_report(df: DataFrame, key: str, share: float = 0.02) -> DataFrame:
    """The heavy keys named with their rows and share: (key_value, n_rows, share)."""
    return heavy_keys(df, key, share).select(F.col(key).alias("key_value"), "n_rows", (F.col("n_rows") / F.col("total_rows")).alias("share"))
