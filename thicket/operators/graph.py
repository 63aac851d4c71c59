"""Operators on a property graph of nodes (id, kind, ...) and edges (source, target, kind, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.skew import lookup
from thicket.session import cut, drop_cut


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The first stored of the edges equal in source, target, kind, line and column, nulls in the last two being alike."""
    return edges.groupBy("source", "target", "kind", F.coalesce("line", F.lit(-1)).alias("l"), F.coalesce("col", F.lit(-1)).alias("c")).agg(F.min("id").alias("id")).select("id", "source", "target", "kind")


def adjacency(edges: DataFrame, kinds: Sequence[str] | None = None, reverse: bool = False) -> DataFrame:
    """Distinct (a, b) pairs, from source to target or turned round."""
    e = edges if kinds is None else edges.filter(F.col("kind").isin(*kinds))
    a, b = ("target", "source") if reverse else ("source", "target")
    return e.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null").distinct()


def reach(pairs: DataFrame, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """(id, depth) of all nodes within so many hops of any start, which has depth 0; all of them for None.

    Breadth first, a join a level, and each level is written out, so the plan does not grow. starts: (id)."""
    pairs = cut(pairs)
    level = cut(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    seen, depth = level, 0
    while hops is None or depth < hops:
        depth += 1
        step = pairs.join(level.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        level = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level))
    return seen


def closure(pairs: DataFrame) -> DataFrame:
    """(a, b) for all nodes b that a reaches over the pairs in one step or more: steps are doubled, so rounds follow the logarithm of the depth."""
    whole = cut(pairs.distinct())
    n = whole.count()
    while n:
        twice = whole.join(whole.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        more = cut(whole.unionByName(twice).distinct())
        now = more.count()
        drop_cut(whole)
        whole = more
        if now == n:
            break
        n = now
    return whole


def impact(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(id, depth) of what a change of the starts may touch: a container's content at its own depth, whatever depends on a node one deeper."""
    inside = cut(adjacency(edges, ("contains",)))
    # Only containers within containers are closed over; what contains nothing, nearly all there is, is met from the level alone.
    nested = closure(inside.join(inside.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
    users = cut(adjacency(edges.filter("kind <> 'contains'"), None, reverse=True))
    follow = lambda pairs, level: pairs.join(level.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
    seen, level = None, starts.select("id").distinct()
    for depth in range(hops + 1):
        level = cut(level if seen is None else follow(users, level).join(seen, "id", "left_anti"))
        # What the level contains: the containers within it, then the content of all of them.
        level = cut(level.unionByName(follow(nested, level)).distinct())
        level = level.unionByName(follow(inside, level)).distinct()
        level = cut((level if seen is None else level.join(seen, "id", "left_anti")).withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = level if seen is None else cut(seen.unionByName(level))
        level = level.select("id")
    return seen


def shortest_path(pairs: DataFrame, start: str, end: str, most: int = 50) -> DataFrame:
    """(step, id) of a shortest path, of several the one whose ids are least from the end on; no rows if there is none.

    Levels are searched forward and kept; the path is read back level by level."""
    spark = pairs.sparkSession
    found = reach(pairs, spark.createDataFrame([(start,)], "id string"), most)
    at = found.filter(F.col("id") == end).select("depth").collect()
    path = [end] if at else []
    for depth in range(at[0][0] - 1 if at else -1, -1, -1):
        up = pairs.filter(F.col("b") == path[-1]).select(F.col("a").alias("id")).join(found.filter(F.col("depth") == depth), "id").agg(F.min("id")).collect()[0][0]
        path.append(up)
    return spark.createDataFrame(list(enumerate(reversed(path))), "step int, id string")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out, n_calls, n_callers, n_children) of every node; edges are counted by end before they meet the nodes."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n_out"), F.count_if(F.col("kind") == "calls").alias("n_calls"), F.count_if(F.col("kind") == "contains").alias("n_children"))
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n_in"), F.count_if(F.col("kind") == "calls").alias("n_callers"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("id").join(out, "id", "left").join(into, "id", "left").select("id", z("n_in"), z("n_out"), z("n_calls"), z("n_callers"), z("n_children"))


def unused(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] = ("function", "method", "class")) -> DataFrame:
    """Nodes of these kinds that are not exported and that nothing but their container refers to."""
    used = edges.filter("kind <> 'contains'").select(F.col("target").alias("id"))
    return nodes.filter(F.col("kind").isin(*kinds) & (F.col("is_exported") == 0)).join(used, "id", "left_anti")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids (id)."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def _same_files(df: DataFrame, made: DataFrame) -> DataFrame:
    df._thicket_path = made._thicket_path
    return df


def file_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_file, to_file, n_links) between different files; links are joined with files one end at a time, safe from heavy nodes."""
    files = cut(nodes.select("id", "file_path").dropDuplicates(["id"]))
    e = edges.filter("kind <> 'contains'").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    # Made by cut(), so that lookup() need not write it out again for the other end.
    named = lambda end, file: _same_files(files.select(F.col("id").alias(end), F.col("file_path").alias(file)), files)
    e = lookup(cut(e), named("source", "from_file"), "source", "inner")
    e = e.groupBy("from_file", "target").agg(F.sum("n").alias("n"))
    e = lookup(cut(e), named("target", "to_file"), "target", "inner")
    return e.filter("from_file <> to_file").groupBy("from_file", "to_file").agg(F.sum("n").alias("n_links"))


def enclosing(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_path, line, id): the innermost span of each line: of those that hold it the one that starts last, then ends first, then has the least id.

    spans: (id, file_path, start_line, end_line); lines: (file_path, line). Spans are cut at blocks of 64 lines, so both sides meet by (file, block)
    and a file with very many spans or lines is spread over its blocks."""
    cutup = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_line") / 64), F.floor(F.greatest("start_line", "end_line") / 64))))
    asked = lines.select("file_path", "line").distinct().withColumn("block", F.floor(F.col("line") / 64))
    met = asked.join(cutup, ["file_path", "block"]).filter("line between start_line and end_line")
    return met.groupBy("file_path", "line").agg(F.min(F.struct(-F.col("start_line"), "end_line", "id"))["id"].alias("id"))


def resolve_names(refs: DataFrame, nodes: DataFrame, ceiling: int | None = 500) -> DataFrame:
    """(ref_id, id, score): for each reference (ref_id, name, file_path) the definition of that name nearest by path.

    With a ceiling, names with more definitions are left open, as they name nothing in particular; None resolves all. Score: 3 for the same file, 2 for the same directory, 1
    otherwise; ties by least id. Only the least id of each name, directory and file can be the answer, so references meet three small tables by equality, however
    often a name is defined."""
    defs = nodes.filter("name is not null").select("name", "id", F.col("file_path").alias("def_path"))
    if ceiling is not None:
        few = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= ceiling)
        defs = defs.join(few.select("name"), "name", "left_semi")
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    sep = "\u0001"
    place = lambda *c: F.concat_ws(sep, *[F.coalesce(x, F.lit("\u0002")) for x in c])
    defs = cut(defs.select("name", "id", place(F.col("name"), F.col("def_path")).alias("in_file"), place(F.col("name"), folder("def_path")).alias("in_folder")))
    out = cut(refs.filter("name is not null").select("ref_id", "name", place(F.col("name"), F.col("file_path")).alias("in_file"), place(F.col("name"), folder("file_path")).alias("in_folder")))
    for key, score in (("in_file", 3), ("in_folder", 2), ("name", 1)):
        least = defs.groupBy(key).agg(F.min("id").alias(f"id{score}"))
        out = cut(lookup(out, least, key))
    best = F.when(F.col("id3").isNotNull(), 3).when(F.col("id2").isNotNull(), 2).when(F.col("id1").isNotNull(), 1)
    return out.select("ref_id", F.coalesce("id3", "id2", "id1").alias("id"), best.alias("score")).filter("id is not null")


def resolution_edges(edges: DataFrame, nodes: DataFrame, ceiling: int = 500) -> DataFrame:
    """(edge_id, name, source, target, kind, source_file_path, source_language): the edges that names were resolved to, with the file each begins in.

    Heuristic edges are left out, and names that more than `ceiling` of the other edges end at. Those are counted by target first, so the edges of hot targets
    are gone before they are joined."""
    e = edges.filter("not (provenance <=> 'heuristic')")
    targets = nodes.select(F.col("id").alias("target"), "name").filter("name is not null")
    n = cut(e.groupBy("target").agg(F.count(F.lit(1)).alias("n")).join(targets, "target"))
    kept = n.join(n.groupBy("name").agg(F.sum("n").alias("all")).filter(F.col("all") <= ceiling).select("name"), "name", "left_semi").select("target", "name")
    met = cut(lookup(e.select(F.col("id").alias("edge_id"), "source", "target", "kind"), cut(kept), "target", "inner"))
    places = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("source_file_path"), F.col("language").alias("source_language"))
    return lookup(met, places, "source", "inner").select("edge_id", "name", "source", "target", "kind", "source_file_path", "source_language")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or modified keys of two snapshots; equal ones are left out."""
    a, b = old.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_o")), new.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_n"))
    j = a.join(b, key, "full")
    return j.select(key, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified").alias("change")).filter("change is not null")


def top_of(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")

