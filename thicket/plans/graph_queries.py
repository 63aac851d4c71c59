"""Filters, joins, aggregates and traversals of the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import text as tx
from thicket.operators import graph, search, skew
from thicket.plans.registry import Registry
from thicket.session import cut, table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
q = R.query


def nodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nodes")


def edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "edges")


q("flt07_list_by_kind", "SELECT id, name, kind FROM nodes WHERE kind IN ('class', 'interface') AND language IN ('typescript', 'python')")(
    lambda s, d: nodes(s, d).filter(F.col("kind").isin("class", "interface") & F.col("language").isin("typescript", "python")).select("id", "name", "kind")
)
q("flt12_exact_name", "SELECT name, id, file_path FROM nodes WHERE name IN (SELECT name FROM nodes GROUP BY name HAVING count(*) BETWEEN 2 AND 4)")(
    lambda s, d: nodes(s, d).join(nodes(s, d).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n between 2 and 4"), "name", "left_semi").select("name", "id", "file_path")
)
q("flt13_name_prefix", "SELECT id, name FROM nodes WHERE starts_with(name, 'load')")(lambda s, d: nodes(s, d).filter(F.col("name").startswith("load")).select("id", "name"))
q("flt15_lower_name", "SELECT lower(name) AS lower_name, count(*) AS n FROM nodes GROUP BY 1 HAVING count(DISTINCT name) > 1")(
    lambda s, d: nodes(s, d).groupBy(F.lower("name").alias("lower_name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("v")).filter("v > 1").select("lower_name", "n")
)
q("flt16_substring_without_prefix", "SELECT id, name, length(name) AS n_chars FROM nodes WHERE contains(lower(name), 'cache') AND NOT starts_with(lower(name), 'cache')")(
    lambda s, d: nodes(s, d).filter(F.lower("name").contains("cache") & ~F.lower("name").startswith("cache")).select("id", "name", F.length("name").alias("n_chars"))
)
q("flt17_decorators", "SELECT d AS decorator, count(*) AS n FROM (SELECT unnest(json_extract_string(decorators, '$[*]')) AS d FROM nodes WHERE decorators IS NOT NULL AND json_valid(decorators)) GROUP BY 1")(
    lambda s, d: nodes(s, d).select(F.explode(F.from_json("decorators", "array<string>")).alias("decorator")).groupBy("decorator").agg(F.count(F.lit(1)).alias("n"))
)
q("flt18_qualified_glob", r"SELECT id, qualified_name FROM nodes WHERE regexp_matches(qualified_name, '^[^/]*_load[^/]*$')")(
    lambda s, d: nodes(s, d).filter(F.col("qualified_name").rlike(tx.glob_regex("*_load*"))).select("id", "qualified_name")
)
q("flt19_filtered_subgraph", "SELECT e.id, e.source, e.target, e.kind FROM edges e WHERE e.source IN (SELECT id FROM nodes WHERE kind = 'class') AND e.target IN (SELECT id FROM nodes WHERE kind = 'class')")(
    lambda s, d: graph.induced(edges(s, d), nodes(s, d).filter("kind = 'class'").select("id")).select("id", "source", "target", "kind")
)
q("flt20_exported_symbols", "SELECT file_path, count(*) AS n_exported FROM nodes WHERE is_exported = 1 GROUP BY 1")(
    lambda s, d: nodes(s, d).filter("is_exported = 1").groupBy("file_path").agg(F.count(F.lit(1)).alias("n_exported"))
)
_TEST = r"(^|/)(tests?|__tests__|spec|specs|testdata|fixtures)/|(^|/)test_[^/]*$|[._-](test|spec)s?\.[A-Za-z0-9]+$|_test\.[A-Za-z0-9]+$|Tests?\.[A-Za-z0-9]+$"
q("flt21_test_files", f"SELECT path FROM files WHERE regexp_matches(path, '{_TEST}')")(lambda s, d: table(s, d, "files").filter(tx.test_path(F.col("path"))).select("path"))
q("flt25_declaration_only_files", "SELECT file_path FROM nodes GROUP BY 1 HAVING bool_and(kind IN ('file', 'interface', 'type_alias', 'enum', 'import')) AND count(*) > 1")(
    lambda s, d: nodes(s, d).groupBy("file_path").agg(F.bool_and(F.col("kind").isin("file", "interface", "type_alias", "enum", "import")).alias("only"), F.count(F.lit(1)).alias("n")).filter("only and n > 1").select("file_path")
)
q("flt33_scope_prefix", "SELECT id, file_path FROM nodes WHERE file_path = 'harborlight' OR starts_with(file_path, 'harborlight/')")(
    lambda s, d: nodes(s, d).filter((F.col("file_path") == "harborlight") | F.col("file_path").startswith("harborlight/")).select("id", "file_path")
)
q("flt34_merged_line_ranges", """WITH s AS (SELECT file_path, start_line AS a, greatest(start_line, end_line) AS b, id FROM nodes WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
m AS (SELECT *, max(b) OVER (PARTITION BY file_path ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s),
i AS (SELECT *, sum(CASE WHEN upto IS NULL OR a > upto + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY a, b, id) AS island FROM m)
SELECT file_path, min(a) AS first_line, max(b) AS last_line FROM i GROUP BY file_path, island""")(lambda s, d: _islands(nodes(s, d)))  # fmt: skip
q("flt43_known_names", "SELECT DISTINCT n.name FROM nodes n WHERE n.kind = 'import' AND n.name IN (SELECT name FROM nodes WHERE kind <> 'import')")(
    lambda s, d: nodes(s, d).filter("kind = 'import'").select("name").distinct().join(nodes(s, d).filter("kind <> 'import'"), "name", "left_semi")
)


def _w(key, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def _islands(n: DataFrame) -> DataFrame:
    """Spans that overlap or touch, merged. A file with very many spans lies in several range partitions, which hand on the furthest line so far and the islands so far."""
    spans = n.filter("start_line is not null and end_line is not null").select("file_path", "id", F.col("start_line").alias("a"), F.greatest("start_line", "end_line").alias("b"))
    order = [F.col("a"), F.col("b"), F.col("id")]
    upto = skew.ordered_totals(spans, ["file_path"], order, F.col("b"), "upto", most=True)
    marked = upto.withColumn("new", F.when(F.col("upto").isNull() | (F.col("a") > F.col("upto") + 1), 1).otherwise(0))
    island = skew.ordered_totals(marked, ["file_path"], order, F.col("new"), "earlier").withColumn("island", F.col("earlier") + F.col("new"))
    return island.groupBy("file_path", "island").agg(F.min("a").alias("first_line"), F.max("b").alias("last_line")).drop("island")


q("flt10_file_outline", "SELECT file_path, id, kind, name, start_line, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id)::INTEGER AS place FROM nodes WHERE kind IN ('class', 'struct', 'interface')")(
    lambda s, d: nodes(s, d).filter(F.col("kind").isin("class", "struct", "interface")).select("file_path", "id", "kind", "name", "start_line").withColumn("place", F.row_number().over(_w("file_path", "start_line", "id")))
)

q("jn04_links_within_files", """SELECT a.file_path, count(*) AS n_links FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.kind <> 'contains' AND a.file_path = b.file_path GROUP BY 1""")(
    lambda s, d: _within(s, d)
)


def _within(s: SparkSession, d: str) -> DataFrame:
    files = nodes(s, d).select("id", "file_path")
    e = cut(edges(s, d).filter("kind <> 'contains'").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")))
    a = skew.lookup(e, files.select(F.col("id").alias("source"), F.col("file_path").alias("a")), "source", "inner")
    b = skew.lookup(cut(a), files.select(F.col("id").alias("target"), F.col("file_path").alias("b")), "target", "inner")
    return b.filter("a = b").groupBy(F.col("a").alias("file_path")).agg(F.sum("n").alias("n_links"))


_LINKS = """WITH l AS (SELECT a.file_path AS from_file, b.file_path AS to_file FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.kind <> 'contains' AND a.file_path <> b.file_path)"""
q("jn06_file_links", _LINKS + " SELECT from_file, to_file, count(*) AS n_links FROM l GROUP BY 1, 2")(lambda s, d: graph.file_links(nodes(s, d), edges(s, d)))
q("jn07_file_dependencies", _LINKS + " SELECT from_file AS file_path, count(DISTINCT to_file) AS n_dependencies FROM l GROUP BY 1")(
    lambda s, d: graph.file_links(nodes(s, d), edges(s, d)).groupBy(F.col("from_file").alias("file_path")).agg(F.count(F.lit(1)).alias("n_dependencies"))
)
q("gr13_file_dependents", _LINKS + " SELECT to_file AS file_path, count(DISTINCT from_file) AS n_dependents FROM l GROUP BY 1")(
    lambda s, d: graph.file_links(nodes(s, d), edges(s, d)).groupBy(F.col("to_file").alias("file_path")).agg(F.count(F.lit(1)).alias("n_dependents"))
)
q("jn10_adjacency", "SELECT e.target AS id, n.kind, count(*) AS n_links FROM edges e JOIN nodes n ON n.id = e.source GROUP BY 1, 2")(
    lambda s, d: skew.lookup(cut(edges(s, d).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))), nodes(s, d).select(F.col("id").alias("source"), "kind"), "source", "inner")
    .groupBy(F.col("target").alias("id"), "kind").agg(F.sum("n").alias("n_links"))
)
q("jn12_name_ceiling", "SELECT n.name, count(*) AS n_edges FROM edges e JOIN nodes n ON n.id = e.target WHERE e.provenance IS DISTINCT FROM 'heuristic' AND n.name IN (SELECT name FROM nodes GROUP BY 1 HAVING count(*) <= 5) GROUP BY 1")(
    lambda s, d: _ceiling(s, d)
)


def _ceiling(s: SparkSession, d: str) -> DataFrame:
    few = nodes(s, d).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n <= 5")
    named = nodes(s, d).select(F.col("id").alias("target"), "name").join(few, "name", "left_semi")
    e = edges(s, d).filter("not (provenance <=> 'heuristic')").groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return e.join(named, "target").groupBy("name").agg(F.sum("n").alias("n_edges"))


q("jn12_resolution_edges", """WITH t AS (SELECT e.*, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.provenance IS DISTINCT FROM 'heuristic'), k AS (SELECT name FROM t GROUP BY 1 HAVING count(*) <= 500)
SELECT t.id AS edge_id, t.name, t.source, t.target, t.kind, s.file_path AS source_file_path, s.language AS source_language FROM t JOIN k USING (name) JOIN nodes s ON s.id = t.source""")(
    lambda s, d: graph.resolution_edges(edges(s, d), nodes(s, d))
)
q("jn18_dangling_edges", "SELECT id, source, target FROM edges WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)")(
    lambda s, d: edges(s, d).select("id", "source", "target").join(nodes(s, d).select(F.col("id").alias("source")), "source", "left_anti")
    .unionByName(edges(s, d).select("id", "source", "target").join(nodes(s, d).select(F.col("id").alias("source")), "source", "left_semi").join(nodes(s, d).select(F.col("id").alias("target")), "target", "left_anti"))
)
q("jn19_metadata_relation", "SELECT id, json_extract_string(metadata, '$.confidence') AS confidence FROM edges WHERE metadata IS NOT NULL AND json_valid(metadata) AND json_extract_string(metadata, '$.confidence') IS NOT NULL")(
    lambda s, d: edges(s, d).filter("try_parse_json(metadata) is not null").select("id", F.get_json_object("metadata", "$.confidence").alias("confidence")).filter("confidence is not null")
)
q("jn21_seed_by_id_file_or_name", """WITH s AS (SELECT id, CASE WHEN id = 'registry' THEN 0 WHEN file_path = 'registry' THEN 1 WHEN name = 'registry.ts' THEN 2 WHEN lower(name) LIKE 'registry%' THEN 3 END AS way FROM nodes)
SELECT id, way FROM s WHERE way = (SELECT min(way) FROM s)""")(lambda s, d: _seed(s, d))  # fmt: skip


def _seed(s: SparkSession, d: str) -> DataFrame:
    way = F.when(F.col("id") == "registry", 0).when(F.col("file_path") == "registry", 1).when(F.col("name") == "registry.ts", 2).when(F.lower("name").startswith("registry"), 3)
    found = cut(nodes(s, d).select("id", way.alias("way")).filter("way is not null"))
    least = found.agg(F.min("way")).collect()[0][0]
    return found.filter(F.col("way") == F.lit(least))


q("jn25_enclosing_symbols")(
    lambda s, d: graph.enclosing(
        nodes(s, d).filter("start_line is not null and end_line is not null").select("id", "file_path", "start_line", "end_line"),
        skew.lookup(cut(edges(s, d).filter("line is not null").select("source", "line").distinct()), nodes(s, d).select(F.col("id").alias("source"), "file_path"), "source", "inner"),
    )
)
ORACLE["jn25_enclosing_symbols"] = """WITH a AS (SELECT DISTINCT n.file_path, e.line FROM edges e JOIN nodes n ON n.id = e.source WHERE e.line IS NOT NULL),
m AS (SELECT a.file_path, a.line, n.id, row_number() OVER (PARTITION BY a.file_path, a.line ORDER BY n.start_line DESC, n.end_line, n.id) AS r FROM a JOIN nodes n ON n.file_path = a.file_path AND a.line BETWEEN n.start_line AND n.end_line)
SELECT file_path, line, id FROM m WHERE r = 1"""
q("jn31_resolve_names", r"""WITH r AS (SELECT id AS ref_id, name, file_path FROM nodes WHERE kind = 'import'), f AS (SELECT * FROM nodes WHERE kind <> 'import'),
few AS (SELECT name FROM f GROUP BY 1 HAVING count(*) <= 500),
m AS (SELECT ref_id, f.id, CASE WHEN r.file_path = f.file_path THEN 3 WHEN regexp_replace(r.file_path, '/[^/]*$', '') = regexp_replace(f.file_path, '/[^/]*$', '') THEN 2 ELSE 1 END AS score FROM r JOIN f ON f.name = r.name WHERE f.name IN (SELECT name FROM few)),
k AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, id) AS i FROM m) SELECT ref_id, id, score FROM k WHERE i = 1""")(
    lambda s, d: graph.resolve_names(nodes(s, d).filter("kind = 'import'").select(F.col("id").alias("ref_id"), "name", "file_path"), nodes(s, d).filter("kind <> 'import'"))
)
q("jn36_unique_lower_names", "SELECT a.id AS ref_id, b.id FROM nodes a JOIN nodes b ON lower(a.name) = lower(b.name) WHERE a.kind = 'import' AND b.kind <> 'import' AND lower(b.name) IN (SELECT lower(name) FROM nodes WHERE kind <> 'import' GROUP BY 1 HAVING count(*) = 1)")(
    lambda s, d: nodes(s, d).filter("kind = 'import'").select(F.col("id").alias("ref_id"), F.lower("name").alias("n"))
    .join(nodes(s, d).filter("kind <> 'import'").groupBy(F.lower("name").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1"), "n").select("ref_id", "id")
)
q("jn43_rewritten_kinds", """SELECT e.id, CASE WHEN e.kind = 'extends' AND n.kind = 'interface' THEN 'implements' WHEN e.kind = 'calls' AND n.kind IN ('class', 'struct') THEN 'instantiates' ELSE e.kind END AS kind FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind IN ('extends', 'calls')""")(
    lambda s, d: edges(s, d).filter("kind in ('extends', 'calls')").join(nodes(s, d).select(F.col("id").alias("target"), F.col("kind").alias("k")), "target")
    .select("id", F.expr("case when kind = 'extends' and k = 'interface' then 'implements' when kind = 'calls' and k in ('class', 'struct') then 'instantiates' else kind end").alias("kind"))
)
q("jn52_sets_within_sets", """WITH m AS (SELECT DISTINCT e.source AS owner, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'contains' AND n.kind = 'method'),
i AS (SELECT * FROM m WHERE owner IN (SELECT id FROM nodes WHERE kind = 'interface')), c AS (SELECT * FROM m WHERE owner IN (SELECT id FROM nodes WHERE kind IN ('struct', 'class'))), n AS (SELECT owner, count(*) AS n FROM i GROUP BY 1)
SELECT i.owner AS interface_id, c.owner AS id FROM i JOIN c ON c.name = i.name JOIN n ON n.owner = i.owner GROUP BY i.owner, c.owner, n.n HAVING count(*) = n.n""")(lambda s, d: _division(s, d))  # fmt: skip


def _division(s: SparkSession, d: str) -> DataFrame:
    m = nodes(s, d).filter("kind = 'method'").select(F.col("id").alias("target"), "name")
    has = cut(edges(s, d).filter("kind = 'contains'").select("source", "target").join(m, "target").select(F.col("source").alias("owner"), "name").distinct())
    of = lambda *kinds: has.join(nodes(s, d).filter(F.col("kind").isin(*kinds)).select(F.col("id").alias("owner")), "owner", "left_semi")
    i = cut(of("interface"))
    met = i.withColumnRenamed("owner", "interface_id").join(of("struct", "class").withColumnRenamed("owner", "id"), "name")
    need = i.groupBy(F.col("owner").alias("interface_id")).agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("interface_id", "id").agg(F.count(F.lit(1)).alias("c")).join(need, "interface_id").filter("c = n").select("interface_id", "id")


q("agg01_counts_by_kind", "SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind UNION ALL SELECT 'language', language, count(*) FROM nodes GROUP BY language")(
    lambda s, d: nodes(s, d).groupBy(F.lit("node").alias("what"), "kind").agg(F.count(F.lit(1)).alias("n")).unionByName(edges(s, d).groupBy(F.lit("edge").alias("what"), "kind").agg(F.count(F.lit(1)).alias("n")))
    .unionByName(nodes(s, d).groupBy(F.lit("language").alias("what"), F.col("language").alias("kind")).agg(F.count(F.lit(1)).alias("n")))
)
_SEG = r"""SELECT DISTINCT id, s FROM (SELECT id, unnest(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' +'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$'))[1:12]) AS s FROM nodes)"""


def _segments(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).select("id", F.explode(F.array_distinct(tx.segments(F.col("name")))).alias("segment"))


q("agg05_segment_rarity", f"SELECT s AS segment, count(*) AS n FROM ({_SEG}) GROUP BY 1")(lambda s, d: _segments(s, d).groupBy("segment").agg(F.count(F.lit(1)).alias("n")))
q("agg04_segments_together", f"SELECT id, count(DISTINCT s) AS n_matches FROM ({_SEG}) WHERE s IN ('load', 'graph', 'cache', 'state') GROUP BY 1 HAVING count(DISTINCT s) >= 2")(
    lambda s, d: _segments(s, d).filter(F.col("segment").isin("load", "graph", "cache", "state")).groupBy("id").agg(F.countDistinct("segment").alias("n_matches")).filter("n_matches >= 2")
)
q("agg08_types_per_file", "SELECT file_path, count(*) AS n_declared, count(*) FILTER (kind IN ('class', 'interface', 'type_alias', 'enum', 'struct')) AS n_types FROM nodes GROUP BY 1")(
    lambda s, d: nodes(s, d).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_declared"), F.count_if(F.col("kind").isin("class", "interface", "type_alias", "enum", "struct")).alias("n_types"))
)
q("agg09_last_indexed", "SELECT language, max(indexed_at) AS last_indexed, count(*) FILTER (indexed_at < modified_at) AS n_stale FROM files GROUP BY 1")(
    lambda s, d: table(s, d, "files").groupBy("language").agg(F.max("indexed_at").alias("last_indexed"), F.count_if(F.col("indexed_at") < F.col("modified_at")).alias("n_stale"))
)
q("agg10_files_by_directory", r"SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory, count(*) AS n_files, sum(size)::BIGINT AS n_bytes FROM files GROUP BY 1")(
    lambda s, d: table(s, d, "files").groupBy(tx.directory(F.col("path")).alias("directory")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))
)
q("agg11_node_degrees", """WITH o AS (SELECT source AS id, count(*) AS n_out, count(*) FILTER (kind = 'calls') AS n_calls, count(*) FILTER (kind = 'contains') AS n_children FROM edges GROUP BY 1),
i AS (SELECT target AS id, count(*) AS n_in, count(*) FILTER (kind = 'calls') AS n_callers FROM edges GROUP BY 1)
SELECT n.id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(n_calls, 0) AS n_calls, coalesce(n_callers, 0) AS n_callers, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")(
    lambda s, d: graph.degrees(nodes(s, d), edges(s, d))
)
q("agg16_facets", f"SELECT CASE WHEN kind IN ('class', 'interface', 'struct', 'enum', 'type_alias') THEN 'definition' WHEN regexp_matches(file_path, '{_TEST}') THEN 'test' WHEN kind = 'import' THEN 'usage' ELSE 'other' END AS facet, count(*) AS n FROM nodes GROUP BY 1")(
    lambda s, d: nodes(s, d).groupBy(F.when(F.col("kind").isin("class", "interface", "struct", "enum", "type_alias"), "definition").when(tx.test_path(F.col("file_path")), "test").when(F.col("kind") == "import", "usage").otherwise("other").alias("facet")).agg(F.count(F.lit(1)).alias("n"))
)
q("agg32_edges_by_provenance", "SELECT provenance, kind, count(*) AS n FROM edges GROUP BY 1, 2")(lambda s, d: edges(s, d).groupBy("provenance", "kind").agg(F.count(F.lit(1)).alias("n")))
q("agg33_top_file_by_kind", "SELECT kind, file_path, n FROM (SELECT kind, file_path, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, file_path) AS r FROM nodes GROUP BY 1, 2) WHERE r = 1")(
    lambda s, d: nodes(s, d).groupBy("kind", "file_path").agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(F.min(F.struct((-F.col("n")).alias("m"), "file_path", "n")).alias("b")).select("kind", "b.file_path", "b.n")
)
q("set03_distinct_edges", "SELECT min(id) AS id, source, target, kind FROM edges GROUP BY source, target, kind, coalesce(line, -1), coalesce(col, -1)")(lambda s, d: graph.distinct_edges(edges(s, d)))
q("set10_changed_files", """SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM (SELECT path, content_hash FROM files WHERE modified_at < TIMESTAMP '2025-06-01') a FULL JOIN (SELECT path, sha256(content_hash || CASE WHEN generated = 1 THEN 'x' ELSE '' END) AS h, content_hash FROM files WHERE language <> 'go') b ON a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR sha256(a.content_hash) <> b.h""")(
    lambda s, d: graph.snapshot_diff(
        table(s, d, "files").filter("modified_at < timestamp_ntz '2025-06-01 00:00:00'").select("path", F.sha2("content_hash", 256).alias("h")),
        table(s, d, "files").filter("language <> 'go'").select("path", F.sha2(F.concat("content_hash", F.when(F.col("generated") == 1, "x").otherwise("")), 256).alias("h")), "path", "h")
)
q("set13_first_file_of_name", "SELECT name, min(file_path) AS file_path, count(DISTINCT file_path) AS n_files FROM nodes GROUP BY 1")(
    lambda s, d: nodes(s, d).groupBy("name").agg(F.min("file_path").alias("file_path"), F.countDistinct("file_path").alias("n_files"))
)

def _most(end: str, kinds: str) -> str:
    return f"(SELECT {end} AS id FROM edges WHERE kind IN ({kinds}) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _start(s: SparkSession, d: str, end: str, *kinds: str) -> DataFrame:
    """The node that most such links begin or end at."""
    return edges(s, d).filter(F.col("kind").isin(*kinds)).groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


def _walk(kinds: str, turned: bool, hops: int, start: str) -> str:
    a, b = ("target", "source") if turned else ("source", "target")
    return f"""WITH RECURSIVE p AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges WHERE kind IN ({kinds})), r(id, depth) AS (SELECT id, 0 FROM {start} UNION SELECT p.b, r.depth + 1 FROM r JOIN p ON p.a = r.id WHERE r.depth < {hops})
SELECT id, min(depth)::INTEGER AS depth FROM r GROUP BY 1"""


_USES = "'calls', 'references', 'imports', 'instantiates'"
_U = ("calls", "references", "imports", "instantiates")
q("gr01_breadth_first", _walk("'calls', 'references', 'contains'", False, 3, _most("source", "'contains'")))(lambda s, d: graph.reach(graph.adjacency(edges(s, d), ("calls", "references", "contains")), _start(s, d, "source", "contains"), 3))
q("gr03_callers", _walk(_USES, True, 3, _most("target", "'calls'")))(lambda s, d: graph.reach(graph.adjacency(edges(s, d), _U, True), _start(s, d, "target", "calls"), 3))
q("gr04_callees", _walk(_USES, False, 3, _most("source", "'calls'")))(lambda s, d: graph.reach(graph.adjacency(edges(s, d), _U), _start(s, d, "source", "calls"), 3))
q("gr06_type_ancestors", _walk("'extends', 'implements'", False, 8, _most("source", "'extends'")))(lambda s, d: graph.reach(graph.adjacency(edges(s, d), ("extends", "implements")), _start(s, d, "source", "extends"), 8))
q("gr06_type_descendants", _walk("'extends', 'implements'", True, 8, _most("target", "'extends'")))(lambda s, d: graph.reach(graph.adjacency(edges(s, d), ("extends", "implements"), True), _start(s, d, "target", "extends"), 8))
q("gr07_usages", "SELECT e.target AS id, count(*) AS n_usages, count(DISTINCT e.source) AS n_users FROM edges e WHERE e.kind <> 'contains' GROUP BY 1")(
    lambda s, d: edges(s, d).filter("kind <> 'contains'").groupBy("target", "source").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("target").alias("id")).agg(F.sum("n").alias("n_usages"), F.count(F.lit(1)).alias("n_users"))
)
q("gr08_impact", f"""WITH RECURSIVE r(id, depth) AS (SELECT id, 0 FROM {_most("target", "'calls'")} UNION
  SELECT CASE WHEN e.kind = 'contains' THEN e.target ELSE e.source END, r.depth + CASE WHEN e.kind = 'contains' THEN 0 ELSE 1 END FROM r JOIN edges e ON (e.kind = 'contains' AND e.source = r.id) OR (e.kind <> 'contains' AND e.target = r.id)
  WHERE r.depth + CASE WHEN e.kind = 'contains' THEN 0 ELSE 1 END <= 2) SELECT id, min(depth)::INTEGER AS depth FROM r GROUP BY 1""")(lambda s, d: graph.impact(edges(s, d), _start(s, d, "target", "calls"), 2))  # fmt: skip
q("gr15_unused", "SELECT id, name, kind FROM nodes n WHERE kind IN ('function', 'method', 'class') AND is_exported = 0 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target = n.id AND e.kind <> 'contains')")(
    lambda s, d: graph.unused(nodes(s, d), edges(s, d)).select("id", "name", "kind")
)
q("gr22_dependency_kinds", _LINKS + ", t AS (SELECT to_file FROM l GROUP BY 1) SELECT f.path, count(DISTINCT l.to_file) AS n_local, f.path IN (SELECT to_file FROM t) AS is_used FROM files f LEFT JOIN l ON l.from_file = f.path GROUP BY 1")(
    lambda s, d: _dependencies(s, d)
)


def _dependencies(s: SparkSession, d: str) -> DataFrame:
    links = cut(graph.file_links(nodes(s, d), edges(s, d)))
    out = links.groupBy(F.col("from_file").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    used = links.select(F.col("to_file").alias("path")).distinct().withColumn("u", F.lit(True))
    return table(s, d, "files").select("path").join(out, "path", "left").join(used, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_local"), F.coalesce("u", F.lit(False)).alias("is_used"))


@q("gr11_shortest_path")
def _path(s: SparkSession, d: str) -> DataFrame:
    pairs = cut(graph.adjacency(edges(s, d), _U))
    start = _start(s, d, "source", "calls")
    found = graph.reach(pairs, start, 6)
    end = found.orderBy(F.desc("depth"), "id").limit(1).collect()[0][0]
    return graph.shortest_path(pairs, start.collect()[0][0], end)


q("rk03_name_tiers", "SELECT id, name, CASE WHEN name = 'load' THEN 1.0 WHEN lower(name) = 'load' THEN 0.9 WHEN starts_with(lower(name), 'load') THEN 0.8 WHEN contains(name, 'load') THEN 0.7 WHEN contains(lower(name), 'load') THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM nodes WHERE contains(lower(name), 'load')")(
    lambda s, d: nodes(s, d).select("id", "name", search.likeness_score(F.col("name"), "load").alias("score")).filter("score > 0")
)
q("rk04_fuzzy_names", "SELECT id, name, levenshtein(lower(name), 'loadgraf')::INTEGER AS distance, 1 / (1 + levenshtein(lower(name), 'loadgraf')) AS score FROM nodes WHERE levenshtein(lower(name), 'loadgraf') <= 2")(
    lambda s, d: search.fuzzy(nodes(s, d).select("id", "name"), "loadgraf")
)
q("rk05_distinctive_names", "SELECT name, count(DISTINCT file_path) AS n_files, count(DISTINCT file_path) < 10 AS distinctive FROM nodes GROUP BY 1")(
    lambda s, d: nodes(s, d).select("name", "file_path").distinct().groupBy("name").agg(F.count("file_path").alias("n_files")).withColumn("distinctive", F.col("n_files") < 10)
)
q("rk11_similar_files", "SELECT path, levenshtein(path, 'harborlight/core/monolit.c')::INTEGER AS distance FROM files WHERE levenshtein(path, 'harborlight/core/monolit.c') <= 3 ORDER BY 2, 1 LIMIT 5")(
    lambda s, d: table(s, d, "files").select("path", F.levenshtein("path", F.lit("harborlight/core/monolit.c"), 3).alias("distance")).filter("distance >= 0").orderBy("distance", "path").limit(5)
)
q("rk51_per_file_cap", "SELECT id, file_path FROM (SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY kind, id) AS r FROM nodes) WHERE r <= 5")(
    lambda s, d: graph.top_of(nodes(s, d).select("id", "file_path", "kind"), ["file_path"], ["kind", "id"], 5).select("id", "file_path")
)
