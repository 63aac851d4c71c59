"""Queries of the general problems: hierarchies (p1) and heavy keys (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators import heavy, hierarchy
from thicket.session import table


def _contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").filter("kind = 'contains'").select("id", "source", "target")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.found_cycles(_contains(spark, d))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.hierarchy(table(spark, d, "nodes"), _contains(spark, d))
    return tree.selectExpr("node_id", "parent_id", "root_id", "depth", "array_join(path, '/') as path", "n_descendants", "in_cycle")


def p1_intervals(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.hierarchy(table(spark, d, "nodes"), _contains(spark, d))
    return tree.select("node_id", "root_id", "preorder", "first_descendant", "last_descendant")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = table(spark, d, "nodes"), _contains(spark, d)
    pairs = hierarchy.descendants(hierarchy.hierarchy(hierarchy.every_id(nodes, links), links))
    return pairs.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")


def p1_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.all_descendants(table(spark, d, "nodes"), _contains(spark, d))


def p1_set_aside(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.set_aside(_contains(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.found_heavy(table(spark, d, "edges"), table(spark, d, "nodes"))


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    return heavy.per_source(table(spark, d, "edges"), table(spark, d, "nodes"))


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return heavy.per_file(table(spark, d, "edges"), table(spark, d, "nodes"))


def p4_heavy_sources(spark: SparkSession, d: str) -> DataFrame:
    return heavy.heavy_report(table(spark, d, "edges"), "source")


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_intervals, p1_descendants, p1_all_descendants, p1_set_aside, p4_found, p4_sources, p4_files, p4_heavy_sources)}

_REACH = """WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'contains' AND source IS NOT NULL AND target IS NOT NULL),
inner_e AS (SELECT * FROM e WHERE target IN (SELECT source FROM e)),
reach(a, b) AS (SELECT source, target FROM inner_e UNION SELECT r.a, x.target FROM reach r JOIN inner_e x ON x.source = r.b)"""

_FOREST = (
    _REACH
    + """, kept AS (SELECT g.source, g.target, min(g.id) AS id FROM edges g WHERE kind = 'contains' AND g.source IS NOT NULL AND g.target IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.a = g.target AND r.b = g.source) AND g.source <> g.target GROUP BY 1, 2),
up AS (SELECT target AS id, arg_min(source, id) AS parent FROM kept GROUP BY 1),
ids AS (SELECT id FROM nodes UNION SELECT source FROM e UNION SELECT target FROM e),
tree(id, parent, root, depth, path) AS (SELECT i.id, NULL::VARCHAR, i.id, 0, [i.id] FROM ids i WHERE i.id NOT IN (SELECT id FROM up)
  UNION ALL SELECT u.id, u.parent, t.root, t.depth + 1, list_append(t.path, u.id) FROM tree t JOIN up u ON u.parent = t.id),
pairs AS (SELECT id, unnest(path[1:-2]) AS above, generate_subscripts(path[1:-2], 1) AS place FROM tree)"""
)

ORACLE = {
    "p1_found": _REACH
    + """, own AS (SELECT a, b FROM reach r WHERE EXISTS (SELECT 1 FROM reach q WHERE q.a = r.b AND q.b = r.a))
SELECT least(min(b), a) AS cycle_id, a AS node_id FROM own GROUP BY a""",
    "p1_hierarchy": _FOREST
    + """, below AS (SELECT above, count(*) AS n FROM pairs GROUP BY 1)
SELECT n.id AS node_id, t.parent AS parent_id, t.root AS root_id, t.depth::INTEGER AS depth, array_to_string(t.path, '/') AS path, coalesce(b.n, 0)::BIGINT AS n_descendants,
  n.id IN (SELECT a FROM reach WHERE a = b) AS in_cycle FROM nodes n JOIN tree t ON t.id = n.id LEFT JOIN below b ON b.above = n.id""",
    "p1_descendants": _FOREST + " SELECT above AS ancestor_id, pairs.id AS node_id, (t.depth - place + 1)::INTEGER AS distance FROM pairs JOIN tree t ON t.id = pairs.id WHERE pairs.id IN (SELECT id FROM nodes)",
    "p1_all_descendants": _REACH.replace("reach(a, b)", "inside(a, b)").replace("FROM reach", "FROM inside")
    + """, reach(a, b) AS (SELECT a, b FROM inside UNION SELECT r.a, e.target FROM inside r JOIN e ON e.source = r.b UNION SELECT source, target FROM e)
SELECT a AS ancestor_id, b AS node_id FROM reach WHERE a <> b AND b IN (SELECT id FROM nodes)""",
    "p1_set_aside": _FOREST
    + """ SELECT e.source AS source_id, e.target AS target_id, EXISTS (SELECT 1 FROM reach r WHERE r.a = e.target AND r.b = e.source) AS within_cycle FROM e
WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.id = e.target AND up.parent = e.source)""",
    "p4_found": """SELECT 'edges.source' AS field, source AS key_value FROM edges WHERE source IS NOT NULL GROUP BY source HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM edges)
UNION ALL SELECT 'nodes.file_path', file_path FROM nodes WHERE file_path IS NOT NULL GROUP BY file_path HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM nodes)""",
    "p4_sources": """WITH c AS (SELECT source, count(*) AS n_links, count(DISTINCT kind) AS n_kinds FROM edges GROUP BY 1),
u AS (SELECT source, count(*) AS n_distinct_links FROM (SELECT DISTINCT source, target, kind FROM edges) GROUP BY 1)
SELECT c.source, n.file_path, c.n_links, c.n_kinds, u.n_distinct_links FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source LEFT JOIN nodes n ON n.id = c.source""",
    "p4_files": """SELECT n.file_path, count(DISTINCT n.id) AS n_symbols, count(e.id) AS n_links FROM nodes n LEFT JOIN edges e ON e.source = n.id GROUP BY 1""",
    "p4_heavy_sources": """SELECT source AS key_value, count(*) AS n_rows, count(*) / (SELECT count(*) FROM edges) AS share FROM edges WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)""",
}
