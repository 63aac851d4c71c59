"""Further lookups, joins, aggregates and set operations over graph, files and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.operators import graph, skew
from thicket.plans.registry import Registry
from thicket.session import cut, small, table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
q = R.query
C = F.col


def N():
    return F.count(F.lit(1)).alias("n")


def t(name: str):
    return lambda s, d: table(s, d, name)


nodes, edges, files, docs, content, pieces = (t(x) for x in ("nodes", "edges", "files", "documents", "content", "content_vectors"))

q("flt08_by_id", "SELECT id, name FROM nodes WHERE id = (SELECT max(target) FROM edges)")(lambda s, d: nodes(s, d).join(edges(s, d).agg(F.max("target").alias("id")), "id", "left_semi").select("id", "name"))
q("flt09_by_ids", "SELECT id, kind FROM nodes WHERE id IN (SELECT target FROM edges WHERE kind = 'overrides')")(lambda s, d: nodes(s, d).join(edges(s, d).filter("kind = 'overrides'").select(C("target").alias("id")), "id", "left_semi").select("id", "kind"))
q("flt11_by_kind", "SELECT id, file_path FROM nodes WHERE kind = 'enum'")(lambda s, d: nodes(s, d).filter("kind = 'enum'").select("id", "file_path"))
q("flt14_by_qualified_name", "SELECT a.id, b.id AS other FROM nodes a JOIN nodes b ON a.qualified_name = b.qualified_name AND a.id < b.id AND a.kind = 'class' AND b.kind = 'class'")(
    lambda s, d: nodes(s, d).filter("kind = 'class'").select("id", "qualified_name").join(nodes(s, d).filter("kind = 'class'").select(C("id").alias("other"), "qualified_name"), "qualified_name").filter("id < other").select("id", "other")
)
q("numbers_in_titles", "SELECT lang, count(*) FILTER (try_cast(regexp_extract(title, '(\\d+)$', 1) AS INTEGER) > 5000) AS n FROM documents GROUP BY 1")(
    lambda s, d: docs(s, d).groupBy("lang").agg(F.count_if(F.regexp_extract("title", r"(\d+)\z", 1).try_cast("int") > 5000).alias("n"))
)
q("first_piece_of_files", "SELECT f.path, min(v.pos) AS pos, max(v.seq) AS last_seq FROM files f JOIN content_vectors v ON v.hash = f.content_hash GROUP BY 1")(
    lambda s, d: files(s, d).select("path", C("content_hash").alias("hash")).join(pieces(s, d).groupBy("hash").agg(F.min("pos").alias("pos"), F.max("seq").alias("last_seq")), "hash").groupBy("path").agg(F.min("pos").alias("pos"), F.max("last_seq").alias("last_seq"))
)
q("interfaces_and_implementers", "SELECT i.id AS interface_id, c.id, c.file_path FROM edges e JOIN nodes c ON c.id = e.source JOIN nodes i ON i.id = e.target WHERE e.kind = 'implements' AND c.kind = 'class' GROUP BY 1, 2, 3")(
    lambda s, d: edges(s, d).filter("kind = 'implements'").select(C("source").alias("id"), C("target").alias("interface_id")).distinct().join(nodes(s, d).filter("kind = 'class'").select("id", "file_path"), "id")
    .join(nodes(s, d).select(C("id").alias("interface_id")), "interface_id", "left_semi").select("interface_id", "id", "file_path").distinct()
)
q("jn08_incoming_from_other_files", "SELECT b.file_path, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE a.file_path <> b.file_path GROUP BY 1")(lambda s, d: _incoming(s, d))


def _incoming(s: SparkSession, d: str) -> DataFrame:
    where = nodes(s, d).select("id", "file_path")
    e = cut(edges(s, d).groupBy("source", "target").agg(N()))
    a = cut(skew.lookup(e, where.select(C("id").alias("source"), C("file_path").alias("a")), "source", "inner"))
    return skew.lookup(a, where.select(C("id").alias("target"), "file_path"), "target", "inner").filter("a <> file_path").groupBy("file_path").agg(F.sum("n").alias("n"))


q("jn09_edges_among_exported", "SELECT id FROM edges WHERE source IN (SELECT id FROM nodes WHERE is_exported = 1) AND target IN (SELECT id FROM nodes WHERE is_exported = 1)")(
    lambda s, d: graph.induced(edges(s, d), cut(nodes(s, d).filter("is_exported = 1").select("id"))).select("id")
)
q("jn15_pending_count", "SELECT count(DISTINCT c.hash) AS n FROM content c LEFT JOIN content_vectors v ON v.hash = c.hash WHERE v.hash IS NULL")(
    lambda s, d: content(s, d).select("hash").join(pieces(s, d), "hash", "left_anti").agg(F.countDistinct("hash").alias("n"))
)
q("jn16_files_without_nodes", "SELECT path FROM files WHERE path NOT IN (SELECT file_path FROM nodes)")(lambda s, d: files(s, d).select("path").join(nodes(s, d).select(C("file_path").alias("path")), "path", "left_anti"))
q("label_coverage", "SELECT source, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM subject_labels)) AS n_labelled FROM documents GROUP BY 1")(
    lambda s, d: docs(s, d).select("doc_id", "source").join(table(s, d, "subject_labels").select("doc_id").distinct().withColumn("l", F.lit(1)), "doc_id", "left").groupBy("source").agg(N(), F.count("l").alias("n_labelled"))
)
q("jn22_collections_without_adr", "SELECT DISTINCT collection FROM documents WHERE collection NOT IN (SELECT collection FROM documents WHERE source = 'adr')")(
    lambda s, d: docs(s, d).select("collection").distinct().join(docs(s, d).filter("source = 'adr'"), "collection", "left_anti")
)
q("nearest_collection", "SELECT d.doc_id, max(c.collection) AS owner FROM documents d JOIN (SELECT DISTINCT collection FROM documents) c ON starts_with(d.path, c.collection || '/') GROUP BY 1")(
    lambda s, d: docs(s, d).select("doc_id", F.element_at(F.split("path", "/"), 1).alias("collection")).join(docs(s, d).select("collection").distinct(), "collection").select("doc_id", C("collection").alias("owner"))
)
q("jn54_definition_delta", "SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.name, b.name) AS name, a.name IS NULL AS added FROM (SELECT DISTINCT file_path, name FROM nodes WHERE updated_at < TIMESTAMP '2026-01-10') a FULL JOIN (SELECT DISTINCT file_path, name FROM nodes WHERE updated_at >= TIMESTAMP '2026-01-05') b ON a.file_path = b.file_path AND a.name = b.name WHERE a.name IS NULL OR b.name IS NULL")(
    lambda s, d: nodes(s, d).filter("updated_at < timestamp_ntz '2026-01-10 00:00:00'").select("file_path", "name", F.lit(1).alias("a")).distinct()
    .join(nodes(s, d).filter("updated_at >= timestamp_ntz '2026-01-05 00:00:00'").select("file_path", "name", F.lit(1).alias("b")).distinct(), ["file_path", "name"], "full").filter("a is null or b is null").select("file_path", "name", C("a").isNull().alias("added"))
)
q("same_identity", "SELECT name, kind, qualified_name, count(*) AS n FROM nodes GROUP BY 1, 2, 3 HAVING count(*) > 1")(lambda s, d: nodes(s, d).groupBy("name", "kind", "qualified_name").agg(N()).filter("n > 1"))
q("agg02_totals", "SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM files) AS n_files")(
    lambda s, d: s.range(1).select(F.lit(nodes(s, d).count()).cast("long").alias("n_nodes"), F.lit(edges(s, d).count()).cast("long").alias("n_edges"), F.lit(files(s, d).count()).cast("long").alias("n_files"))
)
q("agg03_names_paged", "SELECT DISTINCT name FROM nodes ORDER BY name LIMIT 100 OFFSET 50")(lambda s, d: nodes(s, d).select("name").distinct().orderBy("name").offset(50).limit(100))
q("agg07_concentration", "SELECT kind, file_path, n, n / total AS share FROM (SELECT kind, file_path, count(*) AS n, sum(count(*)) OVER (PARTITION BY kind) AS total FROM nodes GROUP BY 1, 2) WHERE n >= 3 AND n >= 0.3 * total")(
    lambda s, d: nodes(s, d).groupBy("kind", "file_path").agg(N()).withColumn("total", F.sum("n").over(Window.partitionBy("kind"))).filter("n >= 3 and n >= 0.3 * total").select("kind", "file_path", "n", (C("n") / C("total")).alias("share"))
)
q("agg13_collection_counts", "SELECT collection, source, count(*) AS n, sum(active)::BIGINT AS n_active FROM documents GROUP BY 1, 2")(lambda s, d: docs(s, d).groupBy("collection", "source").agg(N(), F.sum("active").alias("n_active")))
q("agg17_several_signatures", "SELECT name, count(DISTINCT signature) AS n FROM nodes WHERE signature IS NOT NULL GROUP BY 1 HAVING count(DISTINCT signature) > 1")(
    lambda s, d: nodes(s, d).filter("signature is not null").groupBy("name").agg(F.countDistinct("signature").alias("n")).filter("n > 1")
)
q("means_by_segment", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean, count(*) AS n FROM customer GROUP BY 1")(lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), N()))
q("agg23_middle_row", "SELECT subsystem, record_id, cpuuserms FROM (SELECT DISTINCT subsystem, record_id, cpuuserms, row_number() OVER (PARTITION BY subsystem ORDER BY cpuuserms, record_id) AS i, count(*) OVER (PARTITION BY subsystem) AS n FROM (SELECT DISTINCT subsystem, record_id, cpuuserms FROM work_unit_records)) WHERE i = n // 2 + 1")(
    lambda s, d: _middle(s, d)
)


def _middle(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "work_unit_records").select("subsystem", "record_id", "cpuuserms").distinct()
    ranked = cut(skew.ordered_totals(rows, ["subsystem"], [C("cpuuserms"), C("record_id")]))
    counts = ranked.groupBy(C("subsystem").alias("s")).agg(N())
    return ranked.join(F.broadcast(counts) if small(counts) else counts, C("subsystem").eqNullSafe(C("s"))).filter("before = n div 2").select("subsystem", "record_id", "cpuuserms")


q("agg26_order_percentiles", "SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95 FROM orders GROUP BY 1")(
    lambda s, d: skew.exact_percentiles(table(s, d, "orders"), ["o_orderpriority"], "o_totalprice", (50, 95)).groupBy("o_orderpriority").agg(F.max(F.when(C("percent") == 50, C("x"))).alias("p50"), F.max(F.when(C("percent") == 95, C("x"))).alias("p95"))
)
q("bytes_by_root", "SELECT root, sum(coalesce(rssendbytes, 0) - coalesce(rssstartbytes, 0))::BIGINT AS n_bytes, count(*) AS n FROM work_unit_records GROUP BY 1")(
    lambda s, d: table(s, d, "work_unit_records").groupBy("root").agg(F.sum(F.coalesce("rssendbytes", F.lit(0)) - F.coalesce("rssstartbytes", F.lit(0))).alias("n_bytes"), N())
)
q("kind_and_export_bonus", "SELECT id, CASE kind WHEN 'class' THEN 10 WHEN 'function' THEN 8 WHEN 'method' THEN 6 ELSE 0 END + CASE WHEN is_exported = 1 THEN 5 ELSE 0 END AS score FROM nodes")(
    lambda s, d: nodes(s, d).select("id", (F.expr("case kind when 'class' then 10 when 'function' then 8 when 'method' then 6 else 0 end") + F.when(C("is_exported") == 1, 5).otherwise(0)).alias("score"))
)
q("path_depth_score", "SELECT path, 200 - 20 * (len(string_split(path, '/')) - 1) AS score FROM files")(lambda s, d: files(s, d).select("path", (200 - 20 * (F.size(F.split("path", "/")) - 1)).cast("long").alias("score")))
q("rk36_recency", "SELECT path, CASE WHEN modified_at >= m - INTERVAL 1 DAY THEN 100 WHEN modified_at >= m - INTERVAL 7 DAY THEN 80 WHEN modified_at >= m - INTERVAL 30 DAY THEN 50 ELSE 20 END AS score FROM files, (SELECT max(modified_at) AS m FROM files)")(
    lambda s, d: _recency(s, d)
)


def _recency(s: SparkSession, d: str) -> DataFrame:
    last = F.lit(files(s, d).agg(F.max("modified_at")).collect()[0][0]).cast("timestamp_ntz")
    since = lambda n: C("modified_at") >= last - F.expr(f"interval {n} day")
    return files(s, d).select("path", F.when(since(1), 100).when(since(7), 80).when(since(30), 50).otherwise(20).alias("score"))


q("set01_paths_of_two_tables", "SELECT path FROM files UNION SELECT file_path FROM nodes")(lambda s, d: files(s, d).select("path").union(nodes(s, d).select("file_path")).distinct())
q("set02_best_of_channels", "SELECT id, max(score) AS score FROM (SELECT source AS id, 1.0::DOUBLE AS score FROM edges WHERE kind = 'calls' UNION ALL SELECT target, 0.5 FROM edges WHERE kind = 'references') GROUP BY 1")(
    lambda s, d: edges(s, d).filter("kind = 'calls'").select(C("source").alias("id"), F.lit(1.0).alias("score")).unionByName(edges(s, d).filter("kind = 'references'").select(C("target").alias("id"), F.lit(0.5).alias("score"))).groupBy("id").agg(F.max("score").alias("score"))
)
q("set06_active_only", "SELECT doc_id FROM documents WHERE active = 1")(lambda s, d: docs(s, d).filter("active = 1").select("doc_id"))
q("set07_deactivated", "SELECT doc_id, CASE WHEN modified_at < created_at THEN 0 ELSE active END AS active FROM documents")(lambda s, d: docs(s, d).select("doc_id", F.when(C("modified_at") < C("created_at"), 0).otherwise(C("active")).alias("active")))
q("set09_complete_pieces", "SELECT v.hash, v.seq FROM content_vectors v JOIN (SELECT hash FROM content_vectors GROUP BY 1 HAVING count(DISTINCT seq) = max(total_chunks)) c ON c.hash = v.hash")(
    lambda s, d: pieces(s, d).select("hash", "seq").join(pieces(s, d).groupBy("hash").agg(F.countDistinct("seq").alias("k"), F.max("total_chunks").alias("m")).filter("k = m"), "hash", "left_semi")
)
q("sc08_distinctive_names", "SELECT id FROM nodes WHERE regexp_matches(substr(name, 2), '[A-Z]') OR contains(name, '_')")(lambda s, d: nodes(s, d).filter(F.substring("name", 2, 10**6).rlike("[A-Z]") | C("name").contains("_")).select("id"))
q("sc25_docids", "SELECT doc_id, regexp_matches(hash, '^[a-f0-9]{6,}$') AS proper, '#' || left(hash, 6) AS docid FROM documents")(lambda s, d: docs(s, d).select("doc_id", C("hash").rlike("^[a-f0-9]{6,}$").alias("proper"), F.concat(F.lit("#"), F.substring("hash", 1, 6)).alias("docid")))
q("sc26_virtual_paths", r"SELECT doc_id, regexp_extract(path, '^([^/]+)/(.*)$', 1) AS collection, regexp_extract(path, '^([^/]+)/(.*)$', 2) AS rest FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", F.regexp_extract("path", "^([^/]+)/(.*)$", 1).alias("collection"), F.regexp_extract("path", "^([^/]+)/(.*)$", 2).alias("rest"))
)
q("sc36_errors_unnested", "SELECT path, unnest(json_extract_string(errors, '$[*]')) AS error FROM files WHERE errors IS NOT NULL AND json_valid(errors)")(lambda s, d: files(s, d).select("path", F.explode(F.from_json("errors", "array<string>")).alias("error")))
q("sc44_buckets", "SELECT label, width_bucket AS bucket, count(*) AS n FROM (SELECT event_type AS label, least(greatest(floor(value / 10), 0), 9)::BIGINT AS width_bucket FROM events) GROUP BY 1, 2")(
    lambda s, d: table(s, d, "events").groupBy(C("event_type").alias("label"), F.least(F.greatest(F.floor(C("value") / 10), F.lit(0)), F.lit(9)).cast("long").alias("bucket")).agg(N())
)
q("ext02_identifiers", r"SELECT id, regexp_matches(name, '^[A-Za-z_$][A-Za-z0-9_$]*$') AS identifier FROM nodes")(lambda s, d: nodes(s, d).select("id", C("name").rlike(r"^[A-Za-z_$][\w$]*$").alias("identifier")))
q("ext17_single_definitions", "SELECT name, min(id) AS id FROM nodes WHERE kind <> 'import' GROUP BY 1 HAVING count(*) = 1")(lambda s, d: nodes(s, d).filter("kind <> 'import'").groupBy("name").agg(N(), F.min("id").alias("id")).filter("n = 1").select("name", "id"))
q("ext19_directory_sizes", r"SELECT array_to_string(string_split(path, '/')[1:2], '/') AS directory, count(*) AS n, sum(size)::BIGINT AS n_bytes FROM files GROUP BY 1")(
    lambda s, d: files(s, d).groupBy(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("directory")).agg(N(), F.sum("size").alias("n_bytes"))
)
q("ext32_active_paths", "SELECT collection, path FROM documents WHERE active = 1")(lambda s, d: docs(s, d).filter("active = 1").select("collection", "path"))
q("ext41_names_of_changed_files", "SELECT DISTINCT file_path, name FROM nodes WHERE file_path IN (SELECT path FROM files WHERE indexed_at < modified_at)")(
    lambda s, d: nodes(s, d).select("file_path", "name").distinct().join(files(s, d).filter("indexed_at < modified_at").select(C("path").alias("file_path")), "file_path", "left_semi")
)
q("ext60_by_collection_prefix", "SELECT doc_id FROM documents WHERE starts_with(collection, 'harborlight') OR starts_with(collection, 'feed')")(lambda s, d: docs(s, d).filter(C("collection").startswith("harborlight") | C("collection").startswith("feed")).select("doc_id"))
q("ext65_listing", "SELECT collection, path, row_number() OVER (PARTITION BY collection ORDER BY path)::INTEGER AS place FROM documents")(lambda s, d: skew.ordered_totals(docs(s, d).select("collection", "path"), ["collection"], [C("path")]).select("collection", "path", (C("before") + 1).cast("int").alias("place")))
q("ext63_census", "SELECT model, count(DISTINCT hash) AS n_hashes, min(embedded_at) AS first_at, max(embedded_at) AS last_at FROM content_vectors GROUP BY 1")(lambda s, d: pieces(s, d).groupBy("model").agg(F.countDistinct("hash").alias("n_hashes"), F.min("embedded_at").alias("first_at"), F.max("embedded_at").alias("last_at")))
