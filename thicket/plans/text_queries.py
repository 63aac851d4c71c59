"""Documents: ranked search, vectors, sections, chunks, clean-up, sinks' formats; and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions import text as tx
from thicket.operators import search, skew
from thicket.plans.registry import Registry
from thicket.session import cut, table
from thicket.sources import formats, sinks
from thicket.streaming import streams

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
q = R.query

C = F.col


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "work_unit_records")


_LINES = r"(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


def lines(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", "line", (C("p") + 1).alias("n"))


# Sources
q("src09_titles", r"""SELECT doc_id, trim(CASE WHEN regexp_extract(text, '(?m)^##?[ \t]+(\S.*)$', 1) <> '' THEN regexp_extract(text, '(?m)^##?[ \t]+(\S.*)$', 1)
 WHEN regexp_extract(text, '(?m)^#\+TITLE:[ \t]*(\S.*)$', 1) <> '' THEN regexp_extract(text, '(?m)^#\+TITLE:[ \t]*(\S.*)$', 1) ELSE regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') END) AS title FROM documents""")(
    lambda s, d: docs(s, d).select("doc_id", tx.title(F.regexp_replace("text", "\r", ""), C("path")).alias("title"))
)
ORACLE["src09_titles"] = ORACLE["src09_titles"].replace("FROM documents", "FROM (SELECT doc_id, path, replace(text, chr(13), '') AS text FROM documents)")
q("src10_content_hash", "SELECT doc_id, sha256(text) AS digest, sha256(text) = hash AS agrees, substr(sha256(text), 1, 6) AS docid FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", F.sha2("text", 256).alias("digest"), (F.sha2("text", 256) == C("hash")).alias("agrees"), F.substring(F.sha2("text", 256), 1, 6).alias("docid"))
)
q("src11_distinct_content", "SELECT hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")(lambda s, d: docs(s, d).groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")))
q("src12_slugs")(lambda s, d: table(s, d, "files").select("path", tx.slug(C("path")).alias("slug")))
q("src14_file_types", "SELECT CASE WHEN e IN ('md', 'mdx', 'rst') THEN 'markdown' WHEN e IN ('json', 'yaml', 'yml', 'toml', 'xml', 'ini') THEN 'structured' WHEN e IN ('csv', 'tsv') THEN 'tabular' WHEN e = 'log' THEN 'log' WHEN e = '' THEN 'other' ELSE 'code' END AS file_type, count(*) AS n FROM (SELECT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM files) GROUP BY 1".replace("\\\\", "\\"))(
    lambda s, d: table(s, d, "files").groupBy(tx.file_type(C("path")).alias("file_type")).agg(F.count(F.lit(1)).alias("n"))
)
q("src13_languages_by_extension", r"SELECT lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS extension, count(*) AS n, count(DISTINCT language) AS n_languages FROM files GROUP BY 1")(
    lambda s, d: table(s, d, "files").groupBy(tx.extension(C("path")).alias("extension")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("language").alias("n_languages"))
)
q("src17_head_and_tail", f"SELECT doc_id, n, line FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM {_LINES}) WHERE k > 15 AND (n <= 10 OR n > k - 5)")(
    lambda s, d: docs(s, d).select("doc_id", F.split("text", "\n").alias("l")).filter(F.size("l") > 15).select("doc_id", F.size("l").alias("k"), F.posexplode("l").alias("p", "line"))
    .filter((C("p") < 10) | (C("p") >= C("k") - 5)).select("doc_id", (C("p") + 1).cast("long").alias("n"), "line")
)
q("src19_sections", r"SELECT doc_id, n, length(regexp_extract(line, '^(#{1,6}) ', 1)) AS level, regexp_extract(line, '^#{1,6} +(.*)$', 1) AS heading FROM " + _LINES + r" WHERE regexp_matches(line, '^#{1,6} ')")(
    lambda s, d: lines(s, d).filter(C("line").rlike("^#{1,6} ")).select("doc_id", C("n").cast("long").alias("n"), F.length(F.regexp_extract("line", "^(#{1,6}) ", 1)).cast("long").alias("level"), F.regexp_extract("line", "^#{1,6} +([^\r]*)", 1).alias("heading"))
)
ORACLE["src19_sections"] = ORACLE["src19_sections"].replace("+(.*)$'", r"+([^\r]*)'")
q("src21_section_of_line", r"SELECT doc_id, n, last_value(CASE WHEN regexp_matches(line, '^#{1,6} ') THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section_line FROM " + _LINES)(
    lambda s, d: lines(s, d).withColumn("section_line", F.last(F.when(C("line").rlike("^#{1,6} "), C("n")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    .select("doc_id", C("n").cast("long").alias("n"), C("section_line").cast("long").alias("section_line"))
)
q("links_of_documents", r"SELECT doc_id, u AS url FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\]\(([^)\s]+)\)', 1)) AS u FROM documents) GROUP BY 1, 2")(
    lambda s, d: docs(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), 1)).alias("url")).distinct()
)

# Filters
q("flt02_all_words_no_other", "SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'cache']) AND NOT list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'table')")(
    lambda s, d: docs(s, d).withColumn("w", tx.words(C("text"))).filter(F.array_contains("w", "the") & F.array_contains("w", "cache") & ~F.array_contains("w", "table")).select("doc_id")
)
q("flt02_phrase", "SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' gravity wave ')")(
    lambda s, d: docs(s, d).filter(F.concat(F.lit(" "), F.array_join(tx.words(C("text")), " "), F.lit(" ")).contains(" gravity wave ")).select("doc_id")
)
q("flt26_occurrence_audit", "SELECT collection, count(*) AS n_targets, count(*) FILTER (k > 0) AS n_with, coalesce(sum(k), 0)::BIGINT AS n_occurrences FROM (SELECT collection, len(regexp_extract_all(lower(text), 'wave')) AS k FROM documents) GROUP BY 1")(
    lambda s, d: docs(s, d).withColumn("k", F.size(F.regexp_extract_all(F.lower("text"), F.lit("wave"), 0))).groupBy("collection").agg(F.count(F.lit(1)).alias("n_targets"), F.count_if(C("k") > 0).alias("n_with"), F.sum("k").alias("n_occurrences"))
)
q("flt30_log_filter", f"SELECT doc_id, n, line FROM {_LINES} WHERE regexp_matches(line, '(?i) line \\d+ (error|warn)')")(
    lambda s, d: lines(s, d).filter(C("line").rlike(r"(?i) line \d+ (error|warn)")).select("doc_id", C("n").cast("long").alias("n"), "line")
)
_SECRET = tx.SECRETS
q("flt35_secret_counts", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS {k}" for k, p in _SECRET.items()) + " FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", tx.secret_counts(C("text")).alias("c")).select("doc_id", *[C(f"c.{k}").cast("long").alias(k) for k in _SECRET])
)
q("flt36_redacted")(lambda s, d: docs(s, d).select("doc_id", tx.redact(C("text")).alias("text")))

# Ranking
_BM = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), l AS (SELECT doc_id, len(w) AS len, w FROM w), a AS (SELECT count(*) AS n, avg(len) AS average FROM l),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest(w) AS term FROM l) WHERE term IN ('gravity', 'wave', 'cache') GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))) AS score FROM tf JOIN df USING (term), a GROUP BY 1)"""
_TERMS = ("gravity", "wave", "cache")
q("rk12_bm25", _BM + " SELECT doc_id, round(score, 6) AS score FROM s")(lambda s, d: search.bm25(docs(s, d), "doc_id", "text", _TERMS).select("doc_id", F.round("score", 6).alias("score")))
q("rk12_bm25_queries", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '(\p{Ll})(\p{Lu})', '\1 \2', 'g')), '[\p{L}\p{N}]+') AS w FROM documents), a AS (SELECT count(*) AS n, avg(len(w)) AS average FROM w),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * d.len / average))), 9) AS score
 FROM tf q JOIN tf d ON d.term = q.term AND d.doc_id <> q.doc_id JOIN df ON df.term = q.term, a WHERE q.doc_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")(
    lambda s, d: search.bm25_queries(docs(s, d), docs(s, d).filter("doc_id % 100 = 0"), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
)
_RANKS = _BM + """, a1 AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 50), a2 AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE active = 1 QUALIFY rank <= 50)"""


def _lists(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scores = search.bm25(docs(s, d), "doc_id", "text", _TERMS).withColumn("score", F.round("score", 9))
    return search.ranked(scores, "doc_id", 50), search.ranked(docs(s, d).filter("active = 1").select("doc_id", C("n_chars").alias("score")), "doc_id", 50)


q("rk15_reciprocal_ranks", _RANKS + " SELECT doc_id, round(sum(w / (60 + rank)) + CASE WHEN min(rank) = 1 THEN 0.05 WHEN min(rank) <= 3 THEN 0.02 ELSE 0 END, 9) AS score FROM (SELECT doc_id, rank, 2.0::DOUBLE AS w FROM a1 UNION ALL SELECT doc_id, rank, 1.0 FROM a2) GROUP BY 1")(
    lambda s, d: search.fuse([(_lists(s, d)[0], 2.0), (_lists(s, d)[1], 1.0)], "doc_id").select("doc_id", F.round("score", 9).alias("score"))
)
q("rk13_nearest_vectors", """SELECT query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 10""")(
    lambda s, d: search.nearest(table(s, d, "embeddings"), table(s, d, "embeddings").filter("vec_id % 100 = 0"), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")
)
q("rk22_strong_first", _BM + ", t AS (SELECT score, lead(score) OVER (ORDER BY score DESC, doc_id) AS following FROM s ORDER BY score DESC LIMIT 1) SELECT round(score, 6) AS score, coalesce(score - following >= 0.15 * score, true) AS strong FROM t")(
    lambda s, d: search.ranked(search.bm25(docs(s, d), "doc_id", "text", _TERMS), "doc_id", 2).withColumn("following", F.lead("score").over(Window.orderBy("rank"))).filter("rank = 1")
    .select(F.round("score", 6).alias("score"), F.coalesce(C("score") - C("following") >= 0.15 * C("score"), F.lit(True)).alias("strong"))
)
q("rk45_snippets", f"""WITH l AS (SELECT doc_id, n, (contains(lower(line), 'gravity'))::INTEGER + (contains(lower(line), 'wave'))::INTEGER AS hits FROM {_LINES}),
b AS (SELECT doc_id, n, hits, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, n) AS r FROM l WHERE hits > 0)
SELECT b.doc_id, b.n::INTEGER AS line, b.hits, array_to_string(list_slice(string_split(d.text, chr(10)), greatest(b.n - 1, 1), b.n + 2), chr(10)) AS snippet FROM b JOIN documents d USING (doc_id) WHERE r = 1""")(
    lambda s, d: search.snippets(docs(s, d), "doc_id", "text", ["gravity", "wave"])
)
q("rk59_budget", "SELECT collection, doc_id FROM (SELECT collection, doc_id, sum(ceil(length(text) / 4)) OVER (PARTITION BY collection ORDER BY modified_at DESC, doc_id) AS used FROM documents) WHERE used <= 24000")(
    lambda s, d: skew.ordered_totals(docs(s, d).select("collection", "doc_id", "modified_at", tx.tokens_about(C("text")).alias("k")), ["collection"], [C("modified_at").desc(), C("doc_id")], C("k")).filter(C("before") + C("k") <= 24_000).select("collection", "doc_id")
)
q("rk60_token_estimate", "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS n_tokens FROM documents")(lambda s, d: docs(s, d).select("doc_id", tx.tokens_about(C("text")).alias("n_tokens")))

# Functions
q("sc09_vocabulary", "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")(
    lambda s, d: search.postings(docs(s, d), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
)
q("sc09_tokens")(
    lambda s, d: docs(s, d).select("doc_id", F.explode(tx.tokens(C("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
)
q("sc11_content_words", "SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "], x))) AS n FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", F.size(tx.content_words(C("text"))).cast("long").alias("n"))
)
q("sc16_code_fences", f"SELECT doc_id, count(*) AS n_fences, count(*) % 2 = 1 AS left_open FROM {_LINES} WHERE regexp_matches(line, '^[ ]{{0,3}}```') GROUP BY 1")(
    lambda s, d: lines(s, d).filter(C("line").rlike("^[ ]{0,3}```")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_fences")).withColumn("left_open", C("n_fences") % 2 == 1)
)
q("fingerprints_by_model", "SELECT model, embed_fingerprint, count(DISTINCT hash) AS n_hashes, count(*) AS n FROM content_vectors GROUP BY 1, 2")(
    lambda s, d: table(s, d, "content_vectors").groupBy("model", "embed_fingerprint").agg(F.countDistinct("hash").alias("n_hashes"), F.count(F.lit(1)).alias("n"))
)
q("sc35_event_properties", "SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")(
    lambda s, d: table(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
)
q("sc39_sizes", "SELECT hash, length(doc) AS n_chars, strlen(doc) AS n_bytes, len(string_split(replace(replace(doc, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS n_lines FROM content")(
    lambda s, d: table(s, d, "content").select("hash", F.length("doc").cast("long").alias("n_chars"), F.octet_length("doc").cast("long").alias("n_bytes"), F.size(tx.line_of(C("doc"))).cast("long").alias("n_lines"))
)
q("sc41_ages", "SELECT collection, count(*) FILTER (modified_at < created_at) AS n_before, min(date_trunc('day', created_at)::DATE) AS first_day, max(epoch_us(modified_at)) AS last_us FROM documents GROUP BY 1")(
    lambda s, d: docs(s, d).groupBy("collection").agg(F.count_if(C("modified_at") < C("created_at")).alias("n_before"), F.min(F.to_date("created_at")).alias("first_day"), F.max(F.unix_micros(C("modified_at").cast("timestamp"))).alias("last_us"))
)
q("ext59_highlighted", "SELECT doc_id, regexp_replace(text, '(gravity|wave)', '<b>\\1</b>', 'gi') AS text FROM documents")(lambda s, d: docs(s, d).select("doc_id", tx.highlight(C("text"), ["gravity", "wave", "of"]).alias("text")))

# Aggregates and sets over documents
q("agg12_collections", "SELECT collection, count(*) AS n, count(*) FILTER (active = 1) AS n_active, max(modified_at) AS last_modified, count(DISTINCT hash) AS n_contents FROM documents GROUP BY 1")(
    lambda s, d: docs(s, d).groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("active") == 1).alias("n_active"), F.max("modified_at").alias("last_modified"), F.countDistinct("hash").alias("n_contents"))
)
q("agg15_piece_completeness", "SELECT hash, model, embed_fingerprint, count(*) AS n, max(total_chunks) AS expected, count(DISTINCT seq) = max(total_chunks) AS complete FROM content_vectors GROUP BY 1, 2, 3")(
    lambda s, d: table(s, d, "content_vectors").groupBy("hash", "model", "embed_fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max("total_chunks").alias("expected"), F.countDistinct("seq").alias("k")).withColumn("complete", C("k") == C("expected")).drop("k")
)
q("jn14_pending_pieces", "SELECT c.hash FROM content c LEFT JOIN (SELECT hash, count(DISTINCT seq) AS k, max(total_chunks) AS t FROM content_vectors GROUP BY 1) v ON v.hash = c.hash WHERE v.k IS NULL OR v.k < v.t")(
    lambda s, d: table(s, d, "content").select("hash").join(table(s, d, "content_vectors").groupBy("hash").agg(F.countDistinct("seq").alias("k"), F.max("total_chunks").alias("t")), "hash", "left").filter("k is null or k < t").select("hash")
)
q("jn23_exclusive_hashes", "SELECT hash, min(collection) AS collection FROM documents GROUP BY 1 HAVING count(DISTINCT collection) = 1")(
    lambda s, d: docs(s, d).groupBy("hash").agg(F.min("collection").alias("collection"), F.max("collection").alias("z")).filter("collection = z").drop("z")
)
q("jn02_documents_with_content", "SELECT d.doc_id, d.collection, length(c.doc) AS n FROM documents d JOIN content c ON c.hash = d.hash WHERE d.active = 1")(
    lambda s, d: docs(s, d).filter("active = 1").select("doc_id", "collection", "hash").join(table(s, d, "content").select("hash", F.length("doc").cast("long").alias("n")), "hash").select("doc_id", "collection", "n")
)
q("set04_orphan_content", "SELECT hash FROM content WHERE hash NOT IN (SELECT hash FROM documents WHERE active = 1) AND hash NOT IN (SELECT content_hash FROM files)")(
    lambda s, d: table(s, d, "content").select("hash").join(docs(s, d).filter("active = 1").select("hash"), "hash", "left_anti").join(table(s, d, "files").select(C("content_hash").alias("hash")), "hash", "left_anti")
)
q("set05_orphan_pieces", "SELECT hash, seq FROM content_vectors v WHERE NOT EXISTS (SELECT 1 FROM content c WHERE c.hash = v.hash)")(
    lambda s, d: table(s, d, "content_vectors").select("hash", "seq").join(table(s, d, "content").select("hash"), "hash", "left_anti")
)
q("set08_newest", "SELECT doc_id, modified_at FROM documents ORDER BY modified_at DESC, doc_id LIMIT 1000")(lambda s, d: docs(s, d).select("doc_id", "modified_at").orderBy(F.desc("modified_at"), "doc_id").limit(1000))
q("set11_stale_files", "SELECT f.path FROM files f JOIN content c ON c.hash = f.content_hash WHERE f.size <> strlen(c.doc)")(
    lambda s, d: table(s, d, "files").select("path", "size", C("content_hash").alias("hash")).join(table(s, d, "content").select("hash", F.octet_length("doc").alias("n")), "hash").filter("size <> n").select("path")
)

# Telemetry and orders: run statistics
q("agg21_run_stats", """SELECT subsystem, operation, count(*) AS n, round(avg(cpuuserms), 6) AS mean, round(coalesce(stddev_samp(cpuuserms), 0), 6) AS deviation, min(cpuuserms) AS least, max(cpuuserms) AS most, round(quantile_cont(cpuuserms, 0.5), 6) AS middle FROM work_unit_records GROUP BY 1, 2""")(
    lambda s, d: _run_stats(s, d)
)


def _run_stats(s: SparkSession, d: str) -> DataFrame:
    """Medians by counts of equal values, so that no group is held in one task."""
    r, keys = records(s, d).select("subsystem", "operation", "cpuuserms"), ("subsystem", "operation")
    plain = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cpuuserms"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("cpuuserms"), F.lit(0.0)), 6).alias("deviation"), F.min("cpuuserms").alias("least"), F.max("cpuuserms").alias("most"))
    middle = skew.exact_percentiles(r, keys, "cpuuserms", (50,), between=True).select(C("subsystem").alias("a"), C("operation").alias("b"), F.round("x", 6).alias("middle"))
    return plain.join(middle, C("subsystem").eqNullSafe(C("a")) & C("operation").eqNullSafe(C("b")), "left").drop("a", "b")


q("agg22_outcomes", "SELECT outcome, error IS NOT NULL AS has_error, count(*) AS n, sum(coalesce(bytecount, 0))::BIGINT AS n_bytes FROM work_unit_records GROUP BY 1, 2")(
    lambda s, d: records(s, d).groupBy("outcome", C("error").isNotNull().alias("has_error")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("bytecount", F.lit(0))).alias("n_bytes"))
)
q("agg28_token_buckets", "SELECT CASE WHEN t < 300 THEN 0 ELSE 1 + floor((t - 300) / 200) END::BIGINT AS bucket, count(*) AS n FROM (SELECT ceil(length(text) / 4) AS t FROM documents) GROUP BY 1")(
    lambda s, d: docs(s, d).select(tx.tokens_about(C("text")).alias("t")).groupBy(F.when(C("t") < 300, 0).otherwise(1 + F.floor((C("t") - 300) / 200)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
)
q("revenue", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")(
    lambda s, d: table(s, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
)
q("user_gaps", "SELECT user_id, max(date_diff('second', before, ts)) AS longest_gap, count(*) FILTER (before IS NULL OR ts - before > INTERVAL 1 DAY) AS n_sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1")(
    lambda s, d: table(s, d, "events").withColumn("before", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    .groupBy("user_id").agg(F.max(F.expr("timestampdiff(second, date_trunc('second', before), date_trunc('second', ts))")).alias("longest_gap"), F.count_if(C("before").isNull() | (C("ts") - C("before") > F.expr("interval 1 day"))).alias("n_sessions"))
)
q("ext03_overview", "SELECT language, count(*) AS n_files, sum(size)::BIGINT AS n_bytes, count(*) FILTER (generated = 1) AS n_generated FROM files GROUP BY 1")(
    lambda s, d: table(s, d, "files").groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"), F.count_if(C("generated") == 1).alias("n_generated"))
)
q("top_paths", "SELECT string_split(path, '/')[1] AS top, count(*) AS n FROM documents GROUP BY 1")(lambda s, d: docs(s, d).groupBy(F.split("path", "/")[0].alias("top")).agg(F.count(F.lit(1)).alias("n")))
q("ext64_multi_get", r"SELECT doc_id, path, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) AS head FROM documents WHERE regexp_matches(path, '^[^/]*wiki[^/]*/(?:.*/)?[^/]*\.md$') AND length(text) <= 4000")(
    lambda s, d: docs(s, d).filter(C("path").rlike(tx.glob_regex("*wiki*/**/*.md")) & (F.length("text") <= 4000)).select("doc_id", "path", F.array_join(F.slice(F.split("text", "\n"), 1, 3), "\n").alias("head"))
)
q("embedding_health", "SELECT label, count(*) AS n, round(min(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 4) AS least, bool_and(len(embedding) = 64) AS right_length FROM embeddings GROUP BY 1")(
    lambda s, d: table(s, d, "embeddings").withColumn("n2", F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)))
    .groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("n2"), 4).alias("least"), F.bool_and(F.size("embedding") == 64).alias("right_length"))
)

# Sinks
q("snk01_json_lines")(lambda s, d: sinks.as_json(docs(s, d).select("doc_id", "title", "collection")))
q("snk02_csv_lines", "SELECT doc_id || ',' || CASE WHEN regexp_matches(title, '[\",\\n\\r]') THEN '\"' || replace(title, '\"', '\"\"') || '\"' ELSE coalesce(title, '') END AS line FROM documents".replace("\\\\", "\\"))(
    lambda s, d: sinks.as_csv(docs(s, d).select("doc_id", "title"))
)
q("snk04_markdown_lines")(lambda s, d: sinks.as_markdown(docs(s, d), "title", "path", F.concat(F.lit("documents of "), C("collection"))))
q("snk09_latest_nodes", "SELECT id, max(updated_at) AS updated_at FROM nodes GROUP BY 1")(lambda s, d: sinks.latest(table(s, d, "nodes"), ["id"], "updated_at").select("id", "updated_at"))
q("snk10_insertable_edges", "SELECT source, target, kind, min(id) AS id FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY source, target, kind, coalesce(line, -1), coalesce(col, -1)")(
    lambda s, d: _insertable(s, d)
)


def _insertable(s: SparkSession, d: str) -> DataFrame:
    from thicket.operators import graph

    n = cut(table(s, d, "nodes").select("id"))
    return graph.induced(graph.distinct_edges(table(s, d, "edges")), n).select("source", "target", "kind", "id")


# Streams over what is there
q("windowed_events", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(
    lambda s, d: streams.drained(streams.windowed_counts(streams.parquet_stream(s, d, "events"), "ts", "event_type", "1 day", "40 days"), "complete")
    .select(C("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
)
q("st02_bursts", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, burst""")(
    lambda s, d: streams.drained(streams.bursts(streams.parquet_stream(s, d, "events"), "ts", "user_id", "12 hours", "40 days"), "complete").select("user_id", C("start").cast("timestamp_ntz").alias("start"), "n")
)
q("st06_followed_lines", f"SELECT line AS value, count(*) AS n FROM {_LINES} WHERE regexp_matches(line, '(?i) line \\d+ error') GROUP BY 1")(
    lambda s, d: streams.drained(streams.followed_lines(streams.parquet_stream(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")), r" line \d+ error")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
)
q("kept_postings", "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2")(lambda s, d: _kept(s, d))


def _kept(s: SparkSession, d: str) -> DataFrame:
    import uuid

    from thicket.session import shared_dir

    return streams.keep_postings(streams.parquet_stream(s, d, "documents").select("doc_id", "text"), f"{shared_dir(s)}/thicket-kept-{uuid.uuid4().hex}")()


q("src42_conflicts")(lambda s, d: formats.conflicts(table(s, d, "content"), "hash", "doc"))
q("agg19_retrieval_metrics", _RANKS + """, hit AS (SELECT a1.rank, coalesce(d.source = 'handbook', false) AS good FROM a1 JOIN documents d USING (doc_id) WHERE a1.rank <= 10), all_good AS (SELECT count(*) AS n FROM documents WHERE source = 'handbook')
SELECT round(count(*) FILTER (good) / least(10, (SELECT n FROM all_good)), 6) AS precision_at_10, round(count(*) FILTER (good) / (SELECT n FROM all_good), 6) AS recall_at_10, round(coalesce(1 / min(rank) FILTER (good), 0), 6) AS reciprocal_rank FROM hit""")(
    lambda s, d: _metrics(s, d)
)


def _metrics(s: SparkSession, d: str) -> DataFrame:
    good = docs(s, d).filter("source = 'handbook'").select("doc_id", F.lit(True).alias("g"))
    n = good.count()
    top = _lists(s, d)[0].filter("rank <= 10").join(good, "doc_id", "left")
    hits = F.count_if(F.coalesce("g", F.lit(False)))
    return top.agg(F.round(hits / min(10, max(1, n)), 6).alias("precision_at_10"), F.round(hits / max(1, n), 6).alias("recall_at_10"), F.round(F.coalesce(1 / F.min(F.when(C("g"), C("rank"))), F.lit(0.0)), 6).alias("reciprocal_rank"))
