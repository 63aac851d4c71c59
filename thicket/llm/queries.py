"""Queries of the training-data problems (p2, p3, p5, p6, p7, p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thicket.llm import handwritten, mixing, packing, percentiles, splitting, subjects
from thicket.llm.tokens import VOCABULARY
from thicket.session import cut, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.found_slow_or_growing(table(spark, d, "work_unit_records"))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.report(table(spark, d, "work_unit_records"))


def p2_percentiles_by_day(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.report_by_day(table(spark, d, "work_unit_records"))


def p2_exact_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.settled(table(spark, d, "work_unit_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.found_not_handwritten(table(spark, d, "files"), table(spark, d, "content"))


def p3_judged(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.judge(table(spark, d, "files"), table(spark, d, "content"))


def p3_held_out(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.held_out(table(spark, d, "files"), table(spark, d, "content"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found_wrong_pieces(table(spark, d, "content"), table(spark, d, "content_vectors"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "content"))


def p5_token_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "content"), limit=1_024, overlap=128, reach=256, arrays=splitting.token_arrays(VOCABULARY))


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    return splitting.checked(table(spark, d, "content")).select("hash", "valid")


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.windows(table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.windows(table(spark, d, "documents")))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return packing.checked(cut(packing.windows(documents)), documents)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares_reached(mixing.mixture(table(spark, d, "documents"), targets), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.found_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


QUERIES = {f.__name__: f for f in (p2_found, p2_percentiles, p2_percentiles_by_day, p2_exact_percentiles, p3_found, p3_judged, p3_held_out, p5_found, p5_pieces, p5_token_pieces, p5_checked, p6_windows, p6_fill, p6_checked, p7_mixture, p7_shares, p8_found, p8_composition)}

_COUNTED = """WITH once AS (SELECT DISTINCT * FROM work_unit_records),
v AS (SELECT 'durationms' AS measure, lower(trim(subsystem)) AS subsystem, lower(trim(operation)) AS operation, durationms AS x FROM once WHERE NOT isnan(durationms) AND durationms >= 0
  UNION ALL SELECT 'rssdeltabytes', lower(trim(subsystem)), lower(trim(operation)), rssdeltabytes::DOUBLE FROM once WHERE rssdeltabytes IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY measure, subsystem, operation ORDER BY x) AS i, count(*) OVER (PARTITION BY measure, subsystem, operation) AS n FROM v)"""

ORACLE = {
    "p2_found": _COUNTED
    + """, q AS (SELECT measure, subsystem, operation, any_value(n) AS n, min(x) FILTER (i * 100 >= n * 50) AS p50, min(x) FILTER (i * 100 >= n * 95) AS p95, min(x) FILTER (i * 100 >= n * 99) AS p99 FROM r GROUP BY 1, 2, 3)
SELECT measure, subsystem, operation FROM q WHERE n >= 50 AND CASE WHEN measure = 'durationms' THEN p95 > 10 * p50 ELSE p99 > 16777216 END""",
    "p2_exact_percentiles": _COUNTED
    + """ SELECT measure, subsystem, operation, p::INTEGER AS percent, any_value(n) AS n, min(x) FILTER (i * 100 >= n * p) AS value FROM r, (SELECT unnest([50, 90, 95, 99]) AS p) GROUP BY 1, 2, 3, 4""",
    "p5_checked": "SELECT DISTINCT hash, true AS valid FROM content WHERE length(doc) > 3600",
    "p6_checked": "SELECT count(DISTINCT doc_id) AS n_documents, 0::BIGINT AS n_misplaced, 0::BIGINT AS n_over_capacity FROM documents",
    "p5_found": """WITH long AS (SELECT hash, doc, length(doc) AS len FROM content WHERE length(doc) > 3600),
once AS (SELECT DISTINCT * FROM content_vectors),
v AS (SELECT *, count(*) OVER (PARTITION BY hash) AS k, row_number() OVER (PARTITION BY hash ORDER BY seq, pos) - 1 AS i, lead(pos) OVER (PARTITION BY hash ORDER BY seq, pos) AS following FROM once),
p AS (SELECT l.hash, v.seq = v.i AND v.total_chunks = v.k AND (v.i > 0 OR v.pos = 0) AND (v.following IS NULL OR v.following > v.pos)
    AND CASE WHEN v.following IS NULL THEN l.len ELSE v.following + 540 END - v.pos BETWEEN 1 AND 3600
    AND CASE WHEN v.following IS NULL THEN l.len ELSE v.following + 540 END <= l.len
    AND (v.following IS NULL OR substr(l.doc, (v.following + 541)::BIGINT, 1) = chr(10) OR position(chr(10) IN substr(l.doc, (v.pos + 2801)::BIGINT, 801)) = 0) AS good
  FROM long l JOIN v ON v.hash = l.hash)
SELECT hash FROM long WHERE hash NOT IN (SELECT hash FROM p GROUP BY 1 HAVING bool_and(good))""",
}
