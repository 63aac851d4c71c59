"""Symbol search, page sections, symbol differences, traversals and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions import ranking as rk
from thicket.functions import text as tx
from thicket.operators import graph, hierarchy, search, sections, skew, symbols
from thicket.plans.registry import Registry
from thicket.session import cut, table
from thicket.sources import sinks

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
q = R.query
C = F.col


def N():
    return F.count(F.lit(1)).alias("n")


def t(name: str):
    return lambda s, d: table(s, d, name)


nodes, edges, files, docs, content, pieces, records, events = (t(x) for x in ("nodes", "edges", "files", "documents", "content", "content_vectors", "work_unit_records", "events"))
_TEST = r"(^|/)(tests?|__tests__|spec|specs|testdata|fixtures)/|(^|/)test_[^/]*$|[._-](test|spec)s?\.[A-Za-z0-9]+$|_test\.[A-Za-z0-9]+$|Tests?\.[A-Za-z0-9]+$"

# Checks and clean-up of queries and texts
q("flt03_terms", r"SELECT doc_id, lower(regexp_replace(title, '[^\p{L}\p{N}''_]', '', 'g')) AS term FROM documents")(lambda s, d: docs(s, d).select("doc_id", F.lower(F.regexp_replace("title", r"[^\p{L}\p{N}'_]", "")).alias("term")))
q("flt04_line_query_problems", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\r\n]') THEN 'several lines' WHEN (length(text) - length(replace(text, '"', ''))) % 2 = 1 THEN 'open quote' END AS problem FROM documents""")(
    lambda s, d: docs(s, d).select("doc_id", F.when(C("text").rlike("[\r\n]"), "several lines").when((F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))) % 2 == 1, "open quote").alias("problem"))
)
q("flt05_negated_queries", r"""SELECT doc_id, regexp_matches(text, '(^|\s)-[A-Za-z0-9_"]') AS negated FROM documents""")(lambda s, d: docs(s, d).select("doc_id", C("text").rlike(r'(^|\s)-[A-Za-z0-9_"]').alias("negated")))
q("flt06_spaced_scripts", r"SELECT doc_id, regexp_replace(text, '([\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}])', ' \1 ', 'g') AS text FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", F.regexp_replace("text", r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}])", " $1 ").alias("text"))
)
q("flt10_by_file_in_order", "SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS place FROM nodes")(
    lambda s, d: skew.ordered_totals(nodes(s, d).select("file_path", "id", "start_line"), ["file_path"], [C("start_line").asc_nulls_last(), C("id")]).select("file_path", "id", (C("before") + 1).alias("place"))
)
q("flt14_qualified_name_equality", "SELECT id, kind, qualified_name FROM nodes WHERE qualified_name IN ('queue.limit', 'session.EmberContext.cs')")(
    lambda s, d: nodes(s, d).filter(C("qualified_name").isin("queue.limit", "session.EmberContext.cs")).select("id", "kind", "qualified_name")
)
q("flt22_narrow_test_files", r"""SELECT path, regexp_matches(path, '(^|/)(test|tests|__tests__)(/|$)') OR contains(b, '.test.') OR contains(b, '.spec.') OR starts_with(m, 'test_') OR suffix(m, '_test') OR suffix(m, '-test') AS is_test
FROM (SELECT path, b, string_split(b, '.')[1] AS m FROM (SELECT path, lower(regexp_extract(path, '([^/]*)$', 1)) AS b FROM files))""")(lambda s, d: files(s, d).select("path", rk.narrow_test_path(C("path")).alias("is_test")))  # fmt: skip
q("flt31_alternates", r"""SELECT doc_id, array_to_string(p, ' / ') AS alternates FROM (SELECT doc_id, list_filter(list_transform(string_split(x, '|'), lambda y: trim(y)), lambda y: y <> '') AS p FROM (SELECT doc_id, collection || ' | ' || coalesce(source, '') || '|' || path AS x FROM documents) WHERE NOT contains(x, '||')) WHERE len(p) BETWEEN 2 AND 8""")(
    lambda s, d: docs(s, d).select("doc_id", F.concat("collection", F.lit(" | "), F.coalesce("source", F.lit("")), F.lit("|"), "path").alias("x")).filter(~C("x").contains("||"))
    .select("doc_id", F.filter(F.transform(F.split("x", r"\|"), lambda y: F.trim(y)), lambda y: y != "").alias("p")).filter(F.size("p").between(2, 8)).select("doc_id", F.array_join("p", " / ").alias("alternates"))
)
q("flt32_broadened", r"""SELECT doc_id, array_to_string(w[2:], ' ') AS broader, CASE WHEN len(w) >= 3 THEN array_to_string(w[1:2], ' ') END AS shorter FROM (SELECT doc_id, regexp_extract_all(title, '[^ \t\r\n]+') AS w FROM documents) WHERE len(w) >= 2""")(
    lambda s, d: docs(s, d).select("doc_id", F.regexp_extract_all("title", F.lit(r"[^ \t\r\n]+"), 0).alias("w")).filter(F.size("w") >= 2)
    .select("doc_id", F.array_join(F.slice("w", 2, F.size("w")), " ").alias("broader"), F.when(F.size("w") >= 3, F.array_join(F.slice("w", 1, 2), " ")).alias("shorter"))
)
_URL = "'https://reader:' || left(hash, 6) || '@host.example/' || path || '?page=2&api_token=' || hash || '&q=' || collection"
q("flt37_redacted_urls", rf"""SELECT doc_id, regexp_replace(regexp_replace(u, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\1'), '([?&][^=&#]*(?:token|key|secret|password|signature|auth)[^=&#]*=)[^&#]*', '\1[redacted]', 'gi') AS url FROM (SELECT doc_id, {_URL} AS u FROM documents)""")(
    lambda s, d: docs(s, d).select("doc_id", rk.redact_url(F.expr(_URL)).alias("url"))
)
q("flt42_identifiers", r"""SELECT word, count(*) AS n_texts FROM (SELECT DISTINCT hash, unnest(regexp_extract_all(regexp_replace(regexp_replace(doc, '"[^"\n]*"|''[^''\n]*''', ' ', 'g'), '//[^\n]*', ' ', 'g'), '[a-zA-Z_][a-zA-Z0-9_]*')) AS word FROM content) GROUP BY 1""")(
    lambda s, d: content(s, d).select("hash", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.regexp_replace("doc", "\"[^\"\n]*\"|'[^'\n]*'", " "), "//[^\n]*", " "), F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), 0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_texts"))
)

# Pages in the crawl's scope: same origin, included, not excluded
_LINK = r"SELECT doc_id, CASE WHEN starts_with(u, './') THEN 'https://docs.example/' || collection || substr(u, 2) WHEN starts_with(u, '/') THEN 'https://docs.example' || u ELSE u END AS url FROM (SELECT doc_id, collection, unnest(regexp_extract_all(text, '\]\(([^)\s]+)\)', 1)) AS u FROM documents)"
q("src30_crawl_scope", rf"""SELECT DISTINCT doc_id, url FROM ({_LINK}) WHERE starts_with(url, 'https://docs.example/') AND regexp_matches(substr(url, 21), '^/[^/]*/.*\.md$') AND NOT regexp_matches(substr(url, 21), '^/[^/]*/f[^/]*$')""")(
    lambda s, d: _in_scope(s, d)
)


def _in_scope(s: SparkSession, d: str, include: str = "/*/**.md", exclude: str = "/*/f*") -> DataFrame:
    link = docs(s, d).select("doc_id", "collection", F.explode(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), 1)).alias("u"))
    origin = "https://docs.example"
    url = F.when(C("u").startswith("./"), F.concat(F.lit(origin + "/"), "collection", F.substring("u", 2, 1 << 30))).when(C("u").startswith("/"), F.concat(F.lit(origin), "u")).otherwise(C("u"))
    return link.select("doc_id", url.alias("url")).filter(tx.in_scope(C("url"), origin, [include], [exclude])).distinct()


q("src36_script_shells", r"SELECT doc_id, NOT regexp_matches(text, '(?m)^#{1,6}[ \t]') AND length(text) < 2000 AS needs_script FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", (~C("text").rlike(r"(?m)^#{1,6}[ \t]") & (F.length("text") < 2000)).alias("needs_script"))
)

# Symbol scores
q("rk06_kind_bonuses", "SELECT id, CASE " + " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in rk.KIND_BONUS.items()) + " ELSE 0 END AS bonus FROM nodes")(lambda s, d: nodes(s, d).select("id", rk.kind_bonus(C("kind")).alias("bonus")))


def _name_sql(query: str) -> str:
    whole, words, parts = query.replace(" ", "").lower(), query.lower().split(), query.lower().split()
    return f"""CASE WHEN lower(name) = '{whole}' THEN 80 {f"WHEN lower(name) IN ({', '.join(f"'{w}'" for w in words)}) THEN 60" if len(words) > 1 else ""} WHEN starts_with(lower(name), '{whole}') THEN floor(10 + 30 * {len(whole)}.0::DOUBLE / length(name) + 0.5)::INTEGER
 {f"WHEN {' AND '.join(f"contains(lower(name), '{p}')" for p in parts)} THEN 15" if len(parts) > 1 else ""} WHEN contains(lower(name), '{whole}') THEN 10 ELSE 0 END"""


def _path_sql(query: str) -> str:
    of = lambda w: f"(CASE WHEN contains(regexp_extract(lower(file_path), '([^/]*)$', 1), '{w}') THEN 10 ELSE 0 END + CASE WHEN contains(CASE WHEN contains(file_path, '/') THEN regexp_replace(lower(file_path), '/[^/]*$', '') ELSE '.' END, '{w}') THEN 5 WHEN contains(lower(file_path), '{w}') THEN 3 ELSE 0 END)"
    return " + ".join(of(w) for w in query.lower().split()) + f" - CASE WHEN regexp_matches(file_path, '{_TEST}') THEN 15 ELSE 0 END"


_ASK = "cache load"
q("rk07_name_match_bonus", f"SELECT id, {_name_sql(_ASK)} AS bonus FROM nodes")(lambda s, d: nodes(s, d).select("id", rk.name_bonus(C("name"), _ASK).alias("bonus")))
q("rk08_path_relevance", f"SELECT id, {_path_sql(_ASK)} AS score FROM nodes")(lambda s, d: nodes(s, d).select("id", rk.path_relevance(C("file_path"), _ASK).alias("score")))
q("rk09_bounded_distance", "SELECT id, levenshtein(lower(name), 'ledger')::INTEGER AS distance FROM nodes WHERE levenshtein(lower(name), 'ledger') <= 2")(
    lambda s, d: nodes(s, d).select("id", F.levenshtein(F.lower("name"), F.lit("ledger"), 2).alias("distance")).filter("distance >= 0")
)
q("rk10_edit_distance", "SELECT id, levenshtein(name, qualified_name)::INTEGER AS distance FROM nodes WHERE qualified_name IS NOT NULL")(lambda s, d: nodes(s, d).filter("qualified_name is not null").select("id", F.levenshtein("name", "qualified_name").alias("distance")))


def _bm_sql(query: str) -> str:
    words, fields = query.lower().split(), symbols.WEIGHTS
    n = lambda f, w: f"len(list_filter(w_{f}, lambda x: starts_with(x, '{w}')))"
    score = " + ".join(f"CASE WHEN n{i} > 0 THEN greatest(ln((a.n - a.d{i} + 0.5) / (a.d{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / a.average)) ELSE 0 END" for i in range(len(words)))
    return f"""w AS (SELECT id, name, kind, file_path, {", ".join(f"regexp_extract_all(lower(coalesce({f}, '')), '[a-z0-9]+') AS w_{f}" for f in fields)} FROM nodes),
c AS (SELECT id, name, kind, file_path, {" + ".join(f"len(w_{f})" for f in fields)} AS len, {", ".join(f"{' + '.join(n(f, w) for f in fields)} AS n{i}, {' + '.join(f'{v} * {n(f, w)}' for f, v in fields.items())} AS t{i}" for i, w in enumerate(words))} FROM w),
a AS (SELECT count(*) AS n, avg(len) AS average, {", ".join(f"count(*) FILTER (n{i} > 0) AS d{i}" for i in range(len(words)))} FROM c),
f AS (SELECT id, name, kind, file_path, {score} AS score FROM c, a WHERE {" OR ".join(f"n{i} > 0" for i in range(len(words)))} ORDER BY round(score, 9) DESC, id LIMIT 100)"""


q("rk02_weighted_symbols", f"WITH {_bm_sql(_ASK)} SELECT id, round(score, 6) AS score FROM f")(lambda s, d: symbols.weighted_bm25(nodes(s, d), _ASK.split()).select("id", F.round("score", 6).alias("score")))
q("jn01_matches_with_nodes", f"WITH {_bm_sql(_ASK)} SELECT id, name, kind, file_path, round(score, 6) AS score FROM f")(
    lambda s, d: nodes(s, d).select("id", "name", "kind", "file_path").join(F.broadcast(symbols.weighted_bm25(nodes(s, d), _ASK.split())), "id").withColumn("score", F.round("score", 6))  # 100 rows at most
)
q("rk01_symbol_search", f"""WITH {_bm_sql(_ASK)}, b AS (SELECT id, max(score) AS base FROM (SELECT id, score FROM f UNION ALL SELECT id, (SELECT max(score) FROM f) FROM nodes WHERE lower(name) IN ('cache', 'load')) GROUP BY 1)
SELECT id, name, kind, file_path, round(score, 6) AS score FROM (SELECT id, name, kind, file_path, base + CASE {" ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in rk.KIND_BONUS.items())} ELSE 0 END + {_path_sql(_ASK)} + {_name_sql(_ASK)} AS score FROM nodes JOIN b USING (id)) ORDER BY round(score, 6) DESC, id LIMIT 20""")(
    lambda s, d: symbols.search(nodes(s, d), _ASK).withColumn("score", F.round("score", 6))
)
_STEM = r"lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'))"
q("rk32_base_name_boost", f"""SELECT path, CASE WHEN m = 'cache' THEN 500 WHEN starts_with(m, 'cache') AND substr(m, 6, 1) IN ('_', '.', '-') THEN 350 WHEN suffix(m, 'cache') THEN 250 WHEN contains(m, 'cache') THEN 180 WHEN lower(regexp_extract(path, '([^/]*)/[^/]*$', 1)) = 'cache' THEN 200 ELSE 0 END AS boost FROM (SELECT path, {_STEM} AS m FROM files)""")(
    lambda s, d: files(s, d).select("path", rk.base_name_boost(C("path"), "Cache").alias("boost"))
)
q("rk33_definition_boost", "SELECT id, CASE WHEN name = 'Cache' THEN 220 WHEN lower(name) = 'cache' THEN 180 WHEN starts_with(lower(name), 'cache') THEN 80 WHEN contains(lower(name), 'cache') THEN 40 ELSE 0 END AS boost FROM nodes")(
    lambda s, d: nodes(s, d).select("id", rk.definition_boost(C("name"), "Cache").alias("boost"))
)
q("rk39_no_code_penalty", r"""SELECT path, CASE WHEN e IN ('md', 'mdx', 'txt', 'rst') OR regexp_matches(path, '(^|/)docs?(/|$)') THEN 250 ELSE 0 END + CASE WHEN e IN ('md', 'txt', 'rst') AND regexp_matches(path, '(^|/)(examples?|samples?|templates?)(/|$)') THEN 80 ELSE 0 END
 + CASE WHEN contains(path, 'generated') THEN 150 ELSE 0 END AS penalty FROM (SELECT path, lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS e FROM (SELECT path FROM files UNION ALL SELECT path FROM documents))""")(
    lambda s, d: files(s, d).select("path").unionByName(docs(s, d).select("path")).select("path", rk.no_code_penalty(C("path")).alias("penalty"))
)
q("rk49_frecency_words", "SELECT path, CASE WHEN n >= 100 THEN 'hot' WHEN n >= 50 THEN 'warm' WHEN n >= 10 THEN 'frequent' END AS word FROM (SELECT file_path AS path, count(*) AS n FROM nodes GROUP BY 1)")(
    lambda s, d: nodes(s, d).groupBy(C("file_path").alias("path")).agg(N()).select("path", rk.frecency_word(C("n")).alias("word"))
)
_ROLE = "CASE source WHEN 'handbook' THEN 'current_authority' WHEN 'wiki' THEN 'operator_runbook' WHEN 'adr' THEN 'implementation_or_historical_plan' WHEN 'session' THEN 'generated_or_prompt' END"
q("rk56_role_priors", f"SELECT doc_id, CASE {_ROLE} WHEN 'current_authority' THEN 0.35 WHEN 'operator_runbook' THEN 0.10 WHEN 'implementation_or_historical_plan' THEN -0.35 WHEN 'generated_or_prompt' THEN -0.40 ELSE 0 END::DOUBLE AS prior FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", rk.role_prior(F.expr(_ROLE)).alias("prior"))
)
_CAP = lambda name, share, least, where: f"SELECT id, file_path FROM (SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY kind, id) AS r FROM nodes WHERE {where}) WHERE r <= (SELECT greatest({least}, floor(count(*) * {share} / (SELECT count(*) FROM files))) FROM nodes)"
q("rk51_diverse_by_file", _CAP("", 0.2, 5, "true"))(lambda s, d: _diverse(s, d, 0.2, 5, F.lit(True)))
q("rk52_other_than_production", _CAP("", 0.15, 3, f"regexp_matches(file_path, '{_TEST}')"))(lambda s, d: _diverse(s, d, 0.15, 3, tx.test_path(C("file_path"))))


def _diverse(s: SparkSession, d: str, share: float, least: int, where) -> DataFrame:
    """The first symbols of each file: as many as a share of the mean, `least` at least; a file's rank is had from range partitions, so large files are no one task's."""
    most = max(least, int(nodes(s, d).count() * share / files(s, d).count()))
    ranked = skew.ordered_totals(nodes(s, d).filter(where).select("id", "file_path", "kind"), ["file_path"], [C("kind"), C("id")])
    return ranked.filter(C("before") < most).select("id", "file_path")


# Ranked lists in one
_TERMS = ("gravity", "wave", "cache")
_BM = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), l AS (SELECT doc_id, len(w) AS len, w FROM w), a AS (SELECT count(*) AS n, avg(len) AS average FROM l),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest(w) AS term FROM l) WHERE term IN ('gravity', 'wave', 'cache') GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))) AS score FROM tf JOIN df USING (term), a GROUP BY 1),
a1 AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 50), a2 AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE active = 1 QUALIFY rank <= 50),
r AS (SELECT 'lex' AS list, 'original' AS query, rank, doc_id FROM a1 UNION ALL SELECT 'vec', 'expansion', rank, doc_id FROM a2)"""


def _lists(s: SparkSession, d: str) -> DataFrame:
    scores = search.bm25(docs(s, d), "doc_id", "text", _TERMS).withColumn("score", F.round("score", 9))
    a, b = search.ranked(scores, "doc_id", 50), search.ranked(docs(s, d).filter("active = 1").select("doc_id", C("n_chars").alias("score")), "doc_id", 50)
    of = lambda df, name, query: df.select(F.lit(name).alias("list"), F.lit(query).alias("query"), C("rank").cast("long").alias("rank"), "doc_id")
    return of(a, "lex", "original").unionByName(of(b, "vec", "expansion"))


def _weight():
    return F.when(C("query") == "original", 2.0).otherwise(1.0)


q("rk16_list_weights", _BM + " SELECT doc_id, list, CASE WHEN query = 'original' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM r")(lambda s, d: _lists(s, d).select("doc_id", "list", _weight().alias("weight")))
q("rk17_fusion_trace", _BM + """ SELECT doc_id, string_agg(list || ':' || rank, ',' ORDER BY list) AS trace, min(rank) AS top_rank, CASE WHEN min(rank) = 1 THEN 0.05 WHEN min(rank) <= 3 THEN 0.02 ELSE 0 END::DOUBLE AS bonus,
 round(sum(CASE WHEN query = 'original' THEN 2.0 ELSE 1.0 END / (60 + rank))::DOUBLE, 9) AS fused FROM r GROUP BY 1""")(
    lambda s, d: _lists(s, d).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat("list", F.lit(":"), "rank"))), ",").alias("trace"), F.min("rank").alias("top_rank"), F.round(F.sum(_weight() / (60 + C("rank"))), 9).alias("fused"))
    .withColumn("bonus", F.when(C("top_rank") == 1, 0.05).when(C("top_rank") <= 3, 0.02).otherwise(0.0))
)
_ORDER = "SELECT doc_id, row_number() OVER (ORDER BY round(sum(CASE WHEN query = 'original' THEN 2.0 ELSE 1.0 END / (60 + rank))::DOUBLE, 9) DESC, doc_id) AS place FROM r GROUP BY 1"


def _fused(s: SparkSession, d: str) -> DataFrame:
    sums = _lists(s, d).groupBy("doc_id").agg(F.round(F.sum(_weight() / (60 + C("rank"))), 9).alias("score"))
    return search.ranked(sums, "doc_id", 100).select("doc_id", C("rank").cast("long").alias("place"))  # two lists of 50


q("rk21_blended", _BM + f""" SELECT doc_id, round(CASE WHEN place <= 3 THEN 0.75 / place + 0.25 * x WHEN place <= 10 THEN 0.6 / place + 0.4 * x ELSE 0.4 / place + 0.6 * x END::DOUBLE, 9) AS score
FROM ({_ORDER}) JOIN (SELECT doc_id, 1 / (1 + ln(1 + n_chars))::DOUBLE AS x FROM documents) USING (doc_id)""")(
    lambda s, d: docs(s, d).select("doc_id", (1 / (1 + F.log(1 + C("n_chars")))).alias("x")).join(F.broadcast(_fused(s, d)), "doc_id").select("doc_id", F.round(rk.blended(C("place"), C("x")), 9).alias("score"))
)
q("rk48_resolved_alone", _BM + " SELECT query, list, count(*) = 1 OR max(score) FILTER (i = 1) > 2 * max(score) FILTER (i = 2) AS alone FROM (SELECT query, list, 1.0::DOUBLE / rank AS score, row_number() OVER (PARTITION BY query, list ORDER BY rank) AS i FROM r) GROUP BY 1, 2")(
    lambda s, d: _lists(s, d).filter("rank <= 2").groupBy("query", "list").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(C("rank") == 1, 1 / C("rank"))).alias("a"), F.max(F.when(C("rank") == 2, 1 / C("rank"))).alias("b")).select("query", "list", ((C("n") == 1) | (C("a") > 2 * C("b"))).alias("alone"))
)
_COS = "list_cosine_similarity({0}.embedding::DOUBLE[], b.embedding::DOUBLE[])"
q("rk14_best_of_variants", f"""SELECT query_id, vec_id, round(max(score), 6) AS score FROM (SELECT a.vec_id // 100 AS query_id, b.vec_id, {_COS.format("a")} AS score FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 100 IN (0, 1)) GROUP BY 1, 2 HAVING round(max(score), 6) >= 0.3""")(
    lambda s, d: _variants(s, d)
)


def _variants(s: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector is a query and the one after it a variant of it; a block of queries meets all rows where they lie, and only what scores 0.3 leaves."""
    import numpy as np
    import pandas as pd

    every = table(s, d, "embeddings")
    asked = every.filter("vec_id % 100 in (0, 1)").select("vec_id", "embedding").orderBy("vec_id")
    block, at, out = 4_096, 0, None
    n = asked.count()
    while at < n:
        rows = asked.offset(at).limit(block).collect()
        m = np.array([r.embedding for r in rows], np.float64)
        sent = s.sparkContext.broadcast((np.array([r.vec_id // 100 for r in rows]), m / np.linalg.norm(m, axis=1, keepdims=True)))

        def run(batches, sent=sent):
            ids, m = sent.value
            for pdf in batches:
                for vec, e in zip(pdf["vec_id"], pdf["embedding"]):
                    e = np.asarray(e, np.float64)
                    score = m @ (e / np.linalg.norm(e))
                    hit = np.flatnonzero(score >= 0.29)
                    yield pd.DataFrame({"query_id": ids[hit], "vec_id": vec, "score": score[hit]})

        part = every.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
        at += block
    out = s.createDataFrame([], "query_id long, vec_id long, score double") if out is None else out
    return out.groupBy("query_id", "vec_id").agg(F.round(F.max("score"), 6).alias("score")).filter("score >= 0.3")


# Chunks and page sections
q("sc15_break_points", r"""SELECT hash, len(regexp_extract_all(x, '\n')) AS n_lines, len(regexp_extract_all(x, '\n```')) AS n_fences, len(regexp_extract_all(x, '\n\n+')) AS n_blanks FROM (SELECT hash, doc AS x FROM content)""")(
    lambda s, d: content(s, d).select("hash", *[F.size(F.regexp_extract_all("doc", F.lit(p), 0)).cast("long").alias(n) for n, p in (("n_lines", "\n"), ("n_fences", "\n```"), ("n_blanks", "\n\n+"))])
)
q("sc18_chunks")(lambda s, d: sections.chunk_texts(content(s, d), "hash", "doc"))
q("sc18_chunks_cover", "SELECT hash, length(doc) AS n_chars, true AS whole FROM content")(lambda s, d: _cover(s, d))


def _cover(s: SparkSession, d: str) -> DataFrame:
    """Whether the chunks of every text, with what they share taken off, are its length and none is above the limit."""
    made = cut(sections.chunk_texts(content(s, d), "hash", "doc"))
    after = F.lead("pos").over(Window.partitionBy("hash").orderBy("seq"))
    each = made.withColumn("own", F.coalesce(after - C("pos"), C("n_chars").cast("long"))).groupBy("hash").agg(F.sum("own").alias("n_chars"), F.max("n_chars").alias("longest"), F.min("own").alias("least"))
    return content(s, d).select("hash", F.length("doc").alias("l")).join(each, "hash").select("hash", "n_chars", ((C("n_chars") == C("l")) & (C("longest") <= sections.CHUNK) & ((C("least") > 0) | (C("l") == 0))).alias("whole"))


q("sc21_units")(lambda s, d: sections.split_units(docs(s, d), "doc_id", "text").drop("body"))
q("sc24_heading_navigation", r"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE NOT regexp_matches(text, '(?m)^\s*(```|~~~)')) WHERE regexp_matches(line, '^#{1,3}\s+') GROUP BY 1""")(
    lambda s, d: docs(s, d).filter(~C("text").rlike(r"(?m)^\s*(```|~~~)")).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(C("line").rlike(r"^#{1,3}\s+")).groupBy("doc_id").agg(N())
)
_PAGE = "gravity wave of the shelf"
q("rk42_sections_of_all_pages")(lambda s, d: sections.score_units(cut(sections.split_units(docs(s, d), "doc_id", "text")), "doc_id", _PAGE).select("doc_id", "unit", "heading", F.round("score", 6).alias("score")))
q("rk41_sections_of_each_page")(lambda s, d: sections.best_units(cut(sections.split_units(docs(s, d), "doc_id", "text")), "doc_id", _PAGE).select("doc_id", "unit", "place", "stemmed", F.round("score", 6).alias("score")))
q("rk43_section_snippets")(
    lambda s, d: sections.best_lines(sections.best_units(cut(sections.split_units(docs(s, d), "doc_id", "text")), "doc_id", _PAGE), _PAGE).select("doc_id", "unit", "first_line", "last_line", "match_line", "context")
)
_UNITS = "u AS (SELECT doc_id, title AS heading, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+') AS h, regexp_extract_all(lower(text), '[a-z0-9]+') AS b, length(text) AS len FROM documents WHERE text IS NOT NULL)"
q("rk40_pages_as_units", f"""WITH {_UNITS}, c AS (SELECT doc_id, len, {", ".join(f"2.5 * len(list_filter(h, lambda x: x = '{w}')) + len(list_filter(b, lambda x: x = '{w}')) AS t{i}" for i, w in enumerate(("gravity", "wave", "shelf")))} FROM u),
a AS (SELECT count(*) AS n, avg(len) AS average, {", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(3))} FROM c)
SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, {" + ".join(f"ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * t{i} * 2.5 / (t{i} + 1.5 * (0.5 + 0.5 * greatest(len, 1) / average))" for i in range(3))} AS score FROM c, a) WHERE score > 0""")(
    lambda s, d: sections.score_units(docs(s, d).filter("text is not null").select("doc_id", F.lit(0).alias("unit"), F.coalesce("title", F.lit("")).alias("heading"), C("text").alias("body")), "doc_id", _PAGE).select("doc_id", F.round("score", 6).alias("score"))
)
q("rk44_best_lines", """WITH l AS (SELECT doc_id, line, n, contains(lower(line), 'gravity')::INTEGER + contains(lower(line), 'wave')::INTEGER + contains(lower(line), 'shelf')::INTEGER AS hits
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))
SELECT doc_id, arg_min(n, (-hits, n))::INTEGER AS match_line FROM l GROUP BY 1""")(
    lambda s, d: sections.best_lines(docs(s, d).filter("text is not null").select("doc_id", F.lit(1).alias("first_line"), C("text").alias("body")), _PAGE).select("doc_id", "match_line")
)

# Contexts of paths, from general to specific
_CTX = "ctx AS (SELECT collection, prefix, 'about ' || prefix AS context FROM (SELECT collection, '/' || string_split(path, '/')[2] || '/' AS prefix FROM documents WHERE doc_id % 7 = 0 UNION SELECT collection, '/' FROM documents WHERE source = 'handbook'))"
q("jn24_inherited_contexts", f"""WITH {_CTX} SELECT d.doc_id, 'everything' || coalesce(chr(10) || chr(10) || string_agg(c.context, chr(10) || chr(10) ORDER BY length(c.prefix)), '') AS context
FROM (SELECT doc_id, collection, '/' || array_to_string(string_split(path, '/')[2:], '/') AS rest FROM documents) d LEFT JOIN ctx c ON c.collection = d.collection AND starts_with(d.rest, c.prefix) GROUP BY 1""")(lambda s, d: _contexts(s, d))  # fmt: skip


def _contexts(s: SparkSession, d: str) -> DataFrame:
    """All contexts whose prefix a path has, joined by equality on the path's prefixes, with the global one first."""
    names = F.split("path", "/")
    folder = docs(s, d).filter("doc_id % 7 = 0").select("collection", F.concat(F.lit("/"), F.get(names, 1), F.lit("/")).alias("prefix")).filter("prefix is not null")
    contexts = cut(folder.union(docs(s, d).filter("source = 'handbook'").select("collection", F.lit("/"))).distinct().withColumn("context", F.concat(F.lit("about "), "prefix")))
    rest = docs(s, d).select("doc_id", "collection", F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))).alias("p"))
    # The prefixes that end with a slash, from "/" on.
    prefixes = F.transform(F.sequence(F.lit(0), F.greatest(F.size("p") - 1, F.lit(0))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), i), "/"), F.when(i > 0, "/").otherwise("")))
    asked = rest.select("doc_id", F.explode(F.array_distinct(prefixes)).alias("prefix"), "collection")
    keyed = lambda df: df.withColumn("key", F.concat_ws("\u0001", "collection", "prefix"))
    met = skew.lookup(keyed(asked).select("doc_id", "key"), cut(keyed(contexts).select("key", "prefix", "context")), "key", "inner")
    found = met.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.length("prefix").alias("n"), "context"))).alias("c"))
    out = docs(s, d).select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.array_join(F.concat(F.array(F.lit("everything")), F.coalesce(F.transform("c", lambda x: x["context"]), F.array().cast("array<string>"))), "\n\n").alias("context"))


q("ext28_paths_without_context", f"WITH {_CTX} SELECT DISTINCT collection, string_split(path, '/')[2] AS top FROM documents d WHERE len(string_split(path, '/')) > 2 AND NOT EXISTS (SELECT 1 FROM ctx c WHERE c.collection = d.collection AND c.prefix = '/' || string_split(d.path, '/')[2] || '/')")(
    lambda s, d: docs(s, d).filter(F.size(F.split("path", "/")) > 2).select("collection", F.get(F.split("path", "/"), 1).alias("top")).distinct()
    .join(docs(s, d).filter("doc_id % 7 = 0").select("collection", F.get(F.split("path", "/"), 1).alias("top")).distinct(), ["collection", "top"], "left_anti")
)

# Joins of the graph
q("jn11_incoming", "SELECT target AS id, source, kind, count(*) AS n FROM edges GROUP BY 1, 2, 3")(lambda s, d: edges(s, d).groupBy(C("target").alias("id"), "source", "kind").agg(N()))
q("jn20_projected_edges", "SELECT id FROM edges WHERE source IN (SELECT id FROM nodes WHERE language = 'go') AND target IN (SELECT id FROM nodes WHERE language = 'go')")(
    lambda s, d: graph.induced(edges(s, d), cut(nodes(s, d).filter("language = 'go'").select("id"))).select("id")
)
q("jn33_by_qualified_name", """WITH r AS (SELECT id AS ref_id, qualified_name AS x FROM nodes WHERE kind = 'import'), f AS (SELECT qualified_name AS x, min(id) AS id FROM nodes WHERE kind <> 'import' AND qualified_name IS NOT NULL GROUP BY 1)
SELECT ref_id, id, 0.95::DOUBLE AS confidence FROM r JOIN f USING (x)""")(
    lambda s, d: skew.lookup(nodes(s, d).filter("kind = 'import' and qualified_name is not null").select(C("id").alias("ref_id"), "qualified_name"), cut(nodes(s, d).filter("kind <> 'import'").groupBy("qualified_name").agg(F.min("id").alias("id"))), "qualified_name", "inner")
    .select("ref_id", "id", F.lit(0.95).alias("confidence"))
)
q("jn36_unique_in_any_case", """WITH f AS (SELECT lower(name) AS x, min(id) AS id, min(language) AS language FROM nodes WHERE kind <> 'import' GROUP BY 1 HAVING count(*) = 1)
SELECT r.id AS ref_id, f.id, CASE WHEN r.language = f.language THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM nodes r JOIN f ON f.x = lower(r.name) WHERE r.kind = 'import'""")(
    lambda s, d: skew.lookup(nodes(s, d).filter("kind = 'import'").select(C("id").alias("ref_id"), F.lower("name").alias("x"), C("language").alias("l")), cut(nodes(s, d).filter("kind <> 'import'").groupBy(F.lower("name").alias("x")).agg(N(), F.min("id").alias("id"), F.min("language").alias("language")).filter("n = 1").drop("n")), "x", "inner")
    .select("ref_id", "id", F.when(C("l") == C("language"), 0.5).otherwise(0.3).alias("confidence"))
)
q("jn51_interface_calls", """WITH m AS (SELECT DISTINCT e.source AS owner, n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'contains' AND n.kind = 'method'),
p AS (SELECT DISTINCT e.source AS type, e.target AS base FROM edges e JOIN nodes c ON c.id = e.source WHERE e.kind IN ('extends', 'implements') AND c.kind IN ('class', 'struct', 'union') AND e.source <> e.target),
x AS (SELECT p.type, p.base, b.id AS source, i.id AS target, row_number() OVER (PARTITION BY p.type, p.base ORDER BY b.id, i.id) AS place FROM p JOIN m i ON i.owner = p.type JOIN m b ON b.owner = p.base AND b.name = i.name WHERE b.id <> i.id)
SELECT DISTINCT source, target FROM x WHERE place <= 40""")(lambda s, d: symbols.interface_calls(nodes(s, d), edges(s, d)))  # fmt: skip
_OLD = "o AS (SELECT id, concat(file_path, '|', kind, '|', name) AS identity, kind, name, concat(signature, '#', docstring) AS hash, concat(kind, ':', end_line - start_line, ':', return_type) AS shape, signature, start_line AS place FROM nodes)"
_NEW = "n AS (SELECT id || '+' AS id, concat(file_path, '|', kind, '|', CASE WHEN start_line % 50 = 7 THEN name || '2' ELSE name END) AS identity, kind, CASE WHEN start_line % 50 = 7 THEN name || '2' ELSE name END AS name, concat(CASE WHEN start_line % 30 = 3 THEN 'new ' || coalesce(signature, '') ELSE signature END, '#', CASE WHEN start_line % 30 = 9 THEN 'x' ELSE docstring END) AS hash, concat(kind, ':', end_line - start_line, ':', return_type) AS shape, CASE WHEN start_line % 30 = 3 THEN 'new ' || coalesce(signature, '') ELSE signature END AS signature, start_line AS place FROM nodes WHERE start_line % 41 <> 5)"


def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    view = nodes(s, d)
    text = lambda *c: F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in c])
    lines = C("end_line") - C("start_line")
    shape = text(C("kind"), F.lit(":"), lines, F.lit(":"), C("return_type"))
    old = view.select("id", text(C("file_path"), F.lit("|"), C("kind"), F.lit("|"), C("name")).alias("identity"), "kind", "name", text(C("signature"), F.lit("#"), C("docstring")).alias("hash"), shape.alias("shape"), "signature", C("start_line").alias("place"))
    name = F.when(C("start_line") % 50 == 7, F.concat("name", F.lit("2"))).otherwise(C("name"))
    signature = F.when(C("start_line") % 30 == 3, F.concat(F.lit("new "), F.coalesce("signature", F.lit("")))).otherwise(C("signature"))
    doc = F.when(C("start_line") % 30 == 9, "x").otherwise(C("docstring"))
    new = view.filter("start_line % 41 <> 5").select(F.concat("id", F.lit("+")).alias("id"), text(C("file_path"), F.lit("|"), C("kind"), F.lit("|"), name).alias("identity"), "kind", name.alias("name"), text(signature, F.lit("#"), doc).alias("hash"), shape.alias("shape"), signature.alias("signature"), C("start_line").alias("place"))
    return cut(old), cut(new)


_PAIRS = """a AS (SELECT *, row_number() OVER (PARTITION BY identity, hash ORDER BY place, id) AS k FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY identity, hash ORDER BY place, id) AS k FROM n),
same AS (SELECT a.id AS old_id, b.id AS new_id FROM a JOIN b USING (identity, hash, k)),
ra AS (SELECT id, identity, row_number() OVER (PARTITION BY identity ORDER BY place, id) AS k FROM o WHERE id NOT IN (SELECT old_id FROM same)), rb AS (SELECT id, identity, row_number() OVER (PARTITION BY identity ORDER BY place, id) AS k FROM n WHERE id NOT IN (SELECT new_id FROM same)),
pairs AS (SELECT * FROM same UNION ALL SELECT ra.id, rb.id FROM ra JOIN rb USING (identity, k))"""
q("jn29_paired_overloads", f"WITH {_OLD}, {_NEW}, {_PAIRS} SELECT old_id, new_id FROM pairs")(lambda s, d: symbols.pair_overloads(*_versions(s, d)))
q("jn28_symbol_diff", f"""WITH {_OLD}, {_NEW}, {_PAIRS}, lo AS (SELECT * FROM o WHERE id NOT IN (SELECT old_id FROM pairs)), ln AS (SELECT * FROM n WHERE id NOT IN (SELECT new_id FROM pairs)),
sh AS (SELECT * FROM (SELECT kind, shape, count(*) AS co, min(id) AS old_id, min(name) AS o_name FROM lo GROUP BY 1, 2) JOIN (SELECT kind, shape, count(*) AS cn, min(id) AS new_id, min(name) AS n_name FROM ln GROUP BY 1, 2) USING (kind, shape))
SELECT CASE WHEN o.hash = n.hash THEN 'unchanged' WHEN o.signature IS DISTINCT FROM n.signature THEN 'signature' ELSE 'body' END AS change, old_id, new_id, 'exact' AS how FROM pairs JOIN o ON o.id = old_id JOIN n ON n.id = new_id
UNION ALL SELECT CASE WHEN o_name = n_name THEN 'moved' ELSE 'renamed' END, old_id, new_id, 'structural' FROM sh WHERE co = 1 AND cn = 1
UNION ALL SELECT 'deleted', id, NULL, CASE WHEN EXISTS (SELECT 1 FROM sh WHERE sh.kind = lo.kind AND sh.shape = lo.shape AND (co > 1 OR cn > 1)) THEN 'ambiguous' ELSE 'exact' END FROM lo WHERE id NOT IN (SELECT old_id FROM sh WHERE co = 1 AND cn = 1)
UNION ALL SELECT 'added', NULL, id, CASE WHEN EXISTS (SELECT 1 FROM sh WHERE sh.kind = ln.kind AND sh.shape = ln.shape AND (co > 1 OR cn > 1)) THEN 'ambiguous' ELSE 'exact' END FROM ln WHERE id NOT IN (SELECT new_id FROM sh WHERE co = 1 AND cn = 1)""")(
    lambda s, d: symbols.symbol_diff(*_versions(s, d))
)

# Traversals
_MOST = "(SELECT source AS id FROM edges WHERE kind = 'calls' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _busiest(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d).filter("kind = 'calls'").groupBy(C("source").alias("id")).agg(N()).orderBy(F.desc("n"), "id").limit(1).select("id")


_CALLS = "p AS (SELECT DISTINCT source AS a, target AS b FROM edges WHERE kind = 'calls')"
q("gr02_depth_first_set", f"WITH RECURSIVE {_CALLS}, r(id) AS (SELECT id FROM {_MOST} UNION SELECT p.b FROM r JOIN p ON p.a = r.id) SELECT id FROM r")(lambda s, d: graph.reach(graph.adjacency(edges(s, d), ("calls",)), _busiest(s, d)).select("id"))
q("gr05_call_graph", f"""WITH RECURSIVE {_CALLS}, o(id, n) AS (SELECT id, 0 FROM {_MOST} UNION SELECT p.b, n + 1 FROM o JOIN p ON p.a = o.id WHERE n < 2), i(id, n) AS (SELECT id, 0 FROM {_MOST} UNION SELECT p.a, n + 1 FROM i JOIN p ON p.b = i.id WHERE n < 2) SELECT id FROM o UNION SELECT id FROM i""")(
    lambda s, d: graph.reach(graph.adjacency(edges(s, d), ("calls",)), _busiest(s, d), 2).select("id").union(graph.reach(graph.adjacency(edges(s, d), ("calls",), True), _busiest(s, d), 2).select("id")).distinct()
)
_DEEP = "(SELECT max(target) AS id FROM edges WHERE kind = 'contains')"
q("gr09_ancestors", f"WITH RECURSIVE r(id, depth) AS (SELECT id, 0 FROM {_DEEP} UNION SELECT e.source, depth + 1 FROM r JOIN edges e ON e.kind = 'contains' AND e.target = r.id WHERE depth < 60) SELECT id, min(depth)::INTEGER AS depth FROM r GROUP BY 1")(
    lambda s, d: graph.reach(graph.adjacency(edges(s, d), ("contains",), True), edges(s, d).filter("kind = 'contains'").agg(F.max("target").alias("id")), 60)
)
q("gr10_children", "SELECT DISTINCT e.source AS id, n.id AS child_id, n.kind, n.name FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'contains'")(
    lambda s, d: edges(s, d).filter("kind = 'contains'").select(C("source").alias("id"), C("target").alias("child_id")).distinct().join(nodes(s, d).select(C("id").alias("child_id"), "kind", "name"), "child_id").select("id", "child_id", "kind", "name")
)
q("gr12_node_contexts", """WITH o AS (SELECT source AS id, count(*) FILTER (kind = 'contains') AS n_children, count(*) FILTER (kind IN ('type_of', 'returns')) AS n_types, count(*) FILTER (kind = 'imports') AS n_imports, count(*) FILTER (kind NOT IN ('contains', 'type_of', 'returns', 'imports')) AS n_outgoing FROM edges GROUP BY 1),
i AS (SELECT target AS id, count(*) FILTER (kind <> 'contains') AS n_incoming, min(source) FILTER (kind = 'contains') AS parent_id FROM edges GROUP BY 1)
SELECT n.id, parent_id, coalesce(n_children, 0) AS n_children, coalesce(n_types, 0) AS n_types, coalesce(n_imports, 0) AS n_imports, coalesce(n_outgoing, 0) AS n_outgoing, coalesce(n_incoming, 0) AS n_incoming FROM nodes n LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")(lambda s, d: _node_contexts(s, d))  # fmt: skip


def _node_contexts(s: SparkSession, d: str) -> DataFrame:
    k, e = C("kind"), edges(s, d)
    out = e.groupBy(C("source").alias("id")).agg(F.count_if(k == "contains").alias("n_children"), F.count_if(k.isin("type_of", "returns")).alias("n_types"), F.count_if(k == "imports").alias("n_imports"), F.count_if(~k.isin("contains", "type_of", "returns", "imports")).alias("n_outgoing"))
    into = e.groupBy(C("target").alias("id")).agg(F.count_if(k != "contains").alias("n_incoming"), F.min(F.when(k == "contains", C("source"))).alias("parent_id"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes(s, d).select("id").join(out, "id", "left").join(into, "id", "left").select("id", "parent_id", *[z(c) for c in ("n_children", "n_types", "n_imports", "n_outgoing", "n_incoming")])


q("gr14_circular_dependencies", """WITH RECURSIVE l AS (SELECT DISTINCT a.file_path AS a, b.file_path AS b FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.kind = 'imports' AND a.file_path <> b.file_path),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b) SELECT min(q.b) AS cycle_id, r.a AS node_id FROM r JOIN r q ON q.a = r.a AND EXISTS (SELECT 1 FROM r z WHERE z.a = q.b AND z.b = r.a) WHERE r.a = r.b GROUP BY r.a""")(
    lambda s, d: hierarchy.found_cycles(graph.file_links(nodes(s, d), edges(s, d).filter("kind = 'imports'")), "from_file", "to_file")
)

# Totals of sessions, tokens and lines
q("agg14_index_health", """SELECT (SELECT count(DISTINCT hash) FROM documents WHERE active = 1 AND hash NOT IN (SELECT hash FROM content_vectors)) AS needs_embedding, count(*) AS total_docs, floor((epoch_us(TIMESTAMP '2026-12-01') - max(epoch_us(modified_at))) / 86400000000)::BIGINT AS days_stale FROM documents WHERE active = 1""")(
    lambda s, d: docs(s, d).filter("active = 1").select("hash", "modified_at").join(pieces(s, d).select("hash", F.lit(1).alias("p")).distinct(), "hash", "left")
    .agg(F.countDistinct(F.when(C("p").isNull(), C("hash"))).alias("needs_embedding"), N().alias("total_docs"), F.floor((F.unix_micros(F.lit("2026-12-01 00:00:00").cast("timestamp")) - F.max(F.unix_micros(C("modified_at").cast("timestamp")))) / 86_400_000_000).cast("long").alias("days_stale"))
)
_LAST = "c AS (SELECT user_id, max((ts, event_id)) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1), x AS (SELECT e.*, c.last FROM events e LEFT JOIN c USING (user_id) WHERE c.last IS NULL OR (e.ts, e.event_id) > c.last)"
q("agg27_since_last_compaction", f"WITH {_LAST} SELECT user_id, sum(ceil(length(props) / 4))::BIGINT AS raw_tokens, count(*) FILTER (event_type = 'click') AS tool_calls FROM x GROUP BY 1")(
    lambda s, d: _since(s, d).groupBy("user_id").agg(F.sum(tx.tokens_about(C("props"))).alias("raw_tokens"), F.count_if(C("event_type") == "click").alias("tool_calls"))
)


def _since(s: SparkSession, d: str) -> DataFrame:
    """The entries of each user after the last compaction, or all without one."""
    at = F.struct("ts", "event_id")
    last = events(s, d).filter("event_type = 'purchase'").groupBy("user_id").agg(F.max(at).alias("last"))
    return skew.lookup(events(s, d), last, "user_id").filter(C("last").isNull() | (at > C("last")))


q("agg29_latest_bucket", f"WITH {_LAST} SELECT user_id, coalesce(max(json_extract_string(props, '$.k')::BIGINT) FILTER (event_type = 'view'), 0) AS bucket FROM x GROUP BY 1")(
    lambda s, d: _since(s, d).groupBy("user_id").agg(F.coalesce(F.max(F.when(C("event_type") == "view", F.get_json_object("props", "$.k").cast("long"))), F.lit(0)).alias("bucket"))
)
q("agg28_buckets_of_tokens", "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN t < 50000 THEN 0 ELSE 1 + floor((t - 50000) / 30000) END::BIGINT AS bucket FROM (SELECT collection, sum(ceil(length(text) / 4)) AS t FROM documents GROUP BY 1)) GROUP BY 1")(
    lambda s, d: docs(s, d).groupBy("collection").agg(F.sum(tx.tokens_about(C("text"))).alias("t")).groupBy(rk.token_bucket(C("t")).alias("bucket")).agg(N())
)
q("agg34_output_lines", r"SELECT hash, len(regexp_extract_all(doc, '\r\n|\r|\n')) + CASE WHEN doc <> '' AND NOT regexp_matches(doc, '[\r\n]$') THEN 1 ELSE 0 END AS n_lines FROM content")(
    lambda s, d: content(s, d).select("hash", (F.size(F.regexp_extract_all("doc", F.lit("\r\n|\r|\n"), 0)) + F.when((C("doc") != "") & ~C("doc").rlike(r"[\r\n]\z"), 1).otherwise(0)).cast("long").alias("n_lines"))
)

# Scalar functions
q("sc02_plain_words", "SELECT doc_id, lower(strip_accents(title)) AS words FROM documents WHERE title IS NOT NULL")(lambda s, d: docs(s, d).filter("title is not null").select("doc_id", tx.plain(C("title")).alias("words")))
q("sc04_plural_variants", r"""SELECT s AS word, array_to_string(CASE WHEN regexp_matches(s, '(x|sh|ss|zz)es$') THEN list_filter([s, CASE WHEN length(s) >= 5 THEN left(s, -2) END], lambda x: x IS NOT NULL) WHEN regexp_matches(s, '(ch|s|z|o)es$') THEN list_filter([s, CASE WHEN length(s) >= 5 THEN left(s, -2) END, CASE WHEN length(s) >= 4 THEN left(s, -1) END], lambda x: x IS NOT NULL)
 WHEN regexp_matches(s, 's$') AND NOT regexp_matches(s, 'ss$') THEN list_filter([s, CASE WHEN length(s) >= 4 THEN left(s, -1) END], lambda x: x IS NOT NULL) ELSE [s] END, ' ') AS variants FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(name), '[a-z]+')) AS s FROM nodes)""")(
    lambda s, d: nodes(s, d).select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit("[a-z]+"), 0)).alias("word")).distinct().select("word", F.array_join(tx.plural_variants(C("word")), " ").alias("variants"))
)
q("sc23_excerpts", r"""SELECT doc_id, CASE WHEN length(x) <= 120 THEN x ELSE regexp_replace(CASE WHEN contains(h, ' ') AND length(h) - position(' ' IN reverse(h)) > 72 THEN left(h, length(h) - position(' ' IN reverse(h))) ELSE h END, '\s+$', '') || ' …' END AS excerpt FROM (SELECT doc_id, x, left(x, 120) AS h FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM documents))""")(
    lambda s, d: docs(s, d).select("doc_id", rk.excerpt(C("text"), 120).alias("excerpt"))
)
q("sc27_numbered_lines", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || ': ' || x), chr(10)) AS text FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n").alias("text"))
)
q("sc30_snippet_headers", "SELECT id, '@@ -' || start_line || ',' || n || ' @@ (' || (start_line - 1) || ' before, ' || (2000 - (start_line + n - 1)) || ' after)' AS header FROM (SELECT id, start_line, end_line - start_line + 1 AS n FROM nodes)")(
    lambda s, d: nodes(s, d).withColumn("n", C("end_line") - C("start_line") + 1).select("id", F.concat(F.lit("@@ -"), "start_line", F.lit(","), "n", F.lit(" @@ ("), C("start_line") - 1, F.lit(" before, "), 2000 - (C("start_line") + C("n") - 1), F.lit(" after)")).alias("header"))
)
q("sc32_prompts_of_documents", "SELECT doc_id, 'title: ' || CASE WHEN coalesce(title, '') = '' THEN 'none' ELSE title END || ' | text: ' || text AS prompt FROM documents")(
    lambda s, d: docs(s, d).select("doc_id", F.concat(F.lit("title: "), F.when(F.coalesce("title", F.lit("")) == "", "none").otherwise(C("title")), F.lit(" | text: "), "text").alias("prompt"))
)
q("sc34_dice_of_names")(lambda s, d: nodes(s, d).filter("qualified_name is not null").select("id", F.round(rk.multiset_dice(C("name"), C("qualified_name")), 6).alias("score")))
q("sc38_logical_lines", r"SELECT hash, CASE WHEN doc = '' THEN 0 ELSE len(string_split(doc, chr(10))) - CASE WHEN suffix(doc, chr(10)) THEN 1 ELSE 0 END END AS n_lines, suffix(doc, chr(10)) AS ends_with_feed FROM content")(
    lambda s, d: content(s, d).select("hash", F.when(C("doc") == "", 0).otherwise(F.size(F.split("doc", "\n")) - F.when(C("doc").endswith("\n"), 1).otherwise(0)).cast("long").alias("n_lines"), C("doc").endswith("\n").alias("ends_with_feed"))
)
q("sc40_valid_vectors", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) < 0.001 AS valid FROM embeddings")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", ((F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.abs(F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)) - 1) < 0.001)).alias("valid"))
)
q("sc45_deltas", "SELECT subsystem, CASE WHEN a = 0 THEN '—' ELSE CASE WHEN x > 0 THEN '+' ELSE '' END || round(x)::BIGINT || '%' END AS delta FROM (SELECT subsystem, a, (b - a) / a * 100 AS x FROM (SELECT subsystem, sum(rssstartbytes)::DOUBLE AS a, sum(rssendbytes)::DOUBLE AS b FROM work_unit_records GROUP BY 1))")(
    lambda s, d: records(s, d).groupBy("subsystem").agg(F.sum("rssstartbytes").cast("double").alias("a"), F.sum("rssendbytes").cast("double").alias("b")).withColumn("x", (C("b") - C("a")) / C("a") * 100)
    .select("subsystem", F.when(C("a") == 0, "—").otherwise(F.concat(F.when(C("x") > 0, "+").otherwise(""), F.round("x").cast("long").cast("string"), F.lit("%"))).alias("delta"))
)

# Formats
q("snk03_xml_files", r"""SELECT '<file docid="#' || left(hash, 6) || '" name="' || x(path) || '"' || CASE WHEN coalesce(title, '') = '' THEN '' ELSE ' title="' || x(title) || '"' END || '>' || chr(10) || x(text) || chr(10) || '</file>' AS line FROM documents""")(
    lambda s, d: sinks.as_xml(docs(s, d), F.substring("hash", 1, 6), "path", "title", "text")
)
_X = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
for _c in ("path", "title", "text"):
    ORACLE["snk03_xml_files"] = ORACLE["snk03_xml_files"].replace(f"x({_c})", _X.format(_c))
q("snk05_file_lines", """SELECT '#' || left(hash, 6) || ',' || printf('%.2f', n_chars / 4.0) || ',' || path || CASE WHEN title IS NULL THEN '' ELSE ',"' || replace(title, '"', '""') || '"' END AS line FROM documents""")(
    lambda s, d: docs(s, d).select(F.concat(F.lit("#"), F.substring("hash", 1, 6), F.lit(","), F.format_string("%.2f", C("n_chars") / 4.0), F.lit(","), "path", F.when(C("title").isNull(), "").otherwise(F.concat(F.lit(',"'), F.replace("title", F.lit('"'), F.lit('""')), F.lit('"')))).alias("line"))
)

# Addresses
_HUB = "'https://github.com/' || collection || '/' || coalesce(source, 'main') || CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '/blob/v1/' || path ELSE '/tree/main' END"
q("src34_repository_urls", rf"""SELECT doc_id, regexp_extract(u, '{{p}}', 1) AS owner, regexp_extract(u, '{{p}}', 2) AS repo, regexp_extract(u, '{{p}}', 3) AS view, regexp_extract(u, '{{p}}', 4) AS ref, regexp_extract(u, '{{p}}', 5) AS path FROM (SELECT doc_id, {_HUB} AS u FROM documents)""".replace("{p}", r"^https?://(?:www\.)?github\.com/([^/]+)/([^/#?]+)(?:/(blob|tree)/([^/]+)(?:/(.*))?)?$"))(
    lambda s, d: docs(s, d).select("doc_id", F.expr(_HUB).alias("u")).select("doc_id", *[F.regexp_extract("u", r"^https?://(?:www\.)?github\.com/([^/]+)/([^/#?]+)(?:/(blob|tree)/([^/]+)(?:/(.*))?)?$", i).alias(n) for i, n in enumerate(("owner", "repo", "view", "ref", "path"), 1)])
)
_TUBE = "CASE doc_id % 4 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || left(hash, 11) || '&t=4' WHEN 1 THEN 'https://youtu.be/' || left(hash, 11) WHEN 2 THEN 'https://youtube.com/shorts/' || left(hash, 11) ELSE 'https://example.com/watch?v=' || left(hash, 11) END"
_TUBE_ID = r"^https?://(?:(?:www|m)\.)?(?:youtu\.be/|youtube\.com/(?:watch\?(?:[^#]*&)?v=|shorts/|embed/|live/))([A-Za-z0-9_-]{11})"
q("src35_video_ids", f"SELECT doc_id, regexp_extract(u, '{_TUBE_ID}', 1) AS video_id FROM (SELECT doc_id, {_TUBE} AS u FROM documents)")(lambda s, d: docs(s, d).select("doc_id", F.regexp_extract(F.expr(_TUBE), _TUBE_ID, 1).alias("video_id")))

# Filters on symbols and files
q("flt17_decorated_like", "SELECT id, decorators FROM nodes WHERE decorators LIKE '%\"%a%\"%'")(lambda s, d: nodes(s, d).filter(C("decorators").like('%"%a%"%')).select("id", "decorators"))
_EIGHT = ("function", "method", "class", "interface", "struct", "enum", "type_alias", "module")
q("flt18_qualified_globs", f"SELECT id, qualified_name FROM nodes WHERE kind IN {_EIGHT} AND regexp_matches(qualified_name, '^[^/]*cache[^/]*$')")(lambda s, d: nodes(s, d).filter(C("kind").isin(*_EIGHT) & C("qualified_name").rlike(tx.glob_regex("*cache*"))).select("id", "qualified_name"))
q("flt25_ambient_files", """WITH f AS (SELECT file_path FROM nodes WHERE kind NOT IN ('file', 'import') GROUP BY 1 HAVING bool_and(kind IN ('interface', 'type_alias', 'enum', 'namespace', 'module'))),
o AS (SELECT DISTINCT n.file_path FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind = 'calls') SELECT file_path FROM f WHERE file_path NOT IN (SELECT file_path FROM o)""")(
    lambda s, d: nodes(s, d).filter("kind not in ('file', 'import')").groupBy("file_path").agg(F.bool_and(C("kind").isin("interface", "type_alias", "enum", "namespace", "module")).alias("types")).filter("types").select("file_path")
    .join(edges(s, d).filter("kind = 'calls'").select(C("source").alias("id")).distinct().join(nodes(s, d).select("id", "file_path"), "id"), "file_path", "left_anti")
)

# Imports, siblings and touched signatures
q("jn44_definitions_for_imports", """WITH f AS (SELECT name, language, min(id) AS def_id FROM nodes WHERE kind NOT IN ('import', 'file') GROUP BY 1, 2) SELECT n.id, coalesce(f.def_id, n.id) AS shown_id FROM nodes n LEFT JOIN f ON n.kind = 'import' AND f.name = n.name AND f.language = n.language""")(
    lambda s, d: _for_imports(s, d)
)


def _for_imports(s: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("\u0001", "language", "name")
    found = nodes(s, d).filter("kind not in ('import', 'file') and name is not null").groupBy(key.alias("key")).agg(F.min("id").alias("def_id"))
    asked = nodes(s, d).select("id", F.when((C("kind") == "import") & C("name").isNotNull(), key).alias("key"))
    return skew.lookup(asked, found, "key").select("id", F.coalesce("def_id", "id").alias("shown_id"))


q("jn45_siblings_within", """SELECT DISTINCT e.source AS id, e.target AS sibling_id FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.kind IN ('calls', 'references') AND a.file_path = b.file_path AND e.source <> e.target""")(
    lambda s, d: _both_ends(s, d, edges(s, d).filter("kind in ('calls', 'references') and source <> target")).filter("a = b").select(C("source").alias("id"), C("target").alias("sibling_id"))
)


def _both_ends(s: SparkSession, d: str, e: DataFrame) -> DataFrame:
    """Distinct (source, target) with the files a and b of both ends, joined one end at a time."""
    where = nodes(s, d).select("id", "file_path").dropDuplicates(["id"])
    one = skew.lookup(cut(e.select("source", "target").distinct()), where.select(C("id").alias("source"), C("file_path").alias("a")), "source", "inner")
    return skew.lookup(cut(one), where.select(C("id").alias("target"), C("file_path").alias("b")), "target", "inner")


q("gr21_blast_radius", """WITH t AS (SELECT id, file_path FROM nodes WHERE signature IS NOT NULL AND start_line % 30 = 3) SELECT t.id, count(DISTINCT e.source) AS n_callers, count(DISTINCT n.file_path) AS n_files FROM t JOIN edges e ON e.target = t.id AND e.kind = 'calls' JOIN nodes n ON n.id = e.source WHERE n.file_path <> t.file_path GROUP BY 1""")(
    lambda s, d: _both_ends(s, d, edges(s, d).filter("kind = 'calls'").join(nodes(s, d).filter("signature is not null and start_line % 30 = 3").select(C("id").alias("target")), "target", "left_semi"))
    .filter("a <> b").groupBy(C("target").alias("id"), "a").agg(N()).groupBy("id").agg(F.sum("n").alias("n_callers"), F.count(F.lit(1)).alias("n_files"))
)
q("agg10_module_structure", r"SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory, string_agg(regexp_extract(path, '([^/]*)$', 1), ',' ORDER BY path) AS names FROM files GROUP BY 1")(
    lambda s, d: files(s, d).groupBy(tx.directory(C("path")).alias("directory")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("path")), tx.base_name), ",").alias("names"))
)
q("rk29_dot_products", """SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 5""")(
    lambda s, d: search.nearest(table(s, d, "embeddings"), table(s, d, "embeddings").filter("vec_id % 100 = 0"), 5).select("query_id", "vec_id", F.round("score", 6).alias("score"))
)
q("rk58_following_page", "SELECT name FROM (SELECT DISTINCT name FROM nodes) WHERE name > 'harbor' ORDER BY name LIMIT 50")(lambda s, d: nodes(s, d).filter(C("name") > "harbor").select("name").distinct().orderBy("name").limit(50))
q("set11_changed_content", "SELECT f.path FROM files f JOIN content c ON c.hash = f.content_hash WHERE sha256(c.doc) <> f.content_hash UNION ALL SELECT path FROM files WHERE content_hash NOT IN (SELECT hash FROM content)")(
    lambda s, d: files(s, d).select("path", C("content_hash").alias("hash")).join(content(s, d).select("hash", F.sha2("doc", 256).alias("now")), "hash", "left").filter("now is null or now <> hash").select("path")
)
q("set13_first_files_of_matches", "SELECT file_path, min(start_line) AS line FROM nodes WHERE contains(lower(name), 'cache') GROUP BY 1 ORDER BY line, file_path LIMIT 20")(
    lambda s, d: nodes(s, d).filter(F.lower("name").contains("cache")).groupBy("file_path").agg(F.min("start_line").alias("line")).orderBy("line", "file_path").limit(20)
)
q("sc12_stems")(lambda s, d: nodes(s, d).select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit("[a-z]+"), 0)).alias("word")).distinct().select("word", F.pandas_udf(lambda w: w.map(sections.stem), "string")("word").alias("stem")))
q("sc35_metadata_types", "SELECT id, CASE json_type(metadata, '$.confidence') WHEN 'DOUBLE' THEN 'number' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' END AS type FROM edges WHERE metadata IS NOT NULL AND json_valid(metadata)")(
    lambda s, d: edges(s, d).withColumn("v", F.try_parse_json("metadata")).filter("v is not null").select("id", F.schema_of_variant(F.try_variant_get("v", "$.confidence", "variant")).alias("x"))
    .select("id", F.when(C("x").startswith("DECIMAL") | C("x").isin("BIGINT", "DOUBLE"), "number").when(C("x") == "STRING", "string").when(C("x") == "BOOLEAN", "boolean").alias("type"))
)
q("sc37_matching_paths", r"SELECT path, suffix(path, 'index.ts') OR suffix('index.ts', path) AS matches FROM (SELECT regexp_replace(lower(path), '^\.?/+', '') AS path FROM files)")(
    lambda s, d: files(s, d).select(F.regexp_replace(F.lower("path"), r"^\.?/+", "").alias("path")).select("path", (C("path").endswith("index.ts") | F.lit("index.ts").endswith(C("path"))).alias("matches"))
)
q("snk06_document_objects", "SELECT doc_id, title, collection, length(text) AS n_chars FROM documents")(
    lambda s, d: sinks.as_json(docs(s, d).select("doc_id", "title", "collection", F.length("text").alias("n_chars"))).select(F.from_json("line", "doc_id long, title string, collection string, n_chars long").alias("o")).select("o.*")
)
