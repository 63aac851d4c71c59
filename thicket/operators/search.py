"""Ranked search over texts and vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.text import tokens, words
from thicket.session import cut


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): counted by row inside the JVM, so a common term costs one row a document."""
    terms = docs.select(key, F.explode(words(F.col(text))).alias("term"))
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the documents that hold any of the terms; statistics are of all documents.

    Only the query's terms are exploded; lengths come from the same pass. idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    wanted = sorted({t.lower() for t in terms})
    tokens = words(F.col(text))
    sized = docs.select(key, tokens.alias("w")).select(key, F.size("w").alias("len"), F.filter("w", lambda x: x.isin(*wanted)).alias("hits"))
    sized = cut(sized)
    n, average = sized.agg(F.count(F.lit(1)), F.avg("len")).collect()[0]
    tf = sized.select(key, "len", F.explode("hits").alias("term")).groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = cut(tf)
    df = dict(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect())  # one row a query term
    idf = {t: float(np.log(1 + (n - d + 0.5) / (d + 0.5))) for t, d in df.items()}
    if not idf:
        return tf.select(key, F.lit(0.0).alias("score")).limit(0)
    weight = F.create_map(*[x for t, v in idf.items() for x in (F.lit(t), F.lit(v))])[F.col("term")]
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(float(average))))
    return tf.groupBy(key).agg(F.sum(part).alias("score"))


def bm25_queries(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score, rank): for each row of `queries` the k documents that its distinct tokens score best by BM25, itself left out; ties at nine digits by key.

    Exact: statistics are of all documents. Queries' terms, with their document counts, go out in blocks of about BLOCK / 2 queries; each task scores its documents against
    a block where they lie and keeps its k best for each query, and only those are shuffled."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    none = F.array().cast("array<string>")
    sized = cut(docs.select(key, F.coalesce(tokens(F.col(text)), none).alias("w")).select(key, F.size("w").alias("len"), F.array_join("w", " ").alias("w")))
    n, average = sized.agg(F.count(F.lit(1)), F.avg("len")).collect()[0]
    asked = cut(queries.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")))
    counts = cut(sized.select(F.explode(F.array_distinct(F.split("w", " "))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    blocks = max(1, -(-asked.select("query_id").distinct().count() // (BLOCK // 2)))
    out = None
    for i in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).groupBy("term").agg(F.collect_list("query_id").alias("ids")).join(counts, "term").toPandas()
        if part.empty:
            continue
        idf = np.log(1 + (n - part["df"].to_numpy() + 0.5) / (part["df"].to_numpy() + 0.5))
        ids, places = np.unique(np.concatenate(part["ids"].tolist()), return_inverse=True)
        edges = np.cumsum([0, *map(len, part["ids"])])
        sent = spark.sparkContext.broadcast(({t: j for j, t in enumerate(part["term"])}, idf, ids, places.astype(np.int32), edges))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            at, idf, ids, places, edges = sent.value
            lists = [places[x:y] for x, y in zip(edges[:-1], edges[1:])]
            together = lambda held: _best(pd.DataFrame(dict(zip(("query_id", key, "score"), map(np.concatenate, zip(*held))))), key, k)
            held, rows = [], 0
            least = np.zeros(len(ids))  # what a document must score to be among the k best of a query so far
            for pdf in batches:
                for doc, size, w in zip(pdf[key].tolist(), pdf["len"].tolist(), pdf["w"].tolist()):
                    terms, tf = np.unique(np.array([j for j in map(at.get, w.split(" ")) if j is not None], np.int64), return_counts=True)
                    if not len(terms):
                        continue
                    weight = idf[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / average))
                    met = [lists[j] for j in terms]
                    score = np.bincount(np.concatenate(met), np.repeat(weight, [len(x) for x in met]), len(ids)).round(9)
                    good = np.flatnonzero((score > 0) & (score >= least) & (ids != doc))
                    if len(good):
                        held.append((ids[good], np.full(len(good), doc), score[good]))
                        rows += len(good)
                    if rows > 20 * k * len(ids):
                        best = together(held)
                        held, rows = [tuple(best[c].to_numpy() for c in best)], 0
                        full = best.groupby("query_id")["score"].agg(["size", "min"])
                        full = full[full["size"] >= k]
                        least[np.searchsorted(ids, full.index.to_numpy())] = full["min"].to_numpy()
            if held:
                yield together(held)

        found = sized.mapInPandas(run, f"query_id {kind}, `{key}` {kind}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranked(scores: DataFrame, key: str, limit: int, score: str = "score") -> DataFrame:
    """The best `limit` rows with rank from 1; ties by key. Sorted partly before it is gathered."""
    top = scores.orderBy(F.desc(score), key).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def fuse(lists: Sequence[tuple[DataFrame, float]], key: str, k: int = 60) -> DataFrame:
    """(key, score): reciprocal rank fusion of ranked lists (key, rank from 1) with weights; a first place anywhere adds 0.05, a second or third 0.02."""
    rows = None
    for ranking, weight in lists:
        part = ranking.select(key, "rank", F.lit(float(weight)).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    best = F.min("rank")
    bonus = F.when(best == 1, 0.05).when(best <= 3, 0.02).otherwise(0.0)
    return rows.groupBy(key).agg((F.sum(F.col("w") / (k + F.col("rank"))) + bonus).alias("score"))


#: Query vectors that are sent to the tasks at once.
BLOCK = 4_096


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): the k vectors nearest to each query by cosine, itself left out; ties by key.

    Exact: queries go out in blocks of BLOCK, each task keeps its k best for each query, and only those are shuffled. Vectors of another
    length than the query, null or without length match nothing."""
    spark = vectors.sparkSession
    ids = queries.select(F.col(key).alias("id"), vector).filter(F.col(vector).isNotNull())
    ids = cut(ids)
    n = ids.count()
    blocks = max(1, -(-n // (BLOCK // 2)))
    out = None
    kind = dict(vectors.dtypes)[key]
    for i in range(blocks):
        part = ids.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toPandas()
        if part.empty:
            continue
        sent = spark.sparkContext.broadcast((part["id"].to_numpy(), [np.asarray(v, np.float64) for v in part[vector]]))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            qid, qs = sent.value
            sizes = {len(q) for q in qs}
            held: list[pd.DataFrame] = []
            for pdf in batches:
                for size in sizes:
                    at = [j for j, q in enumerate(qs) if len(q) == size]
                    rows = pdf[[v is not None and len(v) == size for v in pdf[vector]]]
                    if rows.empty or not size:
                        continue
                    m, q = np.stack([np.asarray(v, np.float64) for v in rows[vector]]), np.stack([qs[j] for j in at])
                    with np.errstate(all="ignore"):
                        s = (q @ m.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(m, axis=1)[None]
                    ids_ = rows[key].to_numpy()
                    s = np.where((qid[at][:, None] == ids_[None]) | ~np.isfinite(s), -np.inf, s)
                    # All that score as much as the k-th, so that ties are settled by key.
                    least = np.sort(s, 1)[:, -min(k, s.shape[1])]
                    a, b = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                    held.append(pd.DataFrame({"query_id": qid[at][a], key: ids_[b], "score": s[a, b]}))
                if len(held) > 8:
                    held = [_best(pd.concat(held), key, k)]
            if held:
                yield _best(pd.concat(held), key, k)

        found = vectors.select(key, vector).mapInPandas(run, f"query_id {kind}, `{key}` {kind}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best(rows: pd.DataFrame, key: str, k: int) -> pd.DataFrame:
    rows = rows.sort_values(["query_id", "score", key], ascending=[True, False, True])
    return rows[rows.groupby("query_id").cumcount() < k]


def snippets(docs: DataFrame, key: str, text: str, terms: Sequence[str], before: int = 1, after: int = 2) -> DataFrame:
    """(key, line, hits, snippet): the line with the most distinct terms, the first of several, with lines around it; documents without any are left out."""
    lines = docs.select(key, F.split(F.col(text), "\n").alias("lines"))
    count = lambda line: sum((F.when(F.lower(line).contains(t.lower()), 1).otherwise(0) for t in terms[1:]), F.when(F.lower(line).contains(terms[0].lower()), 1).otherwise(0))
    scored = lines.withColumn("hits_by_line", F.transform("lines", count)).withColumn("hits", F.array_max("hits_by_line")).filter("hits > 0")
    at = F.array_position("hits_by_line", F.col("hits")).cast("int")
    low = F.greatest(at - before, F.lit(1))
    return scored.select(key, at.alias("line"), "hits", F.array_join(F.slice("lines", low, at + after - low + 1), "\n").alias("snippet"))


def likeness_score(name: Column, query: str) -> Column:
    """How well a name matches a query: 1.0 equal, 0.9 equal but for case, 0.8 a prefix, 0.7 contained, 0.5 contained in lower case, else 0."""
    n = F.lower(name)
    q = query.lower()
    return F.when(name == query, 1.0).when(n == q, 0.9).when(n.startswith(q), 0.8).when(name.contains(query), 0.7).when(n.contains(q), 0.5).otherwise(0.0)


def fuzzy(names: DataFrame, query: str, column: str = "name", most: int | None = None) -> DataFrame:
    """Rows whose name is within one (up to four characters) or two edits of the query, with `distance` and score 1 / (1 + distance)."""
    most = (1 if len(query) <= 4 else 2) if most is None else most
    d = F.levenshtein(F.lower(F.col(column)), F.lit(query.lower()), most)
    return names.withColumn("distance", d).filter("distance >= 0").withColumn("score", 1 / (1 + F.col("distance")))
