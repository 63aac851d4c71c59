"""Symbols: weighted full-text search, differences of two versions, calls from interfaces to what implements them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions import ranking as rk
from thicket.functions import text as tx
from thicket.operators.skew import lookup
from thicket.session import cut

# Weights of the fields of a symbol.
WEIGHTS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}


def weighted_bm25(nodes: DataFrame, terms: Sequence[str], weights: dict[str, float] | None = None, limit: int = 20) -> DataFrame:
    """(id, score) of the symbols with words that begin with any of the terms, the best max(5 * limit, 100).

    Frequencies are weighted by field and lengths are of all fields, as in a full-text index with column weights: k1 = 1.2, b = 0.75, rarity of a term floored at 0.000001.
    Statistics cover all symbols. Null fields are empty; ties by id. Terms are parameters, so counts by term are columns and nothing is exploded."""
    weights = weights or WEIGHTS
    terms = [t.lower() for t in terms]
    base = nodes.select("id", *[tx.words(F.coalesce(F.col(f), F.lit(""))).alias(f"w_{f}") for f in weights])
    count = lambda f, t: F.size(F.filter(f"w_{f}", lambda w: w.startswith(t)))
    length = sum((F.size(f"w_{f}") for f in weights), F.lit(0))
    counted = cut(base.select("id", length.alias("len"), *[sum((count(f, t) for f in weights), F.lit(0)).alias(f"n{i}") for i, t in enumerate(terms)], *[sum((F.lit(w) * count(f, t) for f, w in weights.items()), F.lit(0.0)).alias(f"t{i}") for i, t in enumerate(terms)]))
    total = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("average"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    s = counted.join(F.broadcast(total))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)), F.lit(1e-6))
        score = score + F.when(F.col(f"n{i}") > 0, idf * F.col(f"t{i}") * 2.2 / (F.col(f"t{i}") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("average")))).otherwise(0.0)
    hit = s.filter(" or ".join(f"n{i} > 0" for i in range(len(terms))) if terms else "false")
    return hit.select("id", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(max(5 * limit, 100))


def search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, name, kind, file_path, score): symbols for a query, the best `limit`.

    Full-text search; if it finds nothing names with the query in them; if none, names at most two edits away. Symbols named as a word of the query are added at the
    highest score. To that come what the kind, the path and the name are worth; ties by id."""
    words = [w for w in query.split() if w]
    found = cut(weighted_bm25(nodes, words, limit=limit))
    if found.isEmpty():
        low = F.lower("name")
        tier = F.when(F.col("name") == query, 1.0).when(low == query.lower(), 0.9).when(low.startswith(query.lower()), 0.8).when(F.col("name").contains(query), 0.7).otherwise(0.5)
        found = cut(nodes.filter(low.contains(query.lower())).select("id", tier.alias("score")).orderBy(F.desc("score"), "id").limit(max(5 * limit, 100)))
    if found.isEmpty():
        most = 1 if len(query) <= 4 else 2
        d = F.levenshtein(F.lower("name"), F.lit(query.lower()), most)
        found = cut(nodes.select("id", d.alias("d")).filter("d >= 0").select("id", (1 / (1 + F.col("d"))).alias("score")).orderBy(F.desc("score"), "id").limit(max(5 * limit, 100)))
    top = found.agg(F.coalesce(F.max("score"), F.lit(1.0)).alias("top"))
    exact = nodes.filter(F.lower("name").isin([w.lower() for w in words])).select("id").join(F.broadcast(top)).select("id", F.col("top").alias("score"))
    base = found.unionByName(exact).groupBy("id").agg(F.max("score").alias("base"))
    met = nodes.select("id", "name", "kind", "file_path").join(base, "id")
    score = F.col("base") + rk.kind_bonus(F.col("kind")) + rk.path_relevance(F.col("file_path"), query) + rk.name_bonus(F.col("name"), query)
    return met.select("id", "name", "kind", "file_path", score.alias("score")).orderBy(F.desc(F.round("score", 6)), "id").limit(limit)


def interface_calls(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] = ("class", "struct", "union"), most: int = 40) -> DataFrame:
    """(source, target): from each method of a supertype to each method of the same name of a type that extends or implements it.

    Of one type and one supertype only the first `most` pairs count, by method ids; that is the feature's ceiling on what one pair may add."""
    methods = nodes.filter("kind = 'method'").select(F.col("id").alias("method"), "name")
    # Counted by owner and name first: a name that many types share never meets itself, as pairs of types come before it.
    holds = edges.filter("kind = 'contains'").select(F.col("source").alias("owner"), F.col("target").alias("method")).distinct()
    owned = cut(lookup(holds, methods, "method", "inner"))
    types = nodes.filter(F.col("kind").isin(*kinds)).select(F.col("id").alias("type"))
    sups = edges.filter("kind in ('extends', 'implements')").select(F.col("source").alias("type"), F.col("target").alias("base")).filter("type <> base").distinct().join(types, "type", "left_semi")
    mine = cut(sups.join(owned.select(F.col("owner").alias("type"), "name", F.col("method").alias("target")), "type"))
    pairs = mine.join(owned.select(F.col("owner").alias("base"), "name", F.col("method").alias("source")), ["base", "name"]).filter("source <> target")
    place = F.row_number().over(Window.partitionBy("type", "base").orderBy("source", "target"))
    return pairs.withColumn("place", place).filter(F.col("place") <= most).select("source", "target").distinct()


def pair_overloads(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id): symbols of one identity paired, those of equal content first, the rest in order of place.

    old, new: (id, identity, hash, place). The k-th symbol of an identity and content meets the k-th of the other version; what is left meets by place. Each is used once."""
    nth = lambda keys, out: F.row_number().over(Window.partitionBy(*keys).orderBy("place", "id")).alias(out)
    a = old.select(F.col("id").alias("old_id"), "identity", "hash", "place", nth(("identity", "hash"), "k"))
    b = new.select(F.col("id").alias("new_id"), "identity", "hash", "place", nth(("identity", "hash"), "k"))
    same = cut(a.join(b.drop("place"), ["identity", "hash", "k"]).select("old_id", "new_id"))
    left = lambda df, key: df.join(same.select(key), key, "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("identity").orderBy("place", key)))
    rest = left(a, "old_id").select("old_id", "identity", "k").join(left(b, "new_id").select("new_id", "identity", "k"), ["identity", "k"]).select("old_id", "new_id")
    return same.unionByName(rest)


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, old_id, new_id, how): what became of each symbol between two versions.

    old, new: (id, identity, kind, name, hash, shape, signature, place). Symbols of one identity are paired by content, then place: unchanged, signature or body. Of those left,
    ones whose shape exactly one old and one new symbol has are the same, moved or renamed. The rest are deleted or added; how says "ambiguous" where a
    shape had several of either, and "exact" elsewhere. Fuzzy pairs are a further step, on what is deleted and added."""
    pairs = cut(pair_overloads(old, new))
    o = old.select(F.col("id").alias("old_id"), F.col("hash").alias("oh"), F.col("signature").alias("os"), F.col("name").alias("on"), F.col("shape").alias("osh"), F.col("kind").alias("ok"))
    n = new.select(F.col("id").alias("new_id"), F.col("hash").alias("nh"), F.col("signature").alias("ns"), F.col("name").alias("nn"), F.col("shape").alias("nsh"), F.col("kind").alias("nk"))
    same = pairs.join(o, "old_id").join(n, "new_id")
    change = F.when(F.col("oh").eqNullSafe(F.col("nh")), "unchanged").when(~F.col("os").eqNullSafe(F.col("ns")), "signature").otherwise("body")
    out = same.select(change.alias("change"), "old_id", "new_id", F.lit("exact").alias("how"))
    left_o = cut(o.join(pairs.select("old_id"), "old_id", "left_anti"))
    left_n = cut(n.join(pairs.select("new_id"), "new_id", "left_anti"))
    by_shape = left_o.groupBy(F.col("ok").alias("kind"), F.col("osh").alias("shape")).agg(F.count(F.lit(1)).alias("co"), F.min("old_id").alias("old_id"), F.min("on").alias("on"))
    by_shape = by_shape.join(left_n.groupBy(F.col("nk").alias("kind"), F.col("nsh").alias("shape")).agg(F.count(F.lit(1)).alias("cn"), F.min("new_id").alias("new_id"), F.min("nn").alias("nn")), ["kind", "shape"])
    by_shape = cut(by_shape)
    moved = by_shape.filter("co = 1 and cn = 1").select(F.when(F.col("on") == F.col("nn"), "moved").otherwise("renamed").alias("change"), "old_id", "new_id", F.lit("structural").alias("how"))
    several = by_shape.filter("co > 1 or cn > 1").select("kind", "shape", F.lit("ambiguous").alias("how"))
    gone = left_o.join(moved.select("old_id"), "old_id", "left_anti").join(several.select(F.col("kind").alias("ok"), F.col("shape").alias("osh"), "how"), ["ok", "osh"], "left")
    come = left_n.join(moved.select("new_id"), "new_id", "left_anti").join(several.select(F.col("kind").alias("nk"), F.col("shape").alias("nsh"), "how"), ["nk", "nsh"], "left")
    null = F.lit(None).cast("string")
    out = out.unionByName(moved).unionByName(gone.select(F.lit("deleted").alias("change"), "old_id", null.alias("new_id"), F.coalesce("how", F.lit("exact")).alias("how")))
    return out.unionByName(come.select(F.lit("added").alias("change"), null.alias("old_id"), "new_id", F.coalesce("how", F.lit("exact")).alias("how")))
