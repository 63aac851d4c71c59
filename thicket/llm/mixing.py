"""One mixture of several sources by target shares of tokens, small sources repeated up to a cap."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.tokens import VOCABULARY, token_counts
from thicket.operators.skew import running_totals
from thicket.session import cut

#: Tokens of a block, about.
BLOCK = 8_192
#: Sources that mix_targets may name; they are settings, not data.
MAX_SOURCES = 10_000
GOLDEN = (math.sqrt(5) - 1) / 2


def quotas(shares: dict[str, float], there: dict[str, int], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Tokens of each source in a mixture of `total`: its share, or all that its repeats allow, what is missing being divided among the others by their shares."""
    most = {s: there.get(s, 0) * max(0, repeats[s]) for s in shares}
    out, open_, left = {}, {s for s in shares if shares[s] > 0}, float(total)
    while open_:
        weight = sum(shares[s] for s in open_)
        short = {s for s in open_ if most[s] <= left * shares[s] / weight}
        if not short:
            out |= {s: left * shares[s] / weight for s in open_}
            break
        # All shares are of the same rest, so the sources that fall short of it can be taken together.
        out |= {s: float(most[s]) for s in short}
        left -= sum(most[s] for s in short)
        open_ -= short
    return {s: out.get(s, 0.0) for s in shares}


def sized(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, list]:
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    named = documents.filter(F.col("source").isin([r.source for r in wanted]))
    return cut(token_counts(named, ["doc_id", "source"], "text", vocabulary)), sorted(wanted)


def mixture(documents: DataFrame, targets: DataFrame, block: int = BLOCK, total: int | None = None, vocabulary: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """(slot, place, source, epoch, doc_id, n_tokens): the mixture in order of slot and place; epoch counts a source's passes from 0.

    `total` tokens, by default as many as the sources' texts have. The texts of a source are shuffled by a hash and cut, whole, into blocks of equal
    tokens. Slot i goes to the source in whose part of the cumulative weights the i-th multiple of the golden ratio falls, modulo 1; the k-th slot of a source
    takes its k-th block, over again once all are used, and never more often than max_repeats allows. Sources that mix_targets lacks, null ones too, are left
    out; sources without texts get nothing and their share goes to the others. Repeated rows are texts of their own. Texts without tokens go with the block they fall in."""
    tokens, wanted = sized(documents, targets, vocabulary)
    spark = documents.sparkSession
    there = {r["source"]: r["t"] for r in tokens.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect() if r["t"]}
    total = sum(there.values()) if total is None else total
    shares = {r["source"]: float(r["target_share"] or 0) for r in wanted}
    repeats = {r["source"]: int(r["max_repeats"] or 0) for r in wanted}
    quota = {s: q for s, q in quotas(shares, there, repeats, total).items() if q > 0}
    empty = "slot long, place long, source string, epoch int, doc_id long, n_tokens long"
    if not quota:
        return spark.createDataFrame([], empty)
    blocks = {s: max(1, round(there[s] / block)) for s in quota}
    slots = {s: quota[s] / (there[s] / blocks[s]) for s in quota}
    most = {s: min(repeats[s] * blocks[s], max(1, round(slots[s]))) for s in quota}
    names = sorted(quota)
    n, edge, weights = round(sum(slots.values())) + 2 * len(names), 0.0, []
    for s in names:
        edge += slots[s] / sum(slots.values())
        weights.append(edge)
    u = F.col("id") * F.lit(GOLDEN) % F.lit(1.0)
    pick = F.when(u < weights[0], names[0])
    for s, e in zip(names[1:-1], weights[1:-1]):
        pick = pick.when(u < e, s)
    drawn = spark.range(n).select(F.col("id").alias("slot"), (pick.otherwise(names[-1]) if len(names) > 1 else F.lit(names[0])).alias("source"))
    ranked = running_totals(drawn, ["source"], ["slot"], None, "k", rows=n, bucket=F.floor(F.col("slot") / 2_000_000))
    limits = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(most[s]))])
    counts = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(blocks[s]))])
    per = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(there[s] / blocks[s]))])
    ranked = ranked.filter(F.col("k") < limits[F.col("source")]).withColumn("epoch", F.floor(F.col("k") / counts[F.col("source")]).cast("int"))
    ranked = ranked.select("slot", "source", "epoch", (F.col("k") % counts[F.col("source")]).alias("block"))
    mixed = tokens.filter(F.col("source").isin(names)).withColumn("shuffle", F.xxhash64(F.lit(seed), "doc_id"))
    running = running_totals(mixed, ["source"], ["shuffle", "doc_id"], F.col("n_tokens"), "before")
    placed = running.withColumn("block", F.least(F.floor(F.col("before") / per[F.col("source")]), counts[F.col("source")] - 1).cast("long"))
    out = ranked.join(placed, ["source", "block"])
    return out.select("slot", F.col("before").alias("place"), "source", "epoch", "doc_id", "n_tokens")


def shares_reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_rows, n_tokens, share, times_used) for every source of mix_targets; times_used is the most any text is used."""
    each = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.sum("n_tokens").alias("t"))
    by = each.groupBy("source").agg(F.sum("times").alias("n_rows"), F.sum("t").alias("n_tokens"), F.max("times").alias("times_used"))
    by = cut(by)
    whole = by.agg(F.sum("n_tokens")).collect()[0][0] or 1
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = targets.select("source", "target_share", "max_repeats").join(by, "source", "left")
    return out.select("source", "target_share", "max_repeats", z("n_rows"), z("n_tokens"), F.coalesce(F.col("n_tokens") / whole, F.lit(0.0)).alias("share"), z("times_used"))
