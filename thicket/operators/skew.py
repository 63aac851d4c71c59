"""Joins, totals and ranks that hold up when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.session import BROADCAST_ROWS, cut, partitions, small

#: Rows of one key that one task may order.
ROWS_A_BUCKET = 2_000_000
#: A key with at least this share of the rows is joined apart from the rest.
HOT_SHARE = 0.01


def heavy_keys(df: DataFrame, key: str, share: float, total: int | None = None) -> DataFrame:
    """Keys (no nulls) that at least `share` of all rows hold, with their row counts and the total.

    Counts are partial before they are shuffled, so a heavy key costs one row a task. At most 1/share keys come out.
    An empty table gives no keys."""
    total = df.count() if total is None else total
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("total_rows", F.lit(total).cast("long"))
    return counts.filter(F.col(key).isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("total_rows")))


def lookup(df: DataFrame, unique: DataFrame, key: str, how: str = "left", hot_share: float = HOT_SHARE) -> DataFrame:
    """Join df with the one row that `unique` has for each key, without a task that gets a hot key whole.

    `unique` is broadcast if it has at most BROADCAST_ROWS rows. Otherwise keys with `hot_share` of df's rows, 1/hot_share
    at most, are joined by a broadcast of just their rows and all others by shuffle. Null keys match nothing and are kept by how="left".
    `unique` is written out unless cut() made it, as it is read more than once."""
    if getattr(unique, "_thicket_path", None) is None:
        unique = cut(unique)
    if small(unique):
        return df.join(F.broadcast(unique), key, how)
    hot = heavy_keys(df, key, hot_share).select(key)
    keys = [r[0] for r in hot.limit(int(2 / hot_share)).collect()]
    if not keys:
        return df.join(unique, key, how)
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    cold = df.filter(~is_hot).join(unique.filter(~is_hot), key, how)
    return cold.unionByName(df.filter(is_hot).join(F.broadcast(unique.filter(is_hot)), key, how))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | None = None, out: str = "before", rows: int | None = None, rows_a_bucket: int = ROWS_A_BUCKET, bucket: Column | None = None) -> DataFrame:
    """Add to each row the sum of `value` (1 for None) over the rows of its key that come earlier in the order.

    Order within a key, at every size of the table: a hash of `order`, then `order`; with `bucket`, a whole number that rises with `order`, that alone. A key is cut
    into so many buckets, runs of that order, that no task orders more than about rows_a_bucket rows of it; the buckets' sums, few per key, are added up
    apart. `rows` is df's row count, if known. Rows equal in all of `order` get their places in any order."""
    keys, order = list(keys), list(order)
    value = F.lit(1).cast("long") if value is None else value
    df = df.withColumn("_v", value)
    if bucket is None:
        df = df.withColumn("_h", F.xxhash64(*order))
        order = ["_h", *order]
    if rows is None:
        rows = df.count()
    buckets = -(-rows // rows_a_bucket)
    inner = lambda cols: Window.partitionBy(*cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if buckets <= 1:
        return df.withColumn(out, F.coalesce(F.sum("_v").over(inner(keys)), F.lit(0))).drop("_v", "_h")
    bits = max(1, (buckets - 1).bit_length())
    df = df.withColumn("_b", F.shiftright("_h", 64 - bits) if bucket is None else bucket)
    return _with_totals_before(df, keys, inner, out).drop("_h")


def ordered_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column | None = None, out: str = "before", most: bool = False) -> DataFrame:
    """Like running_totals() in the very order that `order` (columns, ascending or descending) gives, however many rows a key has; with `most`, the highest `value` so far
    instead of the sum (null for a key's first rows).

    Rows are range-partitioned by keys and order, so that a large key lies in several partitions, and written out; each partition's rows of a key are summed
    apart from the totals of the partitions before."""
    keys = list(keys)
    df = df.withColumn("_v", F.lit(1).cast("long") if value is None else value)
    spread = cut(df.repartitionByRange(partitions(df.sparkSession), *[F.col(k) for k in keys], *order).withColumn("_b", F.spark_partition_id()))
    inner = lambda cols: Window.partitionBy(*cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return _with_totals_before(spread, keys, inner, out, most)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float], between: bool = False) -> DataFrame:
    """(keys, percent, n, x): exact percentiles of the values that are not null, by counts of equal values and running totals of them; no group is held in one task.

    x is the smallest value that `percent` % of the values do not exceed, or with `between` the point at place (n - 1) * percent / 100, between two
    values in proportion."""
    keys = list(keys)
    counts = cut(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c")))
    totals = counts.groupBy(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)]).agg(F.sum("c").alias("n"))
    on = [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(keys)]
    totals = cut(totals)
    run = ordered_totals(counts, keys, [F.col("x")], F.col("c"), "upto")
    run = run.join(F.broadcast(totals) if small(totals) else totals, on).drop(*[f"_t{i}" for i in range(len(keys))])
    asked = run.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    if not between:
        rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("percent") / 100))
        return asked.filter((F.col("upto") < rank) & (F.col("upto") + F.col("c") >= rank)).select(*keys, "percent", "n", "x")
    place = (F.col("n") - 1) * F.col("percent") / 100
    held = lambda i: (F.col("upto") <= i) & (F.col("upto") + F.col("c") > i)
    near = asked.withColumn("place", place).filter(held(F.floor("place")) | held(F.ceil("place")))
    low, high = F.max(F.when(held(F.floor("place")), F.col("x"))), F.max(F.when(held(F.ceil("place")), F.col("x")))
    part = F.max("place") - F.floor(F.max("place"))
    return near.groupBy(*keys, "percent").agg(F.max("n").alias("n"), F.when(part == 0, low).otherwise(low + (high - low) * part).alias("x"))


def _with_totals_before(df: DataFrame, keys: list[str], inner, out: str, most: bool = False) -> DataFrame:
    """Totals of _v within the buckets _b of each key, with those of its earlier buckets."""
    total, none = (F.max, F.lit(None)) if most else (F.sum, F.lit(0))
    sums = cut(df.groupBy(*keys, "_b").agg(total("_v").alias("_s")))
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_o", F.coalesce(total("_s").over(over), none)).drop("_s")
    before = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), "_o")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_kb")]
    if small(before, BROADCAST_ROWS):
        before = F.broadcast(before)
    ranked = df.withColumn("_w", F.coalesce(total("_v").over(inner([*keys, "_b"])), none))
    both = F.greatest("_w", "_o") if most else F.col("_w") + F.col("_o")
    return ranked.join(before, on, "left").withColumn(out, both).drop("_v", "_b", "_w", "_o", "_kb", *[f"_k{i}" for i in range(len(keys))])
