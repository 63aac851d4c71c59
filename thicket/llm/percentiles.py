"""Percentiles per group with a guaranteed rank error, from digests that add up.

Values become 64-bit keys in their order, those of doubles (longs count as doubles: exact up to 2**53). The top `bits` of a key are the leaves of a
dyadic tree, 2**(bits - 12) of them for each power of two; a digest holds counts of some of its nodes, such that the count at or below any leaf is known
up to bits * n / k. Digests of partitions, files or days are merged by adding the counts of equal nodes and compressing again; the bound then holds for all
their values together. settle() counts again within what a digest leaves open, where an exact answer is wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.operators.skew import HOT_SHARE
from thicket.session import cut, small

#: Depth of the tree: 2**BITS leaves.
BITS = 18
#: Nodes with a count of n / K or more stay; at most 3 K nodes in a digest.
K = 4096
#: Parts that one step of an exact search cuts an interval into.
PARTS = 4096


def _double_keys(values: pd.Series) -> pd.Series:
    """Bits of a double as an ordered long; null for null and NaN."""
    v = values.to_numpy(dtype="float64", na_value=np.nan) + 0.0
    bits = v.view("int64")
    return pd.Series(np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))).astype("Int64").mask(np.isnan(v))


def key_double(keys: np.ndarray) -> np.ndarray:
    """The doubles of ordered longs."""
    return np.where(keys >= 0, keys, keys ^ np.int64(0x7FFFFFFFFFFFFFFF)).view("float64")


def compress(group: np.ndarray, level: np.ndarray, index: np.ndarray, n: np.ndarray, bits: int, k: int) -> tuple[np.ndarray, ...]:
    """Nodes (group, level, index, count) of many digests at once, from the leaves up: a pair and its parent with no more than total / k become the parent.

    group: small whole numbers; level counts from 0, the leaves, to bits, the root; index is the node's place on its level."""
    limits = np.bincount(group, weights=n).astype("int64") // k
    plain = limits[group] < 1
    out = [(group[plain], level[plain], index[plain], n[plain])]
    group, level, index, n = (x[~plain] for x in (group, level, index, n))
    key = (group << (bits + 1)) | index
    now, count = np.empty(0, "int64"), np.empty(0, "int64")
    for at in range(bits + 1):
        here = level == at
        now, count = np.concatenate([now, key[here]]), np.concatenate([count, n[here]])
        if not len(now):
            continue
        now, inverse = np.unique(now, return_inverse=True)
        count = np.bincount(inverse, weights=count).astype("int64")
        groups, places = now >> (bits + 1), now & ((1 << (bits + 1)) - 1)
        if at == bits:
            out.append((groups, np.full(len(now), at), places, count))
            break
        parent, inverse = np.unique((groups << (bits + 1)) | (places >> 1), return_inverse=True)
        pair = np.bincount(inverse, weights=count).astype("int64")
        above = level == at + 1
        place = np.minimum(np.searchsorted(parent, key[above]), len(parent) - 1)
        hit = parent[place] == key[above]
        own = np.bincount(place[hit], weights=n[above][hit], minlength=len(parent)).astype("int64")
        up = pair + own <= limits[parent >> (bits + 1)]
        stay = ~up[inverse]
        out.append((groups[stay], np.full(int(stay.sum()), at), places[stay], count[stay]))
        now, count = parent[up], pair[up]
    return tuple(np.concatenate(x) for x in zip(*out))


#: Rows that are compressed at once; more only if one group has more nodes.
AT_ONCE = 1_000_000


def _side_by_side(keys: Sequence[str], work):
    """A function for mapInPandas over partitions sorted by keys: work(rows, starts) gets whole groups, many at a time, and where each starts."""
    keys = list(keys)

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        for key in keys:
            a, b = pdf[key], pdf[key].shift()
            new |= ((a != b) & ~(a.isna() & b.isna())).to_numpy(dtype=bool, na_value=True)
        new[:1] = True
        return np.flatnonzero(new)

    def run(batches):
        held, rows = [], 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows < AT_ONCE:
                continue
            whole = pd.concat(held, ignore_index=True)
            at = starts(whole)
            last = int(at[-1])
            if last:
                yield work(whole.iloc[:last], at[:-1])
            held = [whole.iloc[last:]]
            rows = len(held[0])
        if rows:
            whole = pd.concat(held, ignore_index=True)
            yield work(whole, starts(whole))

    return run


def digest(df: DataFrame, keys: Sequence[str], value: str, bits: int = BITS, k: int = K) -> DataFrame:
    """Digests of the long column `value` by keys: (keys, level, node, n). Null values are not counted.

    Equal leaves are counted before the shuffle; a group reaches its task as at most 2**bits counts, however many rows it has."""
    leaf = F.shiftright(F.col(value), 64 - bits) + F.lit(1 << (bits - 1))
    leaves = df.filter(F.col(value).isNotNull()).groupBy(*keys, leaf.alias("node")).agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(0))
    return _grouped(leaves, keys, bits, k)


def merge(digests: DataFrame, keys: Sequence[str], bits: int = BITS, k: int = K) -> DataFrame:
    """Digests by fewer keys: counts of equal nodes are added, then compressed again."""
    return _grouped(digests.groupBy(*keys, "level", "node").agg(F.sum("n").alias("n")), keys, bits, k)


def _sorted(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return nodes.select(*keys, "level", "node", "n").repartition(*keys).sortWithinPartitions(*keys)


def _schema(df: DataFrame, keys: Sequence[str], **more: T.DataType) -> T.StructType:
    return T.StructType([*df.select(*keys).schema.fields, *(T.StructField(k, v) for k, v in more.items())])


def _grouped(nodes: DataFrame, keys: Sequence[str], bits: int, k: int) -> DataFrame:
    """Digests compressed."""
    keys = list(keys)

    def work(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
        g, level, index, n = compress(group, pdf["level"].to_numpy("int64"), pdf["node"].to_numpy("int64"), pdf["n"].to_numpy("int64"), bits, k)
        return pdf[keys].iloc[starts[g]].reset_index(drop=True).assign(level=level.astype("int32"), node=index, n=n)

    return _sorted(nodes, keys).mapInPandas(_side_by_side(keys, work), _schema(nodes, keys, level=T.IntegerType(), node=T.LongType(), n=T.LongType()))


def bounds(digests: DataFrame, keys: Sequence[str], percents: Sequence[int], bits: int = BITS) -> DataFrame:
    """(keys, percent, n, rank, low, high): the percentile, the rank-th smallest key with rank = ceil(percent * n / 100), lies in low..high, both included.

    Nodes wholly at or below a leaf give the least rank, those that begin at or below it the greatest. Percentile p is the smallest value
    that at least p % of the values do not exceed; 0 counts as the smallest value."""
    keys, half = list(keys), 1 << (bits - 1)

    def work(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        levels, nodes, counts = (pdf[c].to_numpy("int64") for c in ("level", "node", "n"))
        rows = []
        for a, b in zip(starts, np.append(starts[1:], len(pdf))):
            level, node, n = levels[a:b], nodes[a:b], counts[a:b]
            first, last, total = node << level, ((node + 1) << level) - 1, int(n.sum())
            by_last, by_first = np.argsort(last, kind="stable"), np.argsort(first, kind="stable")
            sure, may = np.cumsum(n[by_last]), np.cumsum(n[by_first])
            for p in percents:
                rank = max(1, -(-p * total // 100))
                # The value is at most the end of the node at which `rank` values surely lie at or below; at least the first at which so many may.
                high, low = int(last[by_last][np.searchsorted(sure, rank)]), int(first[by_first][np.searchsorted(may, rank)])
                rows.append((p, total, rank, (low - half) << (64 - bits), ((high - half + 1) << (64 - bits)) - 1))
        out = pdf[keys].iloc[np.repeat(starts, len(percents))].reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(rows, columns=["percent", "n", "rank", "low", "high"]).astype({"percent": "int32"})], axis=1)

    more = {"percent": T.IntegerType()} | {c: T.LongType() for c in ("n", "rank", "low", "high")}
    return _sorted(digests, keys).mapInPandas(_side_by_side(keys, work), _schema(digests, keys, **more))


def _with_brackets(values: DataFrame, open_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each value with its group's brackets. More than BROADCAST_ROWS of them are joined by shuffle, but for those of groups with HOT_SHARE of all rows, 1 / HOT_SHARE groups at most,
    so that no task gets a large group whole."""
    renamed = open_.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in open_.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    drop = [f"_{k}" for k in keys]
    if small(renamed):
        return values.join(F.broadcast(renamed), on).drop(*drop)
    # n is the group's count of values.
    total = renamed.groupBy(*drop).agg(F.max("n").alias("n")).agg(F.sum("n")).collect()[0][0]
    hot = F.col("n") >= HOT_SHARE * total
    groups = renamed.filter(hot).select(*drop).distinct()
    cold = values.join(F.broadcast(groups), on, "left_anti").join(renamed.filter(~hot), on)
    return cold.unionByName(values.join(F.broadcast(renamed.filter(hot)), on)).drop(*drop)


def settle(df: DataFrame, keys: Sequence[str], value: str, brackets: DataFrame) -> DataFrame:
    """The exact percentiles in the brackets that bounds() gives: (keys, percent, n, exact), by counting ever smaller parts of each bracket.

    Each round cuts every bracket into PARTS parts, counts its group's values by part, and goes on with the part that holds the rank; values
    before it are taken off the rank. 64 bits take 6 rounds at most. Only counts are shuffled, PARTS for a bracket at most from a task."""
    keys = list(keys)
    at = cut(brackets.select(*keys, "percent", "n", "rank", "low", "high", F.lit(None).cast("long").alias("below")))
    values = df.select(*keys, F.col(value).alias("v")).filter("v is not null")
    first = True
    while first or not at.filter("low < high").isEmpty():
        width = F.col("high").cast("double") - F.col("low").cast("double") + 1
        open_ = at.withColumn("cut", F.greatest(F.lit(0), F.ceil(F.log2(width)) - (PARTS.bit_length() - 1)).cast("int"))
        joined = _with_brackets(values, cut(open_), keys).select(*keys, "percent", "n", "rank", "low", "high", "below", "cut", "v")
        part = F.expr("case when v < low then -1 when v <= high then shiftright(v, cut) - shiftright(low, cut) end")
        # On the first round values before the bracket are counted; later they are known.
        near = joined.withColumn("part", part).filter("part is not null" if first else "part >= 0")
        counts = near.groupBy(*keys, "percent", "n", "rank", "low", "high", "below", "cut", "part").agg(F.count(F.lit(1)).alias("c"))
        w = Window.partitionBy(*keys, "percent").orderBy("part")
        run = counts.withColumn("upto", F.sum("c").over(w) + F.coalesce("below", F.lit(0))).withColumn("before", F.col("upto") - F.col("c"))
        hit = run.filter("upto >= rank and before < rank").withColumn("base", F.expr("shiftleft(shiftright(low, cut) + part, cut)"))
        nxt = hit.select(*keys, "percent", "n", "rank", F.greatest("low", "base").alias("low"), F.least("high", F.expr("base + (shiftleft(1L, cut) - 1)")).alias("high"), F.col("before").alias("below"))
        at, first = cut(nxt), False
    return at.select(*keys, "percent", "n", F.col("low").alias("exact"))


def _values(keys: pd.Series) -> pd.Series:
    return pd.Series(key_double(keys.to_numpy("int64")))


def double_keys(column: Column | str) -> Column:
    return F.pandas_udf(_double_keys, "long")(column)


def value_of(column: Column | str) -> Column:
    """The doubles whose keys these are."""
    return F.pandas_udf(_values, "double")(column)


def row_marks(df: DataFrame, row_id: str) -> DataFrame:
    """df with _same: equal for wholly equal rows, which share row_id, and different for rows of one id that differ anywhere.

    A hash of all other columns and of which of them are null."""
    rest = [c for c in df.columns if c != row_id]
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in rest])
    return df.withColumn("_same", F.xxhash64(nulls, *[F.col(f"`{c}`") for c in rest]))


def measurements(df: DataFrame, groups: Sequence[str], measures: dict[str, bool], row_id: str, day: str) -> DataFrame:
    """(measure, groups, day, v): the counted values of wholly equal rows once, as keys, in long form.

    groups are compared trimmed and in lower case. measures: for each column whether negative values count; null and NaN never do."""
    marked = row_marks(df, row_id)
    columns = [F.lower(F.trim(F.col(g))).alias(g) for g in groups]
    kept = marked.select(row_id, "_same", *columns, F.to_date(day).alias("day"), *[F.col(m).cast("double").alias(m) for m in measures])
    once = kept.groupBy(row_id, "_same").agg(*[F.first(c).alias(c) for c in (*groups, "day", *measures)])
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.when(F.col(m) >= (float("-inf") if below else 0.0), F.col(m)).alias("x")) for m, below in measures.items()])).alias("p")
    rows = once.select(*groups, "day", pairs).select("p.measure", *groups, "day", "p.x").filter(F.col("x").isNotNull() & ~F.isnan("x"))
    return cut(rows.select("measure", *groups, "day", double_keys("x").alias("v")))


def merged_bounds(values: DataFrame, groups: Sequence[str], percents: Sequence[int]) -> DataFrame:
    """Brackets of the percentiles by measure and groups, from digests by day that are then merged."""
    keys = ["measure", *groups]
    return bounds(merge(digest(values, [*keys, "day"], "v"), keys), keys, percents)


def found_slow_or_growing(df: DataFrame, groups: Sequence[str] = ("subsystem", "operation"), least: int = 50, spread: float = 10.0, growth: float = 16_777_216.0) -> DataFrame:
    """(measure, groups) with at least `least` counted values whose durationms has a 95th percentile above `spread` times the 50th, or whose
    rssdeltabytes has a 99th above `growth`.

    Digests decide all groups whose brackets leave no doubt; for the rest the percentiles are settled by counting. Null groups are groups
    like others; empty tables give nothing."""
    keys = ["measure", *groups]
    values = measurements(df, groups, {"durationms": False, "rssdeltabytes": True}, "record_id", "logged_at")
    found = cut(merged_bounds(values, groups, (50, 95, 99)).filter(F.col("n") >= least))
    lows, highs = value_of("low"), value_of("high")
    ranges = found.withColumns({"lo": lows, "hi": highs})
    pick = lambda c, p: F.max(F.when(F.col("percent") == p, F.col(c)))
    wide = ranges.groupBy(*keys).agg(*[pick(c, p).alias(f"{c}{p}") for c in ("lo", "hi") for p in (50, 95, 99)])
    slow = F.when(F.col("lo95") > spread * F.col("hi50"), True).when(F.col("hi95") <= spread * F.col("lo50"), False)
    grown = F.when(F.col("lo99") > growth, True).when(F.col("hi99") <= growth, False)
    told = cut(wide.select(*keys, F.when(F.col("measure") == "durationms", slow).otherwise(grown).alias("is")))
    open_ = told.filter("is is null")
    sure = told.filter("is").select(*keys)
    if open_.isEmpty():
        return sure
    asked = found.join(open_.select(*keys), [found[k].eqNullSafe(open_[k]) for k in keys], "left_semi")
    exact = settle(values, keys, "v", asked).withColumn("x", value_of("exact"))
    e = exact.groupBy(*keys).agg(*[pick("x", p).alias(f"x{p}") for p in (50, 95, 99)])
    settled = e.filter(F.when(F.col("measure") == "durationms", F.col("x95") > spread * F.col("x50")).otherwise(F.col("x99") > growth))
    return sure.unionByName(settled.select(*keys))


def report(df: DataFrame, percents: Sequence[int] = (50, 90, 95, 99), groups: Sequence[str] = ("subsystem", "operation"), bits: int = BITS, k: int = K) -> DataFrame:
    """(measure, groups, percent, n, rank, low, high, rank_error): the bracket of each percentile, and by how many ranks a digest may be off at most."""
    values = measurements(df, groups, {"durationms": False, "rssdeltabytes": True}, "record_id", "logged_at")
    b = merged_bounds(values, groups, percents)
    return b.select("measure", *groups, "percent", "n", "rank", value_of("low").alias("low"), value_of("high").alias("high"), F.floor(F.lit(bits) * F.col("n") / k).alias("rank_error"))


def report_by_day(df: DataFrame, percents: Sequence[int] = (50, 95), groups: Sequence[str] = ("subsystem", "operation")) -> DataFrame:
    """The same for each day: the digests that report() merges."""
    values = measurements(df, groups, {"durationms": False, "rssdeltabytes": True}, "record_id", "logged_at")
    keys = ["measure", *groups, "day"]
    b = bounds(digest(values, keys, "v"), keys, percents)
    return b.select(*keys, "percent", "n", "rank", value_of("low").alias("low"), value_of("high").alias("high"))


def settled(df: DataFrame, percents: Sequence[int] = (50, 90, 95, 99), groups: Sequence[str] = ("subsystem", "operation")) -> DataFrame:
    """(measure, groups, percent, n, value): the exact percentiles, settled within the digests' brackets."""
    values = measurements(df, groups, {"durationms": False, "rssdeltabytes": True}, "record_id", "logged_at")
    keys = ["measure", *groups]
    return settle(values, keys, "v", merged_bounds(values, groups, percents)).select(*keys, "percent", "n", value_of("exact").alias("value"))
