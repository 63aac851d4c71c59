"""Filling containers of fixed capacity with whole items.

The histogram of item sizes, no longer than the capacity, is all the driver sees. The configuration linear program, which chooses how often each pattern
of sizes is used so that all items are covered by as few containers as possible, is solved by multiplicative weights: sizes that are covered get cheap, and an
unbounded knapsack by dynamic programming finds the patterns that are worth most. Its solution is rounded by largest remainders, the program of what is left is
solved and rounded again, and the few items left in the end are placed largest first. Items get their containers by their rank among items of their size, from a
table with a row for each pattern and size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.tokens import VOCABULARY, token_counts
from thicket.operators.skew import running_totals
from thicket.session import cut

CAPACITY = 2_048
#: Rounds of the multiplicative weights, the step of their logarithm, and patterns taken from one knapsack table.
ROUNDS, STEP, PATTERNS = 12, 0.1, 96
#: Steps of the weights that it begins with, and rounds of each.
STEPS, ROUNDS_A_STEP = (0.5, 5.0), 60
#: Programs solved for what rounding leaves, and the share of the volume that is small enough to be placed largest first.
PASSES, REST = 6, 0.005


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The most value that fits each capacity from 0, items used as often as wanted; sizes are sorted."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        n = upto[c]
        best[c] = max(best[c - 1], float((best[c - sizes[:n]] + values[:n]).max())) if n else best[c - 1]
    return best


def _pattern(sizes: np.ndarray, counts: np.ndarray, weights: np.ndarray, best: np.ndarray, room: int, first: int, open_: np.ndarray) -> dict[int, int]:
    """Places of sizes and how often: one of place `first` and what is worth most in the room beside it, read off a knapsack table.

    Only sizes that are `open_` count, and none oftener than there are items of it."""
    out, closed, room = {first: 1}, ~open_, room - int(sizes[first])
    if counts[first] <= 1:
        closed[first] = True
    while room > 0:
        n = int(np.searchsorted(sizes, room, "right"))
        if not n:
            break
        worth = np.where(closed[:n], -1.0, weights[:n] + best[room - sizes[:n]])
        at = int(worth.argmax())
        if worth[at] < 0:
            break
        out[at] = out.get(at, 0) + 1
        closed[at] = out[at] >= counts[at]
        room -= int(sizes[at])
    return out


def prices(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """(weights of the sizes to begin with, a lower bound of the containers needed).

    They begin as volumes. A size through which even the best pattern is worth less than the best of all gets dearer by that, with the smaller of the STEPS
    for the bound, as any weights give one: their total over what the best pattern is worth; then with the larger, for weights that keep hard sizes ahead."""
    bound = 0.0
    for step in STEPS:
        out = sizes.astype(float)
        for _ in range(ROUNDS_A_STEP):
            best = knapsack(sizes, out, capacity)
            bound = max(bound, float((counts * out).sum() / best[capacity]))
            short = 1 - (out + best[capacity - sizes]) / best[capacity]
            if short.max() < 1e-4:
                break
            out = out * np.exp(step * short) * (capacity / best[capacity])
    return out, bound


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> tuple[dict[tuple, float], float]:
    """(how often each pattern is used, a lower bound of the containers needed): an approximate solution of the configuration linear program.

    The weight of a size is that of prices(), times exp(-step) for each round that its cover is ahead. In round r all sizes are brought to a cover of r / rounds: for
    each that is behind, the largest first, a pattern through it is taken from a knapsack table under the present weights, which is made anew for every
    PATTERNS patterns, and used until one of its sizes is where it should be. No size gets more than a round ahead, so in the end each is covered once
    and at most 1 / rounds more."""
    cover, used = np.zeros(len(sizes)), {}
    base, bound = prices(sizes, counts, capacity)
    for r in range(1, rounds + 1):
        level, ahead = r / rounds - 1e-9, (r + 1) / rounds - 1e-9
        while (cover < level).any():
            weights = base * np.exp(-step * (cover * rounds - r))
            best = knapsack(sizes, weights, capacity)
            bound = max(bound, float((counts * weights).sum() / best[capacity]))
            for first in np.flatnonzero(cover < level)[::-1][:PATTERNS].tolist():
                if cover[first] >= level:
                    continue
                p = _pattern(sizes, counts, weights, best, capacity, first, cover < ahead)
                at, a = np.fromiter(p.keys(), int), np.fromiter(p.values(), float)
                upto = np.where(cover[at] < level, r, r + 1) / rounds
                times = float(((upto - cover[at]) * counts[at] / a).min())
                key = tuple(sorted((int(sizes[i]), n) for i, n in p.items()))
                used[key] = used.get(key, 0.0) + times
                cover[at] += times * a / counts[at]
    return used, bound


class Plan:
    """Patterns of (size, how many) with the containers that each fills, and what is left of the histogram."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, capacity: int):
        self.left = {int(s): int(n) for s, n in zip(sizes, counts) if n > 0}
        self.capacity, self.patterns, self.by_program = capacity, [], 0

    def use(self, pattern: tuple[tuple[int, int], ...], times: int) -> int:
        """Fill so many containers, or as many as the items left allow."""
        times = min(times, *(self.left[s] // n for s, n in pattern))
        if times > 0:
            self.patterns.append((pattern, times))
            for s, n in pattern:
                self.left[s] -= n * times
        return max(times, 0)

    def volume(self) -> int:
        return sum(s * n for s, n in self.left.items())

    def round_program(self, wanted: dict[tuple, float], last: bool = False) -> int:
        """Containers filled by rounding a solution: down first, then one more of the patterns with the largest remainders, as long as their items last.

        Patterns emptier than the solution's mean are left to the next program, but for those that the last one rounds down."""
        fill = lambda p: sum(s * n for s, n in p)
        mean = sum(x * fill(p) for p, x in wanted.items()) / sum(wanted.values())
        done = sum(self.use(p, int(x)) for p, x in wanted.items() if last or fill(p) >= mean - 1e-6)
        for p, x in sorted(wanted.items(), key=lambda i: (int(i[1]) - i[1], i[0])):
            if x > int(x) and fill(p) >= mean - 1e-6:
                done += self.use(p, 1)
        self.by_program += done
        return done

    def fill_up(self) -> None:
        """Place all that is left, largest first, each container filled with the largest that still fit."""
        there = np.array(sorted(s for s, n in self.left.items() if n), np.int64)
        while len(there):
            room, pattern = self.capacity, {}
            while True:
                upto = int(np.searchsorted(there, room, "right"))
                while upto and self.left[int(there[upto - 1])] <= pattern.get(int(there[upto - 1]), 0):
                    upto -= 1
                if not upto:
                    break
                s = int(there[upto - 1])
                n = min(room // s, self.left[s] - pattern.get(s, 0))
                pattern[s] = pattern.get(s, 0) + n
                room -= n * s
            self.use(tuple(sorted(pattern.items())), sum(self.left.values()))
            there = np.array([s for s in there if self.left[int(s)]], np.int64)


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], float, int]:
    """([(pattern of (size, how many), containers)], lower bound, containers whose pattern the linear program chose) that places every item of the histogram.

    The program is solved and rounded, then solved again for the items that rounding left, until these are REST of the volume or PASSES programs are done;
    those few are placed largest first. The first program's bound holds for the whole histogram."""
    order = np.argsort(sizes)
    sizes, counts = np.asarray(sizes, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(sizes):
        return [], 0.0, 0
    if sizes[0] < 1 or sizes[-1] > capacity:
        raise ValueError("sizes must be from 1 to the capacity")
    out, bound = Plan(sizes, counts, capacity), 0.0
    whole = out.volume()
    for i in range(PASSES):
        there = np.array(sorted(s for s, n in out.left.items() if n), np.int64)
        if not len(there) or (i and out.volume() <= REST * whole):
            break
        wanted, least = fractional(there, np.array([out.left[int(s)] for s in there]), capacity, rounds)
        bound = bound if i else least
        if not out.round_program(wanted, i == PASSES - 1):
            break
    out.fill_up()
    return out.patterns, bound, out.by_program


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """(key, part, n, container_id) for every item; part counts from 0.

    An item within the capacity is one part. A larger one fills as many containers as it can, alone in each, and its rest is an item like others. Items of
    size 0 or null (n = 0) are spread over the containers. Repeated keys are items of their own; an empty table gives nothing. At most `capacity` histogram rows
    come to the driver."""
    base = cut(items.select(key, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n")))
    parts = base.select(key, F.col("n").alias("whole"), F.floor(F.col("n") / capacity).alias("full"))
    ones = base.select(key, F.when(F.col("n") % capacity > 0, F.floor(F.col("n") / capacity)).otherwise(0).cast("int").alias("part"), (F.col("n") % capacity).alias("n"), F.col("n").alias("whole"))
    rest = ones.filter((F.col("n") > 0) | (F.col("whole") == 0)).drop("whole")
    histogram = rest.filter("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("c")).toPandas()
    patterns, _, _ = plan(histogram["n"].to_numpy("int64"), histogram["c"].to_numpy("int64"), capacity, rounds)
    rows, start, first = [], {}, 0
    for pattern, times in patterns:
        for s, n in pattern:
            at = start.get(s, 0)
            rows.append((s, at, n, first))
            start[s] = at + n * times
        first += times
    spread = max(first, 1)
    places = pd.DataFrame(rows, columns=["n", "start", "per", "base"], dtype="int64").sort_values(["n", "start"])
    sent = items.sparkSession.sparkContext.broadcast({c: places[c].to_numpy() for c in places.columns})

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = sent.value
        codes = t["n"] * (1 << 44) + t["start"]
        for pdf in batches:
            n, rank = pdf["n"].to_numpy("int64"), pdf["rank"].to_numpy("int64")
            out = pdf[[key, "part", "n"]].copy()
            if len(codes):
                at = np.maximum(np.searchsorted(codes, n * (1 << 44) + rank, "right") - 1, 0)
                out["container_id"] = np.where(n > 0, t["base"][at] + (rank - t["start"][at]) // t["per"][at], rank % spread)
            else:
                out["container_id"] = rank % spread
            yield out

    ranked = running_totals(rest, ["n"], [key, "part"], None, "rank")
    kind = dict(items.dtypes)[key]
    placed = ranked.mapInPandas(assign, f"`{key}` {kind}, part int, n bigint, container_id bigint")
    # Full containers of oversized items come after all others.
    whole = running_totals(cut(parts.filter("full > 0")).withColumn("one", F.lit(1)), ["one"], [key], F.col("full"), "before")
    alone = whole.select(key, F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("part"), "before")
    alone = alone.select(key, "part", F.lit(capacity).cast("long").alias("n"), (F.lit(first).cast("long") + F.col("before") + F.col("part")).alias("container_id"))
    return placed.unionByName(alone)


def windows(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, n_tokens, container_id): the texts in context windows of `capacity` tokens."""
    sized = cut(token_counts(documents, ["doc_id"], "text", vocabulary))
    return pack(sized, "doc_id", "n_tokens", capacity).withColumnRenamed("n", "n_tokens")


def fill(packed: DataFrame, size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row: n_containers, n_items, n_tokens, least_containers (their total over the capacity), used (share of the room)."""
    each = packed.groupBy("container_id").agg(F.sum(size).alias("t"), F.count(F.lit(1)).alias("i"))
    s = F.coalesce(F.sum("t"), F.lit(0))
    n = F.count(F.lit(1))
    return each.agg(n.alias("n_containers"), F.coalesce(F.sum("i"), F.lit(0)).alias("n_items"), s.alias("n_tokens"), F.ceil(s / capacity).alias("least_containers"), F.when(n > 0, s / (n * capacity)).alias("used"), F.max("t").alias("fullest"))


def checked(packed: DataFrame, documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_documents, n_misplaced (documents not placed as often as they are stored, with parts 0, 1, ... that none but oversized ones have more than one of),
    n_over_capacity (containers that hold more than they can)."""
    parts = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("part") == 0).alias("firsts"), F.max("part").alias("last"), F.sum("n_tokens").alias("t"))
    stored = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("stored"))
    wrong = "firsts is null or stored is null or firsts <> stored or k <> stored * (last + 1) or t > k * {0} or (k > stored and t <= stored * {0})".format(capacity)
    misplaced = stored.join(parts, "doc_id", "full").agg(F.count("stored").alias("n_documents"), F.coalesce(F.count_if(F.expr(wrong)), F.lit(0)).alias("n_misplaced"))
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > capacity).alias("n_over_capacity"))
    return misplaced.join(F.broadcast(over))
