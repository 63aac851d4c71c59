import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from thicket.llm import mixing, packing, tokens


def brute_knapsack(sizes, values, capacity):
    best = [0.0] * (capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max([best[c - 1]] + [best[c - s] + v for s, v in zip(sizes, values) if s <= c])
    return best


def test_knapsack():
    rnd = random.Random(2)
    sizes = np.array(sorted(rnd.sample(range(1, 40), 9)))
    values = np.array([rnd.random() for _ in sizes])
    best = packing.knapsack(sizes, values, 60)
    assert np.allclose(best, brute_knapsack(sizes, values, 60))
    first = int(np.argmax(values / sizes))
    pattern = packing._pattern(sizes, np.full(9, 99), values, best, 60, first, np.ones(9, bool))
    assert sum(sizes[i] * n for i, n in pattern.items()) <= 60 and np.isclose(sum(values[i] * n for i, n in pattern.items()), values[first] + best[60 - sizes[first]])
    scarce = packing._pattern(sizes, np.ones(9, int), values, best, 60, first, np.arange(9) != 3)
    assert set(scarce.values()) == {1} and (3 not in scarce or first == 3)


def test_program_chooses_most_containers_and_beats_largest_first(spark):
    sized = tokens.token_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), ["doc_id"]).selectExpr("n_tokens % 2048 as n").filter("n > 0").groupBy("n").count().toPandas()
    sizes, counts = sized["n"].to_numpy("int64"), sized["count"].to_numpy("int64")
    got, bound, by_program = packing.plan(sizes, counts, 2048)
    total, volume = sum(t for _, t in got), (sizes * counts).sum() / 2048
    alone = packing.Plan(sizes, counts, 2048)
    alone.fill_up()
    assert by_program >= 0.9 * total and total <= sum(t for _, t in alone.patterns)
    assert volume * 0.99 <= bound <= total + 1e-6 and total <= bound * 1.002 + 1


@pytest.mark.parametrize("many", [1, 5000])
def test_plan_places_everything_with_little_room_left(many):
    rnd = random.Random(many)
    sizes = np.array(sorted(rnd.sample(range(20, 260), 60)))
    counts = np.array([rnd.randrange(1, 6) * many for _ in sizes])
    got, bound, by_program = packing.plan(sizes, counts, 256)
    used = Counter()
    for pattern, times in got:
        assert sum(s * n for s, n in pattern) <= 256 and times > 0
        for s, n in pattern:
            used[s] += n * times
    assert used == Counter(dict(zip(sizes.tolist(), counts.tolist())))
    n = sum(t for _, t in got)
    assert bound <= n + 1e-9 and n <= bound * 1.06 + 3 and by_program > 0.5 * n
    alone = packing.Plan(sizes, counts, 256)
    alone.fill_up()
    assert n <= sum(t for _, t in alone.patterns)
    assert packing.plan(np.array([], int), np.array([], int)) == ([], 0.0, 0)
    with pytest.raises(ValueError):
        packing.plan(np.array([300]), np.array([1]), 256)


def test_pack(spark):
    rnd = random.Random(3)
    sizes = {i: rnd.choice([0, None, 1, 7, 7, 7, 50, 99, 100, 101, 250, 400, rnd.randrange(1, 100)]) for i in range(400)}
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in sizes.items()], "k long, size long, part string, container_id int")
    rows = packing.pack(df, "k", "size", 100, rounds=10).collect()
    by_item, by_container = defaultdict(list), Counter()
    for r in rows:
        by_item[r.k].append(r)
        by_container[r.container_id] += r.n
    assert set(by_item) == set(sizes) and max(by_container.values()) <= 100
    for k, parts in by_item.items():
        size = sizes[k] or 0
        assert sum(r.n for r in parts) == size and len(parts) == max(1, -(-size // 100))
        assert sorted(r.part for r in parts) == list(range(len(parts)))
    total = sum(s or 0 for s in sizes.values())
    assert len(by_container) <= total / 100 * 1.05 + 2
    assert packing.pack(df.limit(0), "k", "size", 100).count() == 0
    one = packing.fill(packing.pack(df, "k", "size", 100, rounds=5), "n", 100).collect()[0]
    assert one.n_tokens == total and one.fullest <= 100


def test_token_counts(spark):
    text = "Hello wörld, <|endoftext|> 123"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "a " * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, ["doc_id"]).collect()}
    enc = tokens.encoding(tokens.VOCABULARY)
    assert got == {1: len(enc.encode_ordinary(text)), 2: 0, 3: 0, 4: len(enc.encode_ordinary("a " * 50_000))}
    assert enc.decode(enc.encode_ordinary(text)) == text


def test_quotas():
    q = mixing.quotas({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000, "b": 100, "c": 50}, {"a": 1, "b": 2, "c": 4}, 1000)
    assert q["b"] == 200 and q["c"] == 200 and q["a"] == 600
    assert mixing.quotas({"a": 1.0, "b": 0.0}, {"b": 5}, {"a": 1, "b": 1}, 10) == {"a": 0.0, "b": 0.0}


def test_mixture(spark):
    rnd = random.Random(6)
    docs = [(i, " ".join(["word"] * rnd.randrange(1, 60)), rnd.choice("aaaaab"), "x") for i in range(900)]
    docs += [(2000, "", "a", "x"), (2001, None, "b", "x"), (2002, "other words", "zzz", "x"), (2003, "no source", None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, slot string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(df, targets, block=200).cache()
    times = Counter((r.source, r.doc_id) for r in mixed.collect())
    assert {s for s, _ in times} == {"a", "b"}
    assert max(n for (s, _), n in times.items() if s == "a") == 1 and max(n for (s, _), n in times.items() if s == "b") <= 3
    shares = {r.source: r for r in mixing.shares_reached(mixed, targets).collect()}
    assert abs(sum(r.share for r in shares.values()) - 1) < 1e-9 and shares["none"].n_tokens == 0
    # a may give its 5/9 of all tokens; b all that three uses allow.
    there = {r.source: r.t for r in mixing.sized(df, targets)[0].groupBy("source").sum("n_tokens").toDF("source", "t").collect()}
    quota = mixing.quotas({"a": 0.5, "b": 0.4, "none": 0.1}, there, {"a": 1, "b": 3, "none": 5}, sum(there.values()))
    for s in "ab":
        assert abs(shares[s].share - quota[s] / sum(quota.values())) < 0.03
    slots = defaultdict(set)
    for r in mixed.collect():
        slots[r.slot].add((r.source, r.epoch))
    assert all(len(x) == 1 for x in slots.values())
    assert mixing.mixture(df.limit(0), targets).count() == 0 and mixing.mixture(df, targets.limit(0)).count() == 0
