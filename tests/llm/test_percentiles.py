import datetime as dt
import math
import random

import numpy as np

from thicket.llm import percentiles as p

SCHEMA = "record_id long, subsystem string, operation string, durationms double, rssdeltabytes long, logged_at timestamp_ntz, p string, n long, v string"


def exact(values, percent):
    v = sorted(values)
    return v[max(1, -(-percent * len(v) // 100)) - 1]


def rows(groups):
    out, i = [], 0
    for (sub, op), values in groups.items():
        for d, r in values:
            i += 1
            out.append((i, sub, op, d, r, dt.datetime(2026, 1, 1 + i % 5), "x", i, None))
    return out


def test_compress_keeps_rank_bound():
    rnd = np.random.default_rng(3)
    bits, k = 10, 64
    leaves, n = np.unique(rnd.zipf(1.3, 20_000) % 1024, return_counts=True)
    g, level, index, c = p.compress(np.zeros(len(leaves), "int64"), np.zeros(len(leaves), "int64"), leaves, n, bits, k)
    assert c.sum() == 20_000 and len(c) <= 3 * k and (g == 0).all()
    first, last = index << level, ((index + 1) << level) - 1
    for leaf in range(0, 1024, 7):
        true = n[leaves <= leaf].sum()
        assert c[last <= leaf].sum() <= true <= c[first <= leaf].sum()
        assert c[first <= leaf].sum() - c[last <= leaf].sum() <= bits * 20_000 / k


def test_keys_keep_order():
    import pandas as pd

    v = [-math.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 2.0**60, math.inf]
    keys = p._double_keys(pd.Series(v)).to_numpy("int64")
    assert (np.diff(keys) >= 0).all() and keys[4] == keys[5]
    assert p.key_double(keys).tolist() == v
    assert p._double_keys(pd.Series([None, math.nan])).isna().all()


def test_brackets_and_exact(spark):
    rnd = random.Random(4)
    groups = {("a", "x"): [(rnd.lognormvariate(0, 3), rnd.randrange(-10**9, 10**9)) for _ in range(700)], ("a", None): [(5.0, 7)] * 60, ("b", "y"): [(float(i % 3), i) for i in range(55)]}
    df = spark.createDataFrame(rows(groups), SCHEMA)
    for r in p.report(df, (50, 99), bits=18).collect():
        values = [v[0 if r.measure == "durationms" else 1] for v in groups[(r.subsystem, r.operation)]]
        assert r.n == len(values) and r.low <= exact(values, r.percent) <= r.high
    got = {(r.measure, r.subsystem, r.operation, r.percent): r.value for r in p.settled(df, (1, 50, 95, 100)).collect()}
    for (m, s, o, q), value in got.items():
        assert value == exact([v[0 if m == "durationms" else 1] for v in groups[(s, o)]], q)
    assert len(got) == 24


def test_days_merge_into_the_same_bound(spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([(i % 7, rnd.randrange(2**40)) for i in range(6000)], "day int, v long").selectExpr("'g' as g", "day", "v << 20 as v")
    bits, k = 20, 32
    merged = p.merge(p.digest(df, ["g", "day"], "v", bits, k), ["g"], bits, k)
    assert merged.count() <= 3 * k
    values = sorted(r.v for r in df.collect())
    for r in p.bounds(merged, ["g"], (10, 50, 90), bits).collect():
        assert r.n == 6000 and r.low <= values[r["rank"] - 1] <= r.high
        inside = sum(r.low <= v <= r.high for v in values)
        assert inside <= 2 * bits * 6000 / k + 6000 / k + 1


def test_found_cases_and_dirt(spark):
    groups = {
        (" Slow ", "OP"): [(1.0, 0)] * 40 + [(11.0, 0)] * 20,
        ("slow", "op"): [(None, None), (math.nan, None), (-5.0, None)],
        ("edge", "op"): [(1.0, 16_777_216)] * 50 + [(10.0, 16_777_216)] * 10,
        ("grown", "op"): [(None, 16_777_217)] * 50,
        ("few", "op"): [(1.0, 2**30)] * 26 + [(100.0, 2**30)] * 23,
    }
    data = rows(groups)
    # Repeats of whole rows count once; rows of one id that differ in a null count each.
    data += data[-49:] + [data[-1][:-1] + ("other",)]
    found = {tuple(r) for r in p.found_slow_or_growing(spark.createDataFrame(data, SCHEMA)).collect()}
    assert found == {("durationms", "slow", "op"), ("rssdeltabytes", "grown", "op"), ("durationms", "few", "op"), ("rssdeltabytes", "few", "op")}
    assert p.found_slow_or_growing(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_brackets_are_joined_apart_from_hot_groups(spark, monkeypatch):
    rnd = random.Random(9)
    groups = {("hot", "x"): [(rnd.random() * 100, rnd.randrange(1000)) for _ in range(900)], ("hot", None): [(rnd.random(), 5) for _ in range(300)]}
    groups |= {(f"s{i}", "y"): [(rnd.random(), i)] * 3 for i in range(40)}
    df = spark.createDataFrame(rows(groups), SCHEMA)
    key = lambda r: (r.measure, r.subsystem, r.operation or "", r.percent, r.n, r.value)
    by_broadcast = sorted(key(r) for r in p.settled(df, (50, 95)).collect())
    monkeypatch.setattr(p, "small", lambda *_: False)
    assert sorted(key(r) for r in p.settled(df, (50, 95)).collect()) == by_broadcast and len(by_broadcast) == 42 * 2 * 2
