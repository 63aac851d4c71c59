import random
from collections import defaultdict

from thicket.operators import hierarchy as module
from thicket.operators import skew
from thicket.operators.hierarchy import all_descendants, descendants, found_cycles, hierarchy, set_aside


def brute_cycles(links):
    """Tarjan's algorithm without recursion."""
    out = defaultdict(list)
    for s, t in set(links):
        out[s].append(t)
    index, low, on, stack, result = {}, {}, set(), [], set()
    for start in {x for p in links for x in p}:
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1 or v in out[v]:
                        result |= {(min(part), x) for x in part}
    return result


def edges_df(spark, rows):
    return spark.createDataFrame([(i, s, t, "x") for i, (s, t) in enumerate(rows)], "id long, source string, target string, kind string")


def cycles(spark, rows, one_task=20_000):
    return {tuple(r) for r in found_cycles(edges_df(spark, rows), one_task=one_task).collect()}


def test_cycles_random(spark):
    rnd = random.Random(5)
    for n, m, one_task in ((40, 60, 0), (60, 62, 20_000), (30, 90, 20_000)):
        rows = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)]
        assert cycles(spark, rows, one_task) == brute_cycles(rows)


def test_cycles_shapes(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 37}") for i in range(37)] + [("r5", "tail0"), ("tail0", "tail1"), ("tail1", "tail2")]
    long = [(f"p{i}", f"p{i + 1}") for i in range(50)]
    joined = [("a", "b"), ("b", "c"), ("c", "a"), ("root", "a"), ("root", "b"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "e"), ("z", "z")]
    rows = ring + long + joined + joined
    assert cycles(spark, rows, 0) == brute_cycles(rows)
    dense = [(f"k{i}", f"k{j}") for i in range(5) for j in range(5) if i != j] + [("k1", "m"), ("m", "k2")]
    assert cycles(spark, dense, 0) == brute_cycles(dense)


def test_cycles_odd_rows(spark):
    assert cycles(spark, []) == set()
    rows = [(None, "a"), ("a", None), ("a", "a"), ("", "b"), ("b", "")]
    assert {tuple(r) for r in found_cycles(edges_df(spark, rows)).collect()} == {("a", "a"), ("", ""), ("", "b")}


def test_hierarchy_against_brute_force(spark):
    rnd = random.Random(11)
    parent = {i: rnd.randrange(max(0, i - 4), i) if rnd.random() < 0.9 else (0 if i else None) for i in range(1, 120)}
    parent |= {200 + i: 3 for i in range(40)}  # a hot parent
    rows = [(f"n{p}", f"n{c}") for c, p in parent.items() if p is not None]
    names = sorted({x for r in rows for x in r}) + ["alone"]
    nodes = spark.createDataFrame([(x, "source") for x in names], "id string, source string")
    tree = hierarchy(nodes, edges_df(spark, rows)).cache()
    got = {r.node_id: r for r in tree.collect()}
    up = {c: p for p, c in rows}

    def path(x):
        return (path(up[x]) if x in up else []) + [x]

    paths = {x: path(x) for x in names}
    below = defaultdict(set)
    for x, p in paths.items():
        for a in p[:-1]:
            below[a].add(x)
    assert set(got) == set(names)
    for x in names:
        r = got[x]
        assert (list(r.path), r.depth, r.root_id, r.n_descendants) == (paths[x], len(paths[x]) - 1, paths[x][0], len(below[x]))
        inside = {y for y in names if paths[y][0] == r.root_id and r.first_descendant <= got[y].preorder <= r.last_descendant}
        assert inside == below[x]
    pairs = {(r.ancestor_id, r.node_id) for r in descendants(tree).collect()}
    assert pairs == {(a, x) for a in below for x in below[a]}


def test_hierarchy_with_cycles(spark):
    rows = [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "leaf"), ("x", "y"), ("y", "x"), ("s", "s"), ("late", "leaf")]
    nodes = spark.createDataFrame([(x,) for x in ["r", "a", "b", "c", "leaf", "x", "y", "s", "late", None]], "id string")
    got = {r.node_id: r for r in hierarchy(nodes, edges_df(spark, rows)).collect()}
    assert {k for k, r in got.items() if r.in_cycle} == {"a", "b", "c", "x", "y", "s"}
    assert list(got["a"].path) == ["r", "a"] and got["b"].depth == 0 and list(got["leaf"].path) == ["c", "leaf"]
    assert got[None].depth == 0
    assert hierarchy(nodes.limit(0), edges_df(spark, [])).count() == 0


def test_ladders_of_two_parent_nodes_take_few_rounds(spark, monkeypatch):
    n = 5_000
    ring = [(f"r{i}", f"r{(i + d) % n}") for i in range(n) for d in (1, 2)]
    ladder = [(f"{x}{i}", f"{y}{i + 1}") for i in range(n) for x in "ab" for y in "ab"]  # on no cycle
    rounds, real = [], module._coloured
    monkeypatch.setattr(module, "_coloured", lambda e: rounds.append(e.count()) or real(e))
    written, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: written.append(1) or cut(df))
    assert cycles(spark, ring + ladder, 2_000) == {("r0", f"r{i}") for i in range(n)}
    assert not rounds and len(written) < 200


def test_cycles_are_the_same_on_each_side_of_the_threshold(spark):
    rnd = random.Random(8)
    for n, m in ((30, 70),):
        rows = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)]
        edges, names = module.keyed(edges_df(spark, rows), "source", "target")
        by_task = {tuple(r) for r in found_cycles(edges_df(spark, rows), one_task=10_000).collect()}
        assert by_task == brute_cycles(rows)
        for one_task in (0, 12):
            labels = module._eliminated(edges.filter("s <> t"), one_task).join(names, "k").collect()
            parts = defaultdict(set)
            for r in labels:
                parts[r.scc].add(r.id)
            assert {(min(p), x) for p in parts.values() for x in p} == {x for x in by_task if sum(y[0] == x[0] for y in by_task) > 1}


def test_ids_of_one_hash_are_told_apart(spark, monkeypatch):
    real = module.F.xxhash64

    def poor(*columns):  # few hashes for ids; offers of keys stay as they are
        return module.F.pmod(real(*columns), module.F.lit(7)) if len(columns) == 1 else real(*columns)

    rnd = random.Random(2)
    rows = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(60)] + [(None, "n1")]
    monkeypatch.setattr(module.F, "xxhash64", poor)
    edges, names = module.keyed(edges_df(spark, rows), "source", "target")
    name = {r.k: r.id for r in names.collect()}
    links = {(name[r.s], name[r.t]) for r in edges.collect()}
    monkeypatch.undo()
    assert links == {r for r in rows if r[0]} and len(set(name.values())) == len(name)


def test_all_descendants_and_links_set_aside(spark):
    rnd = random.Random(4)
    rows = [(f"n{rnd.randrange(i)}", f"n{i}") for i in range(1, 60)] + [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(9)] + [("n5", "n5"), ("ghost", "n7")]
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(60)] + [("alone",), (None,)], "id string")
    out = defaultdict(set)
    for s, t in rows:
        out[s].add(t)
    brute = set()
    for start in {x for r in rows for x in r}:
        seen, todo = set(), [start]
        while todo:
            for y in out[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        brute |= {(start, y) for y in seen if y != start}
    got = [tuple(r) for r in all_descendants(nodes, edges_df(spark, rows)).collect()]
    assert set(got) == brute and len(got) == len(brute)
    aside = {(r.source_id, r.target_id) for r in set_aside(edges_df(spark, rows)).collect()}
    parent = {r.node_id: r.parent_id for r in hierarchy(module.every_id(nodes, edges_df(spark, rows)), edges_df(spark, rows)).collect()}
    assert aside == {(s, t) for s, t in set(rows) if parent[t] != s}
    assert all_descendants(nodes, edges_df(spark, [])).count() == 0


def test_running_totals_have_one_order_at_every_size(spark):
    df = spark.createDataFrame([(i % 3, i % 50, i) for i in range(900)], "k int, o int, v long")
    whole = {(r.k, r.v): r.before for r in skew.running_totals(df, ["k"], ["o", "v"], module.F.col("v")).collect()}
    cut_up = {(r.k, r.v): r.before for r in skew.running_totals(df, ["k"], ["o", "v"], module.F.col("v"), rows_a_bucket=20).collect()}
    assert whole == cut_up
    ordered = {(r.k, r.v): (r.before, r.most) for r in skew.ordered_totals(skew.ordered_totals(df, ["k"], [module.F.col("o").desc(), module.F.col("v")]), ["k"], [module.F.col("v")], module.F.col("o"), "most", most=True).collect()}
    for k in range(3):
        rows = sorted(((i % 50, i) for i in range(900) if i % 3 == k), key=lambda x: (-x[0], x[1]))
        for place, (o, v) in enumerate(rows):
            before = [i % 50 for i in range(v) if i % 3 == k]
            assert ordered[(k, v)] == (place, max(before) if before else None)
    import statistics

    got = {(r.k, r.percent): r.x for r in skew.exact_percentiles(df.withColumn("v", module.F.col("v").cast("double")), ["k"], "v", (50, 90), between=True).collect()}
    for k in range(3):
        assert got[(k, 50.0)] == statistics.median(i for i in range(900) if i % 3 == k)
    disc = {(r.k, r.percent): r.x for r in skew.exact_percentiles(df, ["k"], "v", (0, 50, 100)).collect()}
    assert (disc[(0, 0.0)], disc[(0, 50.0)], disc[(0, 100.0)]) == (0, 447, 897)
