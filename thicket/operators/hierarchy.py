"""Trees of unknown depth from parent-child rows: cycle separation, then heavy-path decomposition.

Every loop below runs a number of rounds logarithmic in the depth of the data: pointers double, or chains of heavy children,
of which any root path crosses logarithmically many, are joined level by level. All states are narrow tables of 8-byte keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.skew import lookup, running_totals
from thicket.session import cut, drop_cut


def keyed(links: DataFrame, source: str, target: str, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Distinct links as (s, t) of 64-bit keys, and the names of all ids, as (k, id).

    A key is a hash of the id. Ids that share a hash, few at any size, are told by a second hash and get keys of their own: the first free ones, by the ids' order, of
    a run of hashes of hash and place, so that keys stay one to one. Links with a null end are left out."""
    links = links.select(F.col(source).alias("sid"), F.col(target).alias("tid")).filter("sid is not null and tid is not null")
    ids = links.select(F.col("sid").alias(id_col)).unionByName(links.select(F.col("tid").alias(id_col)))
    names = cut(ids.select(F.xxhash64(id_col).alias("k"), id_col).groupBy("k").agg(F.min(id_col).alias(id_col), (F.min(id_col) != F.max(id_col)).alias("clash")))
    clashing = names.filter("clash")
    if clashing.isEmpty():
        return cut(links.select(F.xxhash64("sid").alias("s"), F.xxhash64("tid").alias("t")).distinct()), names.drop("clash")
    return _keyed_apart(links, ids, names, id_col)


def _keyed_apart(links: DataFrame, ids: DataFrame, names: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """keyed() where hashes clash: the ids of such hashes, a table of the clashes alone, are given the keys that no id has."""
    bad = names.filter("clash").select("k")
    those = cut(ids.select(F.xxhash64(id_col).alias("k"), id_col).join(bad, "k", "left_semi").distinct())
    place = F.row_number().over(Window.partitionBy("k").orderBy(id_col))
    named, taken, rest, turn = None, names.select("k"), those.withColumn("place", place), 0
    while named is None or not rest.isEmpty():
        # Each round offers every id left another key; those that are free and asked for once are given.
        offer = rest.withColumn("new", F.xxhash64(F.lit(turn), "k", "place"))
        once = offer.groupBy("new").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("new")
        given = cut(offer.join(once, "new", "left_semi").join(taken.select(F.col("k").alias("new")), "new", "left_anti").select("new", "k", "place", id_col))
        named = given if named is None else named.unionByName(given)
        taken = taken.unionByName(given.select(F.col("new").alias("k")))
        rest, turn = cut(rest.join(given.select("k", "place"), ["k", "place"], "left_anti")), turn + 1
    own = cut(names.filter("not clash").select("k", id_col).unionByName(named.select(F.col("new").alias("k"), id_col)))
    apart = named.select(F.col(id_col).alias("_id"), F.col("new").alias("_new"))
    key = lambda df, c, out: lookup(df.withColumnRenamed(c, "_id"), apart, "_id").select(*[x for x in df.columns if x != c], F.coalesce("_new", F.xxhash64("_id")).alias(out))
    return cut(key(cut(key(links, "sid", "s")), "tid", "t").select("s", "t").distinct()), own


#: Links that one task may search for cycles; beyond it pointers are doubled.
ONE_TASK = 20_000
#: A graph that keeps more than this share of its links when single-parent nodes are passed over goes another way.
SHRINKS = 0.7
#: Links past a node that may take its place.
FEW = 16


def cycle_members(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(k, scc) for each node that reaches itself over the distinct links (s, t); scc is the same number for nodes that reach each other.

    A node with one parent can only lie on a cycle through that parent, so its pointer is doubled up to the next node with several
    parents (a junction), a root, or round a cycle of single-parent nodes. What is left is a smaller graph of junctions, treated
    likewise, with links turned round every other time, until it has at most `one_task` links, which one task searches. A larger graph
    that no longer shrinks so loses nodes of few links, a part of them a round, to links past them; what is then left has many links a node, so it is
    shallow, and is coloured and searched backward. Cycles are carried back to the nodes passed over. All ways give the same rows."""
    loops = edges.filter("s = t").select(F.col("s").alias("k"), F.col("s").alias("scc"))
    inner = edges.filter("s <> t")
    core = _trim(inner)
    if core is None:
        return cut(loops)
    found = _components(core, 0, one_task)
    # A loop on a node of a larger cycle adds nothing.
    return cut(found.unionByName(loops.join(found, "k", "left_anti")))


def _trim(edges: DataFrame) -> DataFrame | None:
    """Links whose target has links out and whose source has links in; None if there are none."""
    sources, targets = edges.select(F.col("s").alias("t")).distinct(), edges.select(F.col("t").alias("s")).distinct()
    kept = cut(edges.join(sources, "t", "left_semi").join(targets, "s", "left_semi").select("s", "t"))
    return None if kept.isEmpty() else kept


def _components(edges: DataFrame, level: int, one_task: int, stalled: bool = False) -> DataFrame:
    """(k, scc) of the cycles of two nodes or more in a graph without loops."""
    size = edges.count()
    if size <= one_task:
        return cut(edges.coalesce(1).mapInPandas(_tarjan, "k long, scc long"))
    if stalled:
        return _eliminated(edges, one_task)
    e = edges.select(F.col("t").alias("s"), F.col("s").alias("t")) if level % 2 else edges
    parents = cut(e.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("p")))
    single = parents.filter("n = 1").select(F.col("t").alias("k"), F.col("p").alias("up"))
    # A pointer of one step for each single-parent node, done once it is at a junction or root; `low` is the smallest key stepped over.
    first = single.join(single.select(F.col("k").alias("up"), F.lit(False).alias("done")), "up", "left")
    whole = cut(first.select("k", "up", F.col("k").alias("low"), F.coalesce("done", F.lit(True)).alias("done"), F.lit(True).alias("same")))
    ends, steps, pure, active, image = whole.filter("done").select("k", "up"), [], None, -1, -1
    state = whole.filter("not done")
    left = state.count()
    while left:
        steps.append(state.select("k", "up"))
        to = state.select(F.col("k").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"), F.lit(False).alias("done2"))
        to = to.unionByName(ends.select(F.col("k").alias("up"), F.col("up").alias("up2"), F.lit(None).cast("long").alias("low2"), F.lit(True).alias("done2")))
        joined = cut(state.select("k", "up", "low").join(to, "up").select("k", F.col("up2").alias("up"), F.least("low", "low2").alias("low"), F.col("done2").alias("done"), (F.col("low") <= F.col("low2")).alias("same")))
        ends = ends.unionByName(joined.filter("done").select("k", "up"))
        state, active = joined.filter("not done"), left
        left = state.count()
        if left == active:
            # Nothing ends any more: all that is left runs round cycles or hangs below them. What pointers reach is on them once it is no fewer.
            on = cut(state.select(F.col("up").alias("k")).distinct())
            now = on.count()
            state = cut(state.join(on, "k", "left_semi"))
            left = state.count()
            if now == image and left == now and state.filter("not same").isEmpty():
                pure = state.select("k", F.col("low").alias("scc"))
                break
            image = now
    out = pure
    junctions = parents.filter("n > 1").select(F.col("t").alias("k"))
    if not junctions.isEmpty():
        at = lambda c: junctions.select(F.col("k").alias(c))
        into = e.join(at("t"), "t", "left_semi")
        # The junction above each link into a junction: the source itself, or where its pointer ended.
        direct = into.join(at("s"), "s", "left_semi").select("s", "t", F.col("s").alias("a"))
        over = into.join(ends.select(F.col("k").alias("s"), F.col("up").alias("a")), "s").join(at("a"), "a", "left_semi")
        links = cut(direct.unionByName(over.select("s", "t", "a")))
        own = links.filter("a = t").select(F.col("t").alias("k"), F.col("t").alias("scc"))
        core = _trim(links.filter("a <> t").select(F.col("a").alias("s"), "t").distinct())
        found = own.distinct()
        if core is not None:
            deeper = _components(core, level + 1, one_task, core.count() > SHRINKS * size)
            found = found.join(deeper, "k", "left_anti").unionByName(deeper)
        found = cut(found)
        # Links inside one cycle; the single-parent nodes from their source up to the junction are on it too.
        inside = links.join(found.select(F.col("k").alias("t"), "scc"), "t").join(found.select(F.col("k").alias("a"), F.col("scc").alias("scc_a")), "a")
        marked = cut(inside.filter("scc = scc_a and s <> a").select(F.col("s").alias("k"), "scc").distinct())
        for step in steps:
            marked = cut(marked.unionByName(marked.join(step, "k").select(F.col("up").alias("k"), "scc")).distinct())
        out = found.unionByName(marked) if out is None else out.unionByName(found).unionByName(marked)
    return edges.select(F.col("s").alias("k"), F.col("t").alias("scc")).filter(F.lit(False)) if out is None else cut(out.distinct())


def _eliminated(edges: DataFrame, one_task: int) -> DataFrame:
    """(k, scc) by taking out nodes whose links past them, from each source to each target, are no more than the links they have, or than FEW.

    No two nodes that a link joins go in one round: of those that could, the ones with the least hash of that round among their neighbours do. That is a fixed share of a
    graph of few links a node on average, so rounds follow the logarithm of its size, whatever its depth. A node that was taken out is on the cycle of a source
    and a target of it that are on one, or the same."""
    e, taken, turn = cut(edges), [], 0
    first = None
    while True:
        size = e.count()
        first = first or size
        if size <= one_task:
            found = e.coalesce(1).mapInPandas(_tarjan, "k long, scc long") if size else e.select(F.col("s").alias("k"), F.col("t").alias("scc"))
            break
        ins, outs = e.groupBy(F.col("t").alias("k")).agg(F.count(F.lit(1)).alias("i")), e.groupBy(F.col("s").alias("k")).agg(F.count(F.lit(1)).alias("o"))
        degrees = ins.join(outs, "k", "full").select("k", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("o", F.lit(0)).alias("o"))
        free = cut(degrees.filter(f"i * o <= greatest(i + o, {FEW})").select("k", F.xxhash64(F.lit(turn), "k").alias("h"), (F.col("i") * F.col("o") == 0).alias("end")))
        at = lambda c: free.select(F.col("k").alias(c), F.struct("h", "k").alias(f"h{c}"))
        pairs = e.join(at("s"), "s").join(at("t"), "t")
        beaten = pairs.select(F.when(F.col("hs") < F.col("ht"), F.col("t")).otherwise(F.col("s")).alias("k")).distinct()
        # Nodes without sources or without targets are on no cycle; they may all go.
        go = cut(free.filter("end").select("k").unionByName(free.filter("not end").join(beaten, "k", "left_anti").select("k")))
        if go.isEmpty() or size > 2 * first:
            found = _coloured(e)
            break
        into = cut(e.join(go.select(F.col("k").alias("t")), "t", "left_semi").select(F.col("t").alias("k"), F.col("s").alias("a")))
        out = cut(e.join(go.select(F.col("k").alias("s")), "s", "left_semi").select(F.col("s").alias("k"), F.col("t").alias("b")))
        rest = e.join(go.select(F.col("k").alias("s")), "s", "left_anti").join(go.select(F.col("k").alias("t")), "t", "left_anti")
        past = into.join(free.filter("not end").select("k"), "k", "left_semi").join(out, "k")
        loops = cut(past.filter("a = b").select("k", F.col("a").alias("on")))
        nxt = cut(rest.unionByName(past.filter("a <> b").select(F.col("a").alias("s"), F.col("b").alias("t"))).distinct())
        taken.append((into, out, loops))
        drop_cut(e, free, go)
        e, turn = nxt, turn + 1
    labels = cut(found)  # nodes that are on no cycle have none
    for into, out, loops in reversed(taken):
        a = into.join(labels.select(F.col("k").alias("a"), F.col("scc").alias("sa")), "a").select("k", "sa")
        b = out.join(labels.select(F.col("k").alias("b"), F.col("scc").alias("sb")), "b").select("k", "sb")
        inside = a.join(b, "k").filter("sa = sb").select("k", F.col("sa").alias("scc"))
        # A source that is a target too: the node is on its cycle, or makes one with it.
        mutual = loops.join(labels.select(F.col("k").alias("on"), "scc"), "on", "left").select("k", "on", F.coalesce("scc", "on").alias("scc"))
        mine = inside.unionByName(mutual.select("k", "scc")).unionByName(mutual.select(F.col("on").alias("k"), "scc")).distinct()
        labels = cut(labels.unionByName(mine).distinct())
    return labels


def _tarjan(batches):
    """Strongly connected components of a checked, bounded number of links, in one task."""
    import pandas as pd

    out: dict[int, list[int]] = {}
    for batch in batches:
        for s, t in zip(batch["s"].tolist(), batch["t"].tolist()):
            out.setdefault(s, []).append(t)
    index, low, on, stack, rows = {}, {}, set(), [], []
    for start in out:
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    at = len(stack) - 1
                    while stack[at] != v:
                        at -= 1
                    part = stack[at:]
                    del stack[at:]
                    on.difference_update(part)
                    if len(part) > 1:
                        rows += [(k, min(part)) for k in part]
    yield pd.DataFrame(rows, columns=["k", "scc"], dtype="int64")


def _coloured(edges: DataFrame) -> DataFrame:
    """Cycles of a graph whose nodes all have several parents and children: each node takes the smallest key that reaches it, and is on
    that key's cycle if it reaches it within its colour; what is on none is coloured again."""
    out = None
    e = cut(edges)
    while True:
        nodes = e.select(F.col("s").alias("k")).union(e.select("t")).distinct()
        state = cut(nodes.withColumn("c", F.col("k")))
        while True:
            come = e.join(state.withColumnRenamed("k", "s"), "s").groupBy(F.col("t").alias("k")).agg(F.min("c").alias("come"))
            nxt = cut(state.join(come, "k", "left").select("k", F.least("c", "come").alias("c"), (F.col("come") < F.col("c")).alias("moved")))
            moved = not nxt.filter("moved").isEmpty()
            drop_cut(state)
            state = nxt.select("k", "c")
            if not moved:
                break
        same = cut(e.join(state.select(F.col("k").alias("s"), F.col("c").alias("cs")), "s").join(state.select(F.col("k").alias("t"), "c"), "t").filter("c = cs").select("s", "t", "c"))
        back = cut(state.filter("k = c").select("k", "c"))
        reached, front = back, back
        while True:
            more = same.join(front.select(F.col("k").alias("t")), "t", "left_semi").select(F.col("s").alias("k"), "c").distinct()
            front = cut(more.join(reached, "k", "left_anti"))
            if front.isEmpty():
                break
            reached = cut(reached.unionByName(front))
        sizes = reached.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = cut(reached.join(sizes, "c", "left_semi").select("k", F.col("c").alias("scc")))
        out = found if out is None else out.unionByName(found)
        rest = e.join(reached.select(F.col("k").alias("s")), "s", "left_anti").join(reached.select(F.col("k").alias("t")), "t", "left_anti")
        kept = _trim(rest)
        if kept is None:
            return cut(out)
        e = kept


def found_cycles(links: DataFrame, source: str = "source", target: str = "target", one_task: int = ONE_TASK) -> DataFrame:
    """(cycle_id, node_id) for every node that reaches itself; cycle_id is the smallest id of those it reaches and is reached from.

    Null ends are left out; repeated links count once; a self-link is a cycle of one; an empty table gives nothing."""
    rows = links.select(F.col(source).alias("s"), F.col(target).alias("t")).filter("s is not null and t is not null")
    # Only nodes with links both ways can lie on a cycle, and few have both.
    inner = rows.join(rows.select(F.col("s").alias("t")).distinct(), "t", "left_semi")
    edges, names = keyed(inner, "s", "t")
    members = cycle_members(edges, one_task)
    named = cut(members.join(names, "k").select("scc", F.col("id").alias("node_id")))
    least = named.groupBy("scc").agg(F.min("node_id").alias("cycle_id"))
    return lookup(named, least, "scc", "inner").select("cycle_id", "node_id")


def forest(links: DataFrame, source: str = "source", target: str = "target", order: str = "id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(parents, names, cycles, edges): one parent for each node that has any, as (k, p) without cycles; (k, id); (k, scc); all distinct links (s, t).

    Links between nodes of one cycle are set aside. Of several parents the one whose link has the smallest `order` is kept,
    ties by key; the others are in set_aside()."""
    rows = links.filter(F.col(source).isNotNull() & F.col(target).isNotNull())
    edges, names = keyed(rows, source, target)
    cycles = cycle_members(edges)
    ids = names.withColumnRenamed("id", "_id")
    first = rows.groupBy(F.col(source).alias("_s"), F.col(target).alias("_t")).agg(F.min(order).alias("_o"))
    first = lookup(cut(first), ids.select(F.col("_id").alias("_s"), F.col("k").alias("s")), "_s", "inner")
    first = lookup(cut(first.select("s", "_t", "_o")), ids.select(F.col("_id").alias("_t"), F.col("k").alias("t")), "_t", "inner").select("s", "t", "_o")
    if not cycles.isEmpty():
        first = first.join(cycles.select(F.col("k").alias("t"), F.col("scc").alias("ct")), "t", "left").join(cycles.select(F.col("k").alias("s"), F.col("scc").alias("cs")), "s", "left")
        first = first.filter("not (ct <=> cs) or ct is null").select("s", "t", "_o")
    parents = cut(first.groupBy(F.col("t").alias("k")).agg(F.min(F.struct("_o", "s"))["s"].alias("p")))
    return parents, names, cycles, edges


def heavy_paths(parents: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heavy-path decomposition of a forest given as (k, p).

    Returns (inner, leaves). inner: a row for each node with children: k, head (its chain's first node), at (its place in the chain),
    size (nodes below it and itself), up (array of ids from the root to it), root (key), pre (its number in the root's preorder, heavy child first).
    leaves: k, p for each node without children but with a parent."""
    kids = parents.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    inner_keys = cut(kids.select(F.col("p").alias("k"), "n"))
    has = inner_keys.select("k")
    inner_up = cut(parents.join(has, "k", "left_semi"))
    leaves = cut(parents.join(has, "k", "left_anti"))
    leaf_kids = leaves.groupBy(F.col("p").alias("k")).agg(F.count(F.lit(1)).alias("l"))

    # Subtree sizes: the descendants at a distance below 2^(i+1) are those below 2^i and those below 2^i of each node 2^i steps under.
    state = cut(has.join(leaf_kids, "k", "left").join(inner_up, "k", "left").select("k", F.col("p").alias("anc"), (F.lit(1) + F.coalesce("l", F.lit(0))).cast("long").alias("size")))
    while not state.filter("anc is not null").isEmpty():
        below = state.filter("anc is not null").groupBy(F.col("anc").alias("k")).agg(F.sum("size").alias("more"))
        up = lookup(state.filter("anc is not null"), state.select(F.col("k").alias("anc"), F.col("anc").alias("anc2")), "anc").select("k", F.col("anc2").alias("anc"), "size")
        nxt = cut(up.unionByName(state.filter("anc is null").select("k", "anc", "size")).join(below, "k", "left").select("k", "anc", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        drop_cut(state)
        state = nxt
    sizes = state.select("k", "size")

    # The heavy child is the largest inner child; leaves are chains of their own.
    sized = cut(inner_up.join(sizes, "k"))
    heavy = sized.groupBy("p").agg(F.max(F.struct("size", "k")).alias("h")).select("p", F.col("h.k").alias("k"), F.col("h.size").alias("heavy_size"))
    heavy = cut(heavy)
    light = cut(sized.join(heavy.select("k"), "k", "left_anti"))
    # An inner child comes after its parent, the heavy child's subtree and its lighter brothers before it.
    light = running_totals(light, ["p"], ["k"], F.col("size"), "brothers")
    offsets = cut(light.join(heavy.select("p", "heavy_size"), "p", "left").select("k", "p", (F.lit(1) + F.coalesce("heavy_size", F.lit(0)) + F.col("brothers")).alias("offset")))
    drop_cut(sized)

    # Chains: double along heavy links until the head.
    chain = cut(has.join(heavy.select("k", F.col("p").alias("anc")), "k", "left").select("k", "anc", F.coalesce("anc", "k").alias("head"), F.when(F.col("anc").isNull(), 0).otherwise(1).cast("long").alias("at")))
    while True:
        nxt = chain.select(F.col("k").alias("anc"), F.col("anc").alias("anc2"), F.col("head").alias("head2"), F.col("at").alias("at2"))
        more = chain.filter("anc is not null")
        if more.isEmpty():
            break
        joined = more.join(nxt, "anc", "left").select("k", F.col("anc2").alias("anc"), F.col("head2").alias("head"), (F.col("at") + F.col("at2")).alias("at"))
        new = cut(joined.unionByName(chain.filter("anc is null")))
        drop_cut(chain)
        chain = new
    nodes = cut(chain.select("k", "head", "at").join(names, "k"))
    # A chain's nodes in order: no longer than the path of its last node.
    segments = cut(nodes.groupBy("head").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("segment")))

    # Chains by the number of light links above them: each level gets its prefix from the level before.
    hung = cut(offsets.join(chain.select(F.col("k").alias("p"), F.col("head").alias("over"), F.col("at").alias("over_at")), "p").select(F.col("k").alias("head"), "over", "over_at", "offset").join(segments, "head"))
    roots = segments.join(offsets.select(F.col("k").alias("head")), "head", "left_anti")
    level = cut(roots.select("head", "segment", F.array().cast("array<string>").alias("prefix"), F.col("head").alias("root"), F.lit(0).cast("long").alias("pre")))
    done = level
    while True:
        front = level.select(F.col("head").alias("over"), F.col("segment").alias("s2"), F.col("prefix").alias("p2"), "root", F.col("pre").alias("pre2"))
        below = lookup(hung, front, "over", "inner").select("head", "segment", F.concat("p2", F.slice("s2", F.lit(1), (F.col("over_at") + 1).cast("int"))).alias("prefix"), "root", (F.col("pre2") + F.col("over_at") + F.col("offset")).alias("pre"))
        level = cut(below)
        if level.isEmpty():
            break
        done = done.unionByName(level)
    chains = cut(done)
    placed = lookup(cut(chain.select("k", "head", "at").join(sizes, "k")), chains, "head", "inner")
    inner = placed.select("k", "head", "at", "size", F.concat("prefix", F.slice("segment", F.lit(1), (F.col("at") + 1).cast("int"))).alias("up"), "root", (F.col("pre") + F.col("at")).alias("pre"))
    first_leaf = sizes.join(leaf_kids, "k", "left").select("k", (F.col("size") - F.coalesce("l", F.lit(0))).alias("leaf_offset"))
    return cut(inner.join(first_leaf, "k")), leaves


def hierarchy(nodes: DataFrame, links: DataFrame, node_id: str = "id", source: str = "source", target: str = "target", order: str = "id") -> DataFrame:
    """For each row of nodes: node_id, parent_id, root_id, depth, path (array of ids from the root to the node), n_descendants,
    first_descendant and last_descendant (the interval of preorder numbers below the node's own; empty if last < first), preorder, in_cycle.

    Ids that only links name still count as parents and roots. Links inside a cycle are set aside, so a member of a cycle hangs from a
    parent outside it or is a root. Of several parents the earliest stored link's is kept; what that leaves out is in set_aside() and all_descendants(). Nodes without links are roots. Null ids come
    out as roots without descendants; repeated ids as repeated rows; an empty table gives nothing."""
    parents, names, cycles, _ = forest(links, source, target, order)
    inner, leaves = heavy_paths(parents, names)
    ranked = running_totals(leaves, ["p"], ["k"], None, "rank")
    over = inner.select(F.col("k").alias("p"), F.col("up").alias("over"), "root", F.col("pre").alias("pre_p"), "leaf_offset")
    low = lookup(cut(ranked), over, "p", "inner").select("k", "over", "root", F.lit(1).cast("long").alias("size"), (F.col("pre_p") + F.col("leaf_offset") + F.col("rank")).alias("pre"), F.lit(True).alias("leaf"))
    high = inner.select("k", F.col("up").alias("over"), "root", "size", "pre", F.lit(False).alias("leaf"))
    rooted = high.unionByName(low)
    flags = cycles.select("k", F.lit(True).alias("in_cycle"))
    placed = names.join(rooted, "k", "left").join(flags, "k", "left").drop("k", "root")
    mine = nodes.select(F.col(node_id).alias("id"))
    all_rows = mine.join(placed, "id", "left")
    path = F.when(F.col("over").isNull(), F.array("id")).when(F.col("leaf"), F.concat("over", F.array("id"))).otherwise(F.col("over"))
    out = all_rows.withColumn("path", path)
    size, pre = F.coalesce("size", F.lit(1)), F.coalesce("pre", F.lit(0))
    return out.select(
        F.col("id").alias("node_id"),
        F.when(F.size("path") > 1, F.element_at("path", -2)).alias("parent_id"),
        F.element_at("path", 1).alias("root_id"),
        (F.size("path") - 1).alias("depth"),
        "path",
        (size - 1).alias("n_descendants"),
        pre.alias("preorder"),
        (pre + 1).alias("first_descendant"),
        (pre + size - 1).alias("last_descendant"),
        F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
    )


#: Preorder numbers of an interval that one row of a block names.
BLOCK = 4_096


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) for every node and each node above it in the forest: all descendants of every node, read off hierarchy()'s intervals.

    A node's descendants are the preorder numbers of its interval, cut into blocks so that no row names more than BLOCK of them; each number is met by equality,
    so the work follows the pairs that come out. tree should have a row for every id of the links, or the missing ones are no ancestors. Repeated ids count once."""
    once = cut(tree.select("node_id", "root_id", "depth", "preorder", "first_descendant", "last_descendant").filter("node_id is not null").dropDuplicates(["node_id"]))
    above = once.filter("last_descendant >= first_descendant").select(F.col("node_id").alias("ancestor_id"), "root_id", F.col("depth").alias("from_depth"), "first_descendant", "last_descendant")
    blocks = above.withColumn("first", F.explode(F.sequence("first_descendant", "last_descendant", F.lit(BLOCK)))).withColumn("last", F.least("last_descendant", F.col("first") + F.lit(BLOCK - 1)))
    each = blocks.select("ancestor_id", "root_id", "from_depth", "first", "last").repartition("ancestor_id", "first").select("ancestor_id", "root_id", "from_depth", F.explode(F.sequence("first", "last")).alias("preorder"))
    return each.join(once.select("node_id", "root_id", "depth", "preorder"), ["root_id", "preorder"]).select("ancestor_id", "node_id", (F.col("depth") - F.col("from_depth")).alias("distance"))


def every_id(nodes: DataFrame, links: DataFrame, node_id: str = "id", source: str = "source", target: str = "target") -> DataFrame:
    """(id): the ids of nodes and of both ends of links, each once, without null."""
    ends = links.select(F.col(source).alias("id")).unionByName(links.select(F.col(target).alias("id")))
    return nodes.select(F.col(node_id).alias("id")).unionByName(ends).filter("id is not null").distinct()


def set_aside(links: DataFrame, source: str = "source", target: str = "target", order: str = "id") -> DataFrame:
    """(source_id, target_id, within_cycle): each distinct link that the forest does not keep, as it lies within a cycle or ends at a node with an earlier parent. Self-links are within a cycle."""
    parents, names, cycles, edges = forest(links, source, target, order)
    rest = edges.join(parents.select(F.col("k").alias("t"), F.col("p").alias("s")), ["s", "t"], "left_anti")
    on = lambda c: cycles.select(F.col("k").alias(c), F.col("scc").alias(f"c{c}"))
    rest = rest.join(on("s"), "s", "left").join(on("t"), "t", "left").select("s", "t", F.coalesce(F.col("cs") == F.col("ct"), F.lit(False)).alias("within_cycle"))
    name = lambda df, c, out: lookup(cut(df), names.select(F.col("k").alias(c), F.col("id").alias(out)), c, "inner")
    return name(name(rest, "s", "source_id"), "t", "target_id").select("source_id", "target_id", "within_cycle")


def all_descendants(nodes: DataFrame, links: DataFrame, node_id: str = "id", source: str = "source", target: str = "target", order: str = "id") -> DataFrame:
    """(ancestor_id, node_id) for every node and each other node that reaches it over any links, those of further parents and within cycles too.

    The forest's pairs come from its intervals. A link that the forest set aside leads to another one if that begins at or below its target; such chains are closed by
    doubling over the links set aside alone, and each adds the pairs of what is at or above its first link's source with what is at or below its last one's target."""
    from thicket.operators.graph import closure

    tree = cut(hierarchy(every_id(nodes, links, node_id, source, target), links, "id", source, target, order).select("node_id", "root_id", "depth", "path", "preorder", "first_descendant", "last_descendant"))
    known = nodes.select(F.col(node_id).alias("node_id")).filter("node_id is not null").distinct()
    kept = cut(descendants(tree).select("ancestor_id", "node_id"))
    aside = cut(set_aside(links, source, target, order).filter("source_id <> target_id").select("source_id", "target_id"))
    if aside.isEmpty():
        return kept.join(known, "node_id", "left_semi").select("ancestor_id", "node_id")
    # What is at or above the source of each link set aside.
    up = cut(aside.join(tree.select(F.col("node_id").alias("source_id"), "path"), "source_id").select("source_id", "target_id", F.explode("path").alias("above")))
    name = lambda s, t: F.struct(F.col(s).alias("s"), F.col(t).alias("t"))
    leads = up.select(F.col("above").alias("target_id"), name("source_id", "target_id").alias("b")).join(aside.select("target_id", name("source_id", "target_id").alias("a")), "target_id").select("a", "b")
    chains = closure(leads).select("a", F.col("b.t").alias("last")).unionByName(aside.select(name("source_id", "target_id").alias("a"), F.col("target_id").alias("last")))
    tops = cut(up.select(name("source_id", "target_id").alias("a"), "above").join(chains, "a").select(F.col("above").alias("ancestor_id"), "last").distinct())
    below = kept.select(F.col("ancestor_id").alias("last"), "node_id").unionByName(tree.select(F.col("node_id").alias("last"), "node_id"))
    more = tops.join(below, "last").select("ancestor_id", "node_id").filter("ancestor_id <> node_id")
    return kept.unionByName(more).distinct().join(known, "node_id", "left_semi").select("ancestor_id", "node_id")
