import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions import text as tx
from thicket.operators import graph, heavy, search, skew
from thicket.sources import formats, sinks

EDGES = "id long, source string, target string, kind string, line int, col int, links long"


def edges_df(spark, rows, kind="calls"):
    return spark.createDataFrame([(i, s, t, kind, None, None, 5) for i, (s, t) in enumerate(rows)], EDGES)


def test_lookup_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "small", lambda df, rows=0: False)
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 50}", i) for i in range(300)] + [(None, 1), ("lost", 2)]
    df = spark.createDataFrame(rows, "k string, v int")
    unique = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(50)], "k string, w int")
    for how, n in (("left", 802), ("inner", 800)):
        got = skew.lookup(df, unique, "k", how)
        assert got.count() == n and got.filter("k = 'hot' and w = 1").count() == 500 and got.filter("w is null").count() == n - 800


@pytest.mark.parametrize("a_bucket", [10, 10**6])
def test_running_totals(spark, a_bucket):
    rows = [(None if i % 7 == 0 else "a" if i % 3 else "b", i, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, n int")
    got = skew.running_totals(df, ["k"], ["i"], F.col("n"), "before", rows_a_bucket=a_bucket).collect()
    assert len(got) == 200
    by = defaultdict(list)
    for r in got:
        by[r.k].append((r.before, r.n))
    for parts in by.values():
        at = 0
        # Places are cut from 0 without a gap or overlap, whatever the order.
        for before, n in sorted(parts, key=lambda x: (x[0], x[1])):
            assert before == at
            at += n


def test_heavy_keys(spark):
    e = edges_df(spark, [("hot", "x")] * 60 + [(f"s{i}", "x") for i in range(38)] + [(None, "x")] * 2)
    n = spark.createDataFrame([(f"n{i}", "f1" if i < 50 else f"g{i}") for i in range(98)] + [("hot", None), ("hot", "f1")], "id string, file_path string")
    assert {tuple(r) for r in heavy.found_heavy(e, n, 3).collect()} == {("edges.source", "hot"), ("nodes.file_path", "f1")}
    # At 1 % every key of a hundred rows is heavy; nulls are no key.
    assert heavy.found_heavy(e, n, 1).filter("field = 'edges.source'").count() == 39
    assert heavy.found_heavy(e.limit(0), n.limit(0)).count() == 0
    per = {r.file_path: (r.n_symbols, r.n_links) for r in heavy.per_file(e, n).collect()}
    assert per["f1"] == (51, 60) and per[None] == (1, 60) and per["g60"] == (1, 0)
    by = {r.source: r for r in heavy.per_source(e, n.filter("file_path is not null")).collect()}
    assert by["hot"].n_links == 60 and by["hot"].n_distinct_links == 1 and by[None].n_links == 2 and by["s1"].file_path is None


def test_reach_impact_and_path(spark):
    rnd = random.Random(4)
    rows = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(45)]
    inside = [("n1", "m1"), ("m1", "m2"), ("m2", "n2"), ("n2", "n1")]
    out = defaultdict(set)
    for s, t in rows:
        out[s].add(t)

    def brute(start, hops):
        seen, level = {start: 0}, {start}
        for h in range(1, hops + 1):
            level = {y for x in level for y in out[x]} - set(seen)
            seen |= {x: h for x in level}
        return seen

    pairs = graph.adjacency(edges_df(spark, rows))
    start = spark.createDataFrame([("n1",)], "id string")
    assert {r.id: r.depth for r in graph.reach(pairs, start, 3).collect()} == brute("n1", 3)
    far = max(brute("n1", 30).items(), key=lambda x: x[1])
    path = [r.id for r in graph.shortest_path(pairs, "n1", far[0]).orderBy("step").collect()]
    assert len(path) == far[1] + 1 and path[0] == "n1" and path[-1] == far[0] and all(b in out[a] for a, b in zip(path, path[1:]))
    assert graph.shortest_path(pairs, "n1", "nowhere").count() == 0
    both = edges_df(spark, rows).unionByName(edges_df(spark, inside, "contains"))
    got = {r.id: r.depth for r in graph.impact(both, start, 1).collect()}
    zero = {"n1", "m1", "m2", "n2"}
    users = {s for s, t in rows if t in zero} - zero
    assert got == {x: 0 for x in zero} | {x: 1 for x in users}


def test_enclosing(spark):
    spans = [("outer", "f", 1, 500), ("inner", "f", 100, 200), ("same", "f", 100, 200), ("last", "f", 150, 150), ("odd", "f", 300, 290)]
    lines = [("f", x) for x in (1, 99, 100, 150, 201, 500, 501, 300)] + [("g", 1)]
    got = {(r.file_path, r.line): r.id for r in graph.enclosing(spark.createDataFrame(spans, "id string, file_path string, start_line int, end_line int"), spark.createDataFrame(lines, "file_path string, line int")).collect()}
    assert got == {("f", 1): "outer", ("f", 99): "outer", ("f", 100): "inner", ("f", 150): "last", ("f", 201): "outer", ("f", 500): "outer", ("f", 300): "outer"}


def test_nearest_is_exact(spark):
    rnd = np.random.default_rng(1)
    v = rnd.integers(-2, 3, (120, 4)).astype(float)  # ties and zeros
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0]), (902, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in search.nearest(df, df.filter("vec_id % 10 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    norm = np.linalg.norm(v, axis=1)
    for q in range(0, 120, 10):
        if norm[q] == 0:
            assert q not in got
            continue
        s = [(round(-float(v[q] @ v[i] / norm[q] / norm[i]), 9), i) for i in range(120) if i != q and norm[i]]
        assert sorted(round(x, 6) for _, x in got[q]) == sorted(round(-x, 6) for x, _ in sorted(s)[:5])
    assert search.nearest(df.limit(0), df.limit(0), 5).count() == 0


def test_bm25_and_fusion(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None), (5, "A-b")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in search.bm25(df, "doc_id", "text", ["A", "zzz"]).collect()}
    assert set(got) == {1, 5} and got[1] > got[5] > 0
    assert search.bm25(df, "doc_id", "text", ["zzz"]).count() == 0
    a = search.ranked(spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 1.0)], "id long, score double"), "id", 3)
    assert [r.id for r in a.orderBy("rank").collect()] == [1, 2, 3]
    fused = {r.id: round(r.score, 6) for r in search.fuse([(a, 2.0), (a.filter("id = 3"), 1.0)], "id").collect()}
    assert fused[1] == round(2 / 61 + 0.05, 6) and fused[3] == round(2 / 63 + 1 / 63 + 0.02, 6)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def test_text_functions(spark):
    assert one(spark, tx.segments(F.lit("parseHTTPServer_v2 42"))) == ["parse", "http", "server", "v2"]
    assert one(spark, tx.canonical_url(F.lit("HTTPS://Ex.com:443/a/?utm_source=x&b=1#frag"))) == "https://ex.com/a/?b=1"
    assert one(spark, tx.canonical_url(F.lit("http://ex.com/?utm_a=1"))) == "http://ex.com"
    assert one(spark, tx.redact(F.lit("token = abcdefgh12345 and Bearer abcdefghijklmnop"))) == "[assignment removed] and [bearer removed]"
    assert one(spark, tx.slug(F.lit("My docs/--Über uns!.md"))) == "My-docs/Über-uns.md"
    assert one(spark, F.round(tx.dice(F.lit("night"), F.lit("nacht")), 4)) == 0.25
    assert one(spark, tx.dice(F.lit("a"), F.lit("b"))) == 0.0
    assert one(spark, tx.highlight(F.lit("Wave wavy"), ["wav", "y"])) == "<b>Wav</b>e <b>wav</b>y"
    assert one(spark, tx.title(F.lit("text\n## Head here \n"), F.lit("a/b.md"))) == "Head here" and one(spark, tx.title(F.lit(""), F.lit("a/b.c.md"))) == "b.c"
    for glob, path, hit in (("src/**/*.ts", "src/a.ts", True), ("src/**/*.ts", "src/a/b/c.ts", True), ("*.ts", "a/b.ts", False), ("{a,b}?.x", "b1.x", True), ("a+b", "a+b", True)):
        assert one(spark, F.lit(path).rlike(tx.glob_regex(glob))) is hit
    assert one(spark, tx.age_words(F.lit(7300))) == "2h"


def test_sinks_and_formats(spark):
    df = spark.createDataFrame([(1, 'a "b", c', "p"), (2, None, "q")], "id int, title string, path string")
    assert [r.line for r in sinks.as_csv(df.select("id", "title")).orderBy("id").collect()] == ['1,"a ""b"", c"', "2,"]
    assert sinks.as_json(df).filter("line like '%null%'").count() == 1
    new = spark.createDataFrame([(2, "x", "q"), (3, "y", "r")], "id int, title string, path string")
    assert {(r.id, r.title) for r in sinks.upsert(df, new, ["id"]).collect()} == {(1, 'a "b", c'), (2, "x"), (3, "y")}
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n one\n-two\n+--- two\n three\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n\\ No newline at end of file\n"
    rows = formats.diff_lines(spark.createDataFrame([(1, diff), (2, ""), (3, None)], "k int, t string"), "k", "t").collect()
    assert [(r.new_path, r.hunk, r.kind, r.old_line, r.new_line, r.line) for r in rows] == [
        ("x.py", 1, "context", 1, 1, "one"), ("x.py", 1, "removed", 2, None, "two"), ("x.py", 1, "added", None, 2, "--- two"), ("x.py", 1, "context", 3, 3, "three"), (None, 1, "removed", 1, None, "x")
    ]
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\nhello <b>there</b>\n\n00:02.000 --> 00:03.000\nhello there\nagain\n\n01:02:05.000 --> 01:02:06.000\nlate\n"
    got = {r.minute: r.text for r in formats.captions(spark.createDataFrame([(1, vtt)], "k int, t string"), "k", "t").collect()}
    assert got == {0: "hello there again", 62: "late"}
    t = "x\n<<<<<<< ours\na\n=======\nb\n>>>>>>> theirs\ny"
    assert formats.conflicts(spark.createDataFrame([(1, t), (2, "x")], "k int, t string"), "k", "t").collect()[0].block.startswith("<<<<<<< ours")
    fm = formats.front_matter(spark.createDataFrame([(1, "---\ntitle: A: b\ntags: x\n---\nbody")], "k int, t string"), "k", "t").collect()[0].fields
    assert fm == {"title": "A: b", "tags": "x"}


def test_queries_agree_with_sql(spark, data):
    import importlib

    import duckdb

    import __spark_entry__ as entry
    from thicket import plans
    from tools.compare import rows

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings nodes edges files content content_vectors work_unit_records subject_areas subject_labels mix_targets".split():
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    wrong, names = [], Counter()
    for m in plans.MODULES:
        module = importlib.import_module(f"thicket.plans.{m}")
        for name, sql in module.ORACLE.items():
            assert name not in names and name in entry.queries()
            names[name] += 1
            df = module.QUERIES[name](spark, data)
            r = con.execute(sql)
            if rows(df.columns, df.collect()) != rows([x[0] for x in r.description], r.fetchall()):
                wrong.append(name)
    assert not wrong


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_resolution_edges(spark):
    names = {f"n{i}": "six" for i in range(6)} | {"a": "full", "b": "over", "c": "over", "s": None}
    nodes = spark.createDataFrame([(i, n, f"{i}.py", "python") for i, n in names.items()], "id string, name string, file_path string, language string")
    links = [("s", f"n{i}", None) for i in range(6)] + [("s", "a", "scip")] * 500 + [("s", "a", "heuristic")] * 3 + [("s", "b", None)] * 300 + [("s", "c", None)] * 201 + [("gone", "n1", None), ("s", "gone", None), ("a", "s", None)]
    edges = spark.createDataFrame([(k, a, b, "calls", p) for k, (a, b, p) in enumerate(links)], "id long, source string, target string, kind string, provenance string")
    rows = graph.resolution_edges(edges, nodes).collect()
    assert {r.edge_id for r in rows} == set(range(506)) and len(rows) == 506
    assert {tuple(r)[1:] for r in rows if r.name == "full"} == {("full", "s", "a", "calls", "s.py", "python")}
    assert {r.name for r in graph.resolution_edges(edges, nodes, 5).collect()} == set()


def slug_of(path):
    kind = lambda c: unicodedata.category(c)
    word = lambda c: kind(c)[0] in "LN" or c == "$"
    name = re.sub(r"\.[^.]+\Z", "", ([x for x in path.split("/") if x] or [""])[-1])
    if not any(word(c) or kind(c) in ("So", "Sk") for c in name):
        return None

    def hexed(part):
        out, i = "", 0
        while i < len(part):
            run = []
            while i < len(part) and kind(part[i]) in ("So", "Sk"):
                run.append(f"{ord(part[i]):x}")
                i += 2 if kind(part[i]) == "So" and i + 1 < len(part) and kind(part[i + 1]) == "Mn" else 1
            out += "-".join(run)
            if not run:
                out, i = out + part[i], i + 1
        return out

    clean = lambda x: re.sub("-+", "-", "".join(c if word(c) else "-" for c in x)).strip("-")
    parts = [hexed(x) for x in path.replace("___", "/").split("/")]
    ext = re.search(r"(\.[A-Za-z0-9]+)\Z", parts[-1])
    ext = ext[1] if ext else ""
    return "/".join(x for x in [*map(clean, parts[:-1]), clean(parts[-1][: len(parts[-1]) - len(ext)]) + ext] if x) or None


def test_slugs_of_all_paths(spark, data):
    from thicket.plans.text_queries import QUERIES, table

    rnd = random.Random(12)
    paths = ["___", "a___b.md", "/x//y/__z__.py", "🐘.md", "a🐘🎉b/c✅\ufe0f✅.m🐘", "^`a.md", "a/.env", "a/", "-/-b-.c-d", "x.\u00e9", "$id.tsx", ".md", " ", "", "a/___.md"]
    paths += ["".join(rnd.choice("ab/._-$ü🐘\ufe0f^日 ") for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    got = dict(spark.createDataFrame([(p,) for p in set(paths)], "path string").select("path", tx.slug(F.col("path"))).collect())
    assert got == {p: slug_of(p) for p in set(paths)}
    assert slug_of("a🐘🎉b/c.m") == "a1f418-1f389b/c.m" and slug_of("src/__gen__/_x_.py") == "src/gen/x.py"
    rows = [tuple(r) for r in QUERIES["src12_slugs"](spark, data).collect()]
    assert len(rows) == table(spark, data, "files").count() and all(s == slug_of(p) for p, s in rows)


def test_tokens_of_any_script(spark):
    assert one(spark, tx.tokens(F.lit("Über weiß loadGraph2Fast HTTPServer 日本語の x²ü_Ω हिन्दी"))) == ["über", "weiß", "load", "graph2fast", "httpserver", "日本語の", "x²ü", "ω", "हिन", "दी"]


def test_bm25_of_many_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    rnd = random.Random(4)
    texts = {i: " ".join(rnd.choice(["über", "der", "café", "日本", "a", "b", "c", "der"]) for _ in range(rnd.randint(0, 9))) for i in range(120)} | {120: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = defaultdict(list)
    for r in search.bm25_queries(df, df.filter("doc_id % 10 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, round(r.score, 6)))
    held = {i: Counter((t or "").split()) for i, t in texts.items()}
    average = sum(map(Counter.total, held.values())) / len(held)
    n_with = Counter(t for c in held.values() for t in c)
    idf = {t: np.log(1 + (len(held) - d + 0.5) / (d + 0.5)) for t, d in n_with.items()}
    for i in range(0, 121, 10):
        score = {j: round(sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / average)) for t in held[i] if c[t]), 9) for j, c in held.items() if j != i}
        want = sorted(((j, x) for j, x in score.items() if x > 0), key=lambda x: (-x[1], x[0]))[:5]
        assert got[i] == [(j, round(x, 6)) for j, x in want]
