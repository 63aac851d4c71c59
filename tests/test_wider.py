import math
import random
import re

from pyspark.sql import functions as F

from thicket.functions import ranking as rk
from thicket.functions import text as tx
from thicket.operators import graph, sections, symbols


def brute_chunks(text, size=300, shared=40, window=80):
    points = sections.break_points(text)
    code = sections.fences(text)
    out, at = [], 0
    while True:
        target = min(at + size, len(text))
        end = target
        if target < len(text):
            best, score = None, -1.0
            for p, w, _ in points:
                if target - window <= p <= target and not any(a < p < b for a, b in code):
                    s = w * (1 - ((target - p) / window) ** 2 * 0.7)
                    if s > score:
                        best, score = p, s
            if best is not None and best > at:
                end = best
        out.append((at, end))
        if end >= len(text):
            return out
        at = end - shared if end - shared > at else end


def test_chunks_against_brute_force():
    rnd = random.Random(3)
    parts = ["\n# Head\n", "\n## Two\n", "\n```\ncode line\n```\n", "\n\n", "\n- item", "\n1. one", "\n---\n", " words of text go on", "x" * 90, "\n```"]
    for _ in range(60):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 120)))
        want = brute_chunks(text) if len(text) > 300 else [(0, len(text))]
        assert sections.chunks(text, 300, 40, 80) == want
    assert sections.break_points("a\n# b\n\nc")[0] == (1, 100, "h1") and sections.chunks("") == [(0, 0)]


def test_units():
    page = "intro\n\n# A\nbody a\n```\n# no heading\n```\n## B\n" + "para one. " * 120 + "\n\n- item " + "two. " * 200 + "\n" + "y" * 4500
    got = sections.units(page)
    assert [u[0] for u in got[:2]] == ["", "A"] and got[1][1:3] == (4, 7) and "# no heading" in got[1][3]
    assert all(len(u[3]) <= sections.UNIT for u in got) and any(u[0].startswith("- item") for u in got)
    assert sections.units("") == [] and sections.units("\n \n") == []
    joined = "".join(u[3] for u in got)
    assert joined.count("para one.") == 120 and joined.count("y") >= 4500
    assert [sections.stem(w) for w in ("queries", "boxes", "paged", "class", "running", "page", "it")] == ["query", "box", "pag", "class", "runn", "pag", "it"]


def test_section_scores_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["wave", "shelf", "gravity", "other", "more", "waves"]
    pages = [(i, "\n".join(f"# {rnd.choice(words)}\n" + " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 30))) for _ in range(4))) for i in range(12)] + [(90, None), (91, ""), (92, "nothing waved here")]
    df = spark.createDataFrame([(i, t, "x") for i, t in pages], "id long, text string, score string")
    parts = sections.split_units(df, "id", "text").cache()
    rows = parts.collect()
    got = {(r.id, r.unit): r.score for r in sections.score_units(parts, "id", "the wave wave shelf").collect()}
    tok = lambda s: [w for w in re.findall("[a-z0-9]+", s.lower()) if len(w) > 1 and w not in sections.STOP]
    tf = {(r.id, r.unit): {w: 2.5 * tok(r.heading).count(w) + tok(r.body).count(w) for w in ("wave", "shelf")} for r in rows}
    n, avg = len(rows), sum(len(r.body) for r in rows) / len(rows)
    df_ = {w: sum(x[w] > 0 for x in tf.values()) for w in ("wave", "shelf")}
    for r in rows:
        want = sum(math.log((n - df_[w] + 0.5) / (df_[w] + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.5 + 0.5 * len(r.body) / avg)) for w, f in tf[(r.id, r.unit)].items() if f)
        assert abs(got.get((r.id, r.unit), 0.0) - want) < 1e-9
    best = sections.best_units(parts, "id", "wave", 2).collect()
    assert max(r.place for r in best) <= 2 and {r.id for r in best if r.stemmed} == {92}
    lines = sections.best_lines(sections.best_units(parts, "id", "wave", 1), "wave").collect()
    assert all("wave" in r.context and r.first_line <= r.match_line <= r.last_line for r in lines if not r.stemmed)
    assert sections.score_units(parts, "id", "the of").count() == 0


def test_symbol_diff_small(spark):
    schema = "id string, identity string, kind string, name string, hash string, shape string, signature string, place int"
    old = [("a", "f|x", "fn", "x", "1", "s1", "(i)", 1), ("b", "f|x", "fn", "x", "2", "s2", "(j)", 2), ("c", "f|y", "fn", "y", "3", "s3", None, 3), ("d", "f|z", "fn", "z", "4", "s4", None, 4), ("e", "f|w", "fn", "w", "5", "s5", None, 5), ("g", "f|v", "fn", "v", "6", "s5", None, 6)]
    new = [("B", "f|x", "fn", "x", "2", "s2", "(j)", 1), ("A", "f|x", "fn", "x", "9", "s1", "(k)", 2), ("C", "f|y", "fn", "y", "8", "s3", None, 3), ("D", "f|q", "fn", "q", "4", "s4", None, 4), ("E", "f|u", "fn", "u", "5", "s5", None, 5), ("N", "f|new", "fn", "new", "0", "s9", None, 9)]
    got = {tuple(r) for r in symbols.symbol_diff(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == {("unchanged", "b", "B", "exact"), ("signature", "a", "A", "exact"), ("body", "c", "C", "exact"), ("renamed", "d", "D", "structural"), ("deleted", "e", None, "ambiguous"), ("deleted", "g", None, "ambiguous"), ("added", None, "E", "ambiguous"), ("added", None, "N", "exact")}


def test_symbol_search_falls_back(spark):
    schema = "id string, name string, kind string, file_path string, qualified_name string, docstring string, signature string"
    nodes = spark.createDataFrame([("1", "loadCache", "function", "src/cache/load.ts", None, None, None), ("2", "store", "class", "src/store.ts", "a.store", "keeps the cache", None), ("3", "reload", "method", "tests/x_test.ts", None, None, None)], schema)
    assert [r.id for r in symbols.search(nodes, "loadcache").collect()][0] == "1"
    assert {r.id for r in symbols.search(nodes, "oad").collect()} == {"1", "3"}  # no word begins so: names that hold it
    assert [r.id for r in symbols.search(nodes, "storr").collect()] == ["2"]  # an edit away
    assert symbols.search(nodes.limit(0), "x").count() == 0


def test_scores_of_names_and_texts(spark):
    one = lambda c, **v: spark.range(1).select(*[F.lit(x).alias(k) for k, x in v.items()]).select(c).collect()[0][0]
    assert [one(rk.name_bonus(F.col("n"), q), n=n) for n, q in (("Pod", "pod"), ("build", "CacheBuilder build"), ("PodSpec", "Pod"), ("theCacheBuilder", "cache builder"), ("xpody", "pod"), ("zzz", "pod"))] == [80, 60, 23, 15, 10, 0]
    assert one(rk.multiset_dice(F.col("a"), F.col("b")), a="aaaa", b="aa") == 2 * 1 / 4
    assert one(rk.multiset_dice(F.col("a"), F.col("b")), a="night", b="nacht") == 0.25
    assert one(rk.excerpt(F.col("a"), 10), a="one two three four") == "one two …"
    assert one(rk.redact_url(F.col("u")), u="https://me:pw@h/x?api_key=abc&q=1") == "https://h/x?api_key=[redacted]&q=1"
    assert [one(tx.in_scope(F.col("u"), "https://h", ["/a/*"], ["/a/b*"]), u=u) for u in ("https://h/a/c", "https://h/a/c/d", "https://h/a/bc", "https://other/a/c")] == [True, False, False, False]
    assert one(rk.token_bucket(F.col("t")), t=50_000) == 1 and one(rk.token_bucket(F.col("t")), t=49_999) == 0


def test_names_resolve_past_the_ceiling(spark):
    nodes = spark.createDataFrame([(f"d{i:03}", "run", f"lib/f{i}.py") for i in range(30)] + [("near", "run", "app/b.py"), ("own", "run", "app/a.py")], "id string, name string, file_path string")
    refs = spark.createDataFrame([("r1", "run", "app/a.py"), ("r2", "run", "app/c.py"), ("r3", "run", "x/y.py"), ("r4", "none", "x"), ("r5", None, None)], "ref_id string, name string, file_path string")
    rows = {r.ref_id: (r.id, r.score) for r in graph.resolve_names(refs, nodes, None).collect()}
    assert rows == {"r1": ("own", 3), "r2": ("near", 2), "r3": ("d000", 1)}
    assert graph.resolve_names(refs, nodes, 5).count() == 0
