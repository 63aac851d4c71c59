import pytest

from thicket.llm import handwritten as h
from thicket.llm import subjects as s


def test_header_and_notices():
    head, body = h.header("// Copyright the Own developers.\n// Part of this repository; see LICENSE.\n\n// Code generated by gen. DO NOT EDIT.\nint a;\n// generated by x by running y\n")
    assert body.startswith("int a;") and h.notices(head) == (1, 0, 1, 0)
    head, body = h.header("/*! lib v1.2 */var a=1;b()")
    assert body == "var a=1;b()" and h.notices(head) == (0, 1, 0, 1)
    assert h.notices("// Port of an idea from lib; written from scratch for this repository.\n") == (0, 0, 1, 0)
    assert h.notices("// SPDX-FileCopyrightText: 2019 lib contributors\n")[1] == h.notices("# This file is part of lib.\n")[1] == h.notices("// Copyright (c) 2019 Jane Doe\n")[1] == 1
    assert h.notices("# the list is generated at start-up from the table\n# do not edit the table while it is open\n") == (0, 0, 0, 0)
    assert h.header("") == ("", "") and h.shape("") == (0.0,) * len(h.FEATURES)
    assert h.header("/* open\n comment */\nx = 1\n")[1] == "x = 1\n"


def test_features_do_not_follow_length():
    part = "".join(f"def f{i}(a, b):\n    # keep {i}\n    return a + b * {i}\n\n" for i in range(40))
    one, many = h.shape(part), h.shape(part * 30)
    for name, a, b in zip(h.FEATURES, one, many):
        if name in ("packed", "entropy", "distinct", "words"):
            assert abs(a - b) < 0.15, name
    assert len(h.shape("x" * 300_000)) == len(h.FEATURES)


def test_found_files(spark):
    import random

    rnd = random.Random(1)
    word = lambda: rnd.choice(["load", "store", "merge", "graph", "cache", "index", "frame", "shelf", "record"])
    hand = lambda own: ("// Part of this repository; see LICENSE.\n\n" if own else "") + "".join(f"function {word()}{i}({word()}) {{\n    // {word()} the {word()} first\n    if ({word()} > {i}) {{\n        return {word()}({word()});\n    }}\n}}\n\n" for i in range(rnd.randrange(4, 14)))
    made = lambda note: ("// Code generated by gen. DO NOT EDIT.\n\n" if note else "") + "".join(f"get{word().title()}{word().title()}() {{ return this.fields_[{i}]; }}\nset{word().title()}{word().title()}(v) {{ this.fields_[{i}] = v; }}\n" for i in range(rnd.randrange(10, 30)))
    texts = {f"src/own{i}.js": hand(True) for i in range(40)} | {f"src/plain{i}.js": hand(False) for i in range(10)} | {f"src/made{i}.js": made(True) for i in range(30)} | {f"src/quiet{i}.js": made(False) for i in range(8)}
    texts |= {"vendor/lib/a.js": hand(False) + "// unlike", "src/data.js": "const t = [\n" + "  0x1f, 0x22, 0x9a,\n" * 200 + "];\n", "src/empty.js": "", "src/external_rates/x.js": hand(True)}
    texts["src/copy.js"] = texts["vendor/lib/a.js"]
    signed = {f"vendor/dep{i}/x{i}.js": "// Vendored from dep; see NOTICE.\n\n" + hand(False) for i in range(12)}
    texts |= signed
    files = spark.createDataFrame([(p, h_, 0, len(t), "x") for p, t in texts.items() for h_ in [str(hash(t))]] + [("src/lost.js", "gone", None, 1, "x"), (None, "gone", 1, 1, "x"), ("src/null.js", None, 1, 1, "x")], "path string, content_hash string, generated int, size long, machine string")
    content = spark.createDataFrame(list({(str(hash(t)), t) for t in texts.values()}), "hash string, doc string")
    got = {r.path for r in h.found_not_handwritten(files, content).collect()}
    assert got == {p for p in texts if p.startswith(("src/made", "src/quiet"))} | {"vendor/lib/a.js", "src/copy.js", "src/data.js", *signed}
    judged = {r.path: r for r in h.judge(files, content).collect()}
    # The forest itself finds unsigned output, and unsigned copies by their place and by the place of what they equal.
    assert all(judged[p].machine >= 0.5 and not judged[p].tool and not judged[p].foreign for p in [f"src/quiet{i}.js" for i in range(8)] + ["vendor/lib/a.js", "src/copy.js", "src/data.js"])
    assert h.found_not_handwritten(files.limit(0), content).count() == 0
    # Without texts nothing is labelled, so nothing can be told.
    assert h.found_not_handwritten(files, content.limit(0)).count() == 0
    out = h.held_out(files, content).collect()[0]
    assert out.n_signed > 0 and out.n_both / out.n_signed >= 0.9 and out.n_both / out.n_called >= 0.9


def test_passages():
    text = "# Head\n\nOne here. Two there!\n\n```py\ncode here\n```\n\n* [a](b)\n* [c](d)\n\nx.y line 3 error code=4\n\n- item one\n- item two\n"
    assert s.passages(text) == [["One here.", "Two there!"], ["- item one - item two"]]
    assert s.passages("") == [] and s.passages("```\nopen") == []
    assert s.runs(5) == [(0, 5)] and s.runs(9)[0] == (0, 4) and s.runs(9)[-1][1] == 9


def test_passages_after_fences_and_in_long_lines():
    text = "Before it.\n\n```py\ncode\n``` — naïve café\n\nBetween them.\n\n~~~\nmore\n~~~~ \nAfter it.\n\n````\n```\nstill code\n````\nThe end."
    assert s.passages(text) == [["Before it."], ["— naïve café"], ["Between them."], ["After it."], ["The end."]]
    assert s.passages("```a``` is short. It stays.") == [["```a``` is short.", "It stays."]]
    long = "The court met. " * 20
    assert s.passages("## 1.2 - " + long) == [["1.2 - The court met.", *["The court met."] * 19]]
    assert s.passages(long + "It left with exit=1 then. " + long) == [["The court met."] * 40]
    assert s.passages("## A heading") == []


def corpus(rnd, n):
    words = {"sport": "goal match referee league striker".split(), "law": "court judge statute clause plaintiff".split(), "music": "violin chord tempo opera melody".split()}
    rows = []
    for i in range(n):
        mine = rnd.sample(sorted(words), rnd.choice([0, 1, 1, 1, 2]))
        paragraphs = [" ".join(f"The {rnd.choice(words[m])} and the {rnd.choice(words[m])} came up in week {j}." for j in range(3)) for m in mine]
        paragraphs += ["Nothing else changed since the last note. Somebody please check the numbers. The rest is as before."]
        rnd.shuffle(paragraphs)
        rows.append((i, "\n\n".join(paragraphs), mine))
    return rows


def test_subjects(spark):
    import random

    rnd = random.Random(8)
    rows = corpus(rnd, 400)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, "", "x"), (1001, None, "x"), (1002, "word " * 100_000, "x")], "doc_id long, text string, subject string")
    labels = []
    for i, _, mine in rows[:250]:
        given = [rnd.choice(["sport", "law", "music"])] if mine and rnd.random() < 0.08 else mine
        labels += [(i, f" {m.upper()}" if rnd.random() < 0.2 else m, "r") for m in given] or [(i, None, "r")]
    labels = spark.createDataFrame(labels + labels[:5] + [(7, "nonsense", "r"), (None, "law", "r"), (9999, "law", "r")], "doc_id long, subject string, annotator string")
    areas = spark.createDataFrame([("sport",), ("law",), ("music",)], "subject string")
    got = {tuple(r) for r in s.found_subjects(docs, labels, areas).collect()}
    want = {(i, m) for i, _, mine in rows[250:] for m in mine}
    mine = {x for x in got if 250 <= x[0] < 1000}
    assert len(mine & want) / len(want) > 0.95 and len(mine & want) / len(mine) > 0.95
    assert not {x for x in got if x[0] >= 1000}
    by = {r.subject: r.n_documents for r in s.composition(docs, labels, areas).collect()}
    assert sum(by.values()) == len(got) and set(by) == {"sport", "law", "music"}
    assert s.found_subjects(docs, labels.limit(0), areas).count() == 0
    assert s.found_subjects(docs.limit(0), labels, areas).count() == 0 and s.found_subjects(docs, labels, areas.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p5_found", "p6_windows", "p7_mixture", "p8_found"])
def test_queries_run(spark, data, name):
    from thicket.llm.queries import QUERIES

    assert QUERIES[name](spark, data).count() > 0


def test_subjects_stay_within_bounds(spark, monkeypatch):
    areas = spark.createDataFrame([(f"s{i}",) for i in range(4)], "subject string")
    docs = spark.createDataFrame([(i, "One word here. Two words there.") for i in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "s1") for i in range(5)], "doc_id long, subject string")
    monkeypatch.setattr(s, "MAX_SUBJECTS", 3)
    with pytest.raises(ValueError):
        s.found_subjects(docs, labels, areas)
    monkeypatch.setattr(s, "MAX_SUBJECTS", 4)
    monkeypatch.setattr(s, "TRAINED_CHARS", 70)
    assert s.found_subjects(docs, labels, areas).count() >= 0


def test_all_labelled_texts_are_counted(spark, monkeypatch):
    import random

    import numpy as np

    rows = corpus(random.Random(5), 150)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(3, rows[3][1]), (500, None), (501, "12. 34!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, m) for i, _, mine in rows for m in mine or [None]] + [(500, "law"), (501, "law")], "doc_id long, subject string")
    names = ["law", "music", "sport"]
    areas = spark.createDataFrame([(x,) for x in names], "subject string")
    whole = {tuple(r) for r in s.found_subjects(docs, labels, areas).collect()}
    monkeypatch.setattr(s, "TRAINED_CHARS", 300)  # fewer characters than three texts have
    monkeypatch.setattr(s, "COUNTS", 10)
    assert {tuple(r) for r in s.found_subjects(docs, labels, areas).collect()} == whole
    assert len(whole & {(i, m) for i, _, mine in rows for m in mine}) / len(whole) > 0.9

    # The models are those of one process that has all texts at once, and those of the halves have a half each.
    labelled = s.labelled_words(docs, s.label_sets(labels, names))
    half = {r.doc_id: r.half for r in labelled.collect()}
    assert set(half) == {*range(150), 501}
    fitting = s.Fitting(labelled, 3)
    assert set(fitting.vocabulary) == {w for _, t, _ in rows for p in s.plain(t) for x in p for w in x}
    for fit, model in enumerate(fitting.models):
        mine = [(t, {names.index(m) for m in own}) for i, t, own in rows if fit == 2 or half[i] != fit]
        text, own = s.Text([t for t, _ in mine], fitting.vocabulary), [x for _, x in mine]
        expected = None
        for _ in range(s.ROUNDS + 1):
            expected = s.Models(*s.counted(text, s.passage_subjects(expected, text, own, 3), len(fitting.vocabulary), 0, 3), 3, len(fitting.vocabulary))
        assert np.array_equal(model.pairs, expected.pairs)
        assert np.allclose(model.alone, expected.alone) and np.allclose(model.after, expected.after)


def test_threshold_of_blocks():
    assert s.threshold([]) == 0.3 and s.threshold([(2, 25, 0.5)]) == 0.3
    assert s.threshold([(20, 25, 0.9), (22, 25, 0.6), (15, 25, 0.4), (3, 25, 0.1)]) == 0.4
