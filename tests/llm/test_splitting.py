import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thicket.llm import splitting as sp


def brute_valid(text, pos, limit, overlap, reach):
    if not pos or pos[0] != 0 or any(b <= a for a, b in zip(pos, pos[1:])):
        return False
    for i, a in enumerate(pos):
        end = pos[i + 1] + overlap if i + 1 < len(pos) else len(text)
        if not 1 <= end - a <= limit or end > len(text):
            return False
        if i + 1 < len(pos) and text[end : end + 1] != "\n" and "\n" in text[a + limit - reach : a + limit + 1]:
            return False
    return True


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.é🚀", min_size=31, max_size=400))
def test_pieces_are_valid_and_cover(text):
    got = sp.pieces(*sp.char_arrays(text), 30, 6, 9)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b[0] == a[1] - 6 for a, b in zip(got, got[1:]))
    pos = [a for a, _ in got]
    assert brute_valid(text, pos, 30, 6, 9)
    assert sp.valid(len(text), sp.line_feeds(text), np.array(pos), 30, 6, 9)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab\n", min_size=31, max_size=90), st.lists(st.integers(1, 80), max_size=5))
def test_valid_agrees_with_brute_force(text, more):
    pos = sorted({0, *more})
    got = len(pos) > 0 and sp.valid(len(text), sp.line_feeds(text), np.array(pos), 30, 6, 9)
    assert got == brute_valid(text, pos, 30, 6, 9)


def test_split_table(spark):
    rnd = random.Random(1)
    texts = {"a": "", "b": None, "c": "x" * 3600, "d": "y" * 9000, "e": "\n".join("w" * rnd.randrange(80) for _ in range(300)), "f": "ö\r\n" * 3000}
    df = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()], "hash string, doc string, seq string")
    rows = sp.split_texts(df).collect()
    assert {r.hash for r in rows} == {"d", "e", "f"}
    for k in "def":
        mine = sorted((r for r in rows if r.hash == k), key=lambda r: r.seq)
        assert [r.seq for r in mine] == list(range(len(mine))) and {r.total_chunks for r in mine} == {len(mine)}
        assert brute_valid(texts[k], [r.pos for r in mine], 3600, 540, 800)
        assert mine[-1].pos + mine[-1].n_chars == len(texts[k])
    assert sp.split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sp.split_texts(df, limit=5, overlap=5)


def test_token_units():
    path = "/opt/tokenizers/byte_bpe_50k.json"
    text = ("The quick brown fox. " * 40 + "\n") * 6
    ends, levels = sp.token_arrays(path)(text)
    got = sp.pieces(ends, levels, 100, 10, 30)
    starts = np.concatenate([[0], ends[:-1]])
    assert got[0][0] == 0 and got[-1][1] == int(ends[-1])
    for a, b in got:
        assert 1 <= int(((starts >= a) & (ends <= b)).sum()) <= 100


def test_tokens_of_a_vocabulary_file():
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    from thicket.llm.tokens import encoding

    for text in ("Naïve café, 日本語のメモ 🚀🚀. " * 60, "plain words only\n" * 90, "x" * 3000):
        ends, levels = sp.token_arrays(path)(text)
        tokens = [encoding(path).decode_single_token_bytes(i) for i in encoding(path).encode_ordinary(text)]
        whole, at, brute = text.encode(), 0, []
        for t in tokens:
            at += len(t)
            brute.append(next(i for i in range(len(text) + 1) if len(text[:i].encode()) >= at) if len(text) < 2000 else at)
        assert len(whole) == at and ends.tolist() == brute and int(ends[-1]) == len(text)
        got = sp.pieces(ends, levels, 50, 8, 20)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(a < b for a, b in got) and all(c <= b for (_, b), (c, _) in zip(got, got[1:]))


def test_split_by_tokens_and_checked(spark):
    long = "\n".join(["line of text"] * 700)
    content = spark.createDataFrame([("a", long), ("a", long), ("b", "short"), ("c", None), ("d", "x" * 9000), ("e", "")], "hash string, doc string")
    rows = sp.split_texts(content, limit=100, overlap=10, reach=30, arrays=sp.token_arrays("/opt/tokenizers/byte_bpe_50k.tiktoken")).collect()
    assert {r.hash for r in rows} == {"a", "d"} and all(r.n_chars > 0 for r in rows)
    assert sorted((r.hash, r.valid) for r in sp.checked(content).collect()) == [("a", True), ("d", True)]


def test_found_wrong_sets(spark):
    long = "\n".join(["line of text"] * 700)
    content = spark.createDataFrame([(h, long) for h in ("ok", "twice", "none", "gap", "nulls", "count", "far", "rest")] + [("short", "x"), ("null", None)], "hash string, doc string")
    good = [a for a, _ in sp.pieces(*sp.char_arrays(long))]
    k = len(good)
    rows = []
    for h in ("ok", "twice", "gap", "nulls", "count", "far", "rest"):
        rows += [[h, i, p, "m", "", k] for i, p in enumerate(good)]
    rows += [list(r) for r in rows if r[0] == "ok"]  # whole repeats count once
    rows += [r[:3] + ["other"] + r[4:] for r in rows if r[0] == "twice"]
    for r in rows:
        r[1] += r[0] == "gap" and r[1] > 0
        r[5] = None if r[0] == "nulls" else r[5] + (r[0] == "count")
        r[2] += (r[0] == "far" and r[1] == 1) * 7
    rows.append(["rest", k, good[-1] + 10, "m", "", k])
    rows.append([None, 0, 0, "m", "", 1])
    vectors = spark.createDataFrame([tuple(r) for r in rows], "hash string, seq int, pos long, model string, embed_fingerprint string, total_chunks int")
    assert {r.hash for r in sp.found_wrong_pieces(content, vectors).collect()} == {"twice", "none", "gap", "nulls", "count", "far", "rest"}
    assert sp.found_wrong_pieces(content.limit(0), vectors).count() == 0
    assert sp.found_wrong_pieces(content, vectors.limit(0)).count() == 8
