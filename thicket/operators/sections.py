"""Texts cut into ranked units: page sections, and chunks that end at weighted break points."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions import text as tx
from thicket.session import cut

# Where a text may be broken and what such a place is worth; of several at one place the first most worth counts.
BREAKS = (
    ("h1", 100, r"\n#{1}(?!#)"), ("h2", 90, r"\n#{2}(?!#)"), ("h3", 80, r"\n#{3}(?!#)"), ("h4", 70, r"\n#{4}(?!#)"), ("h5", 60, r"\n#{5}(?!#)"), ("h6", 50, r"\n#{6}(?!#)"),
    ("codeblock", 80, r"\n```"), ("hr", 60, r"\n(?:---|\*\*\*|___)\s*\n"), ("blank", 20, r"\n\n+"), ("list", 5, r"\n[-*]\s"), ("numlist", 5, r"\n[0-9]+\.\s"), ("newline", 1, r"\n"),
)
#: Characters of a chunk, shared with the next one, and looked back over; how much a break is worth less at the window's start.
CHUNK, SHARED, WINDOW, DECAY = 3_600, 540, 800, 0.7
#: Characters of a section's unit; weight of its heading; words left out.
UNIT, HEADING_WEIGHT, K1, B = 2_000, 2.5, 1.5, 0.5
# Words that the ranking of sections leaves out.
STOP = "a an and are as at be by for from has have i in is it its of on or that the this to was were will with you your we our".split()
_BREAKS = [(name, score, re.compile(p)) for name, score, p in BREAKS]


def break_points(text: str) -> list[tuple[int, int, str]]:
    """(place, worth, kind) of the breaks of a text, sorted."""
    best: dict[int, tuple[int, str]] = {}
    for name, score, pattern in _BREAKS:
        for m in pattern.finditer(text):
            if m.start() not in best or score > best[m.start()][0]:
                best[m.start()] = (score, name)
    return [(at, *best[at]) for at in sorted(best)]


def fences(text: str) -> list[tuple[int, int]]:
    """The regions of fenced code: from the line feed before a fence to the end of the fence that closes it, or of the text."""
    at = [(m.start(), m.end()) for m in re.finditer("\n```", text)]
    return [(at[i][0], at[i + 1][1] if i + 1 < len(at) else len(text)) for i in range(0, len(at), 2)]


def chunks(text: str, size: int = CHUNK, shared: int = SHARED, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, end) of the chunks of a text: each ends at the break outside code worth most in the last `window` characters, worth falling with the square of the distance."""
    if len(text) <= size:
        return [(0, len(text))]
    points, code = break_points(text), fences(text)
    starts, ends = np.array([a for a, _ in code], np.int64), np.array([b for _, b in code], np.int64)
    place, worth = np.array([p for p, _, _ in points], np.int64), np.array([w for _, w, _ in points], float)
    if len(code) and len(place):
        in_code = np.searchsorted(starts, place, "left") - 1
        free = (in_code < 0) | (place >= ends[np.maximum(in_code, 0)])
        place, worth = place[free], worth[free]
    out, at = [], 0
    while True:
        target = min(at + size, len(text))
        end = target
        if target < len(text):
            low, high = np.searchsorted(place, target - window), np.searchsorted(place, target, "right")
            if high > low:
                score = worth[low:high] * (1 - ((target - place[low:high]) / window) ** 2 * DECAY)
                best = int(place[low + int(score.argmax())])
                end = best if best > at else target
        out.append((at, end))
        if end >= len(text):
            return out
        at = end - shared if end - shared > at else end


def chunk_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, pos, n_chars): the chunks of every text, whole, where the row lies. Null texts have none, an empty one has one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, a, b - a) for k, t in zip(pdf[key], pdf[text]) if t is not None for i, (a, b) in enumerate(chunks(t))]
            yield pd.DataFrame(rows, columns=[key, "seq", "pos", "n_chars"]).astype({"seq": "int32", "pos": "int64", "n_chars": "int32"})

    return df.select(key, text).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, seq int, pos bigint, n_chars int")


def units(body: str) -> list[tuple[str, int, int, str]]:
    """(heading, first line, last line, text) of a page's units: its sections under headings outside code, those above UNIT characters cut further at blank lines.

    Lines count from 1. A part that begins with a list item is named by it. Units of blanks alone are left out."""
    lines, sections, fenced = body.split("\n"), [], False
    for i, line in enumerate(lines):
        head = None
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
            if not sections:  # a fence before any text belongs to no unit
                continue
        elif not fenced:
            head = re.match(r"(#{1,5})\s+(.*)$", line)
        if head:
            sections.append([head[2], i + 2, []])
            continue
        if not sections:
            sections.append(["", i + 1, []])
        sections[-1][2].append(line)
    out = []
    for heading, first, rows in sections:
        if len("\n".join(rows)) <= UNIT:
            out.append((heading, first, rows))
            continue
        parts, part, n = [], [], 0
        for line in rows:
            if len(line) + 1 >= UNIT:
                if part:
                    parts.append(part)
                    part, n = [], 0
                parts += [[line[a : a + UNIT]] for a in range(0, len(line), UNIT)]
                continue
            if part and not line.strip() and n > UNIT / 2:
                parts.append(part)
                part, n = [], 0
                continue
            if part and n + len(line) + 1 > UNIT:
                parts.append(part)
                part, n = [], 0
            part.append(line)
            n += len(line) + 1
        if part:
            parts.append(part)
        if len(parts) < 2:
            out.append((heading, first, rows))
            continue
        for p in parts:
            lead = next((x for x in p if x.strip()), "")
            out.append((lead.strip()[:80] if re.match(r"\s*([-*]|\d+\.)\s+", lead) else heading, first, p))
            first += len(p)
    return [(h, a, a + len(r) - 1, "\n".join(r)) for h, a, r in out if any(x.strip() for x in r)]


def split_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit, heading, first_line, last_line, body) of every text, whole; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *u) for k, t in zip(pdf[key], pdf[text]) if t is not None for i, u in enumerate(units(t))]
            yield pd.DataFrame(rows, columns=[key, "unit", "heading", "first_line", "last_line", "body"]).astype({"unit": "int32", "first_line": "int32", "last_line": "int32"})

    return df.select(key, text).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, unit int, heading string, first_line int, last_line int, body string")


def section_words(column) -> F.Column:
    return F.filter(tx.words(column), lambda w: (F.length(w) > 1) & ~w.isin(STOP))


def stem(word: str) -> str:
    """A word without its common English endings."""
    if len(word) <= 3:
        return word
    if word.endswith("ies") and len(word) > 4:
        word = word[:-3] + "y"
    elif word.endswith("es") and len(word) > 4 and re.search(r"[sxz]|ch$", word[:-2]):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    for ending, least in (("ing", 5), ("ed", 4)):
        if word.endswith(ending) and len(word) > least:
            word = word[: -len(ending)]
            break
    if word.endswith("ly") and len(word) > 4:
        word = word[:-2]
    vowel, other = "aeiouy", "bcdfghjklmnpqrstvwxz"
    if len(word) > 3 and word[-1] == "e" and word[-4] in other and word[-3] in vowel and word[-2] in other:
        word = word[:-1]
    return word


def score_units(parts: DataFrame, key: str, query: str, by_page: bool = False) -> DataFrame:
    """(key, unit, heading, first_line, last_line, body, score): BM25 of the units that have a word of the query, over all units or, by_page, over those of the same text.

    k1 = 1.5, b = 0.5, lengths in characters, words of the heading count 2.5. Words of the query are a parameter, so their counts are columns; nothing is exploded."""
    terms = list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", query.lower()) if len(w) > 1 and w not in STOP))
    return _scored(parts, key, terms, section_words, by_page)


def _scored(parts: DataFrame, key: str, terms: Sequence[str], words, by_page: bool) -> DataFrame:
    if not terms:
        return parts.withColumn("score", F.lit(0.0)).filter("false")
    count = lambda c, t: F.size(F.filter(c, lambda w: w == t))
    seen = parts.withColumns({"_h": words(F.col("heading")), "_b": words(F.col("body"))})
    seen = seen.withColumns({f"_t{i}": HEADING_WEIGHT * count("_h", t) + count("_b", t) for i, t in enumerate(terms)} | {"_len": F.length("body")}).drop("_h", "_b")
    seen = cut(seen)
    about = [F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(terms))]]
    # A page's units are few, or at worst those of one long text, which were split in one place.
    met = seen.join(seen.groupBy(key).agg(*about), key) if by_page else seen.join(F.broadcast(seen.agg(*about)))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5) + 1)
        tf = F.col(f"_t{i}")
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.greatest("_len", F.lit(1)) / F.col("_avg")))).otherwise(0.0)
    return met.withColumn("score", score).filter("score > 0").select(*parts.columns, "score")


def best_units(parts: DataFrame, key: str, query: str, n: int = 3) -> DataFrame:
    """(key, unit, ..., score, place, stemmed): the n best units of each page. Pages where no unit has a word of the query are asked again with stems; those without any then are left out."""
    plain = cut(score_units(parts, key, query, by_page=True).withColumn("stemmed", F.lit(False)))
    rest = parts.join(plain.select(key).distinct(), key, "left_anti")
    stems = F.pandas_udf(lambda a: a.map(lambda ws: [stem(w) for w in ws]), "array<string>")
    terms = list(dict.fromkeys(stem(w) for w in re.findall("[a-z0-9]+", query.lower()) if len(w) > 1 and w not in STOP))
    again = _scored(rest, key, terms, lambda c: stems(section_words(c)), True).withColumn("stemmed", F.lit(True))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "unit"))
    return plain.unionByName(again).withColumn("place", place).filter(F.col("place") <= n)


def best_lines(ranked: DataFrame, query: str) -> DataFrame:
    """ranked with match_line, the first of the lines of a unit with the most distinct words of the query, and context, it and three lines on each side within the unit."""
    terms = [w for w in re.findall("[a-z0-9]+", query.lower()) if len(w) > 1 and w not in STOP]
    lines = F.split("body", "\n")
    hits = F.transform(lines, lambda x: sum((F.lower(x).contains(t).cast("int") for t in terms), F.lit(0)))
    at = F.array_position(hits, F.array_max(hits)).cast("int")
    low = F.greatest(at - 3, F.lit(1))
    return ranked.withColumns({"match_line": F.col("first_line") + at - 1, "context": F.array_join(F.slice(lines, low, F.least(at + 3, F.size(lines)) - low + 1), "\n")})
