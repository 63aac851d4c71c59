"""Cutting long texts into overlapping pieces at natural boundaries, and auditing stored pieces.

Both work on arrays of a text: the offsets where units (characters or tokens) end, as prefix sums of their sizes, and the sorted offsets of its natural
boundaries. The end of a piece is the last boundary that the limit allows, found by binary search; the next piece begins `overlap` units before that end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.tokens import encoding
from thicket.session import cut

#: Characters of a piece at most, shared with the next piece, and before the limit within which a boundary is looked for.
LIMIT, OVERLAP, REACH = 3_600, 540, 800

#: Natural boundaries from the strongest: what stands before the cut.
BOUNDARIES = (re.compile(r"\n[ \t]*\n+"), re.compile(r"\n"), re.compile(r"[.!?。][\"')\]]*\s"), re.compile(r"\s"))


def line_feeds(text: str) -> np.ndarray:
    """Offsets of the line feeds of a text in code points, sorted."""
    if text.isascii():
        return np.flatnonzero(np.frombuffer(text.encode("ascii"), np.uint8) == 10)
    return np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)


def last_in(offsets: np.ndarray, low: int, high: int) -> int | None:
    """The last of the sorted offsets in low..high, both included."""
    at = int(np.searchsorted(offsets, high, "right")) - 1
    return int(offsets[at]) if at >= 0 and offsets[at] >= low else None


def pieces(ends: np.ndarray, levels: list[np.ndarray], limit: int = LIMIT, overlap: int = OVERLAP, reach: int = REACH) -> list[tuple[int, int]]:
    """(first, end) offsets of the pieces of a text.

    ends: prefix sums, the offset after each unit; levels: sorted offsets at which a piece may end, strongest kind first. A piece holds `limit`
    units at most. It ends at the last boundary of the strongest kind that has one within its last `reach` units, else after `limit` units, and the next
    begins `overlap` units before its end, at a unit's start. A boundary that would not let the next piece get further is passed over."""
    total = len(ends)
    if not total:
        return []
    starts = np.concatenate([[0], ends[:-1]])
    out, at = [], 0
    while True:
        if total - at <= limit:
            out.append((int(starts[at]), int(ends[-1])))
            return out
        far, near = int(ends[at + limit - 1]), int(ends[at + max(limit - reach, overlap + 1) - 1])
        end = next((x for x in (last_in(level, near, far) for level in levels) if x is not None), far)
        stop = int(np.searchsorted(ends, end, "right"))  # units that end at or before the cut
        end = int(ends[stop - 1])
        out.append((int(starts[at]), end))
        at = max(stop - overlap, at + 1)


def char_arrays(text: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ends of the characters; cuts before line feeds, the pieces' first choice, then after sentences, then before blanks."""
    feeds = line_feeds(text)
    return np.arange(1, len(text) + 1), [feeds, *(np.array([m.end() - 1 for m in p.finditer(text)], dtype=np.int64) for p in BOUNDARIES[2:])]


def _split(columns: list[str], arrays: Callable, limit: int, overlap: int, reach: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf[columns[0]], pdf[columns[1]]):
                if text is None or text == "":
                    continue
                got = pieces(*arrays(text), limit, overlap, reach)
                if len(got) < 2:
                    continue
                rows += [(key, i, a, b - a, len(got)) for i, (a, b) in enumerate(got)]
            yield pd.DataFrame(rows, columns=[columns[0], "seq", "pos", "n_chars", "total_chunks"]).astype({"seq": "int32", "pos": "int64", "n_chars": "int32", "total_chunks": "int32"})

    return run


def split_texts(df: DataFrame, key: str = "hash", text: str = "doc", limit: int = LIMIT, overlap: int = OVERLAP, reach: int = REACH, arrays: Callable = char_arrays) -> DataFrame:
    """(key, seq, pos, n_chars, total_chunks) for every text longer than the limit; pos and n_chars in code points.

    Texts are read once, where they lie: nothing is shuffled. A text within the limit, empty or null has no pieces here. `arrays` makes the
    arrays of a text; char_arrays counts in characters, token_arrays() in tokens. Repeated rows are cut alike; extra columns are ignored."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below the limit")
    long = df.select(key, text).filter(F.col(text).isNotNull() & (F.length(text) > limit)) if arrays is char_arrays else df.select(key, text)
    kind = dict(df.dtypes)[key]
    return long.mapInPandas(_split([key, text], arrays, limit, overlap, reach), f"`{key}` {kind}, seq int, pos bigint, n_chars int, total_chunks int")


def token_arrays(path: str) -> Callable:
    """Like char_arrays with tokens as units, of a vocabulary file or, for a path that ends in .json, of a file of the library tokenizers.

    The ends are prefix sums of the tokens' bytes, told in characters; a token that ends within a character ends with it."""
    sizes: dict[str, np.ndarray] = {}
    loaded: dict = {}

    def by_offsets(text: str) -> np.ndarray:
        if path not in loaded:
            from tokenizers import Tokenizer

            loaded[path] = Tokenizer.from_file(path)
            loaded[path].encode_special_tokens = True
        ends = np.array([b for _, b in loaded[path].encode(text, add_special_tokens=False).offsets], dtype=np.int64)
        return np.maximum.accumulate(ends) if len(ends) else ends

    def arrays(text: str) -> tuple[np.ndarray, list[np.ndarray]]:
        if path.endswith(".json"):
            return by_offsets(text), char_arrays(text)[1]
        enc = encoding(path)
        if path not in sizes:
            sizes[path] = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)
        ends = np.cumsum(sizes[path][np.array(enc.encode_ordinary(text), np.int64)])
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw) != len(text):
            ends = np.cumsum((raw & 0xC0) != 0x80)[np.minimum(ends, len(raw)) - 1]
        return ends, char_arrays(text)[1]

    return arrays


def _boundaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"hash": pdf["hash"], "length": [len(x) for x in pdf["doc"]], "feeds": [line_feeds(x).astype("int32") for x in pdf["doc"]]})


def _audit(limit: int, overlap: int, reach: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bad = []
            for length, feeds, seq, pos in zip(pdf["length"], pdf["feeds"], pdf["seqs"], pdf["positions"]):
                seq, pos, feeds = np.asarray(seq), np.asarray(pos, dtype=np.int64), np.asarray(feeds)
                own = [first for first, _ in pieces(np.arange(1, length + 1), [feeds], limit, overlap, reach)]
                # Sets that are not what the splitter makes of the text may still be right in another way.
                alike = len(own) == len(pos) and (pos == own).all() and (seq == np.arange(len(seq))).all()
                bad.append(not (alike or ((seq == np.arange(len(seq))).all() and (np.diff(pos) > 0).all() and valid(length, feeds, pos, limit, overlap, reach))))
            yield pdf.loc[bad, ["hash"]]

    return run


def valid(length: int, feeds: np.ndarray, pos: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, reach: int = REACH) -> bool:
    """Whether pieces at these rising positions are within the limit and end at line feeds wherever their last `reach` characters and the next one hold any."""
    ends = np.append(pos[1:] + overlap, length)
    sizes = ends - pos
    if (sizes < 1).any() or (sizes > limit).any() or (ends > length).any():
        return False
    at = np.searchsorted(feeds, ends[:-1])
    on = (at < len(feeds)) & (feeds[np.minimum(at, len(feeds) - 1)] == ends[:-1]) if len(feeds) else np.zeros(len(pos) - 1, bool)
    some = np.searchsorted(feeds, pos[:-1] + limit, "right") > np.searchsorted(feeds, pos[:-1] + limit - reach)
    return bool((on | ~some).all())


def found_wrong_pieces(content: DataFrame, vectors: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, reach: int = REACH) -> DataFrame:
    """(hash) of each text longer than the limit whose stored pieces are not a valid set.

    Wholly equal rows of `vectors` count once. A set of k rows must be numbered 0..k-1, say so in total_chunks, begin at 0 and rise; that is told from
    counts by hash. Only sets that pass, which have no more rows than their text has characters, are brought together with the text's boundary array, not
    the text, which is split anew with it; a set that differs from those pieces is checked piece by piece. Nulls in seq, pos or total_chunks make a set wrong; null texts and hashes are no cases; texts without rows are."""
    long = content.select("hash", "doc").filter(F.col("hash").isNotNull() & (F.length("doc") > limit))
    arrays = cut(long.mapInPandas(_boundaries, "hash string, length int, feeds array<int>").dropDuplicates(["hash"]))
    # Rows are equal if hash, seq, pos, total_chunks and a hash of the rest are.
    rest = [c for c in vectors.columns if c not in ("hash", "seq", "pos", "total_chunks")]
    nulls = F.concat(F.lit(""), *[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in rest])
    once = vectors.filter("hash is not null").select("hash", "seq", "pos", "total_chunks", F.xxhash64(nulls, *[F.col(f"`{c}`") for c in rest]).alias("mark")).distinct()
    once = cut(once)
    counts = [F.count(F.lit(1)).alias("k")] + [F.count(c).alias(f"k_{c}") for c in ("seq", "pos", "total_chunks")]
    ends = [F.min("seq").alias("s0"), F.max("seq").alias("s1"), F.min("total_chunks").alias("t0"), F.max("total_chunks").alias("t1"), F.min("pos").alias("p0")]
    shaped = once.groupBy("hash").agg(*counts, *ends)
    whole = "k_seq = k and k_pos = k and k_total_chunks = k and s0 = 0 and s1 = k - 1 and t0 = k and t1 = k and p0 = 0 and k <= length"
    told = cut(arrays.select("hash", "length").join(shaped, "hash", "left").select("hash", F.coalesce(F.expr(whole), F.lit(False)).alias("open")))
    open_ = told.filter("open").select("hash")
    lists = once.join(open_, "hash", "left_semi").groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("seq", "pos"))).alias("rows"))
    asked = arrays.join(lists, "hash").select("hash", "length", "feeds", F.col("rows.seq").alias("seqs"), F.col("rows.pos").alias("positions"))
    return told.filter("not open").select("hash").unionByName(asked.mapInPandas(_audit(limit, overlap, reach), "hash string"))


def checked(content: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, reach: int = REACH) -> DataFrame:
    """(hash, n_pieces, valid) for each text longer than the limit: what split_texts() makes of it, and whether that passes found_wrong_pieces()."""
    made = cut(split_texts(content.dropDuplicates(["hash"]), "hash", "doc", limit, overlap, reach))
    wrong = found_wrong_pieces(content, made, limit, overlap, reach).withColumn("wrong", F.lit(True))
    sizes = made.groupBy("hash").agg(F.count(F.lit(1)).alias("n_pieces"))
    long = content.filter(F.col("hash").isNotNull() & (F.length("doc") > limit)).select("hash").distinct()
    return long.join(sizes, "hash", "left").join(wrong, "hash", "left").select("hash", F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"), F.col("wrong").isNull().alias("valid"))
