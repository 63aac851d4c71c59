"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary of the byte-level tokenizer lies; it must be there on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict = {}


def encoding(path: str, pattern: str = PATTERN):
    """The encoding of a vocabulary file, read once a process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and n_tokens, a long, of each row's whole text, counted where the row lies. Null and empty texts have 0."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            out = pdf[keep].copy()
            out["n_tokens"] = [len(enc.encode_ordinary(x)) if x else 0 for x in pdf["_text"]]
            yield out

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_tokens bigint"])
    return df.select(*keep, F.col(text).alias("_text")).mapInPandas(run, schema)
