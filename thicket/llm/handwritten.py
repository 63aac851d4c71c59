"""Source files that nobody wrote by hand in their repository: tool output, minified scripts, third-party copies, data kept as code.

A random forest judges the text below a file's header: how far it compresses, the entropy of its tokens, the lengths of its identifiers, its comments, literals
and lines; and where the file and its copies lie, by how often the labelled files in directories of the same names were made elsewhere. It is trained on files whose
header says what they are, and never sees headers.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.skew import lookup
from thicket.session import cut

#: Labelled files of each kind that the forest is fitted on, at most; which ones, a hash of the path decides.
TRAINED_ON = 10_000
#: Trees, their depth, and the share of them that must call a file machine-made.
TREES, DEPTH, THRESHOLD = 60, 10, 0.5

# How tools, other projects and a repository's own authors sign a file.
TOOL_NOTICE = re.compile(r"(?i)\b(code|auto|machine)[- ]?generated\b(?! report)|@generated\b|<auto-generated|\bthis is a generated file\b|\bmachine-written\b|\bchanges (will be|are) (overwritten|discarded)\b|\bgenerated by [`\w.-]+ (by|from|using|with)\b|\bregenerate with:")
FOREIGN_NOTICE = re.compile(r"(?i)SPDX-FileCopyrightText:|Copyright \(c\)|\bthis file is part of\b|\bvendored from\b|\bupstream (?:copy|source|version)\b|\bimported (?:at|from) (?:revision|commit|tag|version)\b|\breport (?:bugs|issues) (?:to|at)\b|@license\b|(?P<bundled>/\*! *[\w-]+ +v?\d)")
OWN_NOTICE = re.compile(r"(?i)\bthis repository\b|^\W*owned by\b", re.M)

COMMENT = re.compile(r"^\s*(//|#(?!\s*(include|define|if|endif|pragma|\[|!\[))|/\*|\*/|\*\s|\*$|--(?!\w)|;|<!--|\"\"\"|''')")
TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\s\w]")
FEATURES = ("packed", "entropy", "distinct", "name_length", "short_names", "long_names", "comments", "line_length", "longest_line", "digits", "literals", "blanks", "repeats", "symbols", "words", "openers")
#: What the forest sees beside FEATURES: the index's hint where the place agrees, the file's place, and for third-party code those of its copies too.
PLACES = ("hinted", "near_made", "near_foreign")


def header(text: str) -> tuple[str, str]:
    """A text's leading comments, blank lines between them included, and what follows; of a one-line script the banner at its start."""
    banner = re.match(r"\s*/\*.*?\*/", text, re.S)
    if banner and "\n" not in banner.group().strip() and not re.match(r"[ \t]*\r?\n", text[banner.end() :]):
        return banner.group(), text[banner.end() :]
    at, inside = 0, False
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if inside:
            inside = "*/" not in bare
        elif bare and not COMMENT.match(line):
            break
        elif bare.startswith("/*"):
            inside = "*/" not in bare
        at += len(line)
    return text[:at], text[at:]


def notices(text: str) -> tuple[int, int, int, int]:
    """(tool, foreign, own, bundled) 0/1 from a header: signed by a tool, by another project, by the repository's own authors, with a bundler's banner."""
    own = 1 if OWN_NOTICE.search(text) else 0
    foreign = None if own else FOREIGN_NOTICE.search(text)
    return int(TOOL_NOTICE.search(text) is not None), int(foreign is not None), own, int(foreign is not None and foreign.group("bundled") is not None)


#: Tokens and bytes that ratios which fall with a text's length are taken over; their means over the whole text count.
WINDOW, CHUNK = 256, 4_096


#: What a line's form leaves out.
WORDS = bytes(i for i in range(256) if i > 127 or chr(i).isalnum() or chr(i) in "_ \t\r\f\v")


def shape(body: str) -> tuple[float, ...]:
    """FEATURES of a text without its header; all 0 for one without tokens."""
    tokens = TOKEN.findall(body)
    if not tokens:
        return (0.0,) * len(FEATURES)
    raw = body.encode("utf-8", "surrogatepass")
    n = len(tokens)
    names = [t for t in tokens if t[0].isalpha() or t[0] in "_$"]
    literals = [t for t in tokens if t[0] in "\"'" or t[0].isdigit()]
    lengths = np.fromiter(map(len, names), np.int32, len(names)) if names else np.zeros(1, np.int32)
    lines = [x for x in body.splitlines() if x.strip()]
    forms = Counter(raw.translate(None, WORDS).split(b"\n"))
    opened = sum(1 for x in lines if x.rstrip()[-1] in "{:" and "(" in x or x.lstrip().startswith(("def ", "function ", "local function ")))
    entropy = distinct = words = 0.0
    for at in range(0, n, WINDOW):
        part = Counter(tokens[at : at + WINDOW])
        size = min(WINDOW, n - at)
        many = np.fromiter(part.values(), float, len(part))
        entropy += float((many * (math.log2(size) - np.log2(many))).sum()) / max(1.0, math.log2(size))
        distinct += len(part)
        words += sum(1 for t in part if len(t) > 2 and (t[0].isalpha() or t[0] in "_$"))
    return (
        sum(len(zlib.compress(raw[at : at + CHUNK], 1)) for at in range(0, len(raw), CHUNK)) / len(raw),
        entropy / n,
        distinct / n,
        float(lengths.mean()),
        float((lengths <= 1).mean()),
        float((lengths >= 14).mean()),
        sum(1 for x in lines if COMMENT.match(x)) / len(lines),
        len(body) / len(lines),
        max(map(len, lines)),
        1 - len(raw.translate(None, b"0123456789")) / len(raw),
        sum(map(len, literals)) / len(body),
        1 - len(raw.translate(None, b" \t\r\n\f\v")) / len(raw),
        max((k for x, k in forms.items() if x), default=0) / len(lines),
        1 - (len(names) + len(literals)) / n,
        words / n,
        opened / len(lines),
    )


def examine(content: DataFrame) -> DataFrame:
    """(hash, tool, foreign, own, bundled, FEATURES) for each text, read once where it lies. Null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["hash"], pdf["doc"]):
                head, body = header(text or "")
                rows.append((key, *notices(head), *shape(body)))
            yield pd.DataFrame(rows, columns=["hash", "tool", "foreign", "own", "bundled", *FEATURES])

    return content.select("hash", "doc").mapInPandas(run, "hash string, tool int, foreign int, own int, bundled int, " + ", ".join(f"{f} double" for f in FEATURES))


def parts(path: Column) -> Column:
    """The names that say where a file lies, each once: its directories, with a slash; of its own name the dotted ends, with a dot, and the first and last word."""
    names = F.split(path, "/")
    folders = F.transform(F.slice(names, 1, F.size(names) - 1), lambda x: F.concat(x, F.lit("/")))
    dotted = F.split(F.element_at(names, -1), r"\.")
    ends = F.transform(F.slice(dotted, 2, F.greatest(F.size(dotted) - 2, F.lit(0))), lambda x: F.concat(F.lit("."), x))
    stem = F.get(dotted, 0)
    word = F.array(F.regexp_extract(stem, "^_?([^_]+_)", 1), F.regexp_extract(stem, "(_[^_]+)$", 1), F.regexp_extract(stem, "[a-z]([A-Z][a-z]+)$", 1))
    return F.array_distinct(F.concat(folders, ends, F.filter(word, lambda x: x != "")))


def places(files: DataFrame) -> DataFrame:
    """(path, near_made, near_foreign): how far files signed by tools, and by other projects, are the most of the labelled files at any of a path's parts().

    That is twice their share, less 1; 0 where they are no majority. files: (path, made, foreign, own) 0/1, each path once. A file's own label does not count for itself, and a share is of one file more than there
    are, so that a name seen once tells little. Counts cover all labelled files; names common to many paths are joined apart."""
    named = cut(files.select("path", "made", "foreign", "own", F.explode(parts(F.col("path"))).alias("part")))
    seen = named.filter("made + foreign + own > 0").groupBy("part").agg(*[F.sum(c).alias(f"n_{c}") for c in ("made", "foreign", "own")])
    met = lookup(named, cut(seen.filter("n_made + n_foreign > 0")), "part", "inner")
    others = F.col("n_made") + F.col("n_foreign") + F.col("n_own") - F.greatest("made", "foreign", "own") + 1
    near = [F.greatest(2 * F.max((F.col(f"n_{c}") - F.col(c)) / others) - 1, F.lit(0.0)).alias(f"near_{c}") for c in ("made", "foreign")]
    return met.groupBy("path").agg(*near)


def judge(files: DataFrame, content: DataFrame, trained_on: int = TRAINED_ON, left_out: Column | None = None) -> DataFrame:
    """(path, content_hash, tool, foreign, own, machine): for each file its header's notices and the share of the forest's trees that say it was not written by hand.

    Labels come from headers: not by hand if a tool, a bundler or another project signed the file, by hand if only its own project did. As nobody signs data, files
    that are half literals and open no block are labelled too. The forest sees FEATURES of the text below the header and PLACES: whether the
    labelled files of its place, or of a place of an equal file, were made elsewhere, and the index's hint where such a place agrees with it. It is fitted on `trained_on` files of each kind at most, chosen by
    a hash of the path, and applied to all; rows where `left_out` holds are no examples, neither for the forest nor for places. Files whose text is missing, empty or
    all header get 0 unless they are placed near such files; with files of one kind only all get 0. A path stored more than once counts as one file."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    seen = cut(examine(content.filter("hash is not null")).dropDuplicates(["hash"]))
    once = files.filter("path is not null").groupBy("path").agg(F.min_by("content_hash", F.coalesce("content_hash", F.lit("~"))).alias("hash"), F.coalesce(F.max("generated"), F.lit(0)).cast("double").alias("hinted"))
    known = lookup(cut(once), seen, "hash", "left").fillna(0.0, list(FEATURES)).fillna(0, ["tool", "foreign", "own", "bundled"])
    made = (F.col("tool") == 1) | (F.col("bundled") == 1) | ((F.col("literals") >= 0.5) & (F.col("openers") == 0))
    label = F.when(made | (F.col("foreign") == 1), 1.0).when(F.col("own") == 1, 0.0)
    if left_out is not None:
        label = F.when(~left_out, label)
    known = cut(known.withColumn("label", label).withColumn("made", F.when(made & (F.col("label") == 1), 1).otherwise(0)))
    marks = known.select("path", "made", F.expr("int(label = 1 and made = 0)").alias("foreign"), F.expr("int(label = 0)").alias("own")).fillna(0)
    near = cut(known.join(places(marks), "path", "left").fillna(0.0, ["near_made", "near_foreign"]).withColumn("hinted", F.when(F.col("near_made") > 0, F.col("hinted")).otherwise(0.0)))
    # A text is where its copies are.
    copies = near.filter("hash is not null and hash <> sha2('', 256)").groupBy("hash").agg(F.max("near_foreign").alias("top")).filter("top > 0")
    every = lookup(near, cut(copies), "hash", "left").withColumn("near_foreign", F.greatest("near_foreign", F.coalesce("top", F.lit(0.0)))).drop("top")
    whole = VectorAssembler(inputCols=[*FEATURES, *PLACES], outputCol="features", handleInvalid="keep").transform(cut(every))
    sample = None
    for kind in (0.0, 1.0):
        part = whole.filter((F.col("label") == kind) & (F.col("packed") > 0)).orderBy(F.xxhash64("path"), "path").limit(trained_on).select("features", "label")
        sample = part if sample is None else sample.unionByName(part)
    sample = cut(sample.coalesce(1))
    kinds = [r[0] for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        return every.select("path", F.col("hash").alias("content_hash"), "tool", "foreign", "own", F.lit(0.0).alias("machine"))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=17, minInstancesPerNode=2, featureSubsetStrategy="onethird").fit(sample)
    share = F.when((F.col("packed") > 0) | (F.col("near_foreign") > 0), vector_to_array("probability")[1]).otherwise(0.0)
    return model.transform(whole).select("path", F.col("hash").alias("content_hash"), "tool", "foreign", "own", share.alias("machine"))


def found_not_handwritten(files: DataFrame, content: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path) of each file that nobody wrote by hand in its repository: those the forest says so of.

    Output that looks like written code, and a third-party copy among its own project's code, differ from hand-written files in nothing but their header; a header
    signed by a tool or another project settles what the forest left open. Null paths are left out; repeated rows come out once."""
    judged = judge(files, content)
    signed = (F.col("tool") == 1) | (F.col("foreign") == 1)
    return judged.filter((F.col("machine") >= threshold) | signed).select("path")


def held_out(files: DataFrame, content: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """One row: n_files, n_signed, n_called, n_both over the labelled files of one of `folds` parts, that the forest was fitted without: recall is n_both / n_signed."""
    out = F.pmod(F.xxhash64(F.lit(5), "path"), F.lit(folds)) == 0
    judged = judge(files, content, left_out=out).filter(out).filter("tool = 1 or foreign = 1 or own = 1")
    signed, called = (F.col("tool") == 1) | (F.col("foreign") == 1), F.col("machine") >= threshold
    return judged.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(signed).alias("n_signed"), F.count_if(called).alias("n_called"), F.count_if(signed & called).alias("n_both"))
