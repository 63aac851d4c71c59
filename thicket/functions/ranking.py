"""Scores of names, paths and kinds against a query, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket.functions import text as tx

# What a symbol's kind adds to its score; other kinds add nothing.
KIND_BONUS = {
    "function": 10, "method": 10, "class": 8, "interface": 9, "type_alias": 6, "struct": 6, "union": 6, "trait": 9, "enum": 5, "component": 8, "route": 9, "module": 4,
    "property": 3, "field": 3, "variable": 2, "constant": 3, "import": 1, "export": 1, "parameter": 0, "namespace": 4, "file": 0, "protocol": 9, "enum_member": 3,
}
# What a document's role adds to its score.
ROLE_PRIOR = {"current_authority": 0.35, "operator_runbook": 0.10, "implementation_or_historical_plan": -0.35, "generated_or_prompt": -0.40}


def kind_bonus(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in KIND_BONUS.items() for x in (F.lit(k), F.lit(v))])[kind], F.lit(0))


def role_prior(role: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in ROLE_PRIOR.items() for x in (F.lit(k), F.lit(v))])[role], F.lit(0.0))


def name_bonus(name: Column, query: str) -> Column:
    """80 for the query itself, 60 for one of its words, 10 to 40 for a name that begins with it by the share it makes up, 15 if all its parts are in the name, 10 if it is; else 0."""
    n, whole = F.lower(name), re.sub(r"\s+", "", query).lower()
    parts = [p.lower() for p in re.split(r"[\s_.\-]+", re.sub("([a-z])([A-Z])", r"\1 \2", query)) if len(p) >= 2]
    words = [w.lower() for w in query.split() if len(w) >= 2]
    out = F.when(n == whole, 80)
    if len(words) > 1:
        out = out.when(n.isin(words), 60)
    out = out.when(n.startswith(whole), F.floor(10 + 30 * F.lit(float(len(whole))) / F.length(n) + 0.5).cast("int"))
    if len(parts) > 1:
        every = F.lit(True)
        for p in parts:
            every = every & n.contains(p)
        out = out.when(every, 15)
    return out.when(n.contains(whole), 10).otherwise(0)


def path_relevance(path: Column, query: str) -> Column:
    """For each word of the query 10 if it is in the file's name, and 5 if in its directory or else 3 if in the path; 15 less for tests unless the query is about them."""
    low, out = F.lower(path), F.lit(0)
    name, folder = tx.base_name(low), tx.directory(low)
    for word in query.split():
        parts = {word.lower(), *(p.lower() for p in re.split(r"[^A-Za-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", word)) if p)}
        some = lambda c, parts=sorted(parts): F.greatest(*[c.contains(p) for p in parts], F.lit(False))
        out = out + F.when(some(name), 10).otherwise(0) + F.when(some(folder), 5).when(some(low), 3).otherwise(0)
    about_tests = "test" in query.lower() or "spec" in query.lower()
    return out if about_tests else out - F.when(tx.test_path(path), 15).otherwise(0)


def base_name_boost(path: Column, query: str) -> Column:
    """500 for a file named as the query, 350 if it begins with it and a separator, 250 if it ends with it, 180 if it has it, 200 for its directory's name; else 0."""
    q, stem = query.lower(), F.lower(F.regexp_replace(tx.base_name(path), r"(.)\.[^.]*$", "$1"))
    parent = F.lower(F.regexp_extract(path, "([^/]*)/[^/]*$", 1))
    return F.when(stem == q, 500).when(stem.startswith(q) & F.substring(stem, len(q) + 1, 1).isin("_", ".", "-"), 350).when(stem.endswith(q), 250).when(stem.contains(q), 180).when(parent == q, 200).otherwise(0)


def definition_boost(name: Column, query: str, target: Column | None = None) -> Column:
    """220 for the query itself, 180 in any case, 120 if it is what the definition implements, 80 as a prefix, 40 within; else 0."""
    q, low = query.lower(), F.lower(name)
    out = F.when(name == query, 220).when(low == q, 180)
    if target is not None:
        out = out.when(target == query, 120)
    return out.when(low.startswith(q), 80).when(low.contains(q), 40).otherwise(0)


def no_code_penalty(path: Column) -> Column:
    """250 for documentation, 80 more if it explains examples, 150 for what is named generated."""
    prose = tx.extension(path).isin("md", "txt", "rst")
    docs = prose | tx.extension(path).isin("mdx") | path.rlike("(^|/)docs?(/|$)")
    shown = prose & path.rlike("(^|/)(examples?|samples?|templates?)(/|$)")
    return F.when(docs, 250).otherwise(0) + F.when(shown, 80).otherwise(0) + F.when(path.contains("generated"), 150).otherwise(0)


def narrow_test_path(path: Column) -> Column:
    """Whether a path is a test's by a directory test, tests or __tests__, or by the file's name."""
    low = F.lower(tx.base_name(path))
    stem = F.split(low, r"\.")[0]
    return path.rlike("(^|/)(test|tests|__tests__)(/|$)") | low.contains(".test.") | low.contains(".spec.") | stem.startswith("test_") | stem.endswith("_test") | stem.endswith("-test")


def frecency_word(score: Column) -> Column:
    return F.when(score >= 100, "hot").when(score >= 50, "warm").when(score >= 10, "frequent")


def blended(rank: Column, rerank: Column) -> Column:
    """A fused rank and a reranker's score in one: the rank weighs 0.75 up to place 3, 0.6 up to 10, 0.4 after."""
    w = F.when(rank <= 3, 0.75).when(rank <= 10, 0.60).otherwise(0.40)
    return w / rank + (1 - w) * rerank


def token_bucket(tokens: Column, start: int = 50_000, interval: int = 30_000) -> Column:
    return F.when(tokens < start, 0).otherwise(1 + F.floor((tokens - start) / interval)).cast("long")


def excerpt(text: Column, chars: int) -> Column:
    """A text within so many characters, cut at the last blank if that is beyond 60 % of them, with an ellipsis."""
    t = F.regexp_replace(text, r"^\s+|\s+\z", "")
    head = F.substring(t, 1, chars)
    last = chars - F.instr(F.reverse(head), " ")  # place of the last blank, from 0
    kept = F.when((F.instr(head, " ") > 0) & (last > chars * 0.6), F.substr(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(t) <= chars, t).otherwise(F.concat(F.regexp_replace(kept, r"\s+\z", ""), F.lit(" …")))


def redact_url(url: Column) -> Column:
    """A URL without its user and with the values of secret parameters gone."""
    u = F.regexp_replace(url, "^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")
    return F.regexp_replace(u, "(?i)([?&][^=&#]*(?:token|key|secret|password|signature|auth)[^=&#]*=)[^&#]*", "$1[redacted]")


def multiset_dice(a: Column, b: Column) -> Column:
    """Sorensen-Dice of the multisets of letter pairs, blanks left out: 1 for equal texts, 0 where one has no pair."""
    x, y = F.regexp_replace(a, r"\s+", ""), F.regexp_replace(b, r"\s+", "")
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2)))
    # The k-th copy of a pair is told from the others by k, so that sets do.
    numbered = lambda p: F.transform(F.sort_array(p), lambda v, i: F.concat(v, F.lit("#"), (i - F.array_position(F.sort_array(p), v)).cast("string")))
    p, q = numbered(pairs(x)), numbered(pairs(y))
    both = F.size(F.array_intersect(p, q))
    return F.when(x == y, 1.0).when((F.length(x) < 2) | (F.length(y) < 2), 0.0).otherwise(2 * both / (F.length(x) + F.length(y) - 2))
