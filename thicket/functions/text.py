"""Column functions on identifiers, paths, URLs and prose; all run inside the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a search over prose leaves out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "with")

# Extensions by kind of file.
MARKDOWN, STRUCTURED, TABULAR, LOGS = ("md", "mdx", "rst"), ("json", "yaml", "yml", "toml", "xml", "ini"), ("csv", "tsv"), ("log",)


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, cut where a capital follows a small letter, in lower case."""
    cut_at_case = F.regexp_replace(text, r"(?<=\p{IsLowercase})(?=\p{IsUppercase})", " ")
    return F.regexp_extract_all(F.lower(cut_at_case), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), 0)


def content_words(text: Column, least: int = 2) -> Column:
    """words() of `least` characters or more that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words(text), lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w))


def segments(name: Column) -> Column:
    """Parts of an identifier in lower case: cut at case changes, acronyms' ends and other characters; numbers alone dropped, 12 at most."""
    split = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.split(F.lower(F.regexp_replace(split, "[^A-Za-z0-9]+", " ")), " +")
    return F.slice(F.filter(parts, lambda p: (p != "") & ~p.rlike("^[0-9]+$")), 1, 12)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_type(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(*MARKDOWN), "markdown").when(e.isin(*STRUCTURED), "structured").when(e.isin(*TABULAR), "tabular").when(e.isin(*LOGS), "log").when(e == "", "other").otherwise("code")


def directory(path: Column) -> Column:
    """All before the last slash; "." where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def title(text: Column, path: Column) -> Column:
    """The first heading of level 1 or 2, else an org title, else the file's name without its extension."""
    org = F.regexp_extract(text, r"(?m)^#\+TITLE:[ \t]*(\S.*)$", 1)
    head = F.regexp_extract(text, r"(?m)^##?[ \t]+(\S.*)$", 1)
    name = F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    return F.trim(F.when(head != "", head).when(org != "", org).otherwise(name))


def tokens_about(text: Column) -> Column:
    """A cheap estimate: a token for every four characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def glob_regex(glob: str) -> str:
    """A glob as a regular expression for rlike(): ** crosses directories, * and ? don't, {a,b} offers alternatives."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            if c == "{":
                depth += 1
            out += {"*": "[^/]*", "?": "[^/]", "{": "(?:"}.get(c) or (")" if c == "}" and depth else "|" if c == "," and depth else re.escape(c))
            depth -= c == "}" and depth > 0
            i += 1
    return f"^{out}$"


def test_path(path: Column) -> Column:
    """Whether a path is a test's by its directory or name."""
    return path.rlike(r"(^|/)(tests?|__tests__|spec|specs|testdata|fixtures)/|(^|/)test_[^/]*$|[._-](test|spec)s?\.[A-Za-z0-9]+$|_test\.[A-Za-z0-9]+$|Tests?\.[A-Za-z0-9]+$")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default ports, fragment and tracking parameters dropped, no slash at the end."""
    u = F.regexp_replace(url, "#.*$", "")
    u = F.regexp_replace(u, r"([?&])(?:utm_[a-z]+|fbclid|gclid|ref)=[^&]*(?=&|$)", "$1")
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "[?]&+", "?"), "&&+", "&"), "[?&]+$", "")
    origin = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)", 1))
    rest = F.substr(u, F.length(origin) + 1)
    origin = F.regexp_replace(F.regexp_replace(origin, "^(http://[^/]+):80$", "$1"), "^(https://[^/]+):443$", "$1")
    return F.when(origin == "", u).otherwise(F.concat(origin, F.regexp_replace(rest, "/+$", "")))


# What secrets look like in text.
SECRETS = {
    "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{12,}",
    "assignment": r"(?i)\b(?:api[_-]?key|secret|token|passw(?:or)?d)\b\s*[:=]\s*[\"']?[A-Za-z0-9._~+/=-]{8,}",
    "key": r"\b(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}",
}


def secret_counts(text: Column) -> Column:
    return F.struct(*[F.size(F.regexp_extract_all(text, F.lit(p), 0)).alias(k) for k, p in SECRETS.items()])


def redact(text: Column) -> Column:
    """Each secret replaced by its kind."""
    for kind, pattern in SECRETS.items():
        text = F.regexp_replace(text, pattern, f"[{kind} removed]")
    return text


def symbols_as_hex(text: Column) -> Column:
    """Emoji and other symbols as code points in hex, a dash between those of a run; a mark after one of them goes."""
    c = F.regexp_extract_all(text, F.lit("(?s)."), 0)
    at = lambda i: F.get(c, i)
    other, modifier, mark = (lambda x, p=p: F.coalesce(x.rlike(p), F.lit(False)) for p in (r"^\p{So}$", r"^\p{Sk}$", r"^\p{Mn}$"))
    swallowed = lambda i: mark(at(i)) & other(at(i - 1))
    goes_on = lambda i: other(at(i - 1)) | modifier(at(i - 1)) | (swallowed(i - 1))
    hexed = lambda x, i: F.when(other(x) | modifier(x), F.concat(F.when(goes_on(i), "-").otherwise(""), F.lower(F.hex(F.ascii(x))))).when(swallowed(i), "").otherwise(x)
    return F.when(text.rlike(r"[\p{So}\p{Sk}]"), F.array_join(F.transform(c, hexed), "")).otherwise(text)


def slug(path: Column) -> Column:
    """A path's parts with runs of anything but letters, digits and $ as dashes, none at the ends of parts; "___" parts too, symbols become hex, the extension is kept.

    Null where the file's name without its extension has no letter, digit, symbol or $, which the reference refuses."""
    name = F.regexp_replace(F.regexp_extract(path, "([^/]*)/*$", 1), r"(?s)\.[^.]+$", "")
    text = symbols_as_hex(F.replace(path, F.lit("___"), F.lit("/")))
    ext = F.regexp_extract(text, r"(\.[A-Za-z0-9]+)\z", 1)
    stem = F.substr(text, F.lit(1), F.length(text) - F.length(ext))
    stem = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}$/]+", "-"), r"(^|/)-+|-+(?=/|\z)", "$1")
    # Empty parts go; a slash before the extension stays, as the extension is a part then.
    whole = F.regexp_replace(F.regexp_replace(F.concat(stem, ext), "/{2,}", "/"), r"^/|/\z", "")
    return F.when(name.rlike(r"[\p{L}\p{N}\p{So}\p{Sk}$]") & (whole != ""), whole)


def dice(a: Column, b: Column) -> Column:
    """Sorensen-Dice of the sets of letter pairs of two strings: 1 for equal ones, 0 where one has no pair."""
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))
    x, y = pairs(a), pairs(b)
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def highlight(text: Column, terms: list[str]) -> Column:
    """Terms of three characters or more between <b> tags, whatever their case."""
    long = [re.escape(t) for t in terms if len(t) >= 3]
    return F.regexp_replace(text, "(?i)(" + "|".join(long) + ")", "<b>$1</b>") if long else text


def line_of(text: Column) -> Column:
    """Lines of a text, whatever ends them."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def age_words(seconds: Column) -> Column:
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60), F.lit("m"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600), F.lit("h"))).otherwise(F.concat(F.floor(seconds / 86400), F.lit("d")))


def in_scope(url: Column, origin: str, include: list[str], exclude: list[str]) -> Column:
    """Whether a URL is of the origin and its path matches one of the globs to include and none to exclude; ** crosses slashes, * does not."""
    pattern = lambda g: "^" + "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", g)) + "$"
    path = F.substring(url, len(origin) + 1, 1 << 30)
    some = lambda globs: F.greatest(F.lit(False), F.lit(False), *[path.rlike(pattern(g)) for g in globs])
    return url.startswith(origin + "/") & some(include) & ~some(exclude)


def _plain(column: pd.Series) -> pd.Series:
    return column.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)).lower())


def plain(column: Column) -> Column:
    """Words in lower case without their accents and other marks."""
    return F.pandas_udf(_plain, "string")(column)


def plural_variants(word: Column) -> Column:
    """A word and what it may be the plural of, by how it is spelled."""
    one, two = F.when(F.length(word) >= 4, F.substr(word, F.lit(1), F.length(word) - 1)), F.when(F.length(word) >= 5, F.substr(word, F.lit(1), F.length(word) - 2))
    more = F.when(word.rlike("(x|sh|ss|zz)es$"), F.array(word, two)).when(word.rlike("(ch|s|z|o)es$"), F.array(word, two, one)).when(word.rlike("s$") & ~word.rlike("ss$"), F.array(word, one)).otherwise(F.array(word))
    return F.filter(more, lambda x: x.isNotNull())
