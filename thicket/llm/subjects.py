"""Subject areas of documents by subject-specific interpolated n-gram language models.

A model of each subject and a background model of all text give every word, after the word before it, a probability mixed from bigrams, single words
and a uniform rest. What a run of sentences gains per token under a subject's model over the background tells how far it is about the subject. Labels are of whole
documents and imperfect, so the models are trained in rounds: each passage of a labelled document goes to the subject that explains it best, or to none. All labelled
documents are counted, in tasks; the driver gets sums by word and word before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators.skew import ordered_totals
from thicket.session import cut, drop_cut, partitions, small

#: Characters of labelled documents' words that a task has as numbers at once; all of them are counted.
TRAINED_CHARS = 1_000_000
#: Counts that a task keeps apart before it adds up equal ones.
COUNTS = 2_000_000
#: Subjects that subject_areas may name; they are settings, not data.
MAX_SUBJECTS = 1_000
#: Shares of bigrams, single words and the uniform rest in a word's probability; rounds of training.
MIX, ROUNDS = (0.5, 0.45, 0.05), 3
#: Sentences of a run; subjects of a document at most.
RUN, MOST = 4, 3

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
# A fence ends at the first line that begins with its marker; what follows that marker is text. A line that has the marker twice opens none.
FENCE = re.compile(r"^[ \t]*(([`~])\2{2,})(?![^\n]*\1).*?(?:^[ \t]*\1\2*|\Z)", re.M | re.S)
SENTENCE = re.compile(r"(?<=[.!?])[\"')\]*_]*\s+")
# Lines that are no prose: links, list items with a link alone, log lines, headings, tables' rules, signatures of turns.
BARE = re.compile(r"^\s*(?:[*+-]\s*)?\[[^\]]*\]\([^)]*\)\s*$|^\s*\S+\.\S+ line \d+|\b(?:code|bytes|exit|status)\s*[=:]\s*\d+|->\s*\d+ bytes|^\s*#{1,6}\s|^\s*[|:+-]{3,}|^\s*\**[\w .]+\** wrote on day|https?://\S+\s*$")
HEADING = re.compile(r"^\s*#{1,6}\s+")
#: Characters from which a line is prose whatever it begins with, as in texts without line breaks: only its heading marker and sentences that are no prose go.
LONG = 200


def prose(line: str) -> str:
    """The prose of a line, or "" where it has none."""
    if not BARE.search(line):
        return line
    return " ".join(x for x in SENTENCE.split(HEADING.sub("", line)) if not BARE.search(x)) if len(line) >= LONG else ""


def passages(text: str) -> list[list[str]]:
    """The prose of a text: its paragraphs and lists as sentences, without code, logs, link lists and headings."""
    out = []
    for block in re.split(r"\n[ \t]*\n", FENCE.sub("\n\n", text.replace("\r\n", "\n").replace("\r", "\n"))):
        lines = [x for x in map(prose, block.split("\n")) if x.strip()]
        sentences = [s for s in SENTENCE.split(" ".join(x.strip(" >\t") for x in lines)) if s.strip()]
        if sentences:
            out.append(sentences)
    return out


def words(sentence: str) -> list[str]:
    return WORD.findall(sentence.lower())


def packed(text: str) -> str:
    """The words of a text's prose, with the ends of sentences and passages, as unpacked() reads them."""
    return "\f".join("\n".join(" ".join(words(s)) for s in sentences) for sentences in passages(text))


def unpacked(text: str) -> list[list[list[str]]]:
    return [[s.split(" ") if s else [] for s in sentences.split("\n")] for sentences in text.split("\f")] if text else []


def plain(text: str | None) -> list[list[list[str]]]:
    return [[words(s) for s in sentences] for sentences in passages(text or "")]


def runs(n: int, size: int = RUN) -> list[tuple[int, int]]:
    """The runs of sentences of a passage: all of them, or windows of `size`, half overlapping."""
    return [(0, n)] if n <= size + 1 else [(a, min(n, a + size)) for a in range(0, n - 1, max(1, size // 2)) if a == 0 or n - a > size // 2]


class Text:
    """Passages of many texts as arrays: tokens with their sentence, sentences with their passage, passages with their text."""

    def __init__(self, texts: Sequence[str | None], vocabulary: dict[str, int], split: Callable[[str | None], list[list[list[str]]]] = plain):
        ids, starts, sentence_passage, passage_text = [], [], [], []
        get = vocabulary.get
        for i, text in enumerate(texts):
            for sentences in split(text):
                passage_text.append(i)
                for sentence in sentences:
                    starts.append(len(ids))
                    sentence_passage.append(len(passage_text) - 1)
                    ids += [get(w, -1) for w in sentence]
        self.word = np.array(ids, np.int32)
        self.passage_text, self.sentence_passage = np.array(passage_text, np.int64), np.array(sentence_passage, np.int64)
        self.sentence_start = np.array([*starts, len(ids)], np.int64)
        first = np.zeros(len(ids) + 1, bool)
        first[self.sentence_start] = True
        self.before = np.where(first[:-1], -2, np.concatenate([np.array([-2], np.int32), self.word[:-1]])).astype(np.int32) if len(ids) else self.word
        self.passage_first = np.searchsorted(self.sentence_passage, np.arange(len(passage_text) + 1))

    def pair(self, size: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """A number for each token of a..b with the one before it; -1 where one of them is unknown or the sentence begins."""
        word, before = self.word[a:b], self.before[a:b]
        return np.where((word >= 0) & (before >= 0), before.astype(np.int64) * size + word, -1)


class Models:
    """What each word, after the word before it, gains under each subject's model over the background: logarithms of two mixtures' quotients."""

    def __init__(self, key: np.ndarray, n: np.ndarray, subjects: int, size: int, mix: tuple[float, float, float] = MIX):
        """key, n: how often each word comes after each word in passages of each subject, as counted() says. Words of the vocabulary that never come gain nothing."""
        two, one, rest = mix
        self.size = size = max(1, size)
        kind, pair = np.divmod(key, (size + 1) * size)
        count = np.bincount(kind * size + pair % size, n, minlength=(subjects + 1) * size).reshape(subjects + 1, size)
        seen = pair >= size  # no sentence begins there
        self.pairs, at = np.unique(pair[seen] - size, return_inverse=True)
        both = np.bincount(kind[seen] * len(self.pairs) + at, n[seen], minlength=(subjects + 1) * len(self.pairs)).reshape(subjects + 1, -1)
        first = self.pairs // size
        # The background has all text; models of subjects with little text lean on it.
        all_one, all_two = count.sum(0), both.sum(0)
        known = all_one > 0
        own_size = max(1, int(known.sum()))
        p_all = (all_one + 0.1) / (all_one.sum() + 0.1 * own_size)
        before = np.stack([np.bincount(first, weights=x, minlength=size) for x in both])
        before_all = before.sum(0)
        base = one * p_all + rest / own_size
        self.alone = np.zeros((size + 1, subjects), np.float32)
        self.after = np.zeros((len(self.pairs), subjects), np.float32)
        word = self.pairs % size
        for s in range(subjects):
            total = count[s + 1].sum()
            p = (count[s + 1] + 200 * p_all) / (total + 200)
            own = one * p + rest / own_size
            self.alone[:size, s] = np.where(known, np.log(own / base), 0)
            # A bigram's share under a subject, shrunk towards the share its word has there.
            share = (both[s + 1] + 2 * p[word]) / (before[s + 1][first] + 2)
            plain = (all_two + 2 * p_all[word]) / (before_all[first] + 2)
            self.after[:, s] = np.log(two * share + own[word]) - np.log(two * plain + base[word])

    def gains(self, text: Text) -> np.ndarray:
        """Sentences x subjects: what the tokens of each sentence gain, AT_ONCE tokens at a time; unknown words gain nothing."""
        n = len(text.sentence_start) - 1
        out = np.zeros((n, self.alone.shape[1]))
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(text.sentence_start, text.sentence_start[first] + AT_ONCE, "right")) - 1)
            a, b = text.sentence_start[first], text.sentence_start[last]
            each = self.alone[text.word[a:b]]  # -1, unknown, is the last row
            pair = text.pair(self.size, a, b)
            if len(self.pairs) and b > a:
                at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                hit = self.pairs[at] == pair
                each[hit] = self.after[at[hit]]
            run = np.zeros((b - a + 1, out.shape[1]))
            np.cumsum(np.clip(each, -4, 4), 0, out=run[1:])
            edges = text.sentence_start[first : last + 1] - a
            out[first:last] = run[edges[1:]] - run[edges[:-1]]
            first = last
        return out


#: Tokens whose gains are held at once.
AT_ONCE = 100_000
#: Tokens added to a run's length, so that a short one needs more of a gain.
FLOOR = 8


def run_scores(text: Text, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each run, runs x subjects): gains per token of all runs of sentences of all passages."""
    total = np.concatenate([np.zeros((1, gains.shape[1])), np.cumsum(gains, 0)])
    low, high, of = [], [], []
    for a, b, t in zip(text.passage_first[:-1].tolist(), text.passage_first[1:].tolist(), text.passage_text.tolist()):
        for i, j in runs(b - a):
            low.append(a + i)
            high.append(a + j)
            of.append(t)
    low, high = np.array(low, np.int64), np.array(high, np.int64)
    length = text.sentence_start[high] - text.sentence_start[low] + FLOOR
    return np.array(of, np.int64), (total[high] - total[low]) / length[:, None]


def best_by_text(n: int, of: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Texts x subjects: the best score of a run in which the subject leads, or 0."""
    out = np.zeros((n, scores.shape[1]))
    if len(of):
        lead = scores.argmax(1)
        np.maximum.at(out, (of, lead), scores[np.arange(len(of)), lead])
    return out


def passage_subjects(models: Models | None, text: Text, labels: Sequence[Iterable[int]], subjects: int) -> np.ndarray:
    """The subject of each passage of labelled texts, or -1: of their labels the one that explains it best; without models, the only label."""
    if models is None:
        only = np.array([next(iter(x)) if len(x) == 1 else -1 for x in labels], np.int64)
        return only[text.passage_text]
    allowed = np.zeros((len(labels), subjects), bool)
    for i, x in enumerate(labels):
        allowed[i, list(x)] = True
    total = np.concatenate([np.zeros((1, subjects)), np.cumsum(models.gains(text), 0)])
    first = text.passage_first
    mean = (total[first[1:]] - total[first[:-1]]) / (np.diff(text.sentence_start[first]) + FLOOR)[:, None]
    # A subject that the labels lack must explain a passage far better than those they have.
    mean = np.where(allowed[text.passage_text], mean, mean - 0.25)
    return np.where(mean.max(1) > 0.12, mean.argmax(1), -1)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its counts added up."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, at, np.concatenate(counts))
    return key, n


def counted(text: Text, of: np.ndarray, size: int, fit: int, subjects: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, n) of the tokens of text. A key is of fit, subject (0 for none), word before (0 where a sentence begins) and word, the word in its last digit."""
    kind = (of + 1)[text.sentence_passage].repeat(np.diff(text.sentence_start)) + fit * (subjects + 1)
    before = np.maximum(text.before.astype(np.int64), -1) + 1
    return np.unique((kind * (size + 1) + before) * size + text.word, return_counts=True)


def parts(pdf: pd.DataFrame, chars: int) -> Iterator[tuple[int, pd.DataFrame]]:
    """(half, rows) of labelled documents, about `chars` characters of words at once."""
    for half, own in pdf.groupby("half"):
        piece = own["words"].str.len().cumsum() // chars
        for _, part in own.groupby(piece):
            yield int(half), part


class Fitting:
    """Models of the labelled documents: two of a half of them each, the other half's scores to be judged by, and one of all. `labelled` has doc_id, words, subjects, half.

    Every round counts all documents in tasks; what comes to the driver are counts of different pairs of words by subject."""

    def __init__(self, labelled: DataFrame, subjects: int):
        self.labelled, self.subjects = labelled, subjects
        found = labelled.select(F.explode(F.split("words", "[\f\n ]")).alias("w")).filter("w != ''").distinct().toArrow()["w"].to_pylist()
        self.vocabulary = {w: i for i, w in enumerate(sorted(found))}
        self.models: list[Models | None] = [None] * 3
        for _ in range(ROUNDS + 1):
            self.models = self.trained()

    def trained(self) -> list[Models]:
        """The three models of passages as the present ones assign them."""
        size, subjects, chars, most = max(1, len(self.vocabulary)), self.subjects, TRAINED_CHARS, COUNTS
        sent = self.labelled.sparkSession.sparkContext.broadcast((self.models, self.vocabulary))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            models, vocabulary = sent.value
            keys, counts = [], []
            for pdf in batches:
                for half, part in parts(pdf, chars):
                    text, labels = Text(part["words"].tolist(), vocabulary, unpacked), part["subjects"].tolist()
                    for fit in (1 - half, 2):
                        key, n = counted(text, passage_subjects(models[fit], text, labels, subjects), size, fit, subjects)
                        keys.append(key)
                        counts.append(n)
                    if sum(map(len, keys)) > most:
                        key, n = added(keys, counts)
                        yield pd.DataFrame({"key": key, "n": n})
                        keys, counts = [], []
            key, n = added(keys, counts)
            yield pd.DataFrame({"key": key, "n": n})

        rows = self.labelled.select("half", "words", "subjects").mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        sent.destroy()
        key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
        a_fit = (subjects + 1) * (size + 1) * size
        fit = key // a_fit
        return [Models(key[fit == i] - i * a_fit, n[fit == i], subjects, size) for i in range(3)]

    def least(self) -> np.ndarray:
        """The score that each subject must reach, found on halves of the documents that the models they are scored with have not seen."""
        subjects, chars = self.subjects, TRAINED_CHARS
        kind = dict(self.labelled.dtypes)["doc_id"]
        sent = self.labelled.sparkSession.sparkContext.broadcast((self.models[:2], self.vocabulary))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            models, vocabulary = sent.value
            for pdf in batches:
                for half, part in parts(pdf, chars):
                    text = Text(part["words"].tolist(), vocabulary, unpacked)
                    best = best_by_text(len(part), *run_scores(text, models[half].gains(text)))
                    at, s = np.nonzero(best > 0)
                    labels = part["subjects"].tolist()
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[at], "subject": s, "score": best[at, s], "hit": [int(j in labels[i]) for i, j in zip(at, s)]})

        judged = cut(self.labelled.mapInPandas(run, f"doc_id {kind}, subject int, score double, hit int"))
        placed = ordered_totals(judged, ["subject"], [F.col("score").desc(), F.col("doc_id")], out="place")
        block = F.floor(F.col("place") / BLOCK).alias("block")
        rows = placed.groupBy("subject", block).agg(F.sum("hit").alias("hit"), F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).orderBy("subject", "block").toArrow().to_pylist()
        sent.destroy()
        drop_cut(judged)
        return np.array([threshold([(r["hit"], r["n"], r["low"]) for r in rows if r["subject"] == s]) for s in range(subjects)])


#: Labelled texts whose scores are neighbours that are counted together.
BLOCK = 25


def threshold(counts: Sequence[tuple[float, float, float]]) -> float:
    """The score from which the share of labelled texts among those scored alike is more than half of what it is among the best.

    counts: labelled texts, texts and the least score of each BLOCK texts, the highest scores first. Labels miss some subjects and have some wrong, alike at every score, so
    shares are compared with each other, not with one. The shares are made to fall with the score by pooling neighbours. With no labels the score must be 0.3."""
    if sum(c[0] for c in counts) < 3:
        return 0.3
    blocks: list[list[float]] = []
    for block in counts:
        blocks.append(list(block))
        while len(blocks) > 1 and blocks[-1][0] / blocks[-1][1] > blocks[-2][0] / blocks[-2][1]:
            hit, n, low = blocks.pop()
            blocks[-1] = [blocks[-1][0] + hit, blocks[-1][1] + n, low]
    top = blocks[0][0] / blocks[0][1]
    return max(0.02, min(b[2] for b in blocks if b[0] / b[1] > top / 2))


class Accepting:
    """Models of all subjects with the score that each must reach."""

    def __init__(self, models: Models, least: np.ndarray, vocabulary: dict[str, int]):
        self.models, self.least, self.vocabulary = models, least, vocabulary

    def subjects(self, texts: Sequence[str | None]) -> list[list[tuple[int, float]]]:
        """(subject, score) of each text's accepted subjects, best first, MOST at most."""
        text = Text(texts, self.vocabulary)
        best = best_by_text(len(texts), *run_scores(text, self.models.gains(text)))
        out = []
        for row in np.where(best >= self.least, best, 0):
            there = np.flatnonzero(row > 0)
            out.append([(int(s), float(row[s])) for s in there[np.argsort(-row[there], kind="stable")][:MOST]])
        return out


def label_sets(labels: DataFrame, names: Sequence[str]) -> DataFrame:
    """(doc_id, subjects): the set of labelled subjects by place in names; empty where readers found none of them. Case and blanks don't count; other words are left out."""
    clean = F.lower(F.trim("subject"))
    places = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n.strip().lower()), F.lit(i))])
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_set(places[clean]).alias("subjects"))


def labelled_words(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, words, subjects, half) of every document of `known` that has a text, written out; half is 0 or 1 by a hash of the id. Of repeated rows of an id the greatest text counts."""
    known = cut(known)
    texts = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(known) if small(known) else known, "doc_id")
    # Few rows with long texts: they are spread over all tasks, however small they are.
    once = texts.repartition(partitions(documents.sparkSession), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("subjects").alias("subjects"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["words"] = [packed(t) for t in pdf["text"]]
            yield pdf[["doc_id", "words", "subjects", "half"]]

    kind = dict(documents.dtypes)["doc_id"]
    halved = once.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    out = cut(halved.mapInPandas(run, f"doc_id {kind}, words string, subjects array<int>, half int"))
    drop_cut(known)
    return out


def scored(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject, score) for each document and each subject that a passage of its text is about, three at most.

    Models are fitted on the whole texts of all labelled documents, written out as words, and applied to whole texts of all documents, where they lie; a word counts however rare it is. Without
    labels nothing is accepted. Empty and null texts have no subjects; repeated rows come out as often as they are stored."""
    names = [r[0] for r in areas.filter("subject is not null").select("subject").distinct().orderBy("subject").limit(MAX_SUBJECTS + 1).collect()]
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    kind = dict(documents.dtypes)["doc_id"]
    if not names:
        return documents.select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("score")).limit(0)
    labelled = labelled_words(documents, label_sets(labels, names))
    fitting = Fitting(labelled, len(names))
    accepting = Accepting(fitting.models[2], fitting.least(), fitting.vocabulary)
    drop_cut(labelled)
    sent = documents.sparkSession.sparkContext.broadcast((accepting, names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, subjects = sent.value
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                got = model.subjects(part["text"].tolist())
                rows = [(d, subjects[s], x) for d, found in zip(part["doc_id"].tolist(), got) for s, x in found]
                yield pd.DataFrame(rows, columns=["doc_id", "subject", "score"])

    return documents.select("doc_id", "text").filter("text is not null").mapInPandas(run, f"doc_id {kind}, subject string, score double")


def found_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject), each once."""
    return scored(documents, labels, areas).select("doc_id", "subject").distinct()


def composition(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(subject, n_documents, n_chars) for every subject of areas, 0 where no document is about it."""
    found = cut(found_subjects(documents, labels, areas))
    sizes = documents.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    by = found.join(sizes, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("c"))
    z = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return areas.select("subject").distinct().join(by, "subject", "left").select("subject", z("d", "n_documents"), z("c", "n_chars"))
