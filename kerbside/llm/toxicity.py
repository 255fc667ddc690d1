"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel of two words counts the character subsequences of ``P`` letters that they
share, each weighted by ``DECAY`` to the length it spans, so gaps and inserted
characters cost little. A document is as toxic as its worst word. Because the kernel
has explicit features (one for each subsequence), the machine over the landmarks, once
trained, folds into one table of weights by subsequence; that is the same function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import ID, SLICE_BYTES, TEXT, give_back, slices

#: Letters of a subsequence, alphabet (blank-free), weight of a spanned letter.
P, ALPHABET, DECAY = 4, 39, 0.7
#: Longest unit. Longer words are read in windows of this length that overlap by half.
UNIT = 14
LANDMARKS = 160
#: Labelled documents of each class that are learned from, at most.
PER_CLASS = 6000
NEGATIVES = 8_000
MINED = 60_000
#: Toxic documents that a word must explain to count as an insult.
LEAST = 3
THRESHOLD = 0.7
CACHE = 100_000
#: Bytes of text that are held as words at once.
WORDS_BYTES = SLICE_BYTES // 4

SCHEMA = f"{ID} bigint, score double, predicted int"
#: Signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "ß": "s", "ø": "o", "æ": "a", "œ": "o", "ł": "l", "đ": "d"}
FIRST, LAST, OTHER = 26, 27, 28
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»…“”‘’"


def letters(token: str) -> str:
    """A token without signs, but for signs inside that stand for letters."""
    if token.isalpha():
        return token
    token = token.strip(PUNCTUATION)
    return token if token.isalpha() else "".join(SIGNS.get(c, c) for c in token if c.isalpha() or c in SIGNS)


def units(token: str) -> list[str]:
    """Windows of up to ``UNIT`` letters over the token's letters; marked where they begin or end the word."""
    word = f"^{letters(token)}$"
    if len(word) < P + 1:
        return []
    if len(word) <= UNIT:
        return [word]
    return [word[i : i + UNIT] for i in range(0, len(word) - UNIT // 2, UNIT // 2)]


def codes(same_length: list[str]) -> np.ndarray:
    """Letter numbers, a row for each unit: a to z, the two marks, and other letters in a few classes."""
    points = np.frombuffer("".join(same_length).encode("utf-32-le"), np.uint32).reshape(len(same_length), -1).astype(np.int64)
    found = np.where((points >= 97) & (points < 123), points - 97, OTHER + points % (ALPHABET - OTHER))
    return np.where(points == 94, FIRST, np.where(points == 36, LAST, found))


def subsequences(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: the number of each subsequence (words by choices), and each choice's weight."""
    choice = np.array(list(combinations(range(words.shape[1]), P)))
    weight = DECAY ** (choice[:, -1] - choice[:, 0] + 1)
    number = np.zeros((len(words), len(choice)), np.int64)
    for k in range(P):
        number = number * ALPHABET + words[:, choice[:, k]]
    return number, weight.astype(np.float64)


def by_length(all_units: list[str], step: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes and letter codes of the units, length by length, in parts of about ``step`` subsequences."""
    lengths = np.fromiter(map(len, all_units), np.int64, len(all_units))
    for n in np.unique(lengths):
        where = np.flatnonzero(lengths == n)
        rows = max(1, step // max(1, comb(int(n), P)))
        for i in range(0, len(where), rows):
            part = where[i : i + rows]
            yield part, codes([all_units[j] for j in part])


def features(all_units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kernel's explicit features as (unit, subsequence, value); values of equal subsequences add up.

    A unit is scaled to length one as if it repeated no subsequence, which depends on
    its number of letters alone.
    """
    rows, cols, values = [], [], []
    for where, words in by_length(all_units):
        number, weight = subsequences(words)
        rows.append(np.repeat(where, number.shape[1]))
        cols.append(number.ravel())
        values.append(np.tile(weight / np.sqrt((weight**2).sum()), len(words)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def kernel(all_units: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values, units by landmarks."""
    out = np.zeros((len(all_units), len(landmarks)))
    mark, number, value = features(landmarks)
    wanted, place = np.unique(number, return_inverse=True)
    dense = np.zeros((len(wanted), len(landmarks)))
    np.add.at(dense, (place, mark), value)
    for where, words in by_length(all_units, 40_000):
        number, weight = subsequences(words)
        weight = weight / np.sqrt((weight**2).sum())
        place = np.minimum(np.searchsorted(wanted, number), len(wanted) - 1)
        unit, choice = np.nonzero(wanted[place] == number)
        starts = np.flatnonzero(np.diff(unit, prepend=-1))
        if len(starts):
            sums = np.add.reduceat(weight[choice, None] * dense[place[unit, choice]], starts, axis=0)
            out[where[unit[starts]]] = sums
    return out


@dataclass
class Machine:
    """``weights`` by subsequence, ``bias``, and the line that makes a probability of a margin."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, all_units: list[str]) -> np.ndarray:
        out = np.full(len(all_units), self.bias)
        for where, words in by_length(all_units):
            number, weight = subsequences(words)
            out[where] += (self.weights[number] @ weight) / np.sqrt((weight**2).sum())
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps on the rows inside the margin; y is -1 or 1."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = reg * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    active = None
    for _ in range(rounds):
        inside = y * (x1 @ w) < 1
        if active is not None and (inside == active).all():
            break
        active = inside
        a = x1[inside] * weight[inside, None]
        w = np.linalg.solve(a.T @ x1[inside] + ridge, a.T @ y[inside])
    return w[:-1], float(w[-1])


def fit_machine(positive: list[str], negative: list[str], pool: list[str]) -> Machine:
    """Trains on labelled words, then again with the hardest of ``pool``, which holds none that is toxic."""
    def landmarks_of(words: list[str], n: int) -> list[str]:
        return [words[int(i)] for i in np.unique(np.linspace(0, len(words) - 1, min(n, len(words))).astype(int))]

    marks = landmarks_of(positive, LANDMARKS * 3 // 4)
    marks += [w for w in landmarks_of(negative, LANDMARKS - len(marks)) if w not in set(marks)]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    at, number, value = features(marks)
    machine = Machine(np.zeros(ALPHABET**P, np.float32), 0.0, 1.0, 0.0)
    for turn in range(3):
        x = kernel(positive + negative, marks) @ root
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        share = np.where(y > 0, 0.5 / max(1, len(positive)), 0.5 / max(1, len(negative)))
        w, bias = fit_svm(x, y, share * len(y) / 2, reg=1e-2)
        weights = np.zeros(ALPHABET**P)
        np.add.at(weights, number, value * (root @ w)[at])
        machine = Machine(weights.astype(np.float32), bias, 1.0, 0.0)
        if turn < 2 and pool:
            margin = machine.margins(pool)
            hard = [pool[i] for i in np.argsort(-margin, kind="stable")[:3000]]
            negative = sorted(set(negative) | set(hard))
    return machine


def fit_line(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on the margin alone, both classes of equal weight."""
    targets = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    a = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (weight * (targets - p)) - 1e-4 * w)
        w += np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


def tokens(text: str | None) -> list[str]:
    """Words between blanks; runs of single letters, as in ``i d i o t``, also together."""
    words = (text or "").lower().split()
    run: list[str] = []
    joined = []
    for word in words:
        if len(word) == 1:
            run.append(word)
            continue
        if len(run) > 2:
            joined.append("".join(run))
        run = []
    if len(run) > 2:
        joined.append("".join(run))
    return words + joined


class Scorer:
    """Scores texts; a word's margin is kept, up to ``CACHE`` words."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}

    def margins(self, texts: list[str | None]) -> np.ndarray:
        each = [tokens(t) for t in texts]
        new = sorted(set().union(*each) - self.known.keys()) if each else []
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = sorted(set().union(*each))
        parts = [units(w) for w in new]
        flat = [u for p in parts for u in p]
        value = self.machine.margins(flat)
        at = 0
        for word, p in zip(new, parts, strict=True):
            self.known[word] = float(value[at : at + len(p)].max()) if p else self.machine.bias
            at += len(p)
        get = self.known.__getitem__
        return np.array([max(map(get, words)) if words else self.machine.bias for words in each])


def _labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """``y`` and ``_text`` of the labelled documents of each class with the smallest hash of the id."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(ID).isNotNull()).select(ID, F.col("toxic").alias("y"))
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64(ID), ID).limit(per_class) for y in (0, 1)]
    drawn = parts[0].unionByName(parts[1])
    return docs.join(F.broadcast(drawn), ID).select("y", F.col(TEXT).alias("_text"))


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> Machine | None:
    """A machine from document labels, or None when one class is missing.

    Labels are of documents. The words that make them toxic are taken as the fewest
    that explain most: words of more toxic than clean documents, by how many toxic
    documents not yet explained hold them. The others are taken as clean. The sample is at most
    ``per_class`` documents of each class, and what the driver gets is bounded by it.
    """
    sample = _labelled(docs, labels, per_class)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            y, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            found = [(w, label) for label, t in zip(y, texts, strict=True) for w in set(map(letters, tokens(t)))]
            yield pa.record_batch(
                [pa.array([w for w, _ in found], pa.string()), pa.array([l for _, l in found], pa.int32())], ["word", "y"]
            )

    counted = (
        sample.mapInArrow(words, "word string, y int").filter(F.length("word") >= 3).groupBy("word")
        .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    )
    suspects = {
        r[0]: r[2]
        for r in counted.filter(f"toxic >= {LEAST} and toxic > clean").orderBy(F.desc("toxic"), "word").limit(20_000).collect()
    }
    others = counted.filter("clean > 0 and clean >= toxic").orderBy(F.xxhash64("word"), "word").limit(MINED)
    clean = others.select("word").toArrow().column(0).to_pylist()
    if not suspects or not clean:
        return None
    held = docs.sparkSession.sparkContext.broadcast(set(suspects))

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            pairs = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            rows = [sorted(held.value & set(map(letters, tokens(t)))) for y, t in pairs if y == 1]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.string()))], ["words"])

    documents = sorted(r[0] for r in sample.mapInArrow(incidence, "words array<string>").filter(F.size("words") > 0).collect())
    positive = explaining(documents, suspects)
    if not positive:
        return None

    def marked(all_words: list[str]) -> list[str]:
        return sorted({u for w in all_words for u in units(w)[:1]})

    pool = sorted(set(marked(clean)) - set(marked(positive)))
    step = max(1, len(pool) // NEGATIVES)
    machine = fit_machine(marked(positive), pool[::step], pool)
    give_back()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine)
        for part in slices(batches, "_text"):
            yield pa.record_batch([part.column(0), pa.array(scorer.margins(part.column(1).to_pylist()))], ["y", "margin"])

    found = sorted(map(tuple, sample.mapInArrow(score, "y int, margin double").collect()))
    y, margin = np.array([r[0] for r in found], float), np.array([r[1] for r in found])
    machine.slope, machine.shift = fit_line(margin, y)
    give_back()
    return machine


def explaining(documents: list[list[str]], clean: dict[str, int], least: int = LEAST) -> list[str]:
    """Words, each chosen for the documents that it explains and none before it does, less the clean ones that hold it.

    It ends where no word explains ``least`` more than that.
    """
    holders: dict[str, set[int]] = {}
    for i, found in enumerate(documents):
        for word in found:
            holders.setdefault(word, set()).add(i)
    chosen = []
    gain = {w: len(h) - clean.get(w, 0) for w, h in holders.items()}
    while holders:
        word = min(holders, key=lambda w: (-gain[w], w))
        if gain[word] < least:
            break
        covered = holders.pop(word)
        chosen.append(word)
        for w in {w for i in covered for w in documents[i]} & holders.keys():
            holders[w] -= covered
            gain[w] = len(holders[w]) - clean.get(w, 0)
    return chosen


def _scored(docs: DataFrame, machine: Machine | None):
    def scores(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        scorer = Scorer(machine) if machine else None
        for part in slices(batches, text, WORDS_BYTES):
            texts = part.column(text).to_pylist()
            yield part, machine.probability(scorer.margins(texts)) if machine else np.zeros(len(texts))

    return scores


def score_toxicity(docs: DataFrame, machine: Machine | None, *, id_column: str = ID, threshold: float = THRESHOLD) -> DataFrame:
    """Per document a score from 0 to 1, and 1 in ``predicted`` where it is at least ``threshold``.

    A text without words, null too, has the machine's score for nothing at all; without
    a machine every score is 0. A null id stays null; repeated rows give repeated rows;
    no documents give no rows. Whole texts are read; other columns are not.
    """
    scores = _scored(docs, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in scores(batches, "_text"):
            bad = pa.array((score >= threshold).astype(np.int32))
            yield pa.record_batch([part.column(0), pa.array(score), bad], [ID, "score", "predicted"])

    return docs.select(F.col(id_column).cast("bigint").alias(ID), F.col(TEXT).alias("_text")).mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, machine: Machine | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``."""
    scores = _scored(docs, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in scores(batches, TEXT):
            yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
