"""Quality rules: document statistics, fixed base rules, and gradient-boosted trees as flat node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import ID, TEXT, slices

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5

#: Features, and the direction in which each may move the odds of good quality: -1 never up, 0 free.
FEATURES = (
    ("log_words", 0),
    ("word_length", 0),
    ("symbol_share", -1),
    ("dup_line_share", -1),
    ("repeat_share", -1),
    ("upper_share", -1),
    ("exclaim_share", -1),
    ("distinct_share", 0),
    ("digit_share", 0),
    ("stop_share", 0),
)
DIRECTIONS = np.array([d for _, d in FEATURES])

#: Labelled documents that the trees learn from, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 40, 3, 64, 0.2, 8
THRESHOLD = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = f"{ID} bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, kept boolean, p_good double"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    codes = ids
    for k in range(1, window):
        # numbers of windows of k + 1 words; numbered anew, so that they stay small and exact
        codes = np.unique(codes[:-1] * len(number) + ids[k:], return_inverse=True)[1]
    twice = np.bincount(codes)[codes] > 1
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, np.flatnonzero(twice), 1)
    np.add.at(inside, np.flatnonzero(twice) + window, -1)
    return int(np.count_nonzero(np.cumsum(inside[:-1])))


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts, and the features of the trees."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    each, all_words = max(1, chars), max(1, n)
    lower = text.lower()
    letters = sum(a != b for a, b in zip(text, lower, strict=True)) if len(text) == len(lower) else 0
    distinct = set(words)
    features = [
        np.log1p(n),
        chars / all_words,
        symbols / each,
        duplicates / max(1, len(lines)),
        repeats / all_words,
        letters / each,
        text.count("!") / each,
        len(distinct) / all_words ** 0.8,
        sum(text.count(c) for c in "0123456789") / each,
        sum(len(w) <= 3 for w in words) / all_words,
    ]
    return [n, chars, symbols, duplicates, repeats], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


@dataclass
class Trees:
    """All trees as node arrays: a leaf has feature -1; ``left`` holds the child of rows at or below ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for all rows; rows go down all trees of one level together."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(DEPTH):
            feature = self.feature[at]
            down = np.where(x[rows, np.maximum(feature, 0)] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(feature < 0, at, down)
        return self.start + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(x))) if len(x) else np.zeros(0)


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees of logistic loss on histograms, monotone where ``DIRECTIONS`` says so.

    A split against its feature's direction is not taken, and the middle of the two
    values bounds what may come below it. Without both labels the trees are leaves.
    """
    n, width = x.shape
    share = np.clip(y.mean() if n else 1.0, 1e-3, 1 - 1e-3)
    nodes: list[list[float]] = []
    roots = []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)] if n else []
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1) if n else None
    f = np.full(n, np.log(share / (1 - share)))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        at = len(nodes)
        weight = float(np.clip(-g[rows].sum() / (h[rows].sum() + 1.0), low, high))
        nodes.append([-1, 0.0, at, at, RATE * weight])
        if level == depth or len(rows) < 2 * LEAST:
            return at
        best = (1e-6, None)
        for j in range(width):
            size = len(edges[j]) + 1
            gs = np.cumsum(np.bincount(binned[rows, j], g[rows], size))
            hs = np.cumsum(np.bincount(binned[rows, j], h[rows], size))
            ns = np.cumsum(np.bincount(binned[rows, j], minlength=size))
            gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
            wl, wr = np.clip(-gl / (hl + 1), low, high), np.clip(-gr / (hr + 1), low, high)
            gain = -(gl * wl + 0.5 * (hl + 1) * wl**2) - (gr * wr + 0.5 * (hr + 1) * wr**2)
            gain += gs[-1] * weight + 0.5 * (hs[-1] + 1) * weight**2
            gain[(ns[:-1] < LEAST) | (ns[-1] - ns[:-1] < LEAST) | ((wr - wl) * DIRECTIONS[j] < 0)] = -np.inf
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), (j, k, wl[k], wr[k]))
        if best[1] is None:
            return at
        j, k, wl, wr = best[1]
        middle = (wl + wr) / 2
        goes = binned[rows, j] <= k
        lows, highs = (low, high), (low, high)
        if DIRECTIONS[j] < 0:
            lows, highs = (middle, high), (low, middle)
        elif DIRECTIONS[j] > 0:
            lows, highs = (low, middle), (middle, high)
        nodes[at][0], nodes[at][1] = j, edges[j][k]
        nodes[at][2] = grow(rows[goes], g, h, *lows, level + 1)
        nodes[at][3] = grow(rows[~goes], g, h, *highs, level + 1)
        return at

    start = float(f[0]) if n else float(np.log(share / (1 - share)))
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-f))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), -4.0, 4.0, 0))
        flat = _flat(nodes, [roots[-1]], 0.0)
        f = f + flat.odds(x)
    return _flat(nodes, roots, start)


def _flat(nodes: list[list[float]], roots: list[int], start: float) -> Trees:
    a = np.array(nodes, float).reshape(-1, 5) if nodes else np.array([[-1, 0, 0, 0, 0.0]])
    whole = a[:, [0, 2, 3]].astype(np.int64)
    return Trees(whole[:, 0], a[:, 1], whole[:, 1], whole[:, 2], a[:, 4], np.array(roots, np.int64), start)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Trees:
    """Trees from documents with a ``quality`` label, at most ``sample``: those with the smallest hash of the id.

    Only the sample's labels are broadcast and only its features reach the driver.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col(ID).isNotNull()).select(ID, "quality")
    drawn = known.orderBy(F.xxhash64(ID), ID).limit(sample)
    picked = docs.join(F.broadcast(drawn), ID).select("quality", F.col(TEXT).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            rows = [statistics(t)[1] for t in part.column(1).to_pylist()]
            yield pa.record_batch(
                [part.column(0).cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["quality", "features"]
            )

    found = picked.mapInArrow(run, "quality int, features array<double>").toArrow()
    x = np.array(found.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(found.column("quality").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the same trees, whatever the order of arrival
    return fit_trees(x[order], y[order])


def judge_quality(docs: DataFrame, trees: Trees, *, id_column: str = ID, threshold: float = THRESHOLD) -> DataFrame:
    """Per document the base counts, whether the base rules fail, and whether it is kept.

    Kept are documents that pass the base rules and that the trees hold good with
    probability ``threshold`` or more. A null text, like an empty one, has no words and
    fails; a null id stays null; repeated rows give repeated rows; no documents give no
    rows. Other columns of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            rows = [statistics(t) for t in part.column(1).to_pylist()]
            counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS))
            good = trees.probability(np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES)))
            failed = np.array([base_failed(c[0], c[4]) for c in counts.tolist()], bool)
            yield pa.record_batch(
                [part.column(0), *[pa.array(counts[:, i]) for i in range(len(COUNTS))], pa.array(failed),
                 pa.array(~failed & (good >= threshold)), pa.array(good)],
                [ID, *COUNTS, "base_failed", "kept", "p_good"],
            )

    picked = docs.select(F.col(id_column).cast("bigint").alias(ID), F.col(TEXT).alias("_text"))
    return picked.mapInArrow(run, SCHEMA)
