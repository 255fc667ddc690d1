"""Word and shingle hashes over many texts at once."""

from __future__ import annotations

import numpy as np

#: Blanks between words: space and \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


#: A random 64-bit number for each byte.
VALUES = np.random.default_rng(20240501).integers(1, 1 << 64, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased; and the words' offsets by text.

    ``data`` holds the texts one after the other; a word ends at a blank or with its text.
    """
    n_texts = len(offsets) - 1
    inside = ~BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    begins[cuts] = inside[cuts]
    where = np.flatnonzero(inside).astype(np.int32) if len(data) < 1 << 31 else np.flatnonzero(inside)
    if not len(where):
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    first = np.flatnonzero(begins[where])
    lengths = np.diff(np.append(first, len(where)))
    place = np.arange(len(where), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    values = VALUES[LOWER[data[where]]]
    values *= powers(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * STEP)
    counts = np.searchsorted(where[first], offsets)
    return hashes, counts.astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles of ``width`` words as sorted 64-bit hashes.

    A text with fewer words, but not none, has one shingle: the whole sequence.
    """
    hashes, by_text = word_hashes(data, offsets)
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * STEP + hashes[k : n - width + 1 + k] if len(rolled) else rolled
    rolled = mix(rolled ^ np.uint64(width))
    out = []
    for a, b in zip(by_text[:-1].tolist(), by_text[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for k in range(a, b):
                    h = h * STEP + hashes[k]
            out.append(mix(np.array([h ^ np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
