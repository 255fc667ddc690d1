"""Language ID by bit-sliced Bloom filters over n-grams: one lookup gives the mask of all languages with an n-gram."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.common import ID, TEXT, slices

#: Bytes of an n-gram. The short ones decide short texts.
ORDERS = (3, 5)
#: Documents per language that a filter learns from, about; and n-grams per language in it.
PER_LANGUAGE = 3000
MAX_GRAMS = 200_000
MIN_COUNT = 3
#: Slots per n-gram of the largest language, rounded up to a power of two; and hash functions.
SLOTS_PER_GRAM = 12
HASHES = 3
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
UNKNOWN = "und"

NOT_LETTERS = re.compile(r"[\W\d_]+")
SCHEMA = f"{ID} bigint, lang_pred string, score double"


def has_letter(text: str | None) -> bool:
    return bool(text) and (re.search("[A-Za-z]", text) is not None or any(c.isalpha() for c in text))


def folded(text: str | None) -> bytes:
    """Lower-cased letters, all else one blank, with a blank at both ends."""
    return f" {NOT_LETTERS.sub(' ', (text or '').lower()).strip()} ".encode()


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """One number for each n-gram of bytes, by its first byte; the order is part of it."""
    n = max(0, len(data) - order + 1)
    out = np.full(n, order, np.uint64)
    for k in range(order):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def slots(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(codes * np.uint64(m)) >> np.uint64(64 - bits) for m in MIX]


@dataclass
class Filters:
    """``table[slot]`` has bit l set if some n-gram of language l falls on the slot."""

    languages: list[str]
    table: np.ndarray
    bits: int
    false_share: np.ndarray

    def masks(self, codes: np.ndarray) -> np.ndarray:
        first, *rest = slots(codes, self.bits)
        found = self.table[first]
        for more in rest:
            found = found & self.table[more]
        return found


def build(languages: list[str], codes_of: dict[str, np.ndarray]) -> Filters:
    largest = max([1, *(len(codes) for codes in codes_of.values())])
    bits = max(12, int(np.ceil(np.log2(largest * SLOTS_PER_GRAM))))
    # One slice of 64 languages; more languages take more slices.
    n_slices = -(-max(1, len(languages)) // 64)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= min(64, len(languages)))
    table = np.zeros((1 << bits, n_slices), kind)
    false_share = np.zeros(len(languages))
    for i, language in enumerate(languages):
        codes = codes_of.get(language, np.zeros(0, np.uint64))
        one = kind(1 << (i % 64))
        for slot in slots(codes, bits):
            table[slot, i // 64] |= one
        fill = np.count_nonzero(table[:, i // 64] & one) / len(table)
        false_share[i] = fill**HASHES
    return Filters(languages, table, bits, false_share)


def train(docs: DataFrame, *, per_language: int = PER_LANGUAGE, max_grams: int = MAX_GRAMS) -> Filters:
    """Filters from ``lang`` and ``text``; rows without either are left out.

    Learns from about ``per_language`` documents of each language, those with the
    smallest hash of the id, and keeps each language's ``max_grams`` most frequent
    n-grams. Counting runs on Spark; what the driver gets is bounded by both figures.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col(TEXT).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return build([], {})
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.col(ID)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(draw < F.element_at(share, F.col("lang"))).select("lang", TEXT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, TEXT):
            names = np.asarray(part.column(0).to_pylist())
            texts = part.column(1).to_pylist()
            for language in np.unique(names):
                data = np.frombuffer(b"".join(folded(texts[i]) for i in np.flatnonzero(names == language)), np.uint8)
                for order in ORDERS:
                    codes, n = np.unique(grams(data, order), return_counts=True)
                    lang = pa.array([str(language)] * len(codes), pa.string())
                    yield pa.record_batch([lang, pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.filter(F.col("n") >= MIN_COUNT).withColumn("rank", rank).filter(F.col("rank") <= max_grams)
    found = top.select("lang", "gram").toArrow()
    lang = found.column("lang").combine_chunks().to_numpy(zero_copy_only=False)
    gram = found.column("gram").combine_chunks().to_numpy().view(np.uint64)
    return build(languages, {k: gram[lang == k] for k in languages})


def shares(filters: Filters, texts: list[str | None]) -> np.ndarray:
    """Share of each text's n-grams that each language holds, freed of the filters' false positives."""
    parts = [folded(t) for t in texts]
    found = np.zeros((len(texts), len(filters.languages)))
    total = np.zeros(len(texts))
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    for order in ORDERS:
        codes = grams(data, order)
        if not len(codes):
            continue
        masks = filters.masks(codes)
        # n-grams that start in a text and end in it
        starts = np.minimum(np.concatenate([[0], ends[:-1]]), len(codes))
        stops = np.maximum(np.minimum(ends - order + 1, len(codes)), starts)
        total += stops - starts
        for i in range(len(filters.languages)):
            bit = (masks[:, i // 64] >> masks.dtype.type(i % 64)) & masks.dtype.type(1)
            running = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
            found[:, i] += running[stops] - running[starts]
    raw = found / np.maximum(total, 1)[:, None]
    return np.maximum(0.0, (raw - filters.false_share) / np.maximum(1 - filters.false_share, 1e-9))


def predict(docs: DataFrame, filters: Filters, *, id_column: str = ID) -> DataFrame:
    """Per document the language that holds most of its n-grams, and that language's part of all shares.

    ``und`` with score 0 for a null text, one without a letter, or when nothing was
    learned. Ties, also of texts that no filter knows, go to the first language by
    name. A null id stays null; repeated rows give repeated rows; no documents give no
    rows. Only the id and the text are read; the id is carried, not used.
    """
    model = filters  # goes with the job; PySpark broadcasts what is large

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            texts = part.column(1).to_pylist()
            if model.languages:
                share = shares(model, texts)
                best = share.argmax(axis=1)
                sums = share.sum(axis=1)
                score = np.where(sums > 0, share[np.arange(len(texts)), best] / np.maximum(sums, 1e-12), 0.0)
                known = [has_letter(t) for t in texts]
                names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, score, 0.0)
            else:
                names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], [ID, "lang_pred", "score"])

    picked = docs.select(F.col(id_column).cast("bigint").alias(ID), F.col(TEXT).alias("_text"))
    return picked.mapInArrow(run, SCHEMA)
