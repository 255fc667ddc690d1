"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import ID, TEXT, sha256_hex, slices

#: A word is a run of letters a-z, digits and characters beyond ASCII, after A-Z is lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH = 13
#: Characters of window text in one automaton. A larger benchmark is scanned in several automata, one at a time.
BLOCK_CHARS = 32_000_000
#: Bytes of documents that pass all automata before the next documents are taken.
SCAN_BYTES = 32 << 20

#: Maps each byte to itself, lower-cased, or to a blank where it is no part of a word.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

SCHEMA = (
    f"{ID} bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start: int, end: int>>"
)


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = TEXT, width: int = WIDTH) -> DataFrame:
    """``window``, ``n`` (its words), ``items``: each window of ``width`` words once, with the items that hold it.

    An item with fewer words is one window; one without words, or null, has none.
    """
    words = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(WORD), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return (
        benchmark.select(F.col(item).cast("string").alias("item"), words.alias("w"))
        .filter(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("w"))
        .groupBy(F.array_join("w", " ").alias("window"), F.size("w").alias("n"))
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def automaton(windows: list[tuple[str, int, list[str]]]) -> ahocorasick.Automaton:
    """One automaton; windows as UTF-8 bytes with a blank on each side, so that only whole words match."""
    found = ahocorasick.Automaton()
    for window, n, items in windows:
        found.add_word(f" {window.encode().decode('latin-1')} ", (n, items))
    found.make_automaton()
    return found


def normalise(text: str) -> tuple[bytes, list[bytes]]:
    """The text's bytes with blanks for all that is outside words, as long as the text; and its words."""
    folded = text.encode().translate(FOLD)
    return folded, folded.split()


def scan(found: ahocorasick.Automaton, words: list[bytes], hit: np.ndarray, items: set[str]) -> None:
    """Marks in ``hit`` the words inside any window, and adds the windows' items."""
    line = f" {b' '.join(words).decode('latin-1')} "
    blanks = None
    for end, (n, of) in found.iter(line):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        last = int(np.searchsorted(blanks, end))
        hit[last - n : last] = True
        items.update(of)


def original_spans(text: str, folded: bytes, hit: np.ndarray) -> list[dict]:
    """Maximal runs of hit words as code-point offsets into the text itself, end exclusive."""
    inside = np.frombuffer(folded, np.uint8) != 32
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    run = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    first, last = np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead)])
    return [
        {"start": int(s), "end": int(e)} for s, e in zip(points[begins[first]], points[ends[last]], strict=True)
    ]


def _matcher(blocks: list, fraction: int):
    """A function from texts to (text, folded, words, hit, items, contaminated), under every automaton."""
    kept: list[ahocorasick.Automaton] = []

    def built(block) -> ahocorasick.Automaton:
        if len(blocks) > 1:
            return automaton(block.value)
        if not kept:
            kept.append(automaton(block.value))
        return kept[0]

    def match(texts: list[str | None]) -> list[tuple]:
        rows = []
        for text in texts:
            folded, words = normalise(text or "")
            rows.append((text or "", folded, words, np.zeros(len(words), bool), set()))
        for block in blocks:
            scanner = built(block)
            if len(scanner):
                for _, _, words, hit, items in rows:
                    if words:
                        scan(scanner, words, hit, items)
        return [(*row, bool(row[3].any() and fraction * int(row[3].sum()) >= len(row[2]))) for row in rows]

    return match


def _blocks(benchmark: DataFrame, item: str, width: int, block_chars: int) -> list:
    """The windows, broadcast in blocks of about ``block_chars`` characters."""
    context = benchmark.sparkSession.sparkContext
    windows = benchmark_windows(benchmark, item, width=width)
    chars = windows.agg(F.coalesce(F.sum(F.length("window")), F.lit(0))).first()[0]
    n = max(1, -(-int(chars) // block_chars))
    block = F.pmod(F.xxhash64("window"), F.lit(n))
    return [context.broadcast([tuple(r) for r in windows.filter(block == i).collect()]) for i in range(n)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_column: str = ID,
    item: str = "item_id",
    width: int = WIDTH,
    fraction: int = 20,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per document: its words, the words inside windows of benchmark items, the items, and the spans hit.

    A document is contaminated when at least one word in ``fraction`` is hit. The
    automaton holds the benchmark, not the corpus; past ``block_chars`` it is split
    and the parts are used one after the other. A null text, like an empty one, has
    no words and is clean; a null id stays null; repeated rows give repeated rows;
    no documents give no rows, and an empty benchmark hits nothing. Columns of
    ``docs`` beside the id and the text are not read.
    """
    match = _matcher(_blocks(benchmark, item, width, block_chars), fraction)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([
            (ID, pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
            ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ])
        for part in slices(batches, "_text", SCAN_BYTES):
            out = []
            for key, row in zip(part.column(0).to_pylist(), match(part.column(1).to_pylist()), strict=True):
                text, folded, words, hit, found, bad = row
                names = sorted(found)
                spans = original_spans(text, folded, hit) if found else []
                out.append((key, len(words), int(hit.sum()), len(names), sha256_hex(",".join(names).encode()), bad, names, spans))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    picked = docs.select(F.col(id_column).cast("bigint").alias(ID), F.col(TEXT).alias("_text"))
    return picked.mapInArrow(run, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without contaminated documents. Null and empty texts stay."""
    match = _matcher(
        _blocks(benchmark, options.get("item", "item_id"), options.get("width", WIDTH), options.get("block_chars", BLOCK_CHARS)),
        options.get("fraction", 20),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, TEXT, SCAN_BYTES):
            yield part.filter(pa.array([not row[-1] for row in match(part.column(TEXT).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
