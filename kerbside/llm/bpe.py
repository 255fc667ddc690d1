"""Byte-level BPE encoding by a distinct-word table, and decoding through an id-to-piece table.

Three steps. Tasks cut texts at blanks, split each distinct piece into words once and send each chunk's distinct words to the
part of the word table that owns them. There each distinct word is encoded once, and
its ids go back to every chunk that asked. Chunks hold their texts as places in their
own word list, so ids join back by position; texts themselves are not shuffled.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import ID, TEXT, give_back, sha256_hex, slices

#: Bytes of text in a chunk, and distinct words that a part of the word table remembers before it starts anew.
CHUNK_BYTES = 8 << 20
REMEMBERED = 2_000_000

#: A blank that does not start a word: another blank or the end follows.
BLANKS = re.compile(r" (?:\s|\Z)")

SCHEMA = f"{ID} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
FULL_SCHEMA = f"{SCHEMA}, ids array<int>, decoded string"


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file: the encoder for single words, the split, the pieces by id; each is made when first asked for."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.plain = spec["model"]["vocab"]
        self.size = 1 + max([*self.plain.values(), *self.special.values()])
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        marks = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.words = regex.compile(split)
        self.marks = regex.compile(f"({marks})") if marks else None

    @cached_property
    def encoder(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(self.path)
        encoder.no_truncation()
        encoder.no_padding()
        return encoder

    @cached_property
    def tables(self) -> tuple[pa.Array, pa.Array]:
        """The id-to-piece table, and each id as decimal text with a comma."""
        letters = byte_letters()
        pieces = [b""] * self.size
        for piece, i in self.plain.items():
            pieces[i] = bytes(letters[c] for c in piece)
        for piece, i in self.special.items():
            pieces[i] = piece.encode()
        return pa.array(pieces, pa.large_binary()), pa.array([f"{i}," for i in range(self.size)], pa.large_string())

    def split(self, text: str) -> list[str]:
        """The text's words, in order; special tokens are words of their own, as the library has it."""
        if self.marks is None or not self.marks.search(text):
            return self.words.findall(text)
        parts = self.marks.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.words.findall(part))]

    def units(self, text: str) -> list[str]:
        """The text in pieces, in order, whose words by ``words_of``, one after the other, are the text's words.

        A word takes a blank in front but none behind, and a blank before anything but a
        blank starts a word. So a text falls apart there, and each distinct piece need be
        split only once. A unit that starts with a blank is one word, behind that blank;
        any other lost the blank that stood before it.
        """
        if BLANKS.search(text) or (self.marks is not None and self.marks.search(text)):
            return [" " + w for w in self.split(text)]
        units = text.split(" ")
        units[:1] = [" " + w for w in self.words.findall(units[0])]
        return units

    def words_of(self, unit: str) -> list[str]:
        return [unit[1:]] if unit[0] == " " else self.words.findall(" " + unit)

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encoder.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(2)
def _vocabulary(path: str, changed: int) -> Vocabulary:
    return Vocabulary(path)


def vocabulary_of(path: str) -> Vocabulary:
    """The file's vocabulary, read once by each Python worker as long as the file does not change."""
    return _vocabulary(path, os.stat(path).st_mtime_ns)


def pack(words: list[str]) -> bytes:
    """Words as lengths and text, compressed. Decoded text keeps any character, also blanks and line ends."""
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.uint32, len(raw)).tobytes()
    return zstandard.compress(np.uint32(len(raw)).tobytes() + sizes + b"".join(raw), 3)


def unpack(data: bytes) -> list[str]:
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]).tolist() if n else []
    return [data[a:b].decode() for a, b in zip(starts, ends.tolist(), strict=True)]


def _id_type(vocabulary: Vocabulary) -> type:
    return np.uint16 if vocabulary.size <= 1 << 16 else np.uint32


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows in chunks of about ``chunk_bytes`` of text, numbered by task and order: the same on every run of the task."""
    base = TaskContext.get().partitionId() << 32
    held, size, n = [], 0, 0
    for part in slices(batches, "_text", chunk_bytes):
        length = pc.sum(pc.binary_length(part.column("_text"))).as_py() or 0
        if held and size + length > chunk_bytes:
            yield base + n, held
            held, size, n = [], 0, n + 1
        held.append(part)
        size += length
    if held:
        yield base + n, held


def _units(vocabulary: Vocabulary, parts: list[pa.RecordBatch]) -> Iterator[list[str]]:
    return (vocabulary.units(t or "") for part in parts for t in part.column("_text").to_pylist())


def _distinct_words(vocabulary: Vocabulary, parts: list[pa.RecordBatch]) -> list[str]:
    """The chunk's distinct words in sorted order."""
    units = set(chain.from_iterable(_units(vocabulary, parts)))
    return sorted(set(chain.from_iterable(map(vocabulary.words_of, units))))


def _placed_words(vocabulary: Vocabulary, parts: list[pa.RecordBatch]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The chunk's distinct words in sorted order, the place among them of each word of the texts, and the number of words by text."""
    number, per_text = defaultdict(count().__next__), []

    def numbers() -> Iterator[int]:
        for units in _units(vocabulary, parts):
            per_text.append(len(units))
            yield from map(number.__getitem__, units)

    unit = np.fromiter(numbers(), np.int64)
    split = [vocabulary.words_of(u) for u in number]
    words = sorted(set(chain.from_iterable(split)))
    place = dict(zip(words, range(len(words)), strict=True))
    flat = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.uint32)
    n = np.fromiter(map(len, split), np.int64, len(split))
    each = n[unit]
    upto = np.concatenate([[0], np.cumsum(each)])
    places = flat[np.repeat((np.cumsum(n) - n)[unit] - upto[:-1], each) + np.arange(upto[-1])]
    return words, places, np.diff(upto[np.concatenate([[0], np.cumsum(per_text, dtype=np.int64)])])


def _owners(words: list[str], n_parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)) % n_parts


def encode_decode(
    docs: DataFrame, *, id_column: str = ID, tokenizer: str | None = None, chunk_bytes: int = CHUNK_BYTES, full: bool = False
) -> DataFrame:
    """Per document the number of ids, the digest of the ids, and that of the text decoded from them.

    With ``full`` also the ids and the decoded text. A null text is encoded as an empty
    one and has no ids; a null id stays null; repeated rows give repeated rows; no
    documents give no rows; a text of any length is encoded whole (it may be larger than
    a chunk). Columns beside the id and the text are not read. ``docs`` is read twice
    and has to give its rows in the same order both times, as a table does: a chunk
    whose words differ between the two readings ends the job.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_column).cast("bigint").alias(ID), F.col(TEXT).alias("_text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        for chunk, parts in _chunks(batches, chunk_bytes):
            words = _distinct_words(vocabulary, parts)
            owner = _owners(words, n_parts)
            asked = [(p, pack([words[i] for i in np.flatnonzero(owner == p)])) for p in np.unique(owner).tolist()]
            yield pa.record_batch(
                [pa.array([chunk] * len(asked), pa.int64()), pa.array([p for p, _ in asked], pa.int32()), pa.array([w for _, w in asked], pa.binary())],
                ["chunk", "part", "words"],
            )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)  # the task's own: its encoder is large, and given back with the task
        kind = _id_type(vocabulary)
        known: dict[str, list[int]] = {}
        for batch in batches:
            for chunk, part, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = unpack(packed)
                new = [w for w in words if w not in known]
                if len(known) + len(new) > REMEMBERED:
                    known, new = {}, words
                for i in range(0, len(new), 20_000):
                    some = new[i : i + 20_000]
                    known.update(zip(some, vocabulary.encode(some), strict=True))
                found = [known[w] for w in words]
                sizes = np.fromiter(map(len, found), np.uint32, len(found))
                ids = np.fromiter(chain.from_iterable(found), kind, int(sizes.sum()))
                data = zstandard.compress(np.uint32(len(found)).tobytes() + sizes.tobytes() + ids.tobytes(), 3)
                check = zlib.crc32(packed)
                yield pa.record_batch(
                    [pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([check], pa.int64()), pa.array([data], pa.binary())],
                    ["chunk", "part", "check", "ids"],
                )
        del vocabulary
        known.clear()
        give_back()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(path)
        for chunk, parts in _chunks(batches, chunk_bytes):
            words, places, sizes = _placed_words(vocabulary, parts)
            owner = _owners(words, n_parts).astype(np.uint32)
            checks = {p: zlib.crc32(pack([words[i] for i in np.flatnonzero(owner == p)])) for p in np.unique(owner).tolist()}
            keys = pa.concat_arrays([p.column(ID).combine_chunks() if isinstance(p.column(ID), pa.ChunkedArray) else p.column(ID) for p in parts])
            yield pa.record_batch(
                [
                    pa.array([chunk], pa.int64()),
                    pa.array([keys.to_pylist()], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([_squeeze(places)], pa.binary()),
                    pa.array([_squeeze(owner)], pa.binary()),
                    pa.array([json.dumps(checks)], pa.string()),
                ],
                ["chunk", "keys", "sizes", "places", "owner", "checks"],
            )

    def join(places: pa.Table, answers: pa.Table) -> pa.Table:
        vocabulary = vocabulary_of(path)
        kind = _id_type(vocabulary)
        out = []
        for row in places.to_pylist():
            owner = _stretch(row["owner"])
            checks = {int(p): c for p, c in json.loads(row["checks"]).items()}
            starts, lengths, flat, base = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64), [], 0
            seen = {}
            for got in answers.to_pylist():
                data = zstandard.decompress(got["ids"])
                n = int(np.frombuffer(data, np.uint32, 1)[0])
                each = np.frombuffer(data, np.uint32, n, 4).astype(np.int64)
                ids = np.frombuffer(data, kind, int(each.sum()), 4 + 4 * n)
                where = np.flatnonzero(owner == got["part"])
                seen[got["part"]] = got["check"]
                if len(where) == n:
                    starts[where], lengths[where] = base + np.cumsum(each) - each, each
                flat.append(ids)
                base += len(ids)
            if seen != checks:
                raise RuntimeError("the documents gave other rows when they were read again; write them to a table first")
            table = np.concatenate(flat).astype(np.int64) if flat else np.zeros(0, np.int64)
            out.append(_documents(vocabulary, row, _stretch(row["places"]), starts, lengths, table, full))
        give_back()
        return pa.Table.from_batches(out)

    answers = (
        rows.mapInArrow(ask, "chunk bigint, part int, words binary")
        .repartition(n_parts, "part")
        .mapInArrow(answer, "chunk bigint, part int, check bigint, ids binary")
    )
    placed = rows.mapInArrow(
        place, "chunk bigint, keys array<bigint>, sizes array<bigint>, places binary, owner binary, checks string"
    )
    return placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(join, FULL_SCHEMA if full else SCHEMA)


def _squeeze(numbers: np.ndarray) -> bytes:
    """uint32 numbers, compressed byte plane by byte plane."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def _stretch(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _documents(vocabulary, row, places, starts, lengths, table, full) -> pa.RecordBatch:
    """The chunk's documents: words to ids by position, ids to pieces, both digested per document."""
    out = []
    ends = np.cumsum(row["sizes"]).tolist()
    at = 0
    # Some documents at a time, so that ids and pieces stay small beside the chunk.
    while at < len(ends):
        stop = at + 1
        begin = ends[at - 1] if at else 0
        while stop < len(ends) and ends[stop] - begin < 500_000:
            stop += 1
        word = places[begin : ends[stop - 1]]
        n = lengths[word]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = table[np.repeat(starts[word] - upto[:-1], n) + np.arange(upto[-1])]
        pieces, decimals = (t.take(pa.array(ids)) for t in vocabulary.tables)
        p_offsets, p_data = _joined(pieces)
        d_offsets, d_data = _joined(decimals)
        for i in range(at, stop):
            a, b = int(upto[(ends[i - 1] if i else 0) - begin]), int(upto[ends[i] - begin])
            decoded = bytes(p_data[p_offsets[a] : p_offsets[b]]).decode("utf-8", "replace")
            listed = bytes(d_data[d_offsets[a] : d_offsets[b]])[:-1]
            found = (row["keys"][i], b - a, sha256_hex(listed), sha256_hex(decoded.encode()))
            out.append((*found, ids[a:b], decoded) if full else found)
        at = stop
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 6 if full else 4]
    names = [ID, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(kinds)]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _joined(values: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of an array of texts that lie one after the other."""
    if not len(values):
        return np.zeros(1, np.int64), memoryview(b"")
    _, offsets, data = values.buffers()
    return np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8), memoryview(data or b"")
