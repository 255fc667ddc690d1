"""Repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Which bytes stand in a string of ``LENGTH`` bytes that starts twice anywhere? In every
such string one place is chosen by its content alone (the smallest hash of ``KEY``
bytes), so equal strings are chosen the same place. Only suffixes from chosen places
are sorted, each once per chunk of text and with the bytes before it; and only those
whose first ``KEY`` bytes occur twice in the corpus. Chunks send sorted, front-coded
runs; a loser tree merges them and goes on from the common prefixes that runs and
earlier matches know, so no known prefix is compared again. Neighbours in the result
with enough bytes in common, before and after the place, are the repeats.

Places whose key stands more than ``HOT`` times in the corpus are not sorted, as all
their suffixes would meet in one task. There each string of ``LENGTH`` bytes is told by
128 bits of hash, once per chunk, and dealt by that; a key's strings spread over all tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import ID, TEXT, cut, sha256_hex, slices, text_bytes
from kerbside.llm.words import VALUES, mix

LENGTH, KEY = 200, 64
#: Bytes of text in a chunk.
CHUNK_BYTES = 8 << 20
#: Anchors that the sort's ranges are taken from: of each chunk, and of the corpus.
CHUNK_SAMPLE, SAMPLE = 64, 20_000
SAMPLES = -1
#: A key that stands oftener than this in the corpus is not sorted; its strings are counted by their hashes.
HOT = 1 << 14

SCHEMA = f"{ID} bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
FULL_SCHEMA = f"{SCHEMA}, kept binary"
#: A second table of values for bytes, and how many places are hashed at once.
OTHER_VALUES = mix(VALUES ^ np.uint64(0xD6E8FEB86659FD93))
STEP = 1 << 18


# --- places chosen by content -------------------------------------------------


def key_hashes(data: np.ndarray, key: int = KEY) -> np.ndarray:
    """Hash of the ``key`` bytes from each place; ``key`` is a power of two."""
    h = VALUES[data]
    width = 1
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while width < key:
            h = h[:-width] * factor + h[width:] if len(h) > width else h[:0]
            factor = factor * factor + np.uint64(2)
            width *= 2
    return mix(h)


class Runs:
    """Strings of one chosen place: starts ``first`` to ``last``, place ``anchor``, hash of its key, for each run."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, key: int = KEY, step: int = 1 << 22):
        width = length - key + 1
        n = len(data)
        starts = np.ones(max(0, n), bool)  # where a string of this length starts inside one text
        for end in offsets[1:].tolist():
            starts[max(0, end - length + 1) : end] = False
        # texts that are shorter have no such place; a longer text's tail was cleared, and so were its neighbours' tails
        parts = []
        for g in range(0, n, step):
            h = key_hashes(data[g : g + step + length], key)
            m = min(step, len(h) - width + 1, n - g)
            if m <= 0:
                continue
            # the place itself breaks ties, so that the leftmost of equal hashes is chosen
            k = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
            pad = -len(k) % width
            k = np.concatenate([k, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
            ahead = np.minimum.accumulate(k, axis=1).ravel()
            behind = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
            best = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & np.uint64(0xFFFFFF)
            at = np.flatnonzero(starts[g : g + m])
            if len(at):
                anchor = best[at].astype(np.int64)
                parts.append((at + g, anchor + g, h[anchor]))
        none = np.zeros(0, np.int64)
        at = np.concatenate([none, *(p[0] for p in parts)])
        anchor = np.concatenate([none, *(p[1] for p in parts)])
        hashes = np.concatenate([np.zeros(0, np.uint64), *(p[2] for p in parts)])
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(at)) - 1
        self.first, self.last = (at[begin], at[stop]) if len(at) else (none, none)
        self.anchor, self.hash = anchor[begin], hashes[begin]


def _wide_hashes(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of the ``LENGTH`` bytes from each place, by a table of values for bytes."""
    h = values[data]
    width = 1
    factor = values[0] | np.uint64(1)
    with np.errstate(over="ignore"):
        while 2 * width <= LENGTH:
            h = h[:-width] * factor + h[width:] if len(h) > width else h[:0]
            factor = mix(np.array([factor]))[0] | np.uint64(1)
            width *= 2
        # the two halves overlap and cover the string
        rest = LENGTH - width
        h = h[: len(h) - rest] * factor + h[rest:] if len(h) > rest else h[:0]
    return mix(h)


def string_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings that start from each ``first`` to its ``last``: the starts, and 128 bits of hash in two columns."""
    sizes = last - first + 1
    ends = np.cumsum(sizes)
    starts = np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    out = np.zeros((len(starts), 2), np.uint64)
    for i in range(0, len(starts), STEP):
        # texts near each other share a window of the data; starts are in order
        at = starts[i : i + STEP]
        low, high = int(at[0]), int(at[-1]) + LENGTH
        for g in range(low, high, STEP):
            a, b = np.searchsorted(at, [g, g + STEP])
            if a < b:
                window = data[g : g + STEP + LENGTH]
                for k, values in enumerate((VALUES, OTHER_VALUES)):
                    out[i + a : i + b, k] = _wide_hashes(window, values)[at[a:b] - g]
    return starts, out


def distinct_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in order, each row's number among them, and how often each stands."""
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    ordered = hashes[order]
    new = np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1))[: len(order)]
    number = np.zeros(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], number, np.bincount(number, minlength=int(new.sum()))


# --- front-coded runs and the loser tree --------------------------------------


def common_prefix(x: bytes, y: bytes, at: int) -> int:
    """Length of the common prefix, which is known to be at least ``at``."""
    end = min(len(x), len(y))
    while at < end and x[at : at + 16] == y[at : at + 16]:
        at += 16
    if at >= end:
        return end
    while at < end and x[at] == y[at]:
        at += 1
    return at


def front_code(right: list[bytes], left: list[bytes], twice: list[bool], number: list[int]) -> bytes:
    """A sorted run: of each suffix the length that it shares with the one before, and the rest; its bytes before; flags."""
    shared, rest, last = [], [], b""
    for r in right:
        n = common_prefix(last, r, 0)
        shared.append(n)
        rest.append(r[n:])
        last = r
    head = np.array([len(right)], np.uint32).tobytes()
    arrays = [np.array(shared, np.uint16), np.array([len(r) for r in rest], np.uint16), np.array([len(x) for x in left], np.uint16),
              np.array(twice, np.uint16)]
    return zstandard.compress(head + np.array(number, np.uint32).tobytes() + b"".join(a.tobytes() for a in arrays) + b"".join(rest) + b"".join(left), 3)


def decode_run(data: bytes) -> Iterator[tuple[bytes, int, bytes, bool, int]]:
    """The run's suffixes as (suffix, shared with the one before, bytes before it, flag, number)."""
    data = zstandard.decompress(data)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    number = np.frombuffer(data, np.uint32, n, 4).tolist()
    shared, rest, left, twice = (np.frombuffer(data, np.uint16, n, 4 + 4 * n + 2 * n * i).tolist() for i in range(4))
    at = 4 + 12 * n
    back = at + sum(rest)
    last = b""
    for i in range(n):
        last = last[: shared[i]] + data[at : at + rest[i]]
        at += rest[i]
        yield last, shared[i], data[back : back + left[i]], bool(twice[i]), number[i]
        back += left[i]


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple[int, int, tuple]]:
    """All runs' items in order, as (run, common prefix with the item before, item).

    A loser tree whose nodes hold the loser and its common prefix with the winner. Two
    contenders are compared only where both share equally much with the last winner, and
    only beyond that; else the one that shares more comes first.
    """
    n = len(runs)
    if not n:
        return
    items: list[tuple | None] = [next(r, None) for r in runs]
    size = 1 << max(0, (n - 1).bit_length())
    loser = [-1] * size
    lcp = [0] * size

    def play(a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """Winner and its prefix, loser and its prefix with the winner."""
        x = items[a] if 0 <= a < n else None
        y = items[b] if 0 <= b < n else None
        if y is None:
            return a, ha, b, 0
        if x is None:
            return b, hb, a, 0
        if ha > hb:
            return a, ha, b, hb
        if hb > ha:
            return b, hb, a, ha
        p, q = x[0], y[0]
        h = common_prefix(p, q, ha)
        if h == len(p) or (h < len(q) and p[h] < q[h]):
            return (a, ha, b, h) if h < len(p) or len(p) < len(q) or a < b else (b, hb, a, h)
        return b, hb, a, h

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        (a, ha), (b, hb) = build(2 * node), build(2 * node + 1)
        w, hw, loser[node], lcp[node] = play(a, ha, b, hb)
        return w, hw

    win, shared = build(1)
    while 0 <= win < n and items[win] is not None:
        yield win, shared, items[win]
        items[win] = next(runs[win], None)
        now, h = win, items[win][1] if items[win] is not None else 0
        node = (win + size) >> 1
        while node:
            now, h, loser[node], lcp[node] = play(now, h, loser[node], lcp[node])
            node >>= 1
        win, shared = now, h


def repeated_starts(group: list[tuple[int, int, tuple]], length: int = LENGTH) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """For a group of suffixes that share their key: (run, number, repeated distances) where there are any.

    A distance ``d`` stands for the string that starts ``d`` bytes before the place; a
    suffix with its bytes before has those from ``length`` less its own size to the
    number of bytes before. A string is repeated if a neighbour in the order shares its
    bytes after the place, as the common prefixes tell, and the bytes before are equal.
    """
    n = len(group)
    if n == 1:
        run, _, (right, _, left, twice, number) = group[0]
        if twice:
            yield run, number, [(length - len(right), len(left))]
        return
    found: list[set[int] | None] = [set() for _ in group]
    # suffixes with equal bytes after and before are repeats as a whole
    whole: dict[tuple[int, bytes], list[int]] = {}
    segment = 0
    for i, (_, h, (right, _, left, _, _)) in enumerate(group):
        if i and not (h == len(right) == len(group[i - 1][2][0])):
            segment += 1
        whole.setdefault((segment, left), []).append(i)
    for same in whole.values():
        if len(same) > 1 or group[same[0]][2][3]:
            for i in same:
                found[i] = None
    if any(f is not None for f in found):
        shares = [0, *(h for _, h, _ in group[1:]), 0]
        low = min(length - len(g[2][0]) for g in group)
        high = max(len(g[2][2]) for g in group)
        for d in range(max(low, length - max(shares)), high + 1):
            need = length - d
            seen: dict[tuple[int, bytes], int] = {}
            segment = 0
            for i in range(n):
                if shares[i] < need:
                    segment += 1
                    if shares[i + 1] < need:
                        continue
                right, _, left, _, _ = group[i][2]
                if d <= len(left) and need <= len(right):
                    key = (segment, left[len(left) - d :])
                    first = seen.setdefault(key, i)
                    if first != i:
                        for j in (first, i):
                            if found[j] is not None:
                                found[j].add(d)
    for (run, _, (right, _, left, _, number)), marks in zip(group, found, strict=True):
        if marks is None:
            yield run, number, [(length - len(right), len(left))]
        elif marks:
            spans = []
            for d in sorted(marks):
                if spans and spans[-1][1] == d - 1:
                    spans[-1] = (spans[-1][0], d)
                else:
                    spans.append((d, d))
            yield run, number, spans


# --- Spark --------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray]]:
    """Chunk number, keys, bytes, offsets: the same on every run of a task."""
    base = TaskContext.get().partitionId() << 32
    held: list[tuple[list, np.ndarray, np.ndarray]] = []
    size = n = 0

    def joined() -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
        ends = np.cumsum(np.concatenate([[0], *(np.diff(o) for _, _, o in held)]))
        return base + n, [k for ks, _, _ in held for k in ks], np.concatenate([d for _, d, _ in held]), ends

    for part in slices(batches, "_text", chunk_bytes):
        data, offsets = text_bytes(part, "_text")
        if held and size + len(data) > chunk_bytes:
            yield joined()
            held, size, n = [], 0, n + 1
        held.append((part.column(0).to_pylist(), data, offsets))
        size += len(data)
    if held:
        yield joined()


def _marked_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.decompress(data)
    n = len(data) // 10
    return np.cumsum(np.frombuffer(data, np.uint64, n)), np.frombuffer(data, np.uint16, n, 8 * n)


def _distinct_suffixes(data: np.ndarray, runs: Runs, wanted: np.ndarray) -> tuple[list[tuple[bytes, bytes]], list[list[int]]]:
    """The distinct (bytes from the place, bytes before it) of the wanted runs, in order, with the runs that have them."""
    text = data.tobytes()
    wanted = np.flatnonzero(wanted)
    found: dict[tuple[bytes, bytes], list[int]] = {}
    rows = zip(wanted.tolist(), runs.first[wanted].tolist(), runs.last[wanted].tolist(), runs.anchor[wanted].tolist(), strict=True)
    for i, first, last, anchor in rows:
        found.setdefault((text[anchor : last + LENGTH], text[first:anchor]), []).append(i)
    order = sorted(found)
    return order, [found[k] for k in order]


def remove_repeats(docs: DataFrame, *, id_column: str = ID, chunk_bytes: int = CHUNK_BYTES, hot_key: int = HOT, full: bool = False) -> DataFrame:
    """Per document its bytes, the bytes removed, the maximal removed runs, and the digest of what is left.

    Removed is each byte in a string of 200 bytes that also starts elsewhere, in the same
    document or another; all copies go. Strings lie within one document. With ``full``
    also the bytes left. A null text is an empty one; texts under 200 bytes stay whole; a
    null id stays null; repeated rows are copies of each other; no documents give no
    rows. Columns beside id and text are not read. ``docs`` is read twice and has to give
    its rows in the same order both times, as a table does; else the job ends.
    """
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_column).cast("bigint").alias(ID), F.col(TEXT).alias("_text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, data, offsets in _chunks(batches, chunk_bytes):
            runs = Runs(data, offsets)
            check = zlib.crc32(data)
            hashes, first, n = np.unique(runs.hash, return_index=True, return_counts=True)
            owner = ((hashes >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
            out = []
            for p in np.unique(owner).tolist():
                mine = owner == p
                gaps = np.diff(hashes[mine], prepend=np.uint64(0))
                out.append((int(p), zstandard.compress(gaps.tobytes() + np.minimum(n[mine], 65535).astype(np.uint16).tobytes(), 1)))
            text = data.tobytes()
            some = [(h, text[a : a + KEY]) for h, a in zip(hashes[:CHUNK_SAMPLE].tolist(), runs.anchor[first[:CHUNK_SAMPLE]].tolist(), strict=True)]
            out.append((SAMPLES, b"".join(h.to_bytes(8, "big") + k for h, k in some)))
            yield pa.record_batch(
                [pa.array([chunk] * len(out), pa.int64()), pa.array([p for p, _ in out], pa.int32()),
                 pa.array([check] * len(out), pa.int64()), pa.array([d for _, d in out], pa.binary())],
                ["chunk", "part", "check", "data"],
            )

    shape = "chunk bigint, part int, check bigint, data binary"
    asked = cut(rows.mapInArrow(ask, shape))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                each = [data[i : i + 8 + KEY] for i in range(0, len(data), 8 + KEY)]
                yield pa.record_batch([pa.array([e[:8] for e in each], pa.binary()), pa.array([e[8:] for e in each], pa.binary())], ["hash", "key"])

    sample = asked.filter(F.col("part") == SAMPLES).select("data").mapInArrow(unpack, "hash binary, key binary").distinct()
    keys = sorted(bytes(r[1]) for r in sample.orderBy("hash").limit(SAMPLE).collect())
    bounds = sorted({keys[len(keys) * i // n_parts] for i in range(1, n_parts)}) if keys else []

    def answer(table: pa.Table) -> pa.Table:
        """Which of the hashes that chunks have occur twice or more in all of them, and which are hot."""
        got = [_marked_hashes(d) for d in table.column("data").to_pylist()]
        values, number = np.unique(np.concatenate([h for h, _ in got]), return_inverse=True)
        times = np.bincount(number, np.concatenate([n for _, n in got]), len(values))
        out, at = [], 0
        for h, _ in got:
            t = times[number[at : at + len(h)]]
            at += len(h)
            out.append(zstandard.compress(np.packbits(np.concatenate([t > 1, t > hot_key])).tobytes(), 1))
        return table.set_column(table.schema.get_field_index("data"), "data", pa.array(out, pa.binary()))

    answers = asked.filter(F.col("part") != SAMPLES).groupBy("part").applyInArrow(answer, shape)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, data, offsets in _chunks(batches, chunk_bytes):
            yield pa.record_batch(
                [pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                 pa.array([zstandard.compress(data.tobytes(), 3)], pa.binary())],
                ["chunk", "ids", "offsets", "data"],
            )

    placed = rows.mapInArrow(place, "chunk bigint, ids array<bigint>, offsets array<bigint>, data binary")

    def prepared(row: dict, told: list[dict]) -> tuple[np.ndarray, np.ndarray, Runs, np.ndarray]:
        """The chunk's bytes, offsets and runs, and of each run 0, 1 if its key occurs twice, 2 if it is hot."""
        data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
        offsets = np.array(row["offsets"], np.int64)
        if any(t["check"] != zlib.crc32(data) for t in told):
            raise RuntimeError("the documents gave other rows when they were read again; write them to a table first")
        runs = Runs(data, offsets)
        hashes = np.unique(runs.hash)
        owner = ((hashes >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
        state = np.zeros(len(hashes), np.uint8)
        for t in told:
            mine = np.flatnonzero(owner == t["part"])
            bits = np.unpackbits(np.frombuffer(zstandard.decompress(t["data"]), np.uint8))
            state[mine] = bits[: len(mine)] + bits[len(mine) : 2 * len(mine)]
        return data, offsets, runs, state[np.searchsorted(hashes, runs.hash)]

    def hot_strings(data: np.ndarray, runs: Runs, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of strings at hot places, the number of each among the distinct ones, these, how often they stand, and their parts."""
        hot = np.flatnonzero(state == 2)
        starts, hashes = string_hashes(data, runs.first[hot], runs.last[hot])
        distinct, number, times = distinct_hashes(hashes)
        return starts, number, distinct, times, ((distinct[:, 0] >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)

    def tell(places: pa.Table, told: pa.Table) -> pa.Table:
        """The chunk's sorted runs for each range, kind 1, and its hot strings for each part of their hashes, kind 2."""
        out = []
        for row in places.to_pylist():
            data, _, runs, state = prepared(row, told.to_pylist())
            suffixes, holders = _distinct_suffixes(data, runs, state == 1)
            check = zlib.crc32(data)
            owner = [bisect_right(bounds, right[:KEY]) for right, _ in suffixes]
            at = 0
            for p, same in groupby(owner):
                n = sum(1 for _ in same)
                part = range(at, at + n)
                run = front_code([suffixes[i][0] for i in part], [suffixes[i][1] for i in part], [len(holders[i]) > 1 for i in part], list(part))
                out.append((row["chunk"], p, check, run, 1))
                at += n
            _, _, distinct, times, parts = hot_strings(data, runs, state)
            for p in np.unique(parts).tolist():
                mine = parts == p
                packed = distinct[mine].T.tobytes() + (times[mine] > 1).astype(np.uint8).tobytes()
                out.append((row["chunk"], int(p), check, zstandard.compress(packed, 1), 2))
        kinds = [("chunk", pa.int64()), ("part", pa.int32()), ("check", pa.int64()), ("data", pa.binary()), ("kind", pa.int32())]
        return pa.table({name: pa.array([o[i] for o in out], kind) for i, (name, kind) in enumerate(kinds)})

    def settle(table: pa.Table) -> pa.Table:
        return (sort if table.column("kind")[0].as_py() == 1 else count)(table)

    def count(table: pa.Table) -> pa.Table:
        """Which of the hot strings that chunks have stand twice or more in all of them."""
        got = [np.frombuffer(zstandard.decompress(d), np.uint8) for d in table.column("data").to_pylist()]
        sizes = [len(g) // 17 for g in got]
        hashes = np.concatenate([g[: 16 * n].view(np.uint64).reshape(2, -1).T for g, n in zip(got, sizes, strict=True)])
        _, number, times = distinct_hashes(hashes)
        often = np.concatenate([g[16 * n :] for g, n in zip(got, sizes, strict=True)])
        again = (times + np.bincount(number, often, len(times)) > 1)[number]
        out, at = [], 0
        for n in sizes:
            out.append(zstandard.compress(np.packbits(again[at : at + n]).tobytes(), 1))
            at += n
        return table.set_column(table.schema.get_field_index("data"), "data", pa.array(out, pa.binary()))

    def sort(table: pa.Table) -> pa.Table:
        """Merges the runs of one range and finds the repeats in it."""
        chunks = table.column("chunk").to_pylist()
        found: list[list[tuple[int, int, int]]] = [[] for _ in chunks]
        group: list[tuple[int, int, tuple]] = []

        def close() -> None:
            for run, number, spans in repeated_starts(group):
                found[run].extend((number, low, high) for low, high in spans)

        for entry in merge_runs([decode_run(d) for d in table.column("data").to_pylist()]):
            if group and entry[1] < KEY:
                close()
                group = []
            group.append(entry)
        if group:
            close()
        data = [zstandard.compress(np.array(f, np.uint32).reshape(-1, 3).T.tobytes(), 3) for f in found]
        return table.set_column(table.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))

    def finish(places: pa.Table, told: pa.Table) -> pa.Table:
        """Marks repeats in each text and takes them out."""
        results = told.to_pylist()
        out = []
        for row in places.to_pylist():
            mine = [t for t in results if t["kind"] == 1]
            data, offsets, runs, state = prepared(row, [t for t in results if t["kind"] == 0])
            holders = _distinct_suffixes(data, runs, state == 1)[1]
            if any(t["check"] != zlib.crc32(data) for t in results):
                raise RuntimeError("the documents gave other rows when they were read again; write them to a table first")
            edge = np.zeros(len(data) + 1, np.int32)
            for t in mine:
                for number, low, high in np.frombuffer(zstandard.decompress(t["data"]), np.uint32).reshape(3, -1).T.tolist():
                    anchors = runs.anchor[holders[number]]
                    np.add.at(edge, anchors - high, 1)
                    np.add.at(edge, anchors - low + LENGTH, -1)
            starts, number, distinct, _, parts = hot_strings(data, runs, state)
            again = np.zeros(len(distinct), bool)
            for t in (t for t in results if t["kind"] == 2):
                mine = np.flatnonzero(parts == t["part"])
                again[mine] = np.unpackbits(np.frombuffer(zstandard.decompress(t["data"]), np.uint8))[: len(mine)]
            starts = starts[again[number]]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for key, a, b in zip(row["ids"], offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                cut_out = gone[a:b]
                spans = int(np.count_nonzero(np.diff(cut_out.astype(np.int8), prepend=0) == 1))
                kept = data[a:b][~cut_out].tobytes()
                digest = (key, b - a, b - a - len(kept), spans, sha256_hex(kept))
                out.append((*digest, kept) if full else digest)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        names = [ID, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if full else 5]
        return pa.table({name: pa.array([o[i] for o in out], kinds[i]) for i, name in enumerate(names)})

    kinds = f"{shape}, kind int"
    found = placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tell, kinds)
    repeats = found.groupBy("kind", "part").applyInArrow(settle, kinds)
    told = answers.withColumn("kind", F.lit(0)).unionByName(repeats)
    return placed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, FULL_SCHEMA if full else SCHEMA)
