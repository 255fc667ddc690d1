"""N-gram Jaccard join: size bands, hashed bitmap signatures that bound the overlap, exact sorted-array intersection.

Two sets whose similarity reaches the threshold share a shingle among the first few of
each, in any fixed order of shingles (the prefix filter). Rare shingles are put first,
so few documents meet. Work goes on in three steps: every document is held against one
pivot of each shingle's group, which joins large groups of near copies without pairs
among them; then groups that still hold more than one component are compared in tiles
of one size band, where places and bitmaps refuse most pairs; what is left is
intersected exactly. A group of more than ``BLOCK`` rows is dealt in blocks, and a task
holds one pair of blocks; rows of one large component never meet each other. A pair need only be told at the first shingle that both sets hold.
Each row knows the few shared shingles before its own, so a pair that holds one of
those is not told again, however many shingles it shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.common import ID, SLICE_BYTES, TEXT, cut, give_back, slices, text_bytes
from kerbside.llm.words import mix, shingle_sets

#: 100 * intersection >= PERCENT * union.
PERCENT = 75
WIDTH = 5
#: Bits of a signature.
BITS = 1024
#: A shingle counts as frequent if this many documents of a slice hold it; how many frequent ones are ranked.
FREQUENT, RANKED = 3, 1 << 20
#: Bytes of text whose shingles are hashed at once; arrays of words and hashes take about 40 times as much.
HASHED_BYTES = SLICE_BYTES // 4
#: Rows of a tile.
TILE = 512
#: How many of its set's shared shingles before its own a row of a tile knows.
BEFORE = 4
#: Bits for each element in the signatures that pairs are held against before their texts are.
FINE = 4
#: Rows of a group that one task compares; larger groups are dealt in blocks of about so many.
BLOCK = 8192
#: Groups up to this size are compared together, larger ones each by tiles.
SMALL = 64
#: Most bits of the filter that keeps texts out of the shuffle that no pair needs. A fuller filter only keeps out fewer.
FILTER_BITS = 1 << 26


def enough(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (a + b - common)


def set_id(hashes: np.ndarray) -> int:
    """One 64-bit number for a set of hashes, as signed."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(hashes ^ np.uint64(0xA0761D6478BD642F))) + np.uint64(len(hashes))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def signature(hashes: np.ndarray) -> bytes:
    bits = np.zeros(BITS, bool)
    bits[(hashes >> np.uint64(17)).astype(np.int64) % BITS] = True
    return np.packbits(bits).tobytes()


def fine_signature(hashes: np.ndarray) -> bytes:
    """A signature as wide as the set's size band asks for, so that large sets do not fill it."""
    width = max(64, 1 << int(FINE * len(hashes) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(hashes >> np.uint64(17)).astype(np.int64) % width] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fine_enough(na: int, nb: int, a: bytes, b: bytes) -> bool:
    """Whether signatures of two size bands leave room for the overlap that a link takes; the wider one is folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(s.reshape(-1, n), axis=0) for s in (x, y))
    return bool(enough(most_common(x, y, np.int64(na), np.int64(nb)), na, nb))


def most_common(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Bound from above of the overlap of sets of ``na`` and ``nb`` by their signatures (rows of uint64).

    Each bit set in one signature alone stands for at least one element that the other set lacks.
    """
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


class Order:
    """Rare shingles first: by the class of their frequency, then by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.rank = np.minimum(np.log2(np.maximum(counts[order], 1)).astype(np.uint64) + np.uint64(1), np.uint64(63))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.hashes >> np.uint64(42)] = True

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers that sort as the shingles do, and are equal only for equal shingles (of 58 bits)."""
        out = hashes >> np.uint64(6)
        if len(self.hashes):
            may = np.flatnonzero(self.seen[hashes >> np.uint64(42)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[may]), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes[may]
            out[may[hit]] |= self.rank[at[hit]] << np.uint64(58)
        return out


def prefix_size(n: int) -> int:
    """Of the first so many shingles, two linked sets share one: n less the least overlap, and one more."""
    return n - -(-PERCENT * n // 100) + 1


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(ID).cast("bigint").alias(ID), F.col(TEXT).alias("_text"))


def _sets(part: pa.RecordBatch) -> list[np.ndarray]:
    """The sets of the part's rows, some texts at a time."""
    return [s for some in slices(iter([part]), "_text", HASHED_BYTES) for s in shingle_sets(*text_bytes(some, "_text"), WIDTH)]


def _described(rows: DataFrame) -> DataFrame:
    """Per document: rid, id, size and number of its set (null when empty), signature.

    Beside them rows without a rid, whose ``frequent`` holds the shingles that many
    documents of one slice share, with their counts.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", ID, "n", "sid", "signature", "frequent"]
        for part in slices(batches, "_text"):
            sets = _sets(part)
            yield pa.record_batch(
                [
                    part.column("rid"), part.column(ID), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([signature(s) for s in sets], pa.binary()), pa.nulls(len(sets), pa.binary()),
                ],
                names,
            )
            every = np.sort(np.concatenate(sets))
            edges = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            n = np.diff(np.append(edges, len(every)))
            often = n >= FREQUENT
            if often.any():
                packed = every[edges[often]].tobytes() + n[often].astype(np.int64).tobytes()
                none = pa.nulls(1, pa.int64())
                yield pa.record_batch([none, none, none, none, pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], names)

    return rows.mapInArrow(describe, f"rid bigint, {ID} bigint, n bigint, sid bigint, signature binary, frequent binary")


def _order(described: DataFrame) -> Order:
    """The order of shingles, from the frequent ones of the whole corpus; at most ``RANKED`` reach the driver."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                hashes, n = np.frombuffer(data, np.int64).reshape(2, -1)
                yield pa.record_batch([pa.array(hashes), pa.array(n)], ["hash", "n"])

    found = (
        described.filter("frequent is not null").select("frequent").mapInArrow(unpack, "hash bigint, n bigint")
        .groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(RANKED).toArrow()
    )
    if not len(found):
        return Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Order(found.column("hash").combine_chunks().to_numpy().view(np.uint64), found.column("n").combine_chunks().to_numpy())


def _prefixes(rows: DataFrame, order: Order, needed: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """``token``, ``sid``, ``place``: the first shingles of each set and how many stand before; a task sends a set once.

    With a filter of tokens, most others are left out.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        marked, shift = None, np.uint64(0)
        if needed:
            marked, shift = np.unpackbits(needed[0]).astype(bool), np.uint64(64 - needed[1].bit_length() + 1)
        for part in slices(batches, "_text", HASHED_BYTES):
            found, owners, places = [], [], []
            for s in shingle_sets(*text_bytes(part, "_text"), WIDTH):
                if not len(s) or (sid := set_id(s)) in sent:
                    continue
                sent.add(sid)
                keys = order.keys(s)
                size = prefix_size(len(s))
                found.append(np.sort(np.partition(keys, size - 1)[:size] if size < len(s) else keys))
                owners.append(np.full(size, sid, np.int64))
                places.append(np.arange(size, dtype=np.int32))
            if found:
                columns = [np.concatenate(found).view(np.int64), np.concatenate(owners), np.concatenate(places)]
                if marked is not None:
                    keep = marked[mix(columns[0].view(np.uint64)) >> shift]
                    columns = [c[keep] for c in columns]
                yield pa.record_batch([pa.array(c) for c in columns], ["token", "sid", "place"])

    return rows.mapInArrow(tokens, "token bigint, sid bigint, place int")


def _needed(wanted: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bounded Bloom filter, one hash, of the numbers in a column of ``wanted``."""
    n = wanted.count()
    bits = min(FILTER_BITS, 1 << int(np.ceil(np.log2(max(1024, 16 * n)))))
    slice_bits = min(bits, 1 << 18)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(bits, bool)
        for batch in batches:
            marked[mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits.bit_length() + 1)] = True
        for i in range(0, bits, slice_bits):
            part = marked[i : i + slice_bits]
            if part.any():
                yield pa.record_batch([pa.array([i // slice_bits], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], ["slice", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()]
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})

    shape = "slice int, bits binary"
    found = wanted.select(column).mapInArrow(mark, shape).groupBy("slice").applyInArrow(merge, shape).collect()
    out = np.zeros(bits, bool)
    for r in found:
        out[r["slice"] * slice_bits : (r["slice"] + 1) * slice_bits] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))
    return np.packbits(out), bits


def _verified(rows: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` of set numbers whose sets reach the threshold, by exact intersection.

    The text of one row stands for each set; which row makes no difference.
    """
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(sets.select("sid", "rid"), "sid"))
    packed, bits = _needed(wanted, "rid")
    shift = np.uint64(64 - bits.bit_length() + 1)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(packed).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(marked[mix(batch.column("rid").to_numpy().view(np.uint64)) >> shift]))

    held = cut(rows.select("rid", "_text").mapInArrow(texts, "rid bigint, _text string").join(wanted, "rid").select("sid", "_text"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            for part in slices(iter([batch]), "text_a"):
                left = shingle_sets(*text_bytes(part, "text_a"), WIDTH)
                ok = []
                for i, (b, s) in enumerate(zip(part.column("b").to_pylist(), left, strict=True)):
                    if last[0] != b:
                        last = (b, shingle_sets(*text_bytes(part.slice(i, 1), "text_b"), WIDTH)[0])
                    n = common(s, last[1])
                    ok.append(100 * n >= PERCENT * (len(s) + len(last[1]) - n))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", HASHED_BYTES):
            sets = shingle_sets(*text_bytes(part, "_text"), WIDTH)
            fine = pa.array([fine_signature(s) for s in sets], pa.binary())
            yield pa.record_batch([part.column("sid"), pa.array([len(s) for s in sets], pa.int64()), fine], ["sid", "n", "fine"])

    def refuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [fine_enough(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "fa", "fb")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    sketches = cut(held.mapInArrow(sketch, "sid bigint, n bigint, fine binary"))
    side = lambda x: sketches.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
    left = cut(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(refuse, "a bigint, b bigint"))
    with_a = left.join(held.select(F.col("sid").alias("a"), F.col("_text").alias("text_a")), "a")
    with_b = with_a.join(held.select(F.col("sid").alias("b"), F.col("_text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


def _ranked(met: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` once, with how many ``times`` they met and the pair's ``rank`` by that among those of ``a``."""
    times = met.groupBy("a", "b").agg(F.count("*").alias("times"))
    return times.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("times"), "b")))


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that sizes and signatures do not refuse: a set's two likeliest, and those that met often enough."""

    def refuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb, times, rank = (batch.column(c).to_numpy() for c in ("na", "nb", "times", "rank"))
            a, b = (_words(batch.column(c)) for c in ("sa", "sb"))
            keep = enough(most_common(a, b, na, nb), na, nb) & ((rank <= 2) | (times >= least_shared(na, nb)))
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        give_back()

    side = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    near = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(near).mapInArrow(refuse, "a bigint, b bigint")


def _words(column: pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint64).reshape(len(column), -1)


class Rows(NamedTuple):
    """Rows of tiles: component, size of the set, place of the token in it, tokens before this one, signature."""

    comp: np.ndarray
    n: np.ndarray
    place: np.ndarray
    before: np.ndarray
    sig: np.ndarray

    def at(self, which: slice) -> Rows:
        return Rows(*(c[which] for c in self))


def tile_pairs(rows: Rows, old: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of pairs of one group's rows, sorted by size, of different components and not refused. By tiles.

    The first ``old`` rows have met each other before.
    """
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    comp, n = rows.comp, rows.n
    for i in range(0, len(n), TILE):
        x = np.arange(i, min(i + TILE, len(n)))
        stop = int(np.searchsorted(n, 100 * n[x[-1]] // PERCENT, side="right"))
        for j in range(i + max(0, old - i) // TILE * TILE, stop, TILE):
            y = np.arange(j, min(j + TILE, len(n)))
            near = (PERCENT * n[y][None, :] <= 100 * n[x][:, None]) & (comp[x][:, None] != comp[y][None, :])
            near &= (x[:, None] < y[None, :]) & (y[None, :] >= old)
            p, q = np.nonzero(near)
            u, v = _unrefused(x[p], y[q], rows)
            out_a.append(u)
            out_b.append(v)
    return np.concatenate(out_a), np.concatenate(out_b)


def cross_pairs(rows: Rows, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``tile_pairs``, of rows sorted by size, but only pairs of a row on the left and one on the right."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left, right = np.flatnonzero(~right), np.flatnonzero(right)
    n = rows.n[right]
    for i in range(0, len(left), TILE):
        x = left[i : i + TILE]
        low, high = rows.n[x[0]], rows.n[x[-1]]
        start = int(np.searchsorted(n, -(-PERCENT * low // 100)))
        stop = int(np.searchsorted(n, 100 * high // PERCENT, side="right"))
        for j in range(start, stop, TILE):
            y = right[j : min(j + TILE, stop)]
            p, q = np.nonzero(rows.comp[x][:, None] != rows.comp[y][None, :])
            u, v = _unrefused(x[p], y[q], rows)
            out_a.append(u)
            out_b.append(v)
    return np.concatenate(out_a), np.concatenate(out_b)


def _unrefused(u: np.ndarray, v: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that may be linked and whose token may be the first that both sets hold.

    At that token all of the overlap is still to come, so neither place may be too far on.
    A token that stands before it in both sets shows that the pair is told elsewhere.
    """
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(u), 1 << 15):
        x, y = u[k : k + (1 << 15)], v[k : k + (1 << 15)]
        ok = enough(np.minimum(rows.n[x] - rows.place[x], rows.n[y] - rows.place[y]), rows.n[x], rows.n[y])
        x, y = x[ok], y[ok]
        told = np.zeros(len(x), bool)
        for i in range(BEFORE):
            key = rows.before[x, i]
            told |= (key != 0) & (key[:, None] == rows.before[y]).any(axis=1)
        x, y = x[~told], y[~told]
        ok = enough(most_common(rows.sig[x], rows.sig[y], rows.n[x], rows.n[y]), rows.n[x], rows.n[y])
        out_a.append(x[ok])
        out_b.append(y[ok])
    return np.concatenate(out_a), np.concatenate(out_b)


def group_pairs(token: np.ndarray, rows: Rows, old: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of pairs within all groups of equal tokens, rows sorted by token and size.

    Small groups go together, row by row with the next, the one after it, and so on;
    large groups go by tiles. The first ``old`` rows, all of one token, have met before.
    """
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    sizes = np.diff(np.append(starts, len(token)))
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        part = slice(start, start + size)
        u, v = tile_pairs(rows.at(part), max(0, min(size, old - start)))
        out_a.append(u + start)
        out_b.append(v + start)
    ends = np.repeat(np.where(sizes > SMALL, 0, starts + sizes), sizes)
    row = np.flatnonzero(np.arange(len(token)) + 1 < ends)
    k = 1
    while len(row):
        other = row + k
        ok = (rows.comp[row] != rows.comp[other]) & (PERCENT * rows.n[other] <= 100 * rows.n[row]) & (other >= old)
        u, v = _unrefused(row[ok], other[ok], rows)
        out_a.append(u)
        out_b.append(v)
        k += 1
        row = row[row + k < ends[row]]
    return np.concatenate(out_a), np.concatenate(out_b)


def least_shared(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many shingles the prefixes of two linked sets share at least.

    A prefix is as long as the least overlap with any set asks for; with a set of about
    the same size more overlap is needed, and the surplus falls into the prefixes.
    """
    overlap = -(-PERCENT * (na + nb) // (100 + PERCENT))
    return overlap - (-(-PERCENT * np.maximum(na, nb) // 100)) + 1


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) of all linked nodes, by alternating stars.

    Each round hangs every node's larger neighbours, then its smaller ones, on its
    smallest; the number of rounds is logarithmic. Rounds are written, not kept as plans.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _dealt(tiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of large groups, each once for each pair of blocks that it belongs to.

    A size band reaches from one power of 4/3 to the next, so linked sets are of one band or
    of neighbours. Rows of a band form cells: one for each component of ``BLOCK`` rows or
    more, one for all others. A cell is dealt by hash in blocks of about ``BLOCK`` rows. A
    block meets the blocks of its own and of other cells, but none of its own large
    component. ``pair`` tells pairs of blocks apart; ``side`` is 0 where a block meets
    itself, else 1 or 2. ``sizes`` has the rows' ``token``, ``comp`` and ``n`` alone.
    """
    # rounding at a band's edge may shift a set by one band, so bands up to two apart meet
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT))).cast("int").alias("band")
    counts = sizes.select("token", "comp", band).groupBy("token", "band", "comp").agg(F.count("*").alias("rows"))
    counts = counts.withColumn("own", F.when(F.col("rows") >= BLOCK, F.col("comp")))
    counts = cut(counts.withColumn("cell", F.xxhash64("band", "own", F.col("own").isNull())))
    cells = cut(counts.groupBy("token", "cell", "band", "own").agg(F.ceil(F.sum("rows") / BLOCK).cast("int").alias("blocks")))
    theirs = cells.select("token", *(F.col(c).alias(f"other_{c}") for c in ("cell", "band", "own", "blocks")))
    meet = (F.abs(F.col("band") - F.col("other_band")) <= 2) & ~F.coalesce(F.col("own") == F.col("other_own"), F.lit(False))
    meet = cells.join(theirs, "token").filter(meet).select("token", "cell", "blocks", "other_cell", "other_blocks")
    rows = tiles.select("*", band).join(counts.select("token", "band", "comp", "cell"), ["token", "band", "comp"])
    rows = rows.join(meet, ["token", "cell"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    here, there = F.struct("cell", "block"), F.struct(F.col("other_cell").alias("cell"), F.col("other").alias("block"))
    alone, first = here == there, here < there
    pair = F.xxhash64(F.least(here, there), F.greatest(here, there))
    return rows.select(*tiles.columns, pair.alias("pair"), F.when(alone, 0).when(first, 1).otherwise(2).alias("side"))


def _met(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of sets of different components that meet in a group and are not refused."""
    # One dealing by set serves both the tokens before each row and the join.
    own = Window.partitionBy("sid").orderBy("place")
    before = [f"before{k}" for k in range(BEFORE)]
    tiles = shared.select("*", *(F.lag("token", k + 1, 0).over(own).alias(c) for k, c in enumerate(before))).join(sets.drop("rid"), "sid")
    plain = tiles.select("*", F.lit(0).cast("bigint").alias("pair"), F.lit(0).alias("side"))
    large = F.col("size") > BLOCK
    if not shared.filter(large).isEmpty():
        sizes = shared.filter(large).select("token", "sid", "comp").join(sets.select("sid", "n"), "sid")
        plain = plain.filter(~large).unionByName(_dealt(tiles.filter(large), sizes))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A group, or a pair of blocks, goes on when all of it has been read.
        held: list[tuple[np.ndarray, ...]] = []

        def pairs() -> Iterator[pa.RecordBatch]:
            token, mate, side, sid, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
            rows = Rows(*rest)
            group = np.cumsum(np.append(False, (token[1:] != token[:-1]) | (mate[1:] != mate[:-1])))
            edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() + [len(group)]
            apart = np.bincount(group, side > 0) > 0
            found = []
            inner = np.flatnonzero(~apart[group])
            if len(inner):
                a, b = group_pairs(group[inner], Rows(*(c[inner] for c in rows)))
                found.append((inner[a], inner[b]))
            for g in np.flatnonzero(apart).tolist():
                part = slice(edges[g], edges[g + 1])
                a, b = cross_pairs(rows.at(part), side[part] == 2)
                found.append((a + edges[g], b + edges[g]))
            a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(a):
                pair = np.unique(np.sort(np.stack([sid[a], sid[b]]), axis=0), axis=1)
                yield pa.record_batch([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            read = [column[c].to_numpy() for c in ("token", "pair", "side", "sid", "comp", "n", "place")]
            read += [np.stack([column[c].to_numpy() for c in before], axis=1), _words(column["signature"])]
            same = (read[0] == read[0][-1]) & (read[1] == read[1][-1])
            at = int(np.argmax(same))
            if at or (held and (held[-1][0][-1], held[-1][1][-1]) != (read[0][0], read[1][0])):
                held.append(tuple(c[:at] for c in read))
                yield from pairs()
                held = []
            held.append(tuple(c[at:] for c in read))
        if held:
            yield from pairs()
            held = []
        give_back()

    return plain.repartition("token", "pair").sortWithinPartitions("token", "pair", "n", "sid").mapInArrow(tile, "a bigint, b bigint")


def _classes(docs: DataFrame) -> DataFrame:
    """``rid``, id, ``n_shingles``, ``root`` (null for an empty set), ``component_id``."""
    rows = _numbered(docs)
    everything = cut(_described(rows))
    described = everything.filter("rid is not null")
    first_row = F.min(F.struct("rid", "n")).alias("first")
    sets = described.filter("sid is not null").groupBy("sid").agg(first_row).select("sid", "first.rid", "first.n")
    sets = cut(sets.join(described.select("rid", "signature"), "rid"))
    # Shingles that different sets share, each with the smallest and the largest of these sets. They are
    # found by map-side aggregates and joined back, so that no task has to hold a group.
    order = _order(everything)
    ends = _prefixes(rows, order).groupBy("token").agg(F.min("sid").alias("pivot"), F.max("sid").alias("last"))
    ends = cut(ends.filter("pivot <> last"))
    shared = cut(_prefixes(rows, order, _needed(ends, "token")).distinct().join(ends, "token"))
    # The smallest and the largest set of a group are its pivots. Links that this step leaves out fall to the tiles.
    stars = _ranked(shared.select(F.col("sid").alias("a"), F.explode(F.array("pivot", "last")).alias("b")).filter("a <> b"))
    first = cut(_verified(rows, sets, cut(_bounded(stars, sets))))
    roots = components(first)
    # Only groups that still hold more than one component go on.
    placed = shared.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select(
        "token", "sid", "place", F.coalesce("root", "sid").alias("comp")
    )
    mixed = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"))
    shared = cut(placed.join(mixed.filter("low <> high").select("token", "size"), "token"))
    second = _verified(rows, sets, cut(_met(shared, sets).distinct()))
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second)
    final = components(links)
    members = described.join(final.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    members = members.select("rid", ID, "n", "root")
    names = members.filter("root is not null").groupBy("root").agg(F.min(ID).alias("component_id"))
    return members.join(names, "root", "left").select(
        "rid", ID, "root", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col(ID)).otherwise(F.col("component_id")).alias("component_id")
    )


def similarity_classes(docs: DataFrame) -> DataFrame:
    """Per document its id, the size of its set, and ``component_id``.

    Sets are the distinct shingles of five lower-cased words, or the whole text if it
    has fewer. Documents of a component are joined by links of similarity 0.75 or more;
    ``component_id`` is its smallest id. A null or empty text, or one of blanks, has an
    empty set and is its own component. A null id is never a component's id unless all
    its documents have none, and then it is null. Repeated rows are equal texts, so they
    share a component. No documents give no rows. Other columns are not read. ``docs``
    has to give its rows in the same order whenever it is read, as a table does.
    """
    return _classes(docs).select(ID, "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of each component the one with the smallest id.

    Of repeated rows with that id the first stays. Documents with an empty set all stay.
    """
    found = _classes(docs)
    lead = F.struct(F.col(ID).isNull(), F.col(ID), F.col("rid"))
    kept = found.filter("root is not null").groupBy("root").agg(F.min(lead).alias("lead")).select("lead.rid")
    kept = kept.unionByName(found.filter("root is null").select("rid"))
    rid = "_rid"
    while rid in docs.columns:
        rid += "_"
    numbered = docs.withColumn(rid, F.monotonically_increasing_id())
    return numbered.join(kept.withColumnRenamed("rid", rid), rid, "left_semi").drop(rid)
