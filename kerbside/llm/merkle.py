"""Merkle dataset manifest: per-language trees of documents under one root, proofs by checkpoint and recompute.

A tree joins every ``FAN`` consecutive nodes into their hash until one node is left. Only
every ``EVERY``-th level is written to the shared folder. A proof needs the siblings of a
leaf at each level; they are found by taking each aligned subtree (``FAN ** EVERY`` nodes of
a stored level under one node of the next stored level) into one task, hashing its interior
levels again from the stored nodes, emitting each node's siblings and dropping the rest.
No task holds more than one aligned subtree, whatever the size of a language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import ID, TEXT, cut
from kerbside.llm.ranks import positions

#: Nodes joined into one parent.
FAN = 8
#: Levels between stored ones; an aligned subtree holds FAN ** EVERY nodes of a stored level.
EVERY = 3
SPAN = FAN**EVERY
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BUILT = "g string, idx bigint, hash string, m bigint, is_root boolean"
PATHS = "g string, idx bigint, lefts array<string>, rights array<string>"


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count of the value as text, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _levels(first: int, hashes: list[str], m: int) -> list[tuple[int, list[str], int]]:
    """The levels of one aligned subtree: (first index, hashes, nodes of the whole level), from the stored one up.

    It stops after ``EVERY`` joins, or where one node is left in the whole tree.
    """
    out = [(first, hashes, m)]
    for _ in range(EVERY):
        if m <= 1:
            break
        start = first // FAN
        # ``first`` is a multiple of FAN: runs of FAN consecutive nodes, the last one shorter
        hashes = [H("".join(hashes[i : i + FAN])) for i in range(0, len(hashes), FAN)]
        first, m = start, -(-m // FAN)
        out.append((first, hashes, m))
    return out


def _build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The subtree's top: a node of the next stored level, or the root of the group's tree."""
    frame = frame.sort_values("idx")
    first, hashes, m = _levels(int(frame["idx"].iloc[0]), list(frame["hash"]), int(frame["m"].iloc[0]))[-1]
    return pd.DataFrame({"g": [key[0]], "idx": [first], "hash": [hashes[0]], "m": [m], "is_root": [m == 1]})


def _siblings(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """For each stored node of the subtree, its run's other nodes left and right of it, level by level."""
    frame = frame.sort_values("idx")
    levels = _levels(int(frame["idx"].iloc[0]), list(frame["hash"]), int(frame["m"].iloc[0]))
    lefts, rights = [], []
    for i in frame["idx"]:
        left, right, at = [], [], int(i)
        for first, hashes, m in levels[:EVERY]:
            if m <= 1:
                break
            run = at - at % FAN - first
            here = at - first
            left.append("".join(hashes[run:here]))
            right.append("".join(hashes[here + 1 : run + FAN]))
            at //= FAN
        lefts.append(left)
        rights.append(right)
    return pd.DataFrame({"g": key[0], "idx": frame["idx"].to_numpy(), "lefts": lefts, "rights": rights})


def _block() -> Column:
    return F.floor(F.col("idx") / SPAN).cast("bigint")


def tree(nodes: DataFrame, tops: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Paths of the bottom nodes ``(g, idx, hash, m)`` of one tree per group ``g``.

    ``tops`` takes the group roots ``(g, hash)`` and gives ``(g, lefts, rights, subroot, root)``:
    the path above each root. Returns ``(g, idx, lefts, rights, subroot, root)``: per level
    from the bottom, the concatenated hashes left and right of the node in its run.
    """
    stored, roots, level = [], [], cut(nodes.select("g", "idx", "hash", "m"))
    while True:
        stored.append(level)
        built = cut(level.groupBy("g", _block().alias("_b")).applyInPandas(lambda k, f: _build(k[:1], f), BUILT))
        roots.append(built.filter("is_root").select("g", "hash"))
        level = built.filter(~F.col("is_root")).drop("is_root")
        if level.isEmpty():
            break
    heads = cut(tops(_union(roots)))
    above: DataFrame | None = None
    for s in range(len(stored) - 1, -1, -1):
        found = roots[s].join(heads, "g").select("g", F.lit(0).cast("bigint").alias("idx"), "lefts", "rights", "subroot", "root")
        parents = found if above is None else above.unionByName(found)
        own = stored[s].groupBy("g", _block().alias("_b")).applyInPandas(lambda k, f: _siblings(k[:1], f), PATHS)
        own = own.withColumn("_b", _block())
        joined = own.join(parents.withColumnRenamed("idx", "_b").withColumnRenamed("lefts", "_l").withColumnRenamed("rights", "_r"), ["g", "_b"])
        above = cut(joined.select("g", "idx", F.concat("lefts", "_l").alias("lefts"), F.concat("rights", "_r").alias("rights"), "subroot", "root"))
    return above


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _no_path(roots: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return roots.select("g", empty.alias("lefts"), empty.alias("rights"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))


def _over_groups(roots: DataFrame) -> DataFrame:
    """The tree over the group roots, ordered by group key, as the path above each group's root."""
    ranked = positions(roots.withColumnRenamed("g", "group"), F.lit(""), F.col("group"))
    paths = tree(ranked, _no_path)
    return ranked.join(paths.drop("subroot"), ["g", "idx"]).select(
        F.col("group").alias("g"), "lefts", "rights", F.col("hash").alias("subroot"), "root"
    )


def group_key(value: Column) -> Column:
    """Orders null first, then values bytewise in UTF-8."""
    return F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), value))


def manifest(docs: DataFrame, *, id: str = ID, text: str = TEXT, by: str = "lang", fields: tuple[str, ...] = (ID, "source", "lang", "n_chars", TEXT)) -> DataFrame:
    """One row per document: ``doc_id``, ``lang``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``lefts``, ``rights``, ``tampered``, ``folded_root``, ``verified``.

    A leaf is the hash of ``fields``, each ``-`` if null, else its UTF-8 byte count, ``:`` and
    its text. Leaves of one value of ``by`` (null is a value of its own, first) ascend by id
    (null first; equal ids by leaf) and form one tree; its root is the group's ``subroot``;
    the subroots ordered by group, bytewise, form the tree of ``root``. ``lefts``/``rights``
    hold per level the siblings left and right of the node in its run; ``proof_sha256`` is
    the hash of all of them, level by level, left to right (of no siblings: of the empty text).
    ``tampered`` is the leaf with A-Z of the text lower-cased where 3 divides the unsigned
    crc32 of the decimal id (null id or text: the leaf); ``folded_root`` folds it up with the
    original siblings, and ``verified`` says whether that gives ``root``. Repeated rows are
    leaves each; an empty table gives no rows. Columns besides ``fields`` are ignored.
    """
    values = [F.col(c) for c in fields]
    changed = [F.translate(F.col(c), UPPER, LOWER) if c == text else F.col(c) for c in fields]
    hit = F.coalesce(F.crc32(F.col(id).cast("string")) % 3 == 0, F.lit(False))
    leaves = docs.select(
        F.col(id).alias("_id"), F.col(by).alias("_by"), leaf_hash(*values).alias("hash"),
        F.when(hit, leaf_hash(*changed)).otherwise(leaf_hash(*values)).alias("tampered"),
    )
    ranked = positions(leaves, group_key(F.col("_by")), F.col("_id"), F.col("hash"))
    paths = tree(ranked, _over_groups)
    zipped = F.arrays_zip("lefts", "rights")
    proof = F.sha2(F.array_join(F.transform(zipped, lambda z: F.concat(z["lefts"], z["rights"])), ""), 256)
    folded = F.aggregate(zipped, F.col("tampered"), lambda acc, z: F.sha2(F.concat(z["lefts"], acc, z["rights"]), 256))
    return (
        ranked.join(paths, ["g", "idx"])
        .select(F.col("_id").alias(ID), F.col("_by").alias("lang"), F.col("hash").alias("leaf"), "subroot", "root",
                proof.alias("proof_sha256"), "lefts", "rights", "tampered", folded.alias("folded_root"))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
