"""Merkle manifest against a tree built in plain Python from the rules."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from kerbside.llm import merkle
from kerbside.llm.common import documents

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row: dict, text_of=lambda t: t) -> str:
    parts = []
    for c in COLUMNS:
        v = row[c]
        if c == "text" and v is not None:
            v = text_of(v)
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return H("".join(parts))


def build(hashes: list[str]) -> list[list[str]]:
    levels = [hashes]
    while len(levels[-1]) > 1:
        h = levels[-1]
        levels.append([H("".join(h[i : i + 8])) for i in range(0, len(h), 8)])
    return levels


def path(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for h in levels[:-1]:
        run = i - i % 8
        out.append(("".join(h[run:i]), "".join(h[i + 1 : run + 8])))
        i //= 8
    return out


def brute(rows: list[dict]) -> dict:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    subs, inner = [], {}
    for k in keys:
        members = sorted(groups[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        levels = build([leaf(r) for r in members])
        subs.append(levels[-1][0])
        inner[k] = (members, levels)
    top = build(subs)
    out = []
    for gi, k in enumerate(keys):
        members, levels = inner[k]
        up = path(top, gi)
        for i, r in enumerate(members):
            p = path(levels, i) + up
            t = leaf(r, lambda s: s.translate(LOW)) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 else leaf(r)
            cur = t
            for left, right in p:
                cur = H(left + cur + right)
            out.append((r["doc_id"], leaf(r), levels[-1][0], top[-1][0], H("".join(a + b for a, b in p)), cur, cur == top[-1][0]))
    return out


def spark_rows(df):
    got = merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_manifest_equals_brute_force_on_documents(spark):
    df = documents(spark, "/root/testdata/sf0.01")
    rows = [r.asDict() for r in df.select(*COLUMNS).collect()]
    assert spark_rows(df) == sorted(brute(rows), key=repr)


def test_manifest_edge_cases(spark, table_of):
    big = [(i, f"Text {i} ABC", "xx", None) for i in range(1100)]
    rows = [(1, None, None, None), (None, "", "en", 3), (2, "Same", "en", 5), (2, "Same", "en", 5), (3, "é Ω ABC", "é", 1),
            (4, "x" * 50_000, "", None), (None, None, None, None), (7, "lone", "zz", 1)] + big
    df = table_of([(r[0], r[1], r[3], None, None, None, None, r[2], "src") for r in rows],
                  "doc_id bigint, text string, n_chars bigint, g string, idx bigint, hash string, m bigint, lang string, source string")
    plain = [dict(zip(("doc_id", "text", "lang", "n_chars"), r), source="src") for r in rows]
    got = spark_rows(df)
    assert got == sorted(brute(plain), key=repr)
    assert all(r[-1] == (r[5] == r[3]) for r in got)
    assert any(not r[-1] for r in got)


def test_manifest_of_nothing(spark, empty):
    assert merkle.manifest(empty.withColumn("lang", empty.text).withColumn("source", empty.text).withColumn("n_chars", empty.n)).count() == 0
