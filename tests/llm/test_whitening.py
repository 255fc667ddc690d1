"""Whitening against numpy's eigen-decomposition of the same covariance, and the solver's parts."""

from __future__ import annotations

import math

import numpy as np
import pytest

from kerbside.llm import whitening
from kerbside.llm.common import table


def brute(rows):
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    xs = {i: tuple(math.floor(256 * float(c)) for c in v) for i, v in kept}
    fit = np.array(sorted(set(xs.values())), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    cov = ((fit - s / n).T @ (fit - s / n)) / n
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1][:4]
    return xs, n, s, w[order], v[:, order], np.trace(cov)


def check(got, rows):
    xs, n, s, e, v, trace = brute(rows)
    assert {r["vec_id"] for r in got} == set(xs)
    for r in got:
        x = np.array(xs[r["vec_id"]])
        k = r["component"] - 1
        assert r["n"] == n
        assert r["deviation"] == int(((n * x - s) ** 2).sum())
        assert abs(r["explained"] - e[k] / trace) <= 1e-4 * e[k] / trace
        want = float((x - s / n) @ v[:, k] / math.sqrt(e[k]))
        assert min(abs(r["whitened"] - want), abs(r["whitened"] + want)) <= 1e-6 * max(1.0, abs(want))
        assert r["identity_error"] <= 1e-4


def test_whitening_equals_numpy_on_embeddings(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    got = whitening.whiten(df).collect()
    check(got, [(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert sorted({r["component"] for r in got}) == [1, 2, 3, 4]


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5),
             (1004, rows[0][1]), (1005, [0.1, 0.2]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("x", whitening.F.lit(1)).withColumn("z", whitening.F.lit("c"))
    got = whitening.whiten(df).collect()
    clean = [r for r in rows if r[1] is None or len(r[1]) == 6]
    check(got, clean)


def test_whitening_of_few_and_none(spark):
    one = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(one).count() == 0
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(none).count() == 0
    two = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [1.0, 2.0, 3.0])], "vec_id bigint, embedding array<float>")
    got = whitening.whiten(two).collect()
    assert [r["component"] for r in got] == [1, 1] and all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in got)


def test_qd_solver_matches_library():
    rng = np.random.default_rng(7)
    for d in (1, 2, 5, 17, 64):
        r = np.linalg.qr(rng.normal(size=(3 * d + 2, d)) * np.logspace(0, -3, d))[1]
        a, b, v = whitening.bidiagonal(r)
        bmat = np.diag(a) + np.diag(b, 1)
        assert np.allclose(np.abs(np.linalg.svd(bmat, compute_uv=False)), np.linalg.svd(r, compute_uv=False))
        lams = whitening.dqds(a * a, b * b)
        want = np.linalg.svd(r, compute_uv=False) ** 2
        assert np.allclose(lams, want, rtol=1e-12, atol=0)
        e, vecs = whitening.directions(r, d)
        ref_w, ref_v = np.linalg.eigh(r.T @ r)
        for k in range(d):
            j = np.argsort(ref_w)[::-1][k]
            assert abs(abs(vecs[:, k] @ ref_v[:, j]) - 1) < 1e-8
