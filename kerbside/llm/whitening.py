"""Embedding whitening by a bidiagonal qd solver.

Spark keeps the distinct integer vectors of the fit list, sums them exactly and reduces the
centred rows ``n*x - S`` (exact integers) to one triangular ``R`` by blockwise QR: each task
folds its rows in blocks into an ``R``, and groups of ``FAN_IN`` of them are stacked and
factored again until few are left. Only ``R`` (dimensions squared) reaches the driver.
There Householder reflections bring ``R`` to an upper bidiagonal ``B``; the dqds algorithm
finds the squared singular values of ``B`` to high relative accuracy; a twisted
factorisation of ``B^T B - lambda`` gives each direction; the reflections take it back.
Rows are then projected and scaled in JVM expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import cut

#: Components returned per row.
COMPONENTS = 4
#: Rows folded into R at once in a task.
BLOCK = 4096
#: R factors stacked and factored again in one group.
FAN_IN = 32
EPS = np.finfo(float).eps


def _fold(rows: np.ndarray, r: np.ndarray | None) -> np.ndarray:
    stacked = rows if r is None else np.vstack([r, rows])
    out = np.linalg.qr(stacked, mode="r")
    d = rows.shape[1]
    if out.shape[0] < d:  # fewer rows than dimensions so far: pad with zero rows
        out = np.vstack([out, np.zeros((d - out.shape[0], d))])
    return out


def _partition_r(n: int, sums: list[int]):
    s = np.asarray(sums, dtype=np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                x = np.stack(frame["x"].iloc[at : at + BLOCK].to_numpy()).astype(np.int64)
                r = _fold((n * x - s).astype(np.float64), r)
        if r is not None:
            yield pd.DataFrame({"key": [TaskContext.get().partitionId()], "r": [r.ravel()]})

    return run


def _stack(d: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r = _fold(np.vstack([np.asarray(v).reshape(d, d) for v in frame["r"]]), None)
        return pd.DataFrame({"key": [int(key[0])], "r": [r.ravel()]})

    return run


def triangular(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """``R`` with ``R^T R = sum over the fit list of (n*x - S)(n*x - S)^T``."""
    d = len(sums)
    rs = fit.mapInPandas(_partition_r(n, sums), "key long, r array<double>")
    while True:
        rs = cut(rs)
        if rs.count() <= FAN_IN:
            break
        rs = rs.groupBy(F.floor(F.col("key") / FAN_IN).alias("group")).applyInPandas(
            lambda k, f: _stack(d)(k, f), "key long, r array<double>"
        )
    parts = [np.asarray(row["r"]).reshape(d, d) for row in rs.collect()]
    return _fold(np.vstack(parts), None) if parts else np.zeros((d, d))


def _house(x: np.ndarray) -> tuple[np.ndarray, float]:
    v = x.astype(float).copy()
    norm = np.linalg.norm(v)
    if norm == 0.0:
        return v, 0.0
    v[0] += np.copysign(norm, v[0]) if v[0] != 0 else norm
    return v, 2.0 / float(v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, V)``: diagonal and superdiagonal of ``B = U^T R V``, and ``V``."""
    a = r.astype(float).copy()
    n = a.shape[1]
    v_acc = np.eye(n)
    for k in range(n):
        v, beta = _house(a[k:, k])
        if beta:
            a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v, beta = _house(a[k, k + 1 :])
            if beta:
                a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
                v_acc[:, k + 1 :] -= beta * np.outer(v_acc[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v_acc


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of ``L D L^T`` (``D = diag(q)``, ``l_i^2 d_i = e_i``), i.e. squared singular values, falling.

    Shifted differential qd steps; a shift that makes a pivot non-positive is halved and the
    step tried again (a zero shift always succeeds); the last entry deflates once its ``e``
    is below machine precision against the eigenvalue.
    """
    q, e = [float(v) for v in q], [float(v) for v in e]
    found, sigma, shift = [], 0.0, 0.0
    while q:
        n = len(q)
        if n == 1:
            found.append(q[0] + sigma)
            break
        if e[-1] <= EPS * (q[-1] + sigma):
            found.append(q.pop() + sigma)
            e.pop()
            shift = 0.0
            continue
        tau = shift
        for _attempt in range(60):
            qn, en, d, dmin, ok = [0.0] * n, [0.0] * (n - 1), q[0] - tau, q[0] - tau, True
            for i in range(n - 1):
                qn[i] = d + e[i]
                if qn[i] <= 0.0 or d < 0.0:
                    ok = False
                    break
                t = q[i + 1] / qn[i]
                en[i] = e[i] * t
                d = d * t - tau
                dmin = min(dmin, d)
            if ok and d >= 0.0:
                qn[n - 1] = d
                break
            tau = 0.0 if tau < 1e-300 or _attempt > 40 else tau * 0.5
        sigma += tau
        q, e = qn, en
        shift = 0.9 * max(dmin, 0.0)
    return np.sort(np.asarray(found))[::-1]


def twisted_vector(a: np.ndarray, b: np.ndarray, lam: float) -> np.ndarray:
    """Unit eigenvector of ``B^T B`` for eigenvalue ``lam`` by a twisted factorisation of ``L D L^T - lam``."""
    n = len(a)
    d, l = a * a, (b / a[:-1] if n > 1 else np.zeros(0))
    dp, lp, s = np.zeros(n), np.zeros(max(n - 1, 0)), -lam
    for i in range(n - 1):
        dp[i] = d[i] + s
        lp[i] = d[i] * l[i] / dp[i] if dp[i] != 0 else 0.0
        s = lp[i] * l[i] * s - lam
    dp[n - 1] = d[n - 1] + s
    dm, um, p = np.zeros(n), np.zeros(max(n - 1, 0)), d[n - 1] - lam
    dm[n - 1] = p
    for i in range(n - 2, -1, -1):
        dm[i + 1] = d[i] * l[i] ** 2 + p
        t = d[i] / dm[i + 1] if dm[i + 1] != 0 else 0.0
        um[i] = l[i] * t
        p = p * t - lam
    dm[0] = p
    diag = d - lam
    diag[1:] += l**2 * d[:-1]
    gamma = dp + dm - diag
    r = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -lp[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -um[i] * z[i]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``R^T R`` above numerical zero, falling, and their unit eigenvectors (columns)."""
    d = r.shape[1]
    a, b, v = bidiagonal(r)
    scale = float(np.max(np.abs(r))) if r.size else 0.0
    if scale == 0.0:
        return np.zeros(0), np.zeros((d, 0))
    if np.min(np.abs(a)) <= d * EPS * scale:
        # rank-deficient R (fewer distinct vectors than dimensions): zero pivots break the
        # qd representation, so these directions come from the library's SVD of R
        _, sv, vt = np.linalg.svd(r)
        keep = sv > d * EPS * sv[0]
        return (sv[keep] ** 2)[:k], vt[keep][:k].T
    lams = dqds(a * a, b * b)
    lams = lams[lams > (d * EPS) ** 2 * lams[0]][:k] if len(lams) else lams
    vecs = np.column_stack([v @ twisted_vector(a, b, lam) for lam in lams]) if len(lams) else np.zeros((d, 0))
    if len(lams) > 1 and np.max(np.abs(vecs.T @ vecs - np.eye(len(lams)))) > 1e-9:
        # close eigenvalues: the twisted vectors of a cluster are made orthogonal within its span
        q, _ = np.linalg.qr(vecs)
        small = q.T @ (r.T @ (r @ q))
        w, y = np.linalg.eigh(small)
        order = np.argsort(w)[::-1]
        lams, vecs = w[order], q @ y[:, order]
    return lams, vecs


def whiten(embeddings: DataFrame, *, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``, ``eigenvalue``.

    Rows whose vector is null, empty or holds a null, NaN or infinite entry are dropped; so
    are vectors whose length is not the most common one (ties: the longer). Each entry ``c``
    becomes ``x = floor(256 c)``. The fit list holds each distinct ``x`` once (``n`` of them,
    sums ``S``); the covariance ``V`` is over it with divisor ``n``. For every kept row
    (repeated rows each) and each of the first ``components`` eigenvectors of ``V`` with a
    positive eigenvalue ``e`` (falling), ``whitened`` is ``(x - S/n)`` projected on it over
    ``sqrt(e)``; ``explained`` is ``e / trace(V)``; ``deviation`` is the exact sum of
    ``(n x - S)^2``. ``identity_error`` is the largest entry of the whitened fit list's
    covariance minus the identity. No kept row, or a fit list of one vector: no rows.
    """
    spark = embeddings.sparkSession
    entry = F.col("_v").cast("array<double>")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = embeddings.select(F.col(id).alias("_id"), F.col(vector).alias("_v")).filter(F.col("_v").isNotNull() & finite & (F.size("_v") > 0))
    rows = rows.select("_id", F.transform(entry, lambda c: F.floor(c * 256)).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, eigenvalue double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d = int(sizes[0]["d"])
    rows = rows.filter(F.size("x") == d)
    fit = cut(rows.select("x").distinct())
    totals = fit.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("s")).collect()
    n = fit.count()
    sums = [0] * d
    for t in totals:
        sums[t["j"]] = int(t["s"])
    r = triangular(fit, n, sums)
    lams, vecs = directions(r, components)
    if n < 2 or not len(lams):
        return spark.createDataFrame([], schema)
    cube = float(n) ** 3
    trace = float(np.sum(r * r)) / cube
    eig = lams / cube
    coeffs = [(vecs[:, i] / np.sqrt(eig[i])).tolist() for i in range(len(eig))]
    s_lit = F.array(*[F.lit(v) for v in sums])
    centred = F.transform("x", lambda v, j: F.lit(n) * v - s_lit[j])

    def project(c: list[float]) -> F.Column:
        c_lit = F.array(*[F.lit(v) for v in c])
        return F.aggregate(F.zip_with("z", c_lit, lambda zi, ci: zi.cast("double") / F.lit(float(n)) * ci), F.lit(0.0), lambda acc, y: acc + y)

    projected = F.array(*[project(c) for c in coeffs])
    error = _identity_error(fit.select(centred.alias("z")).select(projected.alias("w")), len(coeffs), n)
    info = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(float(eig[i])).alias("eigenvalue"), F.lit(float(eig[i] / trace)).alias("explained")) for i in range(len(eig))])
    return (
        rows.select("_id", centred.alias("z"))
        .select("_id", F.aggregate("z", F.lit(0).cast("bigint"), lambda acc, y: acc + y * y).alias("deviation"), projected.alias("w"))
        .select("_id", "deviation", F.posexplode(F.arrays_zip("w", info.alias("info"))).alias("k", "p"))
        .select(
            F.col("_id").alias("vec_id"), F.col("p.info.component").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
            F.col("p.w").alias("whitened"), F.col("p.info.explained").alias("explained"), F.lit(error).alias("identity_error"),
            F.col("p.info.eigenvalue").alias("eigenvalue"),
        )
    )


def _identity_error(w: DataFrame, k: int, n: int) -> float:
    """Largest absolute entry of the covariance of ``w`` (divisor ``n``, centred first) minus the identity."""
    means = w.agg(*[F.sum(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    mu = [float(means[f"m{i}"]) / n for i in range(k)]
    prods = w.agg(*[F.sum((F.col("w")[i] - mu[i]) * (F.col("w")[j] - mu[j])).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(abs(float(prods[f"c{i}_{j}"]) / n - (1.0 if i == j else 0.0)) for i in range(k) for j in range(i, k))
