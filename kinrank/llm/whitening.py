"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

X holds the distinct vectors of the table, as whole numbers, centred.  Step j
of the bidiagonalisation (Golub, Kahan 1965) is

    alpha_j u_j = X v_j - beta_{j-1} u_{j-1},    beta_j v_{j+1} = X' u_j - alpha_j v_j

with u_j (as long as the table) and v_j reorthogonalised against all before.
The left vectors never leave the tasks and are not stored: each is u_j = X p_j
for a short vector p_j, which the tasks get with the pass.  One distributed
pass a step gives w = X (v_j - beta_{j-1} p_{j-1}) as the sums w'w, U'w and
X'w; with c = U'w the reorthogonalised vector is (w - Uc) / alpha_j, its norm
follows from w'w - c'c, and X'u_j from X'w and the earlier X'u_k.  The small
bidiagonal matrix goes through an SVD on the driver: its right vectors, turned
by V, are the components, its values squared over n the variances.

A vanishing beta (or alpha) ends an invariant subspace; the next step starts
from a fresh direction orthogonal to all before, so that repeated variances
are found.  All dimensions are gone through, so the components are those of
the full decomposition.  What reaches the driver per pass is a few sums per
dimension, added up by Spark before.

Defined results: a vector that is null, or holds a null or non-finite entry,
is left out; so is one of another length than the most common one (of equally
common ones the longest).  Equal vectors enter the fit once and each gets its
rows; a null vec_id is kept.  Directions without variance (at most 1e-12 of the
largest) are no components: a table of equal vectors, like an empty one, gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinrank.plans.context import materialize

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
NO_VARIANCE = 1e-12
START_SEED = 13


class Whitening(NamedTuple):
    """A fit: counts, sums of each dimension, components (one a row), variances."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float


def whole(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The usable rows with ``x``, their entries as whole numbers."""
    entry = F.col(column)
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(entry, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + SHIFT)
    usable = vectors.filter(entry.isNotNull() & ~bad).withColumn("x", scaled)
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max(F.struct("n", "d")).alias("most")).select("most.d").scalar()
    return usable.filter(F.size("x") == most)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n  # n x - S is exact, one rounding


def _added(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part(x)`` over the batches of the table, added up by Spark."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(_matrix(batch))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.float64())], ["at", "value"])

    sums = fit.select("x").mapInArrow(task, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value"))
    return np.array([row.value for row in sorted(sums.collect())])


def _fresh(rng: np.random.Generator, basis: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to the rows of ``basis``."""
    v = rng.standard_normal(basis.shape[1])
    for _ in range(3):
        v -= basis.T @ (basis @ v)
        v /= np.linalg.norm(v)
    return v


def bidiagonalise(fit: DataFrame, n: int, sums: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): right vectors as rows and the upper bidiagonal matrix."""
    d = len(sums)
    rng = np.random.default_rng(START_SEED)
    right, left, images = np.empty((0, d)), np.empty((0, d)), np.empty((0, d))  # v_j, p_j, X'u_j
    small = NO_VARIANCE * norm
    diagonal, above = [], []
    v, beta = _fresh(rng, right), 0.0
    for j in range(d):
        right = np.vstack([right, v])
        q = v - beta * left[-1] if beta else v

        def products(x: np.ndarray, q=q, left=left) -> np.ndarray:
            y = _centred(x, n, sums)
            w = y @ q
            return np.concatenate([[w @ w], (y @ left.T).T @ w, w @ y])

        got = _added(fit, products)
        c, image = got[1:j + 1], got[j + 1:]
        alpha = float(np.sqrt(max(got[0] - c @ c, 0.0)))
        if alpha <= small:  # no left vector: X v_j lies in the span of those before
            left, images, alpha = np.vstack([left, np.zeros(d)]), np.vstack([images, np.zeros(d)]), 0.0
        else:
            left = np.vstack([left, (q - c @ left) / alpha])
            images = np.vstack([images, (image - c @ images) / alpha])
        diagonal.append(alpha)
        if j + 1 == d:
            break
        v = images[-1] - alpha * right[-1]
        for _ in range(2):
            v -= right.T @ (right @ v)
        beta = float(np.linalg.norm(v))
        if beta <= small:
            v, beta = _fresh(rng, right), 0.0
        else:
            v /= beta
        above.append(beta)
    return right, np.diag(diagonal) + np.diag(above, 1)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct ``x`` in ``rows``; None without rows."""
    distinct = materialize(rows.select("x").distinct())
    n = distinct.count()
    if not n:
        return None
    sums_of = distinct.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("s"))
    sums = np.array([row.s for row in sorted(sums_of.collect())], np.int64)
    if not len(sums):
        return None
    squares = _added(distinct, lambda x: np.array([np.sum(_centred(x, n, sums) ** 2)]))[0]
    right, small = bidiagonalise(distinct, n, sums, float(np.sqrt(squares)))
    _, deviations, turned = np.linalg.svd(small)
    kept = [i for i in range(min(components, len(deviations))) if deviations[i] ** 2 > NO_VARIANCE * deviations[0] ** 2]
    axes = turned[kept] @ right
    variances = deviations[kept] ** 2 / n
    error = 0.0
    if kept:
        k = len(kept)

        def moments(x: np.ndarray) -> np.ndarray:
            w = _centred(x, n, sums) @ axes.T / np.sqrt(variances)
            return np.concatenate([w.sum(0), (w.T @ w).ravel()])

        got = _added(distinct, moments)
        mean, second = got[:k] / n, got[k:].reshape(k, k) / n
        error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    return Whitening(n, sums, axes, variances, float(squares / n), error)


def transform(rows: DataFrame, model: Whitening | None, key: str = "vec_id") -> DataFrame:
    """One row per row of ``rows`` and component: ``whitened`` coordinates,
    the row's exact ``deviation``, and what the component explains."""
    key_type = rows.schema[key].dataType.simpleString()
    schema = (f"{key} {key_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    if model is None or not len(model.variances):
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, axes, variances, trace, error = model
    k = len(variances)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            exact = n * x - sums
            if (exact.astype(float) ** 2).sum(1).max() < 2.0**62:
                deviation = pa.array((exact * exact).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array([Decimal(sum(c * c for c in row)) for row in exact.tolist()], pa.decimal128(38, 0))
            values = (exact / n) @ axes.T / np.sqrt(variances)
            who = np.repeat(np.arange(len(x)), k)
            total = len(who)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(who)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(total, n, np.int64)), deviation.take(pa.array(who)), pa.array(values.ravel()),
                 pa.array(np.tile(variances / trace, len(x))), pa.array(np.full(total, error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, "x").mapInArrow(task, schema)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``transform`` of all usable rows by their own ``fit``.  Runs jobs when called."""
    rows = whole(vectors)
    return transform(rows, fit(rows, components))
