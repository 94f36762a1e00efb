"""Second moments of many columns as one matrix of sums, taken in a single pass.

Every row becomes a short vector and the sum of its outer products is built up
inside the partitions and combined as a tree, so k columns cost one scan and a
matrix of k x k sums, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

FLAT = 1e-12  # a spread below this share of its square sum is rounding


def outer_sums(df: DataFrame, values: Sequence[Column]) -> np.ndarray:
    """Sum over the rows of the outer product of ``values``; an empty table gives zeros."""
    vectors = df.select(array_to_vector(F.array(*values)).alias("v"))
    if vectors.isEmpty():
        return np.zeros((len(values), len(values)))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), 0, len(values)).computeGramianMatrix()
    return gram.toArray()


def centres(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation per column, 0 and 1 where there is none."""
    row = df.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(columns)]).first()
    finite = lambda v, other: other if v is None or not np.isfinite(v) else float(v)
    spread = [finite(row[f"s{k}"], 1.0) or 1.0 for k in range(len(columns))]
    return np.array([finite(row[f"m{k}"], 0.0) for k in range(len(columns))]), np.array(spread)


def pairwise_correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlations, each pair over the rows where both columns have a value; NaN where one of them does not vary.

    A row gives (mask, masked value, masked square) of every column, so the
    matrix of sums holds what each pair needs: rows in common, and sums, squares
    and products over just those rows. Values are centred and scaled first,
    which changes no correlation and keeps the sums accurate.
    """
    names = [f"c{k}" for k in range(len(columns))]
    numeric = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)])
    mean, spread = centres(numeric, names)
    z = [F.coalesce((F.col(n) - float(m)) / float(s), F.lit(0.0)) for n, m, s in zip(names, mean, spread)]
    mask = [F.col(n).isNotNull().cast("double") for n in names]
    sums = outer_sums(numeric, [*mask, *z, *[v * v for v in z]])
    k = len(names)
    n, s, q, p = sums[:k, :k], sums[k : 2 * k, :k], sums[2 * k :, :k], sums[k : 2 * k, k : 2 * k]
    with np.errstate(all="ignore"):
        own = n * q - s * s  # spread of the row's column over the rows shared with the other
        flat = own <= FLAT * np.maximum(n * q, 1e-300)
        out = (n * p - s * s.T) / np.sqrt(own * own.T)
    out[flat | flat.T | (n < 1)] = np.nan
    return out


def lasso_from_sums(gram: np.ndarray, target: np.ndarray, penalty: float, weights: np.ndarray, rounds: int = 1000, tolerance: float = 1e-9) -> np.ndarray:
    """Weights w that minimise w'Gw / 2 - t'w + penalty * |w| by coordinate descent from ``weights``."""
    w = weights.copy()
    for _ in range(rounds):
        largest = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            rest = target[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - penalty, 0.0) / gram[j, j]
            largest = max(largest, abs(new - w[j]))
            w[j] = new
        if largest < tolerance:
            break
    return w


def lasso_path(sums: Sequence[np.ndarray], steps: int, ratio: float) -> tuple[np.ndarray, float, list[float]]:
    """Cross-validated lasso from the outer sums of (1, features, label) of every fold; no further look at the rows.

    Each fold is held out once; features are scaled to unit spread over the
    rows that are fitted. Returns the weights over all rows at the penalty of
    the least mean held-out error, that penalty, and the mean error (rmse) per
    penalty, from the smallest one that leaves no feature down to ``ratio`` of it.
    """
    whole = np.sum(sums, axis=0)

    def prepared(s: np.ndarray):
        n = max(s[0, 0], 1.0)
        mean = s[0, 1:] / n
        cov = s[1:, 1:] / n - np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
        spread[spread <= 1e-9 * np.sqrt(np.maximum(np.diag(s)[1:-1] / n, 1e-300))] = 0.0
        scale = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
        return cov[:-1, :-1] * np.outer(scale, scale), cov[:-1, -1] * scale, scale, mean

    gram, target, scale, _ = prepared(whole)
    largest = float(np.abs(target).max(initial=0.0)) or 1.0
    penalties = [largest * ratio ** (k / max(1, steps - 1)) for k in range(steps)]
    errors = np.zeros(steps)
    used = [s for s in sums if s[0, 0] > 0 and whole[0, 0] > s[0, 0]]
    for held in used:
        g, t, own, mean = prepared(whole - held)
        w = np.zeros(len(t))
        for k, penalty in enumerate(penalties):
            w = lasso_from_sums(g, t, penalty, w)
            beta = w * own
            line = np.concatenate(([beta @ mean[:-1] - mean[-1]], -beta, [1.0]))  # label minus prediction
            errors[k] += np.sqrt(max(line @ held @ line, 0.0) / held[0, 0]) / len(used)
    best = int(errors.argmin()) if used else steps - 1
    w = np.zeros(len(target))
    for penalty in penalties[: best + 1]:
        w = lasso_from_sums(gram, target, penalty, w)
    return w * scale, penalties[best], errors.tolist()
