"""Discriminants and readouts: distributed sums, then a small dense solve."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import sufficient
from .sums import finite, matrix


def class_statistics(stats: dict) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Labels, means, covariances (n - 1) and their plain mean, from sums."""
    labels = sorted(stats)
    means = np.array([stats[c][1] / stats[c][0] for c in labels])
    covs = np.array([(stats[c][2] - np.outer(stats[c][1], stats[c][1]) / stats[c][0]) / max(1, stats[c][0] - 1) for c in labels])
    return labels, means, covs, covs.mean(0)


def fisher_axes(stats: dict, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Axes (unit length, by falling eigenvalue) and eigenvalues of the size-weighted Fisher discriminant."""
    labels, means, _, _ = class_statistics(stats)
    n = np.array([stats[c][0] for c in labels], float)
    grand = n @ means / n.sum()
    d = means.shape[1]
    within = sum(stats[c][2] - stats[c][0] * np.outer(m, m) for c, m in zip(labels, means, strict=True)) / max(1, n.sum() - len(labels))
    within = within + ridge * np.trace(within) / d * np.eye(d)
    between = sum(k * np.outer(m - grand, m - grand) for k, m in zip(n, means, strict=True)) / max(1, len(labels) - 1)
    low = np.linalg.cholesky(within)
    half = np.linalg.solve(low, between)
    values, vectors = np.linalg.eigh(np.linalg.solve(low, half.T))
    pick = np.argsort(-values)[: len(labels) - 1]
    axes = np.linalg.solve(low.T, vectors[:, pick])
    return axes / np.linalg.norm(axes, axis=0), np.maximum(0, values[pick])


def fisher_values(n: np.ndarray, means: np.ndarray, second: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """The eigenvalues of fisher_axes from class sizes, class means and the sum of x x' over all rows, which no labelling changes."""
    n = n.astype(float)
    grand = n @ means / n.sum()
    inner = (means * n[:, None]).T @ means
    within = (second - inner) / max(1, n.sum() - len(n))
    within = within + ridge * np.trace(within) / len(within) * np.eye(len(within))
    between = (inner - n.sum() * np.outer(grand, grand)) / max(1, len(n) - 1)
    low = np.linalg.cholesky(within)
    values = np.linalg.eigvalsh(np.linalg.solve(low, np.linalg.solve(low, between).T))[::-1]
    return np.maximum(0, values[: len(n) - 1])


def linear_scores(windows: DataFrame, key: str, label: str, vector: str, loading: float = 1e-3) -> DataFrame:
    """(key, label, predicted): argmax over classes of x b_c - m_c b_c / 2 with b_c = C^-1 m_c, C the mean covariance plus a loading."""
    labels, means, _, pooled = class_statistics(sufficient(windows, vector, label))
    d = pooled.shape[0]
    beta = np.linalg.solve(pooled + loading * np.trace(pooled) / d * np.eye(d), means.T).T
    shift = -0.5 * (means * beta).sum(1)
    scores = [F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(v)) for v in b]), lambda a, w: a.cast("double") * w), F.lit(float(s)), lambda t, v: t + v) for b, s in zip(beta, shift, strict=True)]
    best = F.array(*scores)
    return windows.withColumn("_s", best).select(key, label, F.element_at(F.array(*[F.lit(c) for c in labels]), F.array_position("_s", F.array_max("_s")).cast("int")).alias("predicted"))


def ridge_readout(windows: DataFrame, key: str, label: str, vector: str, lam: float = 1e-2) -> DataFrame:
    """(key, label, predicted): class-balanced ridge on one-hot targets with an unpenalised intercept; ties to the smaller class."""
    stats = sufficient(windows, vector, label)
    labels = sorted(stats)
    total, k = sum(stats[c][0] for c in labels), len(labels)
    d = len(stats[labels[0]][1])
    g, r = np.zeros((d + 1, d + 1)), np.zeros((d + 1, k))
    for j, c in enumerate(labels):
        n, s, ss = stats[c]
        w = total / (k * n)
        g += w * np.block([[ss, s[:, None]], [s[None], np.array([[float(n)]])]])
        r[:, j] = w * np.r_[s, n]
    weights = np.linalg.solve(g + lam * np.diag(np.r_[np.ones(d), 0.0]), r)
    scores = [F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(v)) for v in weights[:d, j]]), lambda a, w: a.cast("double") * w), F.lit(float(weights[d, j])), lambda t, v: t + v) for j in range(k)]
    return windows.withColumn("_s", F.array(*scores)).select(key, label, F.element_at(F.array(*[F.lit(c) for c in labels]), F.array_position("_s", F.array_max("_s")).cast("int")).alias("predicted"))


def quadratic_scores(windows: DataFrame, key: str, label: str, vector: str, alpha: float, loading: float = 1e-3) -> DataFrame:
    """(key, label, predicted): argmax of -(log det C + (x - m)' C^-1 (x - m)) / 2, C = (1 - alpha) C_class + alpha C_mean plus a loading.

    alpha 1 gives the linear rule. A covariance that is not positive definite is an
    error; no pseudo-inverse is taken. Ties go to the smaller class. Rows without a vector, or with a null or non-finite
    component, take no part; one of another length is an error.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    labels, means, covs, pooled = class_statistics(sufficient(windows, vector, label))
    d = pooled.shape[0]
    load = loading * np.trace(pooled) / d * np.eye(d)
    lows = [np.linalg.cholesky((1 - alpha) * c + alpha * pooled + load) for c in covs]
    whiten = [np.linalg.inv(low) for low in lows]
    logdet = [2 * np.log(np.diag(low)).sum() for low in lows]
    names = np.array(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2), d)
            s = np.array([-0.5 * (g + (((x - m) @ w.T) ** 2).sum(1)) for m, w, g in zip(means, whiten, logdet, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[s.argmax(0)], pa.int64())], names=[key, label, "predicted"])

    kinds = {f.name: f.dataType.simpleString() for f in windows.schema}
    return windows.where(finite(vector)).select(key, label, vector).mapInArrow(run, f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, predicted long")


def covariance_diagnostics(stats: dict) -> list[tuple[int, int, int, float, float]]:
    """(label, n, numerical rank, condition, log determinant) of each class's covariance; the last two are infinite where it is singular."""
    labels, _, covs, _ = class_statistics(stats)
    out = []
    for c, cov in zip(labels, covs, strict=True):
        values = np.linalg.eigvalsh(cov)
        rank = int((values > len(values) * np.finfo(float).eps * max(values[-1], 0)).sum())
        full = rank == len(values)
        out.append((c, stats[c][0], rank, float(values[-1] / values[0]) if full else float("inf"), float(np.log(values).sum()) if full else float("-inf")))
    return out
