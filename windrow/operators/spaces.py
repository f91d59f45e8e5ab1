"""Reduced spaces, discriminants and geometry of subspaces: distributed sums, a small dense solve, one pass to apply."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .readout import class_statistics
from .sums import finite, matrix


def covariance_of(stats: dict, balanced: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, scatter per unit of weight and number of rows; balanced gives every class (or group) the same weight."""
    n = {c: s[0] for c, s in stats.items()}
    total = sum(n.values())
    weight = {c: (1 / (len(n) * n[c]) if balanced else 1 / total) for c in n}
    mean = sum(weight[c] * stats[c][1] for c in n)
    second = sum(weight[c] * stats[c][2] for c in n)
    return mean, second - np.outer(mean, mean), total


def feasible_rank(stats: dict, requested: int) -> int:
    """min(dimensions, rows - 1, sum of class rows less one); a request beyond it is an error."""
    sizes = [s[0] for s in stats.values()]
    limit = min(len(next(iter(stats.values()))[1]), sum(sizes) - 1, sum(n - 1 for n in sizes))
    if requested > limit:
        raise ValueError(f"rank {requested} is not feasible: at most {limit}")
    return limit


def reducer(stats: dict, rank: int, balanced: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes in columns, singular values): the first `rank` right singular vectors of the centred, weighted rows.

    It comes from the Gram sums, so any number of rows costs one pass. Of each axis the component of largest size is positive.
    """
    feasible_rank(stats, rank)
    mean, cov, total = covariance_of(stats, balanced)
    values, vectors = np.linalg.eigh(cov)
    pick = np.argsort(-values, kind="stable")[:rank]
    axes = vectors[:, pick]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(rank)])
    return mean, axes, np.sqrt(np.maximum(0, values[pick]) * total)


def captured(stats: dict, rank: int, balanced: bool = False) -> tuple[float, float]:
    """(share of the variance in the first `rank` axes, condition of them: first over last singular value)."""
    _, cov, _ = covariance_of(stats, balanced)
    _, _, s = reducer(stats, rank, balanced)
    return float((s**2).sum() / sum(n for n, _, _ in stats.values()) / np.trace(cov)), float(s[0] / s[-1]) if s[-1] > 0 else float("inf")


def spectrum(stats: dict) -> dict[int, np.ndarray]:
    """The eigenvalues of each class's covariance (n - 1), falling."""
    labels, _, covs, _ = class_statistics(stats)
    return {c: np.maximum(0, np.linalg.eigvalsh(cov)[::-1]) for c, cov in zip(labels, covs, strict=True)}


def effective_rank(values: np.ndarray) -> float:
    """exp of the entropy of the shares of the eigenvalues."""
    p = values / values.sum()
    return float(np.exp(-(p * np.log(p + 1e-30)).sum()))


def canonical_axes(sessions: dict[tuple[int, int], tuple], shrinkage: float = 0.9) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(axes, eigenvalues, class means) of the discriminant on session-balanced moments {(class, session): (n, sum, sum of squares)}.

    A class's mean is the mean of its session means; within scatter is that inside sessions plus that between
    them; it shrinks to trace / d times I, with 1e-10 of that as jitter. The largest pair gap on each axis is positive.
    """
    classes = sorted({c for c, _ in sessions})
    means, within = {}, 0.0
    for c in classes:
        own = [sessions[k] for k in sorted(sessions) if k[0] == c]
        centre = np.array([s / n for n, s, _ in own])
        means[c] = centre.mean(0)
        inner = sum(ss / n - np.outer(s / n, s / n) for n, s, ss in own) / len(own)
        within = within + inner + (centre - means[c]).T @ (centre - means[c]) / len(own)
    d = len(means[classes[0]])
    within = within / len(classes)
    within = (1 - shrinkage) * within + (shrinkage + 1e-10) * np.trace(within) / d * np.eye(d)
    m = np.array([means[c] for c in classes])
    between = (m - m.mean(0)).T @ (m - m.mean(0)) / max(1, len(classes) - 1)
    low = np.linalg.cholesky(within)
    values, vectors = np.linalg.eigh(np.linalg.solve(low, np.linalg.solve(low, between).T))
    pick = np.argsort(-values)[: len(classes) - 1]
    axes = np.linalg.solve(low.T, vectors[:, pick])
    for k in range(axes.shape[1]):
        at = m @ axes[:, k]
        gaps = {(j, i): at[j] - at[i] for i in range(len(at)) for j in range(i + 1, len(at))}
        axes[:, k] *= 1 if gaps[max(gaps, key=lambda g: abs(gaps[g]))] >= 0 else -1
    return axes, np.maximum(0, values[pick]), means


def quadratic_weights(stats: dict, alphas: list[float]) -> dict[float, list[tuple[int, np.ndarray, np.ndarray, float]]]:
    """For each alpha of a grid (label, mean, inverse, log determinant) of (1 - alpha) C_class + alpha C_mean. No loading and no pseudo-inverse: one that is not positive definite is an error."""
    labels, means, covs, pooled = class_statistics(stats)
    out = {}
    for a in alphas:
        rows = []
        for c, m, cov in zip(labels, means, covs, strict=True):
            mixed = (1 - a) * cov + a * pooled
            try:
                low = np.linalg.cholesky(mixed)
            except np.linalg.LinAlgError:
                raise ValueError(f"the covariance of class {c} at alpha {a} is not positive definite") from None
            inverse = np.linalg.inv(low)
            rows.append((c, m, inverse.T @ inverse, float(2 * np.log(np.diag(low)).sum())))
        out[a] = rows
    return out


def quadratic_grid(windows: DataFrame, key: str, label: str, vector: str, weights: dict) -> DataFrame:
    """(key, label, alpha, predicted): all alphas of a grid in one pass; ties go to the smaller class.

    Rows without a vector, or with a null or non-finite component, take no part; one of another length than the fit's is an error.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    dim = len(next(iter(weights.values()))[0][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2), dim)
            for alpha, rows in weights.items():
                s = np.array([-0.5 * (logdet + (((x - m) @ inv) * (x - m)).sum(1)) for _, m, inv, logdet in rows])
                names = np.array([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(b.num_rows, alpha)), pa.array(names[s.argmax(0)], pa.int64())], names=[key, label, "alpha", "predicted"])

    kinds = {f.name: f.dataType.simpleString() for f in windows.schema}
    return windows.where(finite(vector)).select(key, label, vector).mapInArrow(run, f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, alpha double, predicted long")


def standardised(rows: DataFrame, columns: list[str], train: Column, tolerance: float = 1e-12) -> DataFrame:
    """The columns as z-scores by mean and deviation (n) of the training rows; one whose deviation is under tolerance x (1 + |mean|) is 0."""
    sums = rows.where(train).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {c: F.when(F.col(f"_s_{c}") < tolerance * (1 + F.abs(f"_m_{c}")), 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    return rows.join(F.broadcast(sums)).select(*[z[c].alias(c) if c in z else F.col(c) for c in rows.columns])


def feature_arms(rows: DataFrame, linear: list[str], quadratic: list[str], train: Column, others: list[str]) -> DataFrame:
    """(others, f0, f1, f2, f3): z(l); z(q); [z(l), z(r)] with r = q - l; and with the products of the two, again standardised, row by row."""
    both = rows.select(*others, train.alias("_train"), *linear, *quadratic, *[(F.col(q) - F.col(v)).alias(f"_r_{v}") for v, q in zip(linear, quadratic, strict=True)])
    rest = [f"_r_{v}" for v in linear]
    z = standardised(both, [*linear, *quadratic, *rest], F.col("_train"))
    cross = [f"_x_{v}_{r}" for v in linear for r in rest]
    z = standardised(z.select("*", *[(F.col(v) * F.col(r)).alias(f"_x_{v}_{r}") for v in linear for r in rest]), cross, F.col("_train"))
    return z.select(*others, F.array(*linear).alias("f0"), F.array(*quadratic).alias("f1"), F.array(*linear, *rest).alias("f2"), F.array(*linear, *rest, *cross).alias("f3"))


# geometry of rank-one parts


def orthonormal(x: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns; dependent ones drop out."""
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, s > s[0] * max(x.shape) * np.finfo(float).eps] if len(s) and s[0] > 0 else u[:, :0]


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles in degrees between the spans of two sets of columns, rising."""
    return np.degrees(np.arccos(np.clip(np.linalg.svd(orthonormal(a).T @ orthonormal(b), compute_uv=False), -1, 1)))


def operator_gram(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the rank-one operators u_i v_i'."""
    return (u.T @ u) * (v.T @ v)


def projection_fractions(u: np.ndarray, v: np.ndarray, context_u: np.ndarray, context_v: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """Share (0 to 1) of the energy of each unit operator u_i v_i' in the span of the context's operators."""
    values, vectors = np.linalg.eigh(operator_gram(context_u, context_v))
    keep = values > tolerance**2 * max(values[-1], 0)
    base = vectors[:, keep] / np.sqrt(values[keep])
    return np.clip(((base.T @ ((context_u.T @ u) * (context_v.T @ v))) ** 2).sum(0), 0, 1)


def principal_parts(u: np.ndarray, v: np.ndarray, s: np.ndarray, context_u: np.ndarray, context_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, weights): principal directions between the spans of a candidate's and a context's operators, by falling cosine, and the candidate's coefficient on each."""

    def base(a, b):
        values, vectors = np.linalg.eigh(operator_gram(a, b))
        keep = values > 1e-16 * max(values[-1], 0)
        return vectors[:, keep] / np.sqrt(values[keep])

    mine, other = base(u, v), base(context_u, context_v)
    left, cosines, _ = np.linalg.svd(mine.T @ ((u.T @ context_u) * (v.T @ context_v)) @ other)
    coefficients = (mine @ left).T @ operator_gram(u, v) @ s
    return np.clip(cosines, 0, 1), coefficients[: len(cosines)]


def haar_basis(dimension: int, rank: int, rng: np.random.Generator) -> np.ndarray:
    """A uniformly random orthonormal basis: QR of normals, signs fixed by the diagonal of R."""
    q, r = np.linalg.qr(rng.standard_normal((dimension, rank)))
    return q * np.sign(np.diag(r))


def projection_quantile(quantile_z: float, rank: Column, dimension: Column) -> Column:
    """Normal approximation to a quantile of the energy share that a random subspace of a rank holds: k/D + z sqrt(2k(D - k) / (D^2 (D + 2))), within 0 and 1."""
    k, d = rank.cast("double"), dimension.cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), k / d + quantile_z * F.sqrt(2 * k * (d - k) / (d * d * (d + 2)))))


def rank_for_fraction(full: Column, fraction: Column) -> Column:
    """Components that a fraction keeps: ceil(fraction x rank), safe against rounding; 0 for 0."""
    return F.ceil(full * fraction - 1e-9).cast("int")


def matched_null(parts: DataFrame, module: str, draws: int, seed: int, context: int = 2) -> DataFrame:
    """(module, draw, fraction): energy of a module's components (sigma, u, v) in the span of `context` random rank-one operators of the same shape.

    Each (module, draw) is one small group with a generator of its own, seeded by both, so any order of tasks gives the same rows.
    """
    import pandas as pd

    def one(f: pd.DataFrame) -> pd.DataFrame:
        u, v, s = np.array(f["u"].tolist()).T, np.array(f["v"].tolist()).T, f["sigma"].to_numpy()
        rng = np.random.default_rng([seed, int(f["_m"].iloc[0]) & 0xFFFFFFFF, int(f["draw"].iloc[0])])
        p = projection_fractions(u, v, haar_basis(len(u), context, rng), haar_basis(len(v), context, rng))
        return pd.DataFrame({"_m": f["_m"].iloc[:1], "draw": f["draw"].iloc[:1], "fraction": [float((s * s * p).sum() / (s * s).sum())]})

    every = parts.select(F.col(module).cast("long").alias("_m"), "sigma", "u", "v").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return every.groupBy("_m", "draw").applyInPandas(one, "_m long, draw int, fraction double").withColumnRenamed("_m", module)


def sliced_wasserstein(a: DataFrame, b: DataFrame, vector: str, directions: np.ndarray) -> DataFrame:
    """(direction, distance): mean squared difference of the sorted projections of two clouds of equally many rows."""
    table = F.array(*[F.array(*map(F.lit, map(float, d))) for d in directions])

    def ranked(x: DataFrame) -> DataFrame:
        dot = F.transform(table, lambda d: F.aggregate(F.zip_with(F.col(vector), d, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v))
        long = x.select(F.posexplode(dot).alias("direction", "p"))
        return long.withColumn("r", F.row_number().over(Window.partitionBy("direction").orderBy("p")))

    met = ranked(a).join(ranked(b).withColumnRenamed("p", "q"), ["direction", "r"])
    return met.groupBy("direction").agg(F.avg((F.col("p") - F.col("q")) ** 2).alias("distance"))


def gaussian_projection(dimension: int, out: int, seed: int) -> np.ndarray:
    """A matrix of normals of variance 1 / dimension, the same for one seed."""
    return np.random.default_rng(seed).standard_normal((dimension, out)) / math.sqrt(dimension)
