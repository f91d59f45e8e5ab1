"""Truncated reducers of very long vectors: a random sketch, power iterations and a distributed QR.

No matrix of dimensions x dimensions is formed anywhere. Each power iteration is one pass: a task
multiplies its rows with the sketch and back, and the tasks' dimensions x width products are added
up. At the end the rows are projected once more, and the QR of the projections gives the singular
values without squaring them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sums import finite, matrix, summed, triangular

#: Doubles of a sketch, which the driver and each task hold.
MOST_CELLS = 1 << 24


def weighted_mean(rows: DataFrame, dim: int) -> tuple[np.ndarray, float]:
    """Mean of x by weight w, and the sum of weights, of rows (w, x)."""

    def part(b: pa.RecordBatch) -> np.ndarray:
        w = b.column(0).to_numpy()
        return np.r_[w @ matrix(b.column(1), dim), w.sum()]

    total = summed(rows, part, dim + 1)
    return total[:dim] / total[dim], float(total[dim])


def group_weights(rows: DataFrame, group: str) -> DataFrame:
    """rows with `weight`, by which every group weighs the same and all weigh 1; rows without a group have none.

    The groups' sizes are joined by a shuffle join that Spark turns into a broadcast where they are few.
    """
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"))
    groups = sizes.count()
    return rows.join(sizes, group).withColumn("weight", 1.0 / (F.col("_n") * max(groups, 1))).drop("_n")


def range_finder(rows: DataFrame, vector: str, rank: int, weight: str | Column | None = None, oversample: int = 8, power: int = 12, tolerance: float = 1e-13, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, axes in columns, singular values, total energy) of the centred rows, each scaled by the root of its weight.

    The singular values belong to the first `rank` axes; total energy is the sum of all squared ones. Power
    iterations go on until the `rank` Ritz values settle within `tolerance`, at most `power` times; a sketch as wide as
    the vectors holds all of their space and needs none. Of each axis the
    component of largest size is positive. Rows with a null or non-finite component or a weight that is null or not positive take no part.
    A rank beyond min(dimensions, rows - 1) is an error, and so are vectors of unlike length and a sketch of more than MOST_CELLS.
    """
    w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    good = rows.where(finite(vector)).select(w.cast("double").alias("w"), F.col(vector).alias("x")).where("w > 0")
    head = good.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).first()
    if head["lo"] != head["hi"]:
        raise ValueError("vectors differ in length")
    n, dim = head["n"], head["hi"] or 0
    if rank > min(dim, n - 1):
        raise ValueError(f"rank {rank} is not feasible: at most {min(dim, max(n - 1, 0))}")
    width = min(rank + oversample, dim, n)
    if dim * width > MOST_CELLS:
        raise ValueError(f"a sketch of {dim} x {width} is too large")
    mean, total = weighted_mean(good, dim)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))

    def back_and_forth(b: pa.RecordBatch) -> np.ndarray:
        own, x = b.column(0).to_numpy(), matrix(b.column(1), dim)
        seen = (x @ basis - mean @ basis) * own[:, None]
        return x.T @ seen - np.outer(mean, seen.sum(0))

    before = np.zeros(rank)
    for _ in range(power if width < dim else 0):
        product = summed(good, back_and_forth, dim * width).reshape(dim, width)
        ritz = np.sort(np.linalg.eigvalsh(basis.T @ product))[::-1][:rank]
        basis, _ = np.linalg.qr(product)
        if np.abs(ritz - before).max() <= tolerance * max(ritz[0], 1e-300):
            break
        before = ritz

    def project(b: pa.RecordBatch) -> np.ndarray:
        return (matrix(b.column(1), dim) @ basis - mean @ basis) * np.sqrt(b.column(0).to_numpy())[:, None]

    _, values, right = np.linalg.svd(triangular(good, project, width))
    axes = basis @ right.T[:, :rank]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(rank)])

    def energy(b: pa.RecordBatch) -> np.ndarray:
        off = matrix(b.column(1), dim) - mean
        return np.array([b.column(0).to_numpy() @ (off * off).sum(1)])

    return mean, axes, values[:rank], float(summed(good, energy, 1)[0])
