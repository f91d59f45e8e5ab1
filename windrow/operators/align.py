"""Alignment of window clouds and slow features: distributed sums, a small solve, one pass to apply."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .moments import sufficient


def affine(windows: DataFrame, vector: str, matrix: np.ndarray, shift: np.ndarray, out: str = "aligned") -> DataFrame:
    """Adds `out`: vector times matrix plus shift, Arrow batch by batch. Null vectors, or ones of another length, give null."""
    position = windows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, n, width = b.column(position), b.num_rows, len(matrix)
            flat, starts = column.flatten(), np.cumsum(np.r_[0, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)])
            holes = np.cumsum(np.r_[0, flat.is_null().to_numpy(zero_copy_only=False)])
            good = (np.diff(starts) == width) & (holes[starts[1:]] == holes[starts[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(good)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
            made = values[(starts[rows][:, None] + np.arange(width))] @ matrix + shift
            ends = np.cumsum(np.where(good, len(shift), 0)).astype(np.int32)
            # an offset that is null makes its list null
            offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[~good, False])
            lists = pa.ListArray.from_arrays(offsets, pa.array(made.ravel())) if n else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, out])

    return windows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema) + f", `{out}` array<double>")


def moments_of(windows: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (n - 1) of all windows with a vector."""
    n, s, ss = sufficient(windows.where(F.col(vector).isNotNull()).withColumn("_one", F.lit(0)), vector, "_one")[0]
    return s / n, (ss - np.outer(s, s) / n) / max(1, n - 1)


def _power(c: np.ndarray, exponent: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(c)
    return (vectors * np.maximum(values, 1e-12) ** exponent) @ vectors.T


def coral(source: DataFrame, target: DataFrame, vector: str, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, shift) that gives source the mean and covariance of target; both covariances carry ridge times their mean variance."""
    (m, c), (n, t) = moments_of(source, vector), moments_of(target, vector)
    d = len(m)
    loaded = [x + ridge * np.trace(x) / d * np.eye(d) for x in (c, t)]
    a = _power(loaded[0], -0.5) @ _power(loaded[1], 0.5)
    return a, n - m @ a


def procrustes(pairs: DataFrame, x: str, y: str, scaled: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, shift): the rotation, without reflection, with one scale if `scaled`, that best takes x to y over paired rows."""
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.concat(F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).alias("_xy"))
    mean, cov = moments_of(both, "_xy")
    d = len(mean) // 2
    u, s, vt = np.linalg.svd(cov[:d, d:])
    sign = np.r_[np.ones(d - 1), 1.0 if np.linalg.det(u @ vt) > 0 else -1.0]
    matrix = (u * sign) @ vt * (float(s @ sign) / max(np.trace(cov[:d, :d]), 1e-300) if scaled else 1.0)
    return matrix, mean[d:] - mean[:d] @ matrix


def centred_by(windows: DataFrame, vector: str, group: str, out: str = "aligned") -> DataFrame:
    """Adds `out`: the vector less its group's mean. The means (groups x dimensions) join on the group."""
    long = windows.select(group, F.posexplode(vector).alias("dim", "v")).groupBy(group, "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    means = long.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("_m"))
    return windows.join(means, group, "left").withColumn(out, F.zip_with(vector, "_m", lambda a, b: a.cast("double") - b)).drop("_m")


def relative_displacement(rows: DataFrame, before: str, after: str, *keys: str) -> DataFrame:
    """(keys, displacement): mean of |after - before| / |before|; a zero vector before gives no share."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    step, size = norm(F.zip_with(after, before, lambda a, b: a.cast("double") - b.cast("double"))), norm(F.transform(before, lambda v: v.cast("double")))
    return rows.groupBy(*keys).agg(F.avg(F.when(size > 0, step / size)).alias("displacement"))


def slow_features(windows: DataFrame, segment: str, order: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """(gammas rising, weights): solves C_delta w = gamma C_x w on the support of C_x; steps stay within a segment."""
    w = Window.partitionBy(segment).orderBy(order)
    steps = windows.select(F.zip_with(vector, F.lag(vector).over(w), lambda a, b: a.cast("double") - b.cast("double")).alias("_d")).where("_d is not null")
    _, c = moments_of(windows, vector)
    n, _, ss = sufficient(steps.withColumn("_one", F.lit(0)), "_d", "_one")[0]
    values, vectors = np.linalg.eigh(c)
    keep = values > len(values) * np.finfo(float).eps * values[-1] * 100
    white = vectors[:, keep] / np.sqrt(values[keep])
    gammas, axes = np.linalg.eigh(white.T @ (ss / n) @ white)
    weights = white @ axes
    pivot = np.abs(weights).argmax(0)
    return gammas, weights * np.sign(weights[pivot, np.arange(weights.shape[1])])
