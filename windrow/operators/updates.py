"""Update matrices: singular components, energy, interference between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def components(matrices: DataFrame, key: str, rows: int, cols: int, data: str) -> DataFrame:
    """(key, k from 1, sigma, u, v): the singular components of each row-major matrix. A matrix of another size or with nulls has none."""
    kind = matrices.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, x in zip(f["_key"], f["_data"], strict=True):
                if x is None or len(x) != rows * cols or not np.isfinite(np.asarray(x, float)).all():
                    continue
                u, s, vt = np.linalg.svd(np.asarray(x, float).reshape(rows, cols), full_matrices=False)
                out += [(name, k + 1, float(s[k]), u[:, k].tolist(), vt[k].tolist()) for k in range(len(s))]
            yield pd.DataFrame(out, columns=[key, "k", "sigma", "u", "v"])

    return matrices.select(F.col(key).alias("_key"), F.col(data).alias("_data")).mapInPandas(run, f"`{key}` {kind}, k int, sigma double, u array<double>, v array<double>")


def energy_curve(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, k, energy): share of the squared singular values up to k."""
    w = Window.partitionBy(*keys)
    e = F.col("sigma") * F.col("sigma")
    return parts.select(*keys, "k", (F.sum(e).over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) / F.sum(e).over(w)).alias("energy"))


def relative_energy(deltas: DataFrame, bases: DataFrame, module: str, data: str, *keys: str) -> DataFrame:
    """(module, keys, energy): sum of squares of a delta over that of its module's base; a zero base gives null."""
    square = F.aggregate(F.transform(data, lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    base = bases.groupBy(module).agg(F.sum(square).alias("_base"))
    return deltas.groupBy(module, *keys).agg(F.sum(square).alias("_delta")).join(base, module).select(module, *keys, F.when(F.col("_base") > 0, F.col("_delta") / F.col("_base")).alias("energy"))


def interference(parts: DataFrame, module: str, task: str, share: float) -> DataFrame:
    """(module, n_tasks, k, interference): sum of |(U'U - I) diag(s) (V'V - I)| over the first floor(rank x share) components, 1 at least, of each task.

    A group holds one module's components, whose count is tasks x rank: bounded by
    the models compared, not by the data. Tasks of unequal rank are an error.
    """

    def one(f: pd.DataFrame) -> pd.DataFrame:
        ranks = f.groupby("_task")["k"].max()
        if ranks.nunique() > 1:
            raise ValueError("tasks of one module differ in rank")
        k = max(1, int(ranks.iloc[0] * share + 1e-9))
        f = f[f["k"] <= k].sort_values(["_task", "k"])
        u, v, s = np.array(f["u"].tolist()).T, np.array(f["v"].tolist()).T, f["sigma"].to_numpy()
        eye = np.eye(len(s))
        return pd.DataFrame({"_module": [f["_module"].iloc[0]], "n_tasks": [len(ranks)], "k": [k], "interference": [float(np.abs((u.T @ u - eye) * s @ (v.T @ v - eye)).sum())]})

    kind = parts.schema[module].dataType.simpleString()
    out = parts.select(F.col(module).alias("_module"), F.col(task).alias("_task"), "k", "sigma", "u", "v").groupBy("_module").applyInPandas(one, f"_module {kind}, n_tasks int, k int, interference double")
    return out.withColumnRenamed("_module", module)


def moved(rows: DataFrame, vector: str, base: str) -> DataFrame:
    """Adds moved: |vector - base| / |base|; null where the base is zero."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    size = norm(F.transform(base, lambda v: v.cast("double")))
    return rows.withColumn("moved", norm(F.zip_with(vector, base, lambda a, b: a.cast("double") - b.cast("double"))) / F.nullif(size, F.lit(0.0)))
