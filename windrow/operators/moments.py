"""Moments, centroids and covariances as sums over long-form components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def centroids(long: DataFrame, *keys: str) -> DataFrame:
    """Mean, standard deviation (n - 1) and count of each component of each class."""
    return long.groupBy(*keys, "dim").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("*").alias("n"))


def covariance(windows: DataFrame, vector: str, dims: int, *keys: str) -> DataFrame:
    """Covariance (n - 1) of the first `dims` components of each class, upper triangle in long form: one aggregate, no self join."""
    x = [F.col(vector)[i].cast("double") for i in range(dims)]
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    wide = windows.groupBy(*keys).agg(*[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("cov")) for i, j in pairs])
    return wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.i", "c.j", "c.cov")


def whole_covariance(windows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Covariance (n - 1) of all components of each class, upper triangle in long form: each row pairs its own components."""
    first = windows.select(*keys, vector, F.posexplode(vector).alias("i", "_x"))
    both = first.select(*keys, "i", "_x", F.posexplode(F.slice(F.col(vector), F.col("i") + 1, F.size(vector))).alias("_k", "_y"))
    return both.groupBy(*keys, "i", (F.col("i") + F.col("_k")).alias("j")).agg(F.covar_samp(F.col("_x").cast("double"), F.col("_y").cast("double")).alias("cov"))


def squared_distances(windows: DataFrame, centres: DataFrame, vector: str, key: str) -> DataFrame:
    """d2 of each window to each of a bounded list of centres (label, centre array): at most MOST, more are an error, so they are broadcast."""
    if centres.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} centres")
    d2 = F.aggregate(F.zip_with(F.col(vector), F.col("centre"), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    return windows.join(F.broadcast(centres)).select(*windows.columns, F.col(key).alias("centre_label"), d2.alias("d2"))


def centre_arrays(windows: DataFrame, label: str, vector: str) -> DataFrame:
    """(centre_of, centre): class means as arrays in component order."""
    long = windows.select(label, F.posexplode(vector).alias("dim", "v")).groupBy(label, "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return long.groupBy(F.col(label).alias("centre_of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centre"))


def nearest_centroid(windows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(key, label, predicted, margin): the class of the nearest mean, ties to the smaller label; margin is the best other d2 less that of the own class.

    The centres of at most MOST classes (more are an error) go along as one array: each row is scored in place, without a shuffle.
    """
    centres = centre_arrays(windows, label, vector).where(F.col("centre_of").isNotNull())
    count = F.count("*")
    checked = centres.agg(F.when(count > MOST, F.raise_error(F.lit(f"more than {MOST} classes"))).otherwise(F.collect_list(F.struct("centre_of", "centre"))).alias("_all"))
    d2 = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    scored = windows.select(key, label, vector).where(F.col(vector).isNotNull()).join(F.broadcast(checked)).select(key, label, F.transform("_all", lambda c: F.struct(d2(c["centre"]).alias("d2"), c["centre_of"].alias("c"))).alias("_d"))
    least = lambda own: F.array_min(F.transform(F.filter("_d", lambda x: (x["c"] == F.col(label)) == own), lambda x: x["d2"]))
    return scored.select(key, label, F.array_min("_d")["c"].alias("predicted"), (least(F.lit(False)) - least(F.lit(True))).alias("margin"))


def decomposition(rows: DataFrame, group: str, value: str, *keys: str) -> DataFrame:
    """Total, within-group and between-group sums of squares: total = within + between."""
    g = rows.groupBy(*keys, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    mean = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy(*keys)) / F.sum("n").over(Window.partitionBy(*keys))
    return g.withColumn("mu", mean).groupBy(*keys).agg(F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * (F.col("m") - F.col("mu")) * (F.col("m") - F.col("mu"))).alias("between"), F.sum("n").alias("n"))


#: Doubles of a sum that travel as one row, and classes whose matrices may reach the driver.
WIDE, MOST = 64, 10_000


def sufficient(windows: DataFrame, vector: str, label: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """n, sum x and sum x x' of each class: summed in each task, then by Spark's sum over rows of WIDE doubles; one matrix a class reaches the driver.

    Rows with a null label, a null vector, or a null, NaN or infinite component are left out; vectors of
    unlike length are an error, as are more than MOST classes: subjects are not classes.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            y = b.column(0).to_numpy(zero_copy_only=False)
            sizes = np.diff(b.column(1).offsets.to_numpy())
            if (sizes != sizes[0]).any():
                raise ValueError("vectors differ in length")
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(y), -1)
            for c in np.unique(y).tolist():
                o = x[y == c]
                t = total.setdefault(int(c), [0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)])
                t[0] += len(o)
                t[1] += o.sum(0)
                t[2] += o.T @ o
        for c, (n, s, ss) in total.items():
            flat = np.concatenate([[float(n), float(len(s))], s, ss.ravel()])
            rows = -(-len(flat) // WIDE)
            flat = np.pad(flat, (0, rows * WIDE - len(flat)))
            flat[1] = len(s) if n else 0
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * WIDE)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, c), pa.int64()), pa.array(np.arange(rows, dtype=np.int32)), pa.array(np.ones(rows, np.int64)), pa.array(np.full(rows, len(s)), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["label", "i", "parts", "d", "v"])

    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = windows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad)
    parts = good.select(F.col(label).cast("long"), vector).mapInArrow(run, "label long, i int, parts long, d long, v array<double>")
    sums = parts.groupBy("label", "i").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.array(*[F.sum(F.col("v")[k]) for k in range(WIDE)]).alias("v"))
    if sums.select("label").distinct().limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} classes")
    flat: dict[int, dict[int, list[float]]] = {}
    size: dict[int, int] = {}
    for r in sums.collect():
        if r["lo"] != r["hi"] or size.setdefault(r["label"], r["lo"]) != r["lo"] or len(set(size.values())) > 1:
            raise ValueError("vectors differ in length")
        flat.setdefault(int(r["label"]), {})[r["i"]] = r["v"]
    out = {}
    for c, rows in flat.items():
        a, d = np.concatenate([rows[i] for i in sorted(rows)]), size[c]
        out[c] = (int(a[0]), a[2 : 2 + d], a[2 + d : 2 + d + d * d].reshape(d, d))
    return out
