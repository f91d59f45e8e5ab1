"""Null distributions that copy no row for each draw: permuted count tables, keyed permutations by arithmetic, cached draws."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks
from .readout import fisher_values
from .spaces import haar_basis, principal_angles, projection_fractions
from .sums import finite, matrix, summed


def exact_label_null(rows: DataFrame, run: str, truth: str, predicted: str) -> DataFrame:
    """(draw, balanced_accuracy, observed boolean): balanced accuracy under every assignment of the runs' labels to the runs.

    Each run has one true label (else an error), runs are at most 8. The rows meet once, as counts of (run, predicted); an
    assignment is a row for each run, and joins those counts. Assignments that swap equal labels count as often as they come.
    """
    cells = rows.groupBy(run, truth, predicted).agg(F.count("*").alias("n"))
    owners = cells.groupBy(run).agg(F.count_distinct(truth).alias("k"), F.first(truth).alias("label")).where(F.col(run).isNotNull()).limit(9).collect()
    if len(owners) > 8 or any(r["k"] != 1 for r in owners):
        raise ValueError("exact enumeration needs at most 8 runs of one label each")
    runs = sorted((r[run], r["label"]) for r in owners)
    table = [(d, r, label, labels == tuple(x for _, x in runs)) for d, labels in enumerate(itertools.permutations([x for _, x in runs])) for (r, _), label in zip(runs, labels, strict=True)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    draws = rows.sparkSession.createDataFrame(table, f"draw int, _run {kinds[run]}, _label {kinds[truth]}, observed boolean")
    met = cells.join(F.broadcast(draws), F.col(run) == F.col("_run"))  # 8 runs, 8! assignments at most
    recall = met.groupBy("draw", "observed", "_label").agg((F.sum(F.when(F.col(predicted) == F.col("_label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("r"))
    return recall.groupBy("draw", "observed").agg(F.avg("r").alias("balanced_accuracy"))


def permuted(place: np.ndarray, n: int, draw: int, seed: int) -> np.ndarray:
    """A pseudo-random permutation of 0 .. n - 1, applied to places: a four-round Feistel network that is walked until it lands below n.

    Any task can permute its own places; nothing is sorted and nothing moves.
    """
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << bits) - 1)
    keys = np.random.default_rng([seed, draw]).integers(0, 1 << 63, 4, dtype=np.uint64)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(bits), x & mask
        for key in keys:
            h = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        return (left << np.uint64(bits)) | right

    x = network(place.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = network(x[out])
    return x.astype(np.int64)


def eigenvalue_null(windows: DataFrame, key: str, label: str, vector: str, draws: int, seed: int = 0, ridge: float = 1e-4) -> DataFrame:
    """(k, real, null95, p): each discriminant eigenvalue, the 95th percentile of its null under permuted labels, and its plus-one p.

    A permuted label is the class that a row's permuted place falls into when rows stand class by class, so class sizes stay. Only the
    classes' sums depend on the labels, for the total scatter does not: one pass adds up draws x classes x dimensions numbers.
    Rows with a null label or key, or without a finite vector, take no part; fewer than two classes are an error.
    """
    spark = windows.sparkSession
    good = windows.where(finite(vector) & F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("long").alias("_y"), F.col(vector).alias("_x"))
    sizes = {r["_y"]: r["count"] for r in good.groupBy("_y").count().limit(10_001).collect()}
    if not 2 <= len(sizes) <= 10_000:
        raise ValueError("eigenvalues need from 2 to 10,000 classes")
    labels = sorted(sizes)
    counts = np.array([sizes[c] for c in labels])
    ends, n, k = np.cumsum(counts), int(counts.sum()), len(labels)
    dim = good.agg(F.max(F.size("_x")).alias("d")).first()["d"]
    placed = ranks.places(good, [], ["_key", "_y"], "_place").select("_place", "_y", "_x")

    def part(b: pa.RecordBatch) -> np.ndarray:
        x, place = matrix(b.column(2), dim), b.column(0).to_numpy()
        given = [np.searchsorted(labels, b.column(1).to_numpy())] + [np.searchsorted(ends, permuted(place, n, d, seed), "right") for d in range(1, draws + 1)]
        sums = np.zeros((draws + 1, k, dim))
        for d, y in enumerate(given):
            order = np.argsort(y, kind="stable")
            which, first = np.unique(y[order], return_index=True)
            sums[d][which] += np.add.reduceat(x[order], first, axis=0)
        return np.concatenate([sums.ravel(), (x.T @ x).ravel()])

    total = summed(placed, part, (draws + 1) * k * dim + dim * dim)
    sums, second = total[: (draws + 1) * k * dim].reshape(draws + 1, k, dim), total[(draws + 1) * k * dim :].reshape(dim, dim)
    values = np.array([fisher_values(counts, s / counts[:, None], second, ridge) for s in sums])
    real, null = values[0], values[1:]
    bars = np.percentile(null, 95, axis=0)
    rows = [(j + 1, float(real[j]), float(bars[j]), float((1 + (null[:, j] >= real[j]).sum()) / (1 + draws))) for j in range(len(real))]
    return spark.createDataFrame(rows, "k int, real double, null95 double, p double")


def matched_statistic(u: np.ndarray, v: np.ndarray, s: np.ndarray, context: int, kind: str, rng: np.random.Generator) -> float:
    """One draw for a module's components against random ones of the same shape: the energy in their span, the smallest angle to it, or the interference with them."""
    a, b = haar_basis(len(u), context, rng), haar_basis(len(v), context, rng)
    if kind == "energy":
        return float((s * s * projection_fractions(u, v, a, b)).sum() / (s * s).sum())
    if kind == "angle":
        flat = lambda p, q: np.einsum("ik,jk->ijk", p, q).reshape(-1, p.shape[1])
        return float(principal_angles(flat(u, v), flat(a, b)).min())
    if kind == "sti":
        left, right, weights = np.hstack([u, a]), np.hstack([v, b]), np.r_[s, np.full(context, s.mean())]
        return float(np.abs((left.T @ left - np.eye(len(weights))) @ np.diag(weights) @ (right.T @ right - np.eye(len(weights)))).sum())
    raise ValueError(f"no such statistic: {kind}")


def cached_null(parts: DataFrame, module: str, kind: str, draws: int, seed: int, folder: str, context: int = 2, drawn=None) -> DataFrame:
    """(module, draw, value) of matched_statistic for each module's components (sigma, u, v), from a table in `folder` that keeps what was drawn.

    A comparison's signature is a hash of its components (in any order), the statistic, the size of the context and the seed. Draws that the table has are not
    made again, for this module or another of the same components; new ones are added to it. A draw depends on its signature and number alone.
    `drawn`, an accumulator, gets the number of draws made.
    """
    import pandas as pd

    spark = parts.sparkSession
    each = F.xxhash64("sigma", "u", "v").cast("decimal(38,0)")
    own = parts.groupBy(module).agg(F.sum(each).alias("a"), F.sum(F.xxhash64(F.lit(1), "sigma", "u", "v").cast("decimal(38,0)")).alias("b"), F.count("*").alias("n"))
    signed = own.select(module, F.sha2(F.concat_ws("|", F.lit(kind), F.lit(context), F.lit(seed), F.col("a").cast("string"), F.col("b").cast("string"), F.col("n").cast("string")), 256).alias("signature"))
    schema = "signature string, draw int, value double"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    held = spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)
    asked = signed.select("signature").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    missing = asked.join(held.select("signature", "draw"), ["signature", "draw"], "left_anti")
    one_of = signed.groupBy("signature").agg(F.min(module).alias(module))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        u, v, s = np.array(frame["u"].tolist()).T, np.array(frame["v"].tolist()).T, frame["sigma"].to_numpy()
        order = np.lexsort((*v[::-1], *u[::-1], s))
        signature, draw = frame["signature"].iloc[0], int(frame["draw"].iloc[0])
        rng = np.random.default_rng([int(signature[:15], 16), draw])
        if drawn is not None:
            drawn.add(1)
        return pd.DataFrame({"signature": [signature], "draw": [draw], "value": [matched_statistic(u[:, order], v[:, order], s[order], context, kind, rng)]})

    met = missing.join(one_of, "signature").join(parts.select(module, "sigma", "u", "v"), module)
    if not missing.isEmpty():
        met.select("signature", "draw", "sigma", "u", "v").groupBy("signature", "draw").applyInPandas(run, schema).write.mode("append").parquet(folder)
        held = spark.read.schema(schema).parquet(folder)
    return signed.join(held.where(F.col("draw") <= draws), "signature").select(module, "draw", "value")
