"""Splits, folds and caps that any run repeats: order comes from a digest, not from a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def digest(seed: str, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def stratified_split(rows: DataFrame, key: str, strata: list[str], fraction: float, seed: str = "0") -> DataFrame:
    """is_test: in each stratum max(1, min(round(f n), n - 1)) rows by digest; a stratum of one row stays in train."""
    named = rows.withColumn("_d", digest(seed, key))
    placed = ranks.places(named, strata, ["_d", key], "_r").drop("_d")
    sizes = rows.groupBy(*[F.col(c).alias(f"_k_{c}") for c in strata]).agg(F.count("*").alias("_n"))
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    n = F.col("_n")
    test = F.when(n > 1, F.greatest(F.lit(1), F.least(F.bround(n * fraction, 0), n - 1))).otherwise(0)
    return placed.join(sizes, same).select(*rows.columns, (F.col("_r") < test).alias("is_test"))


def balanced_cap(rows: DataFrame, key: str, cell: list[str], most: int, seed: str = "0") -> DataFrame:
    """At most `most` rows of each cell, by digest."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy(digest(seed, key), key))).where(F.col("_r") <= most).drop("_r")


def greedy_folds(counts: list[tuple[int, int]], folds: int) -> dict[int, list[tuple[int, int]]]:
    """Row count -> (fold, how many subjects) in order, from the histogram (rows, subjects): largest first into the smallest fold, ties to the first.

    Subjects of one count take their turns in order; turns in a row of one fold are one entry.
    """
    total, out = [0] * folds, {}
    for n, subjects in sorted(counts, reverse=True):
        turns: list[tuple[int, int]] = []
        while subjects:
            low = min(total)
            f = total.index(low)
            take = subjects if folds == 1 or n == 0 else 1
            if turns and turns[-1][0] == f:
                turns[-1] = (f, turns[-1][1] + take)
            else:
                turns.append((f, take))
            total[f] += n * take
            subjects -= take
        out[n] = turns
    return out


def subject_folds(rows: DataFrame, subject: str, folds: int) -> DataFrame:
    """(subject, fold): subjects by falling row count, ties by the subject, each into the fold with fewest rows so far.

    Only the histogram of row counts reaches the driver, never a subject; the plan that comes
    back has at most a row for each turn, and a subject finds its fold by its rank among those of its count.
    """
    sizes = rows.groupBy(subject).agg(F.count("*").alias("_n"))
    histogram = [(r["_n"], r["k"]) for r in sizes.groupBy("_n").agg(F.count("*").alias("k")).collect()]
    table = []
    for n, turns in greedy_folds(histogram, folds).items():
        at = 0
        for f, k in turns:
            table.append((n, at, at + k, f))
            at += k
    plan = rows.sparkSession.createDataFrame(table, "_n long, _lo long, _hi long, fold int")
    ranked = sizes.withColumn("_r", F.row_number().over(Window.partitionBy("_n").orderBy(subject)) - 1)
    return ranked.join(plan, "_n").where("_r >= _lo and _r < _hi").select(subject, "fold")


def unlike(a: DataFrame, b: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: for each name how many values of its column only one of two tables has; folds can be shared where all are 0."""
    out = None
    for name, c in columns.items():
        sides = a.select(F.col(c).alias("v"), F.lit(1).alias("s")).union(b.select(F.col(c).alias("v"), F.lit(2).alias("s"))).groupBy("v").agg(F.count_distinct("s").alias("n"))
        one = sides.agg(F.count_if(F.col("n") == 1).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def quota_cap(rows: DataFrame, key: str, cell: list[str], session: str, most: int, quota: int, seed: str = "0") -> DataFrame:
    """At most `most` rows of each cell: first up to `quota` of every session by digest, then refilled from what the sessions have left, in turn."""
    own = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*cell, session).orderBy(digest(seed, key), key)))
    order = [F.when(F.col("_r") <= quota, 0).otherwise(1), F.col("_r"), F.col(session), F.col(key)]
    return own.withColumn("_o", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).where(F.col("_o") <= most).drop("_r", "_o")


def nested_select(scores: DataFrame, outer: str, inner: str, grid: list[str], loss: str, folds: int, ties: list[Column]) -> DataFrame:
    """(outer, grid, loss): in each outer fold the candidate of least mean loss over its inner folds; one that lacks a fold is out; ties by `ties`."""
    mean = scores.where(F.col(loss).isNotNull() & ~F.isnan(loss)).groupBy(outer, *grid).agg(F.count_distinct(inner).alias("_folds"), F.round(F.avg(loss), 6).alias(loss)).where(F.col("_folds") == folds)
    w = Window.partitionBy(outer).orderBy(F.col(loss), *ties)
    return mean.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(outer, *grid, loss)
