"""Classification metrics, nulls and multiple testing, exact and distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def recalls(rows: DataFrame, truth: str, predicted: str, *keys: str) -> DataFrame:
    """Support and recall of each class that occurs."""
    return rows.groupBy(*keys, truth).agg(F.count("*").alias("support"), F.avg(F.when(F.col(truth) == F.col(predicted), 1.0).otherwise(0.0)).alias("recall"))


def balanced_accuracy(rows: DataFrame, truth: str, predicted: str, *keys: str, classes: int | None = None) -> DataFrame:
    """Mean recall: over the classes that occur, or over `classes` with absent ones as 0."""
    r = recalls(rows, truth, predicted, *keys)
    value = F.avg("recall") if classes is None else F.sum("recall") / classes
    return r.groupBy(*keys).agg(value.alias("balanced_accuracy"))


def average_ranks(rows: DataFrame, score: str, *keys: str) -> DataFrame:
    """rank: ties share the mean of their ranks. Equal scores are one row with their count, and running counts come from ranges of scores."""
    counts = rows.groupBy(*keys, score).agg(F.count("*").alias("_n"))
    before = ranks.running_sums(counts, list(keys), [score], _before=F.col("_n"))
    return rows.join(before.select(*keys, score, (F.col("_before") + (F.col("_n") + 1) / 2).alias("rank")), [*keys, score])


def auc(rows: DataFrame, score: str, positive: str, *keys: str) -> DataFrame:
    """Rank AUC of a boolean; null if a side is empty."""
    counts = rows.groupBy(*keys, score).agg(F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    before = ranks.running_sums(counts, list(keys), [score], _before=F.col("n"))
    sums = before.withColumn("r", (F.col("_before") + (F.col("n") + 1) / 2) * F.col("p")).groupBy(*keys).agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    q = F.col("n") - F.col("p")
    return sums.select(*keys, F.when((F.col("p") > 0) & (q > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * q)).alias("auc"))


def empirical_p(rows: DataFrame, real: str, null: str, *keys: str) -> DataFrame:
    """Plus-one Monte Carlo p, upper and lower, of real against an array-free table of null draws."""
    n = F.count("*")
    return rows.groupBy(*keys).agg(((F.sum(F.when(F.col(null) >= F.col(real), 1).otherwise(0)) + 1) / (n + 1)).alias("p_upper"), ((F.sum(F.when(F.col(null) <= F.col(real), 1).otherwise(0)) + 1) / (n + 1)).alias("p_lower"))


def benjamini_hochberg(rows: DataFrame, p: str, *keys: str) -> DataFrame:
    """q: step-up adjusted p over the valid ones; null and NaN stay null.

    Equal p are one row with their count; ranks are running counts, and the least value from above runs the other way.
    """
    valid = F.col(p).isNotNull() & ~F.isnan(p)
    counts = rows.where(valid).groupBy(*keys, p).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_m"))
    ranked = ranks.running_sums(counts, list(keys), [p], _before=F.col("_n"))
    ranked = ranked.join(total, list(keys)) if keys else ranked.join(F.broadcast(total))  # without keys one row
    raw = ranked.withColumn("_q", F.col(p) * F.col("_m") / (F.col("_before") + F.col("_n"))).select(*keys, p, "_q")
    least = ranks.running_least(raw, list(keys), [p], True, _later=F.col("_q")).select(*keys, p, F.least(F.lit(1.0), "_q", "_later").alias("q"))
    return rows.join(least, [*keys, p], "left")


def retention(value, reference, chance: float):
    """(value - chance) / (reference - chance); null where the reference is at chance."""
    return F.when(F.abs(reference - chance) > 1e-12, (value - chance) / (reference - chance))


def summary(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, balanced_accuracy and macro_f1 over the classes that occur as truth."""
    cells = rows.groupBy(truth, predicted).agg(F.count("*").alias("c"))
    per = cells.select(F.col(truth).alias("k"), F.col("c").alias("n"), F.when(F.col(truth) == F.col(predicted), F.col("c")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("m")).union(cells.select(F.col(predicted), F.lit(0).cast("long"), F.lit(0).cast("long"), "c"))
    sums = per.groupBy("k").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"), F.sum("m").alias("m")).where("n > 0")
    return sums.agg(F.sum("n").alias("n"), (F.sum("tp") / F.sum("n")).alias("accuracy"), F.avg(F.col("tp") / F.col("n")).alias("balanced_accuracy"), F.avg(2 * F.col("tp") / (F.col("n") + F.col("m"))).alias("macro_f1"))
