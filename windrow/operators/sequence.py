"""Ordered operators: segments, runs, grids, differences, curves. Each is one window over its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(*keys: str, by: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*by)


def upto(w) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def positions(rows: DataFrame, keys: list[str], by: list, name: str = "t") -> DataFrame:
    """Position from 0 within each key."""
    return rows.withColumn(name, F.row_number().over(order(*keys, by=by)) - 1)


def segments(rows: DataFrame, keys: list[str], by: list, breaks: Column) -> DataFrame:
    """segment_id from 0: a new one wherever `breaks` (which may look at lag columns) is true."""
    w = order(*keys, by=by)
    return rows.withColumn("_break", F.when(breaks, 1).otherwise(0)).withColumn("segment_id", F.sum("_break").over(upto(w))).drop("_break")


def decimated(rows: DataFrame, position: str, step: int, offset: int = 0) -> DataFrame:
    """Every step-th position from offset on."""
    return rows.where((F.col(position) >= offset) & ((F.col(position) - offset) % step == 0))


def uniform_subsample(rows: DataFrame, key: str, by: list, n: int) -> DataFrame:
    """At most n rows of each key at the positions round(i (count - 1) / (n - 1)), halves to even."""
    counted = positions(rows, [key], by).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (n - 1), 0).cast("int"))
    return counted.where((F.col("_n") <= n) | F.array_contains(at, F.col("t"))).drop("_n")


def jump_energy(rows: DataFrame, key: str, by: list, value: str) -> DataFrame:
    """E[(x_t+1 - x_t)^2] / Var(x) (population) of each key; null where the variance is 0."""
    d = F.col(value) - F.lag(value).over(order(key, by=by))
    return rows.withColumn("_d2", d * d).groupBy(key).agg(F.count("*").alias("n"), (F.avg("_d2") / F.nullif(F.var_pop(value), F.lit(0.0))).alias("jump_energy"))


def sliding_windows(rows: DataFrame, key: str, position: str, width: int, step: int) -> DataFrame:
    """A row for each whole window that holds a sample: start, start + width // 2 as centre, and the sample's columns."""
    last = F.max(position).over(Window.partitionBy(key))
    first = F.greatest(F.lit(0), F.ceil((F.col(position) - width + 1) / step))
    to = F.least(F.floor(F.col(position) / step), F.floor((last + 1 - width) / step))
    return rows.withColumn("_i", F.when(first <= to, F.sequence(first, to))).select("*", F.explode("_i").alias("_w")).withColumn("start", F.col("_w") * step).withColumn("centre", F.col("start") + width // 2).drop("_i", "_w")


def stable_cutoff(curve: DataFrame, key: str, x: str, y: str, target: float) -> DataFrame:
    """The smallest x from which every later y reaches the target; null if none does."""
    later = F.min(y).over(Window.partitionBy(key).orderBy(x).rowsBetween(0, Window.unboundedFollowing))
    return curve.withColumn("_m", later).groupBy(key).agg(F.min(F.when(F.col("_m") >= target, F.col(x))).alias("cutoff"))


def first_crossing(curve: DataFrame, key: str, x: str, y: str, target: float) -> DataFrame:
    """x at which y first reaches the target, linear between the two neighbours."""
    w = order(key, by=[x])
    rows = curve.withColumns({"_x": F.lag(x).over(w), "_y": F.lag(y).over(w)}).where((F.col(y) >= target) & (F.col("_y").isNull() | (F.col("_y") < target)))
    first = rows.groupBy(key).agg(F.min_by(F.struct(x, y, "_x", "_y"), x).alias("r"))
    r = lambda n: F.col(f"r.{n}")
    return first.select(key, F.when(r("_y").isNull(), r(x)).otherwise(r("_x") + (target - r("_y")) / (r(y) - r("_y")) * (r(x) - r("_x"))).alias("crossing"))
