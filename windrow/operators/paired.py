"""Paired tests: exact sign test and Wilcoxon signed ranks, one row for each key."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Up to so many pairs without ties or zeros the signed-rank p is exact.
EXACT_UP_TO = 50


def sign_test(rows: DataFrame, difference: str, *keys: str) -> DataFrame:
    """(keys, wins, losses, p): two-sided exact binomial p at 1/2; zeros and nulls drop out, p is 1 where none are left."""
    d = F.col(difference)
    counts = rows.groupBy(*keys).agg(F.count(F.when(d > 0, 1)).alias("wins"), F.count(F.when(d < 0, 1)).alias("losses"))
    n, m = F.col("wins") + F.col("losses"), F.least("wins", "losses")
    first = F.struct((-n * math.log(2)).alias("term"), F.exp(-n * math.log(2)).alias("sum"))

    def step(s, i):
        term = s["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>"))
    return counts.select(*keys, "wins", "losses", F.least(F.lit(1.0), 2 * F.aggregate(steps, first, step)["sum"]).alias("p"))


@lru_cache(maxsize=64)
def _subset_sums(n: int) -> tuple[int, ...]:
    """How many subsets of 1..n have each sum."""
    ways = [1]
    for k in range(1, n + 1):
        ways = [(ways[i] if i < len(ways) else 0) + (ways[i - k] if i >= k else 0) for i in range(len(ways) + k)]
    return tuple(ways)


def signed_rank_p(n: int, statistic: float, z: float | None, exact: bool) -> float:
    """Two-sided p of the smaller rank sum."""
    if n == 0 or z is None or math.isnan(z):
        return 1.0
    if exact:
        return min(1.0, 2 * sum(_subset_sums(n)[: int(statistic) + 1]) / 2**n)
    return math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(DoubleType())
def _p(n: pd.Series, statistic: pd.Series, z: pd.Series, exact: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(int(a), b, c, bool(e)) for a, b, c, e in zip(n, statistic, z, exact, strict=True)], dtype="float64")


def signed_ranks(rows: DataFrame, difference: str, *keys: str) -> DataFrame:
    """(keys, n, w_plus, w_minus, z, p): zeros drop out, tied sizes share their mean rank.

    p is exact up to EXACT_UP_TO pairs without ties or zeros, else normal with tie
    correction. Equal sizes meet in an aggregate first, so the window sorts
    distinct sizes. A key without a non-zero difference has n = 0 and p = 1.
    """
    sizes = rows.where(F.col(difference).isNotNull()).groupBy(*keys, F.abs(difference).alias("_a")).agg(F.count(F.when(F.col(difference) > 0, 1)).alias("_up"), F.count("*").alias("_n"))
    kept = F.when(F.col("_a") > 0, F.col("_n")).otherwise(0)
    before = F.coalesce(F.sum(kept).over(Window.partitionBy(*keys).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("_r", F.when(F.col("_a") > 0, before + (F.col("_n") + 1) / 2).otherwise(0.0))
    n = F.sum(kept)
    sums = ranked.groupBy(*keys).agg(
        n.alias("n"),
        F.sum(F.col("_r") * F.col("_up")).alias("w_plus"),
        F.sum(F.when(F.col("_a") > 0, F.col("_r") * (F.col("_n") - F.col("_up"))).otherwise(0.0)).alias("w_minus"),
        F.sum(F.when(F.col("_a") > 0, F.col("_n") * F.col("_n") * F.col("_n") - F.col("_n")).otherwise(0)).alias("_ties"),
        F.max(F.when(F.col("_a") == 0, 1).otherwise(0)).alias("_zero"),
    )
    m = F.col("n").cast("double")
    spread = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("_ties") / 48)
    least = F.least("w_plus", "w_minus")
    scored = sums.withColumn("z", F.when(F.col("n") > 0, (least - m * (m + 1) / 4) / spread))
    exact = (F.col("n") <= EXACT_UP_TO) & (F.col("_ties") == 0) & (F.col("_zero") == 0)
    return scored.select(*keys, "n", "w_plus", "w_minus", "z", _p("n", least, "z", exact).alias("p"))
