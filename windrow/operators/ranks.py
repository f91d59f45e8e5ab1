"""Places, running sums and percentiles within keys, where a key may hold any share of the rows.

Rows are dealt by ranges of (key, order), so that a key of any size spreads over tasks; each part sums
its own rows, and a key that goes on from an earlier part starts from what the parts before it hold. Every
part has at most one such key, its first, so the table of starts has no more rows than there are parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _over_parts(rows: DataFrame, keys: list[str], order: list[str], down: bool, values: dict[str, Column], fold: Callable, meet: Callable, keep: Callable) -> DataFrame:
    """rows with each value folded over the rows of its key that stand before (with down: behind) in order."""
    way = (lambda c: _column(c).desc_nulls_last()) if down else (lambda c: _column(c).asc_nulls_first())
    names = list(values)
    dealt = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
    ranged = keep(dealt.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *map(way, order)).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*keys, "_part").agg(*[fold(f"_v_{n}").alias(f"_t_{n}") for n in names], F.lit(True).alias("_any"))
    starts = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.first("_any").over(before).alias("_later"), *[fold(f"_t_{n}").over(before).alias(f"_s_{n}") for n in names]).where("_later").drop("_later")
    inside = Window.partitionBy(*keys, "_part").orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({f"_o_{n}": fold(f"_v_{n}").over(inside) for n in names})
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # no more rows than parts: see above
    met = own.join(F.broadcast(starts), same, "left")
    return met.select(*rows.columns, *[meet(F.col(f"_o_{n}"), F.col(f"_s_{n}")).alias(n) for n in names])


def running_sums(rows: DataFrame, keys: list[str], order: list[str], down: bool = False, keep: Callable = kept, **values: str | Column) -> DataFrame:
    """rows with name = the sum of a value over the rows of their key that come before them in order (0 for the first).

    order must tell the rows of a key apart; null keys are a key, null orders come first (with down: last).
    """
    meet = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return _over_parts(rows, keys, order, down, {n: _column(v) for n, v in values.items()}, F.sum, meet, keep)


def running_least(rows: DataFrame, keys: list[str], order: list[str], down: bool = False, keep: Callable = kept, **values: str | Column) -> DataFrame:
    """The same for the least value before a row; null where there is none."""
    return _over_parts(rows, keys, order, down, {n: _column(v) for n, v in values.items()}, F.min, F.least, keep)


def places(rows: DataFrame, keys: list[str], order: list[str], name: str, down: bool = False, keep: Callable = kept) -> DataFrame:
    """rows with their place in their key, from 0 on."""
    return running_sums(rows, keys, order, down, keep, **{name: F.lit(1).cast("long")})


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, p0, p1, ...): exact percentiles with linear interpolation, the i-th for shares[i]; nulls and NaN take no part.

    Equal values travel as one row with their count; only the two values around each percentile meet.
    """
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_x"))
    counts = good.groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    at = running_sums(counts, keys, ["_x"], _before=F.col("_n"))
    totals = good.groupBy(*keys).agg(F.count("*").alias("_all"))
    if keys:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        met = at.join(totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_all"), same)
    else:
        met = at.join(F.broadcast(totals))  # one row
    holds = lambda place: (F.col("_before") <= place) & (place < F.col("_before") + F.col("_n"))
    out = []
    for i, q in enumerate(shares):
        exact = F.lit(float(q)) * (F.col("_all") - 1)
        low, high = F.floor(exact), F.ceil(exact)
        a, b = F.max(F.when(holds(low), F.col("_x"))), F.max(F.when(holds(high), F.col("_x")))
        out.append((a + (b - a) * F.max(exact - low)).alias(f"p{i}"))
    return met.groupBy(*keys).agg(*out)
