"""Curves, states and ordered decisions: prefixes, convergence, onsets, interpolation, spread positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subsegments(rows: DataFrame, keys: list[str], by: list, keep: Column) -> DataFrame:
    """Rows where keep holds, with run_id: a new one for each stretch of neighbours that all keep."""
    w = Window.partitionBy(*keys).orderBy(*by)
    flag = rows.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    runs = F.row_number().over(w) - F.sum(F.when(F.col("_keep"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # rows kept before this one do not change the number of those left out
    return flag.withColumn("run_id", runs).where("_keep").drop("_keep")


def segment_windows(segments: DataFrame, keys: list[str], start: str, stop: str, width: int, step: int) -> DataFrame:
    """Windows that restart in each half-open segment: (keys, start, stop, window, elapsed), elapsed counting steps over the key's segments in order."""
    room = F.col(stop) - F.col(start) - width
    starts = F.when(room >= 0, F.sequence(F.col(start), F.col(start) + room, F.lit(step).cast("long")))
    each = segments.where(room >= 0).withColumn("_s", F.explode(starts)).select(*keys, F.col("_s").alias("start"), (F.col("_s") + width).alias("stop"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1
    return each.withColumn("window", order).withColumn("elapsed", F.col("window") * step)


def run_reasons(rows: DataFrame, keys: list[str], by: list, phase: str, least: int) -> DataFrame:
    """(keys, n, valid, reasons): why a run is refused: phases other than 0 and 1, not exactly one step from 0 to 1, too few rows of a phase."""
    w = Window.partitionBy(*keys).orderBy(*by)
    up = F.coalesce((F.lag(phase).over(w) == 0) & (F.col(phase) == 1), F.lit(False))
    down = F.coalesce((F.lag(phase).over(w) == 1) & (F.col(phase) == 0), F.lit(False))
    sums = rows.withColumns({"_up": up, "_down": down}).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(phase).isin(0, 1), F.lit(False))).alias("_other"), F.count_if("_up").alias("_up"), F.count_if("_down").alias("_down"), *[F.count_if(F.col(phase) == p).alias(f"_n{p}") for p in (0, 1)])
    found = F.array_compact(F.array(F.when(F.col("_other") > 0, "unknown phase"), F.when((F.col("_up") != 1) | (F.col("_down") > 0), "not one onset"), F.when(F.col("_n0") < least, "short baseline"), F.when(F.col("_n1") < least, "short task")))
    return sums.select(*keys, "n", (F.size(found) == 0).alias("valid"), found.alias("reasons"))


def onset(rows: DataFrame, keys: list[str], at: str, phase: str) -> DataFrame:
    """(keys, onset): halfway between the last baseline (phase 0) place before the first task (phase 1) place and that one."""
    first = F.min(F.when(F.col(phase) == 1, F.col(at))).over(Window.partitionBy(*keys))
    return rows.withColumn("_f", first).groupBy(*keys).agg(((F.max(F.when((F.col(phase) == 0) & (F.col(at) < F.col("_f")), F.col(at))) + F.max("_f")) / 2).alias("onset"))


def vector_motion(rows: DataFrame, keys: list[str], by: list, vector: str) -> DataFrame:
    """(keys, n, velocity, curvature): mean norms of first and second differences of neighbouring vectors."""
    w = Window.partitionBy(*keys).orderBy(*by)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    wide = rows.select(*keys, F.transform(vector, lambda v: v.cast("double")).alias("_x"), *[F.col(c) for c in by if c not in keys])
    steps = wide.withColumns({"_a": F.lag("_x").over(w), "_b": F.lag("_x", 2).over(w)})
    one = F.zip_with("_x", "_a", lambda x, a: x - a)
    two = F.zip_with(one, F.zip_with("_a", "_b", lambda a, b: a - b), lambda p, q: p - q)
    return steps.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(norm(one)).alias("velocity"), F.avg(norm(two)).alias("curvature"))


def ranked_prefix(rows: DataFrame, keys: list[str], order: list, flag: Column) -> DataFrame:
    """Adds rank (from 1) and in_prefix: no row before it, nor itself, lacks the flag."""
    w = Window.partitionBy(*keys).orderBy(*order)
    good = F.when(F.coalesce(flag, F.lit(False)), 1).otherwise(0)
    return rows.withColumns({"rank": F.row_number().over(w), "in_prefix": F.min(good).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1})


def converged_at(rows: DataFrame, key: str, step: str, loss: str, score: str, width: int = 3, patience: int = 2, loss_range: float = 0.03, score_range: float = 0.01) -> DataFrame:
    """(key, converged): the step that ends the first streak of `patience` stable windows; null if there is none.

    A window of `width` steps is stable if (largest - smallest) loss over the mean
    size of the loss, and the range of the score, stay within bounds.
    """
    w = Window.partitionBy(key).orderBy(step)
    last = w.rowsBetween(-(width - 1), 0)
    span = (F.max(loss).over(last) - F.min(loss).over(last)) / F.greatest(F.abs(F.avg(loss).over(last)), F.lit(1e-12))
    stable = (F.count(loss).over(last) == width) & (span <= loss_range) & (F.max(score).over(last) - F.min(score).over(last) <= score_range)
    marked = rows.withColumn("_ok", F.when(F.coalesce(stable, F.lit(False)), 1).otherwise(0))
    streak = F.sum("_ok").over(w.rowsBetween(-(patience - 1), 0))
    return marked.withColumn("_k", streak).groupBy(key).agg(F.min(F.when(F.col("_k") == patience, F.col(step))).alias("converged"))


def block_spread(rows: DataFrame, keys: list[str], by: list, blocks: int, each: int) -> DataFrame:
    """Up to `each` rows of every one of `blocks` blocks of a key's rows, evenly spread: block b holds the places from floor(b n / blocks) on.

    Inside a block of m rows the places floor((i + 1/2) m / each) are taken, all if m <= each. Adds block and place.
    """
    w = Window.partitionBy(*keys)
    placed = rows.withColumns({"place": F.row_number().over(w.orderBy(*by)) - 1, "_n": F.count("*").over(w)})
    block = F.floor(((F.col("place") + 1) * blocks - 1) / F.col("_n"))
    start = lambda b: F.floor(b * F.col("_n") / blocks)
    inside = placed.withColumn("block", block).withColumns({"_i": F.col("place") - start(F.col("block")), "_m": start(F.col("block") + 1) - start(F.col("block"))})
    pick = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.floor((2 * i + 1) * F.col("_m") / (2 * each)))
    return inside.where((F.col("_m") <= each) | F.array_contains(pick, F.col("_i"))).drop("_n", "_i", "_m")


def effective_dimension(curve: DataFrame, keys: list[str], k: str, score: str, error: str, p: str, alpha: float = 0.05) -> DataFrame:
    """(keys, significant, peak, one_se): axes before the first p above alpha; the k of the best score (ties: smallest); the smallest k whose score is within the best one's error."""
    w = Window.partitionBy(*keys)
    best = F.max(F.struct(F.col(score), -F.col(k), F.col(error))).over(w)
    run = F.min(F.when(F.coalesce(F.col(p) <= alpha, F.lit(False)), 1).otherwise(0)).over(w.orderBy(k).rowsBetween(Window.unboundedPreceding, 0))
    marked = curve.withColumns({"_run": run, "_best": best})
    edge = F.col(f"_best.{score}") - F.col(f"_best.{error}")
    return marked.groupBy(*keys).agg(F.sum("_run").alias("significant"), F.max(-F.col("_best.col2")).alias("peak"), F.min(F.when(F.col(score) >= edge, F.col(k))).alias("one_se"))


def resampled(curve: DataFrame, keys: list[str], x: str, y: str, lowest: float, highest: float, points: int) -> DataFrame:
    """(keys, x, y) at `points` even places, linear between neighbours; places outside a curve get its end value. Of points with one x the highest y counts."""
    own = curve.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.max(F.col(y).cast("double")).alias("y"))
    grid = own.select(*keys).distinct().withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(lowest) + i * (highest - lowest) / (points - 1))))
    both = own.withColumn("_side", F.lit(0)).unionByName(grid.withColumns({"y": F.lit(None).cast("double"), "_side": F.lit(1)}))
    point = F.when(F.col("_side") == 0, F.struct("x", "y"))
    w = Window.partitionBy(*keys)
    a = F.last(point, ignorenulls=True).over(w.orderBy("x", "_side").rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(point, ignorenulls=True).over(w.orderBy(F.col("x"), F.col("_side").desc()).rowsBetween(0, Window.unboundedFollowing))
    t = (F.col("x") - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    value = F.when(F.col("_a").isNull(), F.col("_b.y")).when(F.col("_b").isNull() | (F.col("_b.x") == F.col("_a.x")), F.col("_a.y")).otherwise(F.col("_a.y") + t * (F.col("_b.y") - F.col("_a.y")))
    return both.withColumns({"_a": a, "_b": b}).where("_side = 1").select(*keys, "x", value.alias("y"))


def slow_advantage(axes: DataFrame, keys: list[str], gamma: str, null_median: str, p: str, coverage: float = 0.99, alpha: float = 0.05) -> DataFrame:
    """Adds advantage, max(0, 1 - gamma / null median) for axes with p of alpha or less, and selected: the fewest axes by falling advantage that reach `coverage` of the whole."""
    gain = F.when(F.col(p) <= alpha, F.greatest(F.lit(0.0), 1 - F.col(gamma) / F.nullif(F.col(null_median), F.lit(0.0)))).otherwise(0.0)
    rows = axes.withColumn("advantage", F.coalesce(gain, F.lit(0.0)))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("advantage").over(w.orderBy(F.col("advantage").desc(), gamma).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("selected", (F.col("advantage") > 0) & (before < coverage * F.sum("advantage").over(w)))


def spectral_blocks(axes: DataFrame, keys: list[str], order: str, gamma: str, gap: float = 0.1) -> DataFrame:
    """Adds block (from 0): an axis joins while (max - min) / max(|min|, |max|, 1e-12) of the whole block stays under gap.

    The state of the fold (first, block) runs along a key's axes in one ordered aggregate; a key has
    as many axes as dimensions, which bounds its array.
    """
    kind = "struct<lo:double,hi:double,block:int,out:array<int>>"
    start = F.struct(F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(-1).alias("block"), F.array().cast("array<int>").alias("out")).cast(kind)

    def step(s, x):
        lo, hi = F.least(s["lo"], x["g"]), F.greatest(s["hi"], x["g"])
        joins = s["lo"].isNotNull() & ((hi - lo) / F.greatest(F.abs(lo), F.abs(hi), F.lit(1e-12)) < gap)
        block = F.when(joins, s["block"]).otherwise(s["block"] + 1)
        return F.struct(F.when(joins, lo).otherwise(x["g"]).alias("lo"), F.when(joins, hi).otherwise(x["g"]).alias("hi"), block.alias("block"), F.concat(s["out"], F.array(block)).alias("out")).cast(kind)

    lists = axes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(gamma).cast("double").alias("g")))).alias("_a"))
    folded = lists.select(*keys, "_a", F.aggregate("_a", start, step)["out"].alias("_b"))
    return folded.select(*keys, F.explode(F.arrays_zip("_a", "_b")).alias("z")).select(*keys, F.col("z._a.o").alias(order), F.col("z._a.g").alias(gamma), F.col("z._b").alias("block"))


def shuffled_within(rows: DataFrame, strata: list[str], key: str, value: str, seed: int, out: str = "shuffled") -> DataFrame:
    """Adds `out`: value permuted inside each stratum, by the order of a hash of (seed, key); a stratum's permutation that moves nothing turns by one place."""
    w = Window.partitionBy(*strata)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy(key)), "_j": F.row_number().over(w.orderBy(digest, key)), "_n": F.count("*").over(w)})
    still = F.min(F.when(F.col("_i") == F.col("_j"), 1).otherwise(0)).over(w) == 1
    # the row at place i takes the value of the row whose hash ranks i
    source = placed.withColumn("_to", F.when(still, F.col("_j") % F.col("_n") + 1).otherwise(F.col("_j")))
    given = source.select(*strata, F.col("_to").alias("_i"), F.col(value).alias(out))
    return placed.drop("_j", "_n").join(given, [*strata, "_i"]).drop("_i")


def permutation_null(rows: DataFrame, truth: str, predicted: str, unit: str, draws: int) -> DataFrame:
    """(draw, balanced_accuracy): the truth of each unit shifted by `draw` places along the rows of the unit, circularly, against unchanged predictions. Draw 0 is the real one."""
    w = Window.partitionBy(unit)
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy("_place")) - 1, "_n": F.count("*").over(w)})
    every = placed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    # the shift grows with the draw and differs between units of unlike length
    to = F.pmod(F.col("_i") + F.col("draw") * F.greatest(F.lit(1), F.floor(F.col("_n") / (draws + 1))), F.col("_n"))
    labels = every.select(unit, "draw", to.alias("_i"), F.col(truth).alias("_y"))
    met = every.select(unit, "draw", "_i", predicted).join(labels, [unit, "draw", "_i"])
    r = met.groupBy("draw", "_y").agg(F.avg(F.when(F.col("_y") == F.col(predicted), 1.0).otherwise(0.0)).alias("_r"))
    return r.groupBy("draw").agg(F.avg("_r").alias("balanced_accuracy"))
