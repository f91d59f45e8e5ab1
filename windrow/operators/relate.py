"""Joins and set-like matching: ledgers, ranges, nearest samples, duplicates, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from . import metric
from .sums import finite


def ledger_difference(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each column: rows that differ, by a full outer join on the key, and rows of one side only."""
    left = a.select(F.col(key), F.struct(*columns).alias("a"), F.lit(True).alias("_a"))
    right = b.select(F.col(key), F.struct(*columns).alias("b"), F.lit(True).alias("_b"))
    both = left.join(right, key, "full")
    sums = both.agg(F.sum(F.when(F.col("_b").isNull(), 1).otherwise(0)).alias("only_a"), F.sum(F.when(F.col("_a").isNull(), 1).otherwise(0)).alias("only_b"), *[F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), 1).otherwise(0)).alias(f"m_{c}") for c in columns])
    return sums.select("only_a", "only_b", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"m_{c}").alias("mismatches")) for c in columns])).alias("c")).select(F.col("c.name").alias("name"), F.col("c.mismatches").alias("mismatches"), "only_a", "only_b", F.when((F.col("only_a") + F.col("only_b")) > 0, "row_count_mismatch").when(F.col("c.mismatches") > 0, "value_mismatch").otherwise("pass").alias("status"))


def paired_contrast(arms: DataFrame, key: str, arm: str, value: str, first: str, second: str, tolerance: float = 1e-12) -> DataFrame:
    """One row: pairs, mean difference, wins, ties and losses of first against second."""
    wide = arms.where(F.col(arm).isin(first, second)).groupBy(key).agg(F.max(F.when(F.col(arm) == first, F.col(value))).alias("x"), F.max(F.when(F.col(arm) == second, F.col(value))).alias("y"))
    d = F.col("x") - F.col("y")
    return wide.where("x is not null and y is not null").agg(F.count("*").alias("pairs"), F.avg(d).alias("mean_difference"), F.sum(F.when(d > tolerance, 1).otherwise(0)).alias("wins"), F.sum(F.when(F.abs(d) <= tolerance, 1).otherwise(0)).alias("ties"), F.sum(F.when(d < -tolerance, 1).otherwise(0)).alias("losses"))


def in_intervals(samples: DataFrame, intervals: DataFrame, key: str, at: str, start: str, stop: str, width: int) -> DataFrame:
    """Samples joined with the half-open intervals of their key that hold them: an equi-join on (key, bin) and a filter."""
    bins = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))))
    return samples.withColumn("_bin", F.floor(F.col(at) / width)).join(bins, [key, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("_bin")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before it: one union, one ordered window, no join."""
    rest = [c for c in left.columns if c not in (key, at)]
    rows = left.select(key, at, *rest, F.lit(None).alias("_v"), F.lit(1).alias("_side")).unionByName(right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("as_of", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(key, at, *rest, "as_of")


def duplicates_across(rows: DataFrame, content: str, group: str, key: str) -> DataFrame:
    """Exact duplicates that span groups: digest, copies, groups and the first key."""
    return rows.groupBy(F.sha2(F.col(content), 256).alias("digest")).agg(F.count("*").alias("copies"), F.count_distinct(group).alias("groups"), F.min(key).alias("first_key")).where("copies > 1 and groups > 1")


def eligible(rows: DataFrame, subject: str, task: str, tasks: list[str], least: int) -> DataFrame:
    """Subjects with at least `least` rows of every task."""
    counts = rows.where(F.col(task).isin(tasks)).groupBy(subject, task).count().where(F.col("count") >= least)
    return counts.groupBy(subject).agg(F.count("*").alias("n_tasks")).where(F.col("n_tasks") == len(tasks))


def selected(rows: DataFrame, column: str, include: list | None = None, exclude: list | None = None) -> DataFrame:
    """Rows whose value is in include (where given) and not in exclude; both reach the scan as filters."""
    if include is not None:
        rows = rows.where(F.col(column).isin(include))
    return rows.where(~F.col(column).isin(exclude)) if exclude else rows


def index_difference(a: DataFrame, b: DataFrame, run: str, key: str, first: int) -> DataFrame:
    """(run, only_a, only_b, first_a, first_b) of each run that differs: keys of one side only, and the `first` smallest of them."""
    one = a.select(run, key, F.lit(1).alias("_s")).union(b.select(run, key, F.lit(2).alias("_s"))).groupBy(run, key).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).where("_lo = _hi")
    rank = F.row_number().over(Window.partitionBy(run, "_lo").orderBy(key))
    side = lambda s: F.col("_lo") == s
    counts = one.withColumn("_r", rank).groupBy(run).agg(F.count_if(side(1)).alias("only_a"), F.count_if(side(2)).alias("only_b"), *[F.sort_array(F.collect_list(F.when(side(s) & (F.col("_r") <= first), F.col(key)))).alias(n) for s, n in ((1, "first_a"), (2, "first_b"))])
    return counts


def with_reference(rows: DataFrame, reference: DataFrame, keys: list[str], value: str, chance: float) -> DataFrame:
    """rows with status (ok, or missing where reference has no such keys) and retention, (value - chance) / (reference - chance)."""
    ref = reference.select(*keys, F.col(value).alias("_ref"))
    return rows.join(ref, keys, "left").withColumns({"status": F.when(F.col("_ref").isNull(), "missing").otherwise("ok"), "retention": (F.col(value) - chance) / F.nullif(F.col("_ref") - chance, F.lit(0.0))}).drop("_ref")


def composition(rows: DataFrame, group: str, member: str, groups: DataFrame | None = None) -> DataFrame:
    """(a, b, only_a, only_b, both) of each pair of groups, which are few: members of one, of the other and of both.

    Each member's set of groups makes its pairs, so the members meet nobody else; pairs
    without a common member come from the list of groups.
    """
    own = rows.groupBy(group, member).agg(F.lit(1).alias("_n"))
    sizes = own.groupBy(group).agg(F.count("*").alias("n"))
    names = (groups if groups is not None else rows).select(group).distinct().join(sizes, group, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    sets = own.groupBy(member).agg(F.sort_array(F.collect_list(group)).alias("_g"))
    pairs = sets.select(F.posexplode("_g").alias("_i", "a"), "_g").select("a", F.explode(F.slice("_g", F.col("_i") + 2, F.size("_g"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("both"))
    a, b = names.select(F.col(group).alias("a"), F.col("n").alias("_na")), names.select(F.col(group).alias("b"), F.col("n").alias("_nb"))
    every = a.join(b, F.col("a") < F.col("b")).join(pairs, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0).cast("long")))
    return every.select("a", "b", (F.col("_na") - F.col("both")).alias("only_a"), (F.col("_nb") - F.col("both")).alias("only_b"), "both")


def combinations(runs: DataFrame, task: str, replicate: str, tasks) -> DataFrame:
    """One row for each choice of one replicate of every task (r0, r1, ...): the product of the tasks' few replicates."""
    out = None
    for i, t in enumerate(tasks):
        own = runs.where(F.col(task) == t).select(F.col(replicate).alias(f"r{i}"))
        out = own if out is None else out.crossJoin(own)
    return out


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the right value nearest in `at` (a whole number), ties to the earlier one, and the gap: one union, two ordered windows, no join."""
    rest = [c for c in left.columns if c not in (key, at)]
    r = right.select(key, at, F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("_v"), F.lit(0).alias("_side"))
    rows = left.select(key, at, *rest, F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key)
    before = F.last("_v", ignorenulls=True).over(w.orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_v", ignorenulls=True).over(w.orderBy(F.col(at), F.col("_side").desc()).rowsBetween(0, Window.unboundedFollowing))
    both = rows.withColumns({"_b": before, "_a": after}).where("_side = 1")
    first = F.col("_a").isNull() | (F.col(at) - F.col("_b.at") <= F.col("_a.at") - F.col(at))
    pick = F.when(first & F.col("_b").isNotNull(), F.col("_b")).otherwise(F.col("_a"))
    return both.withColumn("_p", pick).select(key, at, *rest, F.col("_p.v").alias("nearest"), F.abs(F.col(at) - F.col("_p.at")).alias("gap"))


def nearest_neighbours(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, page: int = metric.PAGE, counted=None) -> DataFrame:
    """(query_id, rank, neighbour, distance): the k Euclidean neighbours of each query among all rows but its own key; ties to the smaller key.

    Exact, by a metric index of the rows (see `metric`): what its bounds put beyond a query's k-th best so far is not compared.
    Rows without a key or vector, with a null, NaN or infinite component, or of another length than the query's take no part; of
    rows of one key the smallest vector does. Vectors of each length, of which there may be a few, have an index of their own.
    """

    def clean(df: DataFrame) -> DataFrame:
        good = df.where(finite(vector) & F.col(key).isNotNull())
        return scratch.kept(good.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).groupBy("id").agg(F.min("x").alias("x")))

    every, asked = clean(rows), clean(queries)
    lengths = [r[0] for r in asked.select(F.size("x")).distinct().limit(65).collect()]
    if len(lengths) > 64:
        raise ValueError("the queries have vectors of more than 64 lengths")
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    out = []
    for d in sorted(lengths):
        mine, own = asked.where(F.size("x") == d), every.where(F.size("x") == d)
        top = own.agg(F.max(norm).alias("b")).first()["b"]
        if top is None or not d:
            continue
        far = mine.agg(F.max(norm).alias("b")).first()["b"]
        index = metric.indexed(scratch.kept(metric.firsts_of_copies(own, k + 1)), d, scratch.kept, None, 1 + max(top, far) ** 0.5, page)
        out.append(metric.nearest(index, mine, k, counted=counted))
    if not out:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, neighbour long, distance double")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.select("query_id", "rank", F.col("id").alias("neighbour"), F.sqrt("score").alias("distance"))


def intrinsic_dimension(near: DataFrame, k: int) -> DataFrame:
    """(query_id, dimension): the maximum-likelihood dimension 1 / mean(ln(T_k / T_j)) over the k - 1 nearer neighbours of positive distance."""
    far = F.max(F.when(F.col("rank") == k, F.col("distance"))).over(Window.partitionBy("query_id"))
    return near.withColumn("_t", far).where((F.col("rank") < k) & (F.col("distance") > 0)).groupBy("query_id").agg((1 / F.avg(F.log(F.col("_t") / F.col("distance")))).alias("dimension"))


def neighbour_overlap(near: DataFrame, lag: int, *keys: str) -> DataFrame:
    """(keys, query_id, jaccard) of each query's neighbours with those of the query `lag` places later in its key, by query_id."""
    sets = near.groupBy(*keys, "query_id").agg(F.collect_set("neighbour").alias("_n"))
    later = F.lead("_n", lag).over(Window.partitionBy(*keys).orderBy("query_id"))
    return sets.withColumn("_l", later).where("_l is not null").select(*keys, "query_id", (F.size(F.array_intersect("_n", "_l")) / F.size(F.array_union("_n", "_l"))).alias("jaccard"))
