"""Queries over ordered sequences, curves and nulls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curves, metrics, sampling, sequence
from ..sources import tables
from .registry import CENTRED, LONG, POSITIONS, events, query, rounded, samples, windows

_PHASE = "CASE WHEN t.t < 5 THEN 0 ELSE 1 END"


@query(f"WITH {POSITIONS}, k AS (SELECT *, value > 20 AS keep FROM t), g AS (SELECT *, t - row_number() OVER (PARTITION BY user_id, keep ORDER BY t) AS r FROM k) SELECT user_id, min(t) AS start, max(t) + 1 AS stop, count(*) AS n FROM g WHERE keep GROUP BY user_id, r")
def kept_subsegments(spark, sf_dir):
    runs = curves.subsegments(samples(spark, sf_dir), ["user_id"], ["t"], F.col("value") > 20)
    return runs.groupBy("user_id", "run_id").agg(F.min("t").cast("long").alias("start"), (F.max("t") + 1).cast("long").alias("stop"), F.count("*").alias("n")).drop("run_id")


@query(f"WITH {POSITIONS}, k AS (SELECT *, value > 10 AS keep FROM t), g AS (SELECT *, t - row_number() OVER (PARTITION BY user_id, keep ORDER BY t) AS r FROM k), s AS (SELECT user_id, min(t) AS a, max(t) + 1 AS b FROM g WHERE keep GROUP BY user_id, r HAVING count(*) >= 4), w AS (SELECT user_id, unnest(range(a, b - 4 + 1, 2)) AS start FROM s) SELECT user_id, start, start + 4 AS stop, row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS window_no, (row_number() OVER (PARTITION BY user_id ORDER BY start) - 1) * 2 AS elapsed FROM w")
def windows_in_segments(spark, sf_dir):
    runs = curves.subsegments(samples(spark, sf_dir), ["user_id"], ["t"], F.col("value") > 10)
    s = runs.groupBy("user_id", "run_id").agg(F.min("t").cast("long").alias("a"), (F.max("t") + 1).cast("long").alias("b"))
    w = curves.segment_windows(s, ["user_id"], "a", "b", 4, 2)
    return w.select("user_id", "start", "stop", F.col("window").cast("long").alias("window_no"), F.col("elapsed").cast("long").alias("elapsed"))


@query(f"WITH {POSITIONS}, p AS (SELECT user_id, t, CASE WHEN value > 97 THEN 2 WHEN t < user_id % 12 THEN 0 ELSE 1 END AS phase FROM t), l AS (SELECT *, lag(phase) OVER (PARTITION BY user_id ORDER BY t) AS b FROM p), s AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE phase NOT IN (0, 1)) AS other, count(*) FILTER (WHERE b = 0 AND phase = 1) AS up, count(*) FILTER (WHERE b = 1 AND phase = 0) AS down, count(*) FILTER (WHERE phase = 0) AS n0, count(*) FILTER (WHERE phase = 1) AS n1 FROM l GROUP BY 1) SELECT user_id, n, other = 0 AND up = 1 AND down = 0 AND n0 >= 4 AND n1 >= 4 AS valid, array_to_string(list_filter([CASE WHEN other > 0 THEN 'unknown phase' END, CASE WHEN up <> 1 OR down > 0 THEN 'not one onset' END, CASE WHEN n0 < 4 THEN 'short baseline' END, CASE WHEN n1 < 4 THEN 'short task' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s")
def refused_runs(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("phase", F.when(F.col("value") > 97, 2).when(F.col("t") < F.col("user_id") % 12, 0).otherwise(1))
    return curves.run_reasons(s, ["user_id"], ["t"], "phase", 4).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {POSITIONS}, p AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, CASE WHEN t < user_id % 12 THEN 0 ELSE 1 END AS phase FROM t), f AS (SELECT *, min(s) FILTER (WHERE phase = 1) OVER (PARTITION BY user_id) AS f FROM p) SELECT user_id, round((max(s) FILTER (WHERE phase = 0 AND s < f) + max(f)) / 2, 3) AS onset FROM f GROUP BY 1")
def task_onsets(spark, sf_dir):
    s = samples(spark, sf_dir).select("user_id", (F.unix_micros("ts") / 1e6).alias("s"), F.when(F.col("t") < F.col("user_id") % 12, 0).otherwise(1).alias("phase"))
    return curves.onset(s, ["user_id"], "s", "phase").withColumn("onset", rounded("onset", 3))


@query(f"WITH {LONG}, o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings), y AS (SELECT label, i, dim, v FROM x JOIN o USING (vec_id, label)), d AS (SELECT a.label, a.i, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS s, sqrt(sum((a.v - 2 * b.v + c.v) * (a.v - 2 * b.v + c.v))) AS k FROM y a LEFT JOIN y b ON a.label = b.label AND a.dim = b.dim AND b.i = a.i - 1 LEFT JOIN y c ON a.label = c.label AND a.dim = c.dim AND c.i = a.i - 2 GROUP BY 1, 2) SELECT label, count(*) AS n, round(avg(s), 6) AS velocity, round(avg(k), 6) AS curvature FROM d GROUP BY 1")
def vector_motion(spark, sf_dir):
    m = curves.vector_motion(windows(spark, sf_dir), ["label"], ["vec_id"], "embedding")
    return m.withColumns({"velocity": rounded("velocity"), "curvature": rounded("curvature")})


@query("WITH e AS (SELECT user_id, event_type, round(sum(value), 4) AS energy, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY energy DESC, user_id) AS rank FROM e) SELECT event_type, user_id, CAST(rank AS INTEGER) AS shared_rank, min(CASE WHEN n >= 8 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY rank) = 1 AS in_prefix FROM r")
def shared_ranks(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id", "event_type").agg(rounded(F.sum("value"), 4).alias("energy"), F.count("*").alias("n"))
    return curves.ranked_prefix(e, ["event_type"], [F.col("energy").desc(), F.col("user_id")], F.col("n") >= 8).select("event_type", "user_id", F.col("rank").alias("shared_rank"), "in_prefix")


@query("WITH d AS (SELECT event_type, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS step, round(avg(value), 6) AS loss, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS score FROM events GROUP BY 1, 2), w AS (SELECT *, count(loss) OVER l AS c, (max(loss) OVER l - min(loss) OVER l) / greatest(abs(avg(loss) OVER l), 1e-12) AS span, max(score) OVER l - min(score) OVER l AS r FROM d WINDOW l AS (PARTITION BY event_type ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), o AS (SELECT event_type, step, CASE WHEN c = 3 AND span <= 0.15 AND r <= 0.12 THEN 1 ELSE 0 END AS ok FROM w), k AS (SELECT *, sum(ok) OVER (PARTITION BY event_type ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS k FROM o) SELECT event_type, min(step) FILTER (WHERE k = 2) AS converged FROM k GROUP BY 1")
def convergence(spark, sf_dir):
    step = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("timestamp")).cast("long")
    d = events(spark, sf_dir).groupBy("event_type", step.alias("step")).agg(rounded(F.avg("value")).alias("loss"), rounded(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0))).alias("score"))
    return curves.converged_at(d, "event_type", "step", "loss", "score", 3, 2, 0.15, 0.12)


@query(f"WITH {POSITIONS}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM t), b AS (SELECT *, ((t + 1) * 4 - 1) // n AS block FROM n), m AS (SELECT *, t - block * n // 4 AS i, (block + 1) * n // 4 - block * n // 4 AS m FROM b) SELECT user_id, event_id, t AS place, block FROM m WHERE m <= 2 OR list_contains([m // 4, 3 * m // 4], i)")
def spread_positions(spark, sf_dir):
    rows = curves.block_spread(events(spark, sf_dir).select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 4, 2)
    return rows.select("user_id", "event_id", F.col("place").cast("long").alias("place"), F.col("block").cast("long").alias("block"))


@query("WITH c AS (SELECT user_id % 9 AS model, user_id // 9 AS k, round(avg(value), 6) AS score, round(stddev_samp(value) / sqrt(count(*)), 6) AS error, ((user_id // 9) * 37 % 101) / 1000.0 AS p FROM events GROUP BY user_id), b AS (SELECT model, arg_max((score, error, k), (score, -k)) AS b FROM c GROUP BY 1), r AS (SELECT c.*, b.b, min(CASE WHEN p <= 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY k) AS run FROM c JOIN b USING (model)) SELECT model, CAST(sum(run) AS BIGINT) AS significant, max(b[3]) AS peak, min(k) FILTER (WHERE score >= b[1] - b[2]) AS one_se FROM r GROUP BY 1")
def dimension_summary(spark, sf_dir):
    c = events(spark, sf_dir).groupBy("user_id").agg(rounded(F.avg("value")).alias("score"), rounded(F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("error"))
    c = c.withColumns({"model": F.col("user_id") % 9, "k": F.floor(F.col("user_id") / 9)}).withColumn("p", F.col("k") * 37 % 101 / 1000.0)
    return curves.effective_dimension(c, ["model"], "k", "score", "error", "p").withColumn("significant", F.col("significant").cast("long"))


@query(f"WITH {POSITIONS}, c AS (SELECT user_id, round(t / 10.0, 1) AS x, max(value) AS y FROM t GROUP BY 1, 2), g AS (SELECT user_id, i * 0.2 AS x FROM (SELECT DISTINCT user_id FROM c), range(0, 21) r(i)), a AS (SELECT g.user_id, g.x, arg_max(c.y, c.x) FILTER (WHERE c.x <= g.x + 1e-9) AS ya, max(c.x) FILTER (WHERE c.x <= g.x + 1e-9) AS xa, arg_min(c.y, c.x) FILTER (WHERE c.x >= g.x - 1e-9) AS yb, min(c.x) FILTER (WHERE c.x >= g.x - 1e-9) AS xb FROM g JOIN c USING (user_id) GROUP BY 1, 2), v AS (SELECT user_id, x, CASE WHEN xa IS NULL THEN yb WHEN xb IS NULL OR abs(xb - xa) < 1e-9 THEN ya ELSE ya + (x - xa) / (xb - xa) * (yb - ya) END AS y FROM a) SELECT CAST(round(x * 10) AS INTEGER) AS tenths, count(*) AS n, round(avg(y), 5) AS mean_y, round(median(y), 5) AS median_y FROM v GROUP BY 1")
def mean_curve(spark, sf_dir):
    c = samples(spark, sf_dir).withColumn("x", F.round(F.col("t") / 10.0, 1).cast("double"))
    r = curves.resampled(c, ["user_id"], "x", "value", 0.0, 4.0, 21)
    return r.groupBy(F.round(F.col("x") * 10).cast("int").alias("tenths")).agg(F.count("*").alias("n"), rounded(F.avg("y"), 5).alias("mean_y"), rounded(F.median("y"), 5).alias("median_y"))


@query("SELECT event_type, count(*) AS replicates, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(min(m), 6) AS lowest, round(max(m), 6) AS highest, round(log10(greatest(median(m), 1e-300)), 6) AS log_median FROM (SELECT event_type, user_id % 6 AS replicate, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def replicate_summary(spark, sf_dir):
    m = events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 6).alias("r")).agg(F.avg("value").alias("m"))
    return m.groupBy("event_type").agg(F.count("*").alias("replicates"), rounded(F.avg("m")).alias("mean"), rounded(F.median("m")).alias("median"), rounded(F.min("m")).alias("lowest"), rounded(F.max("m")).alias("highest"), rounded(F.log10(F.greatest(F.median("m"), F.lit(1e-300)))).alias("log_median"))


@query("WITH s AS (SELECT user_id, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi, avg(value) AS m, sum(value * value) AS e FROM events GROUP BY 1) SELECT user_id, round(lo, 6) AS lowest, round(hi, 6) AS highest, round(m, 6) AS mean, round(s, 6) AS std, round(e, 3) AS energy, s <= 1e-6 AS dead FROM s")
def channel_audit(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).groupBy("user_id").agg(rounded(F.min(v)).alias("lowest"), rounded(F.max(v)).alias("highest"), rounded(F.avg(v)).alias("mean"), rounded(F.stddev_pop(v)).alias("std"), rounded(F.sum(v * v), 3).alias("energy"), (F.stddev_pop(v) <= 1e-6).alias("dead"))


@query("SELECT label, round(avg(a), 6) AS mean0, round(stddev_samp(a), 6) AS std0, round(quantile_cont(a, 0.25), 6) AS low0, round(median(a), 6) AS median0, round(quantile_cont(a, 0.75), 6) AS high0, round(avg(b), 6) AS mean1, round(stddev_samp(b), 6) AS std1, round(quantile_cont(b, 0.25), 6) AS low1, round(median(b), 6) AS median1, round(quantile_cont(b, 0.75), 6) AS high1 FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings) GROUP BY 1")
def coordinate_statistics(spark, sf_dir):
    w = windows(spark, sf_dir).select("label", *[F.col("embedding")[i].cast("double").alias(f"a{i}") for i in (0, 1)])
    one = lambda i: [rounded(f(f"a{i}")).alias(f"{n}{i}") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("low", lambda c: F.percentile(c, 0.25)), ("median", F.median), ("high", lambda c: F.percentile(c, 0.75)))]
    return w.groupBy("label").agg(*one(0), *one(1))


@query("WITH a AS (SELECT event_type, user_id, round(var_pop(value), 6) AS gamma, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, round(median(gamma) OVER (PARTITION BY event_type), 6) AS med, (user_id * 13 % 97) / 1000.0 AS p FROM a), g AS (SELECT *, CASE WHEN p <= 0.05 AND med <> 0 THEN greatest(0, 1 - gamma / med) ELSE 0 END AS adv FROM m), c AS (SELECT *, coalesce(sum(adv) OVER (PARTITION BY event_type ORDER BY adv DESC, gamma, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(adv) OVER (PARTITION BY event_type) AS t FROM g) SELECT event_type, user_id, round(adv, 6) AS advantage, adv > 0 AND b < 0.9 * t AS selected FROM c")
def slow_selection(spark, sf_dir):
    a = events(spark, sf_dir).groupBy("event_type", "user_id").agg(rounded(F.var_pop("value")).alias("gamma"))
    m = rounded(F.median("gamma").over(Window.partitionBy("event_type")))
    rows = a.withColumns({"med": m, "p": F.col("user_id") * 13 % 97 / 1000.0})
    return curves.slow_advantage(rows, ["event_type"], "gamma", "med", "p", 0.9).select("event_type", "user_id", rounded("advantage").alias("advantage"), "selected")


@query(f"WITH RECURSIVE {LONG}, s AS (SELECT label, round(var_samp(v), 8) AS g, row_number() OVER (PARTITION BY label ORDER BY round(var_samp(v), 8), dim) AS o FROM x GROUP BY label, dim), r AS (SELECT label, o, g, g AS lo, g AS hi, 0 AS block FROM s WHERE o = 1 UNION ALL SELECT s.label, s.o, s.g, CASE WHEN (greatest(r.hi, s.g) - least(r.lo, s.g)) / greatest(abs(least(r.lo, s.g)), abs(greatest(r.hi, s.g)), 1e-12) < 0.1 THEN least(r.lo, s.g) ELSE s.g END, CASE WHEN (greatest(r.hi, s.g) - least(r.lo, s.g)) / greatest(abs(least(r.lo, s.g)), abs(greatest(r.hi, s.g)), 1e-12) < 0.1 THEN greatest(r.hi, s.g) ELSE s.g END, CASE WHEN (greatest(r.hi, s.g) - least(r.lo, s.g)) / greatest(abs(least(r.lo, s.g)), abs(greatest(r.hi, s.g)), 1e-12) < 0.1 THEN r.block ELSE r.block + 1 END FROM r JOIN s ON s.label = r.label AND s.o = r.o + 1) SELECT label, CAST(o AS INTEGER) AS o, CAST(block AS INTEGER) AS block FROM r")
def spectral_blocks(spark, sf_dir):
    v = tables.long_form(windows(spark, sf_dir)).groupBy("label", "dim").agg(F.round(F.var_samp("v"), 8).alias("g"))
    ranked = v.withColumn("o", F.row_number().over(Window.partitionBy("label").orderBy("g", "dim")))
    return curves.spectral_blocks(ranked, ["label"], "o", "g").select("label", "o", "block")


_SHUFFLED = f"WITH {POSITIONS}, w AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('3|' || event_id), event_id) AS j, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM t), k AS (SELECT *, min(CASE WHEN i = j THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type) AS still FROM w), g AS (SELECT user_id, event_type, value, CASE WHEN still = 1 THEN j % n + 1 ELSE j END AS i FROM k)"


@query(_SHUFFLED + " SELECT k.event_id, g.value AS shuffled FROM k JOIN g USING (user_id, event_type, i)")
def temporal_shuffle(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_type", "event_id", "value")
    return curves.shuffled_within(e, ["user_id", "event_type"], "event_id", "value", 3).select("event_id", "shuffled")


@query(_SHUFFLED + ", r AS (SELECT k.user_id, k.event_id, k.value, g.value AS s FROM k JOIN g USING (user_id, event_type, i)), d AS (SELECT user_id, value, s, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS a, s - lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM r) SELECT user_id, round(avg(a * a) / nullif(var_pop(value), 0), 6) AS jump_energy, round(avg(b * b) / nullif(var_pop(s), 0), 6) AS shuffled_energy FROM d GROUP BY 1")
def shuffled_jump_energy(spark, sf_dir):
    e = curves.shuffled_within(events(spark, sf_dir).select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id", "value", 3)
    real = sequence.jump_energy(e, "user_id", ["event_id"], "value").select("user_id", rounded("jump_energy").alias("jump_energy"))
    null = sequence.jump_energy(e, "user_id", ["event_id"], "shuffled").select("user_id", rounded("jump_energy").alias("shuffled_energy"))
    return real.join(null, "user_id")


@query(f"WITH {POSITIONS}, n AS (SELECT user_id, t AS i, event_type, CASE WHEN value > 20 THEN event_type ELSE 'click' END AS predicted, count(*) OVER (PARTITION BY user_id) AS n FROM t), e AS (SELECT n.*, d.draw FROM n, range(0, 6) d(draw)), y AS (SELECT user_id, draw, (i + draw * greatest(1, n // 6)) % n AS i, event_type AS y FROM e), m AS (SELECT e.draw, y.y, avg(CASE WHEN y.y = e.predicted THEN 1.0 ELSE 0.0 END) AS r FROM e JOIN y USING (user_id, draw, i) GROUP BY 1, 2) SELECT CAST(draw AS INTEGER) AS draw, round(avg(r), 6) AS balanced_accuracy FROM m GROUP BY 1")
def label_shift_null(spark, sf_dir):
    e = samples(spark, sf_dir).select("user_id", F.col("t").alias("_place"), "event_type", F.when(F.col("value") > 20, F.col("event_type")).otherwise("click").alias("predicted"))
    return curves.permutation_null(e, "event_type", "predicted", "user_id", 5).withColumn("balanced_accuracy", rounded("balanced_accuracy"))


# metrics


@query(f"WITH {CENTRED}, k AS (SELECT label AS c, count(*) AS n, count(*) FILTER (WHERE predicted = label) AS tp FROM p GROUP BY 1), q AS (SELECT predicted AS c, count(*) AS m FROM p GROUP BY 1), f AS (SELECT k.c, k.n, k.tp, 2.0 * k.tp / (k.n + coalesce(q.m, 0)) AS f1 FROM k LEFT JOIN q ON q.c = k.c) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(tp) / sum(n), 6) AS accuracy, round(avg(tp / n), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1 FROM f")
def accuracy_summary(spark, sf_dir):
    from ..operators import moments

    p = moments.nearest_centroid(windows(spark, sf_dir), "vec_id", "label", "embedding")
    return metrics.summary(p, "label", "predicted").select("n", *[rounded(c).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])


@query(f"WITH {CENTRED}, s AS (SELECT cl, label = cl AS pos, round(-d2, 9) AS s FROM d), r AS (SELECT *, rank() OVER (PARTITION BY cl ORDER BY s) + (count(*) OVER (PARTITION BY cl, s) - 1) / 2.0 AS r FROM s), a AS (SELECT cl, sum(r) FILTER (WHERE pos) AS r, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS q FROM r GROUP BY 1) SELECT count(*) AS classes, round(avg((r - p * (p + 1) / 2.0) / (p * q)), 6) AS macro_auc FROM a WHERE p > 0 AND q > 0")
def macro_auc(spark, sf_dir):
    from ..operators import moments

    w = windows(spark, sf_dir)
    d = moments.squared_distances(w.select("vec_id", "label", "embedding"), moments.centre_arrays(w, "label", "embedding"), "embedding", "centre_of")
    s = d.select("centre_label", (F.col("label") == F.col("centre_label")).alias("pos"), F.round(-F.col("d2"), 9).alias("s"))
    return metrics.auc(s, "s", "pos", "centre_label").where("auc is not null").agg(F.count("*").alias("classes"), rounded(F.avg("auc")).alias("macro_auc"))


@query(f"WITH {CENTRED} SELECT view, count(*) AS n, round(avg(hit), 6) AS accuracy FROM (SELECT 'all' AS view, CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END AS hit FROM p UNION ALL SELECT 'task', CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END FROM p WHERE label > 0 UNION ALL SELECT 'rest', CASE WHEN predicted = 0 THEN 1.0 ELSE 0.0 END FROM p WHERE label = 0) GROUP BY 1")
def view_accuracy(spark, sf_dir):
    from ..operators import moments

    p = moments.nearest_centroid(windows(spark, sf_dir), "vec_id", "label", "embedding")
    views = F.array_compact(F.array(F.lit("all"), F.when(F.col("label") > 0, "task"), F.when(F.col("label") == 0, "rest")))
    return p.select(F.explode(views).alias("view"), "label", "predicted").groupBy("view").agg(F.count("*").alias("n"), rounded(F.avg(F.when(F.col("label") == F.col("predicted"), 1.0).otherwise(0.0))).alias("accuracy"))


# sampling


@query("WITH RECURSIVE s AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS i FROM events GROUP BY 1), r AS (SELECT i, user_id, 0 AS fold, n AS f0, CAST(0 AS BIGINT) AS f1, CAST(0 AS BIGINT) AS f2, CAST(0 AS BIGINT) AS f3 FROM s WHERE i = 1 UNION ALL SELECT i, user_id, k, CASE WHEN k = 0 THEN f0 + n ELSE f0 END, CASE WHEN k = 1 THEN f1 + n ELSE f1 END, CASE WHEN k = 2 THEN f2 + n ELSE f2 END, CASE WHEN k = 3 THEN f3 + n ELSE f3 END FROM (SELECT s.i, s.user_id, s.n, r.f0, r.f1, r.f2, r.f3, CASE WHEN r.f0 <= least(r.f1, r.f2, r.f3) THEN 0 WHEN r.f1 <= least(r.f2, r.f3) THEN 1 WHEN r.f2 <= r.f3 THEN 2 ELSE 3 END AS k FROM r JOIN s ON s.i = r.i + 1)) SELECT user_id, CAST(fold AS INTEGER) AS fold FROM r")
def subject_folds(spark, sf_dir):
    return sampling.subject_folds(events(spark, sf_dir), "user_id", 4)


@query("WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id FROM a EXCEPT SELECT DISTINCT user_id FROM b)) + (SELECT count(*) FROM (SELECT DISTINCT user_id FROM b EXCEPT SELECT DISTINCT user_id FROM a)) AS unlike_subjects, (SELECT count(*) FROM (SELECT DISTINCT event_type FROM a EXCEPT SELECT DISTINCT event_type FROM b)) + (SELECT count(*) FROM (SELECT DISTINCT event_type FROM b EXCEPT SELECT DISTINCT event_type FROM a)) AS unlike_labels")
def shared_fold_check(spark, sf_dir):
    e = events(spark, sf_dir)
    return sampling.unlike(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), {"unlike_subjects": "user_id", "unlike_labels": "event_type"})


@query("WITH s AS (SELECT event_id, user_id, event_type, event_id % 3 AS session FROM events), q AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, session ORDER BY md5('0|' || event_id), event_id) AS r FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN r <= 2 THEN 0 ELSE 1 END, r, session, event_id) AS o FROM q) SELECT event_id, user_id, event_type, session FROM k WHERE o <= 6")
def quota_cap(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", (F.col("event_id") % 3).alias("session"))
    return sampling.quota_cap(e, "event_id", ["user_id", "event_type"], "session", 6, 2)


@query("WITH g AS (SELECT a.alpha, l.lam FROM (SELECT unnest([0.1, 0.5, 0.9]) AS alpha) a, (SELECT unnest([0.01, 1.0]) AS lam) l), s AS (SELECT user_id % 5 AS outer_fold, user_id % 3 AS inner_fold, alpha, lam, round(avg(abs(value - 50 * alpha) / (1 + lam)), 6) AS loss FROM events, g GROUP BY 1, 2, 3, 4), m AS (SELECT outer_fold, alpha, lam, count(loss) AS folds, round(avg(loss), 6) AS loss FROM s GROUP BY 1, 2, 3) SELECT outer_fold, arg_min(alpha, (loss, -lam, alpha)) AS alpha, arg_min(lam, (loss, -lam, alpha)) AS lam, min(loss) AS loss FROM m WHERE folds = 3 GROUP BY 1")
def nested_selection(spark, sf_dir):
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(v).alias("lam")) for a in (0.1, 0.5, 0.9) for v in (0.01, 1.0)]))
    e = events(spark, sf_dir).select((F.col("user_id") % 5).alias("outer_fold"), (F.col("user_id") % 3).alias("inner_fold"), "value", grid.alias("g")).select("outer_fold", "inner_fold", "value", "g.alpha", "g.lam")
    scores = e.groupBy("outer_fold", "inner_fold", "alpha", "lam").agg(rounded(F.avg(F.abs(F.col("value") - 50 * F.col("alpha")) / (1 + F.col("lam")))).alias("loss"))
    return sampling.nested_select(scores, "outer_fold", "inner_fold", ["alpha", "lam"], "loss", 3, [-F.col("lam"), F.col("alpha")])
