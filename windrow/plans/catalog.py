"""The registered queries of the engine's own operators, with their SQL oracles.

The tables have no recordings: a user of events stands for a subject, an event
type for a class or phase, an embedding for a window's payload. These
bindings are synthetic.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import align, metrics, moments, paired, ranks, readout, relate, sampling, sequence, updates
from ..sources import tables
from .registry import CENTRED as _C
from .registry import LONG as _X
from .registry import ORACLES, QUERIES, query
from .registry import POSITIONS as _T
from .registry import events as _events
from .registry import rounded as _r
from .registry import samples as _samples
from .registry import windows as _windows

FLAGSHIP = "nearest_centroid_recall"


# scans and labels


@query("SELECT count(*) AS n_rows, count(DISTINCT label) AS n_classes, CAST(min(len(embedding)) AS BIGINT) AS min_dim, CAST(max(len(embedding)) AS BIGINT) AS max_dim, count(*) FILTER (WHERE label IS NULL) AS null_labels FROM embeddings")
def inspect_windows(spark, sf_dir):
    return tables.inspect(_windows(spark, sf_dir), "embedding", "label")


@query("SELECT vec_id, CAST(label AS INTEGER) AS label, CASE WHEN label = 0 THEN 0 WHEN label BETWEEN 1 AND 4 THEN 1 ELSE 2 END AS family, CASE WHEN label > 0 THEN label - 1 END AS task_class FROM embeddings WHERE label <> 9")
def scenario_labels(spark, sf_dir):
    y = F.col("label")
    return tables.scan(spark, sf_dir, "embeddings", "vec_id", "label").where(y != 9).select("vec_id", "label", F.when(y == 0, 0).when(y.between(1, 4), 1).otherwise(2).alias("family"), F.when(y > 0, y - 1).alias("task_class"))


@query("WITH k AS (SELECT DISTINCT label FROM embeddings WHERE label IN (1, 4, 7)), m AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS dense FROM k) SELECT dense, count(*) AS n FROM embeddings JOIN m USING (label) GROUP BY 1")
def dense_relabel(spark, sf_dir):
    rows = tables.scan(spark, sf_dir, "embeddings", "label").where(F.col("label").isin(1, 4, 7))
    classes = rows.select("label").distinct().agg(F.array_sort(F.collect_set("label")).alias("all"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(classes)).select((F.array_position("all", F.col("label")) - 1).cast("long").alias("dense"), "n")


@query(f"WITH {_T}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM t) SELECT DISTINCT user_id, t, event_id FROM n, (SELECT unnest(range(0, 8)) AS i) WHERE n <= 8 OR t = round_even(i * (n - 1) / 7.0, 0)")
def uniform_subsample(spark, sf_dir):
    return sequence.uniform_subsample(_events(spark, sf_dir), "user_id", ["ts", "event_id"], 8).select("user_id", F.col("t").cast("long").alias("t"), "event_id")


@query(f"WITH {_X}, m AS (SELECT dim, avg(v) AS m FROM x GROUP BY 1) SELECT vec_id, round(sum((v - m) * CASE WHEN dim % 2 = 0 THEN 0.125 ELSE -0.125 END), 6) AS axis0, round(sum((v - m) * CASE WHEN dim < 32 THEN 0.125 ELSE -0.125 END), 6) AS axis1 FROM x JOIN m USING (dim) GROUP BY 1")
def linear_projection(spark, sf_dir):
    w = _windows(spark, sf_dir)
    centre = tables.long_form(w.select("embedding")).groupBy("dim").agg(F.avg("v").alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("dim", "m"))).alias("mu"))
    axis = lambda sign: F.aggregate(F.transform("embedding", lambda v, i: (v.cast("double") - F.col("mu")[i]) * sign(i)), F.lit(0.0), lambda s, v: s + v)
    return w.join(F.broadcast(centre)).select("vec_id", _r(axis(lambda i: F.when(i % 2 == 0, 0.125).otherwise(-0.125))).alias("axis0"), _r(axis(lambda i: F.when(i < 32, 0.125).otherwise(-0.125))).alias("axis1"))


# joins and matching


@query("WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders), j AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, a.o_custkey AS ca, b.o_custkey AS cb, a.o_orderstatus AS sa, b.o_orderstatus AS sb FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey), s AS (SELECT count(*) FILTER (WHERE kb IS NULL) AS only_a, count(*) FILTER (WHERE ka IS NULL) AS only_b, count(*) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL AND ca IS DISTINCT FROM cb) AS m1, count(*) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL AND sa IS DISTINCT FROM sb) AS m2 FROM j) SELECT name, mismatches, only_a, only_b, CASE WHEN only_a + only_b > 0 THEN 'row_count_mismatch' WHEN mismatches > 0 THEN 'value_mismatch' ELSE 'pass' END AS status FROM (SELECT 'o_custkey' AS name, m1 AS mismatches, only_a, only_b FROM s UNION ALL SELECT 'o_orderstatus', m2, only_a, only_b FROM s)")
def ledger_difference(spark, sf_dir):
    o = tables.scan(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    b = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return relate.ledger_difference(o.where("o_orderkey % 7 <> 0"), b, "o_orderkey", ["o_custkey", "o_orderstatus"])


@query("WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), e AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events), p AS (SELECT x.v - y.v AS d FROM m x JOIN m y USING (user_id), e WHERE x.event_type = e.a AND y.event_type = e.b) SELECT count(*) AS pairs, round(avg(d), 6) AS mean_difference, count(*) FILTER (WHERE d > 1e-12) AS wins, count(*) FILTER (WHERE abs(d) <= 1e-12) AS ties, count(*) FILTER (WHERE d < -1e-12) AS losses FROM p")
def paired_contrast(spark, sf_dir):
    e = _events(spark, sf_dir)
    ends = F.broadcast(e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")))
    arms = e.groupBy("user_id", "event_type").agg(F.avg("value").alias("v")).join(ends).withColumn("arm", F.when(F.col("event_type") == F.col("a"), "first").when(F.col("event_type") == F.col("b"), "second"))
    return relate.paired_contrast(arms, "user_id", "arm", "v", "first", "second").withColumn("mean_difference", _r("mean_difference"))


@query(f"WITH {_T} SELECT user_id, i.k AS interval_no, count(*) AS n FROM t JOIN (SELECT unnest(range(0, 5)) AS k) i ON t.t >= i.k * 7 AND t.t < i.k * 7 + 5 GROUP BY 1, 2")
def samples_in_intervals(spark, sf_dir):
    s = _samples(spark, sf_dir).select("user_id", "t")
    users = s.select("user_id").distinct()
    spans = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("interval_no")).withColumns({"start": F.col("interval_no") * 7, "stop": F.col("interval_no") * 7 + 5})
    return relate.in_intervals(s, spans, "user_id", "t", "start", "stop", 8).groupBy("user_id", F.col("interval_no").cast("long").alias("interval_no")).agg(F.count("*").alias("n"))


@query(f"WITH {_T} SELECT user_id, t // 7 AS interval_no, count(*) AS n FROM t WHERE t % 7 < 5 GROUP BY 1, 2")
def samples_in_all_intervals(spark, sf_dir):
    """samples_in_intervals with intervals up to each user's last position."""
    s = _samples(spark, sf_dir).select("user_id", "t")
    last = s.groupBy("user_id").agg(F.max("t").alias("last"))
    spans = last.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 7))).alias("interval_no")).withColumns({"start": F.col("interval_no") * 7, "stop": F.col("interval_no") * 7 + 5})
    return relate.in_intervals(s, spans, "user_id", "t", "start", "stop", 8).groupBy("user_id", "interval_no").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)), l AS (SELECT user_id, ts, event_id FROM events JOIN e USING (event_type) WHERE i = 1), r AS (SELECT user_id, ts, max(value) AS value FROM events JOIN e USING (event_type) WHERE i = 2 GROUP BY 1, 2) SELECT l.user_id, l.event_id, round(r.value, 6) AS as_of FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
def as_of_match(spark, sf_dir):
    e = _events(spark, sf_dir)
    names = [r["event_type"] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    left = e.where(F.col("event_type") == names[0]).select("user_id", "ts", "event_id")
    right = e.where(F.col("event_type") == names[-1]).groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return relate.as_of(left, right, "user_id", "ts", "value").select("user_id", "event_id", _r("as_of").alias("as_of"))


@query("SELECT sha256(text) AS digest, count(*) AS copies, count(DISTINCT source) AS groups, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT source) > 1")
def duplicates_across_sources(spark, sf_dir):
    return relate.duplicates_across(tables.scan(spark, sf_dir, "documents", "doc_id", "source", "text"), "text", "source", "doc_id")


@query("WITH e AS (SELECT DISTINCT event_type FROM events), c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2) SELECT user_id, count(*) AS n_tasks FROM c GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM e)")
def eligible_subjects(spark, sf_dir):
    e = _events(spark, sf_dir)
    names = [r[0] for r in e.select("event_type").distinct().collect()]
    return relate.eligible(e, "user_id", "event_type", names, 2)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def members_not_refused(spark, sf_dir):
    o = tables.scan(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").withColumnRenamed("o_custkey", "c_custkey")
    return tables.scan(spark, sf_dir, "customer", "c_custkey").join(o, "c_custkey", "left_semi").join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_anti")


@query(f"WITH {_X}, c AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY 1, 2) SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS distance FROM c a JOIN c b ON a.dim = b.dim AND a.label < b.label GROUP BY 1, 2")
def centroid_pairs(spark, sf_dir):
    c = moments.centroids(tables.long_form(_windows(spark, sf_dir)), "label").select("label", "dim", "mean")
    a, b = c.select(F.col("label").alias("a"), "dim", F.col("mean").alias("x")), c.select(F.col("label").alias("b"), "dim", F.col("mean").alias("y"))
    return a.join(b, "dim").where("a < b").groupBy("a", "b").agg(_r(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2))).alias("distance"))


# aggregates


@query("WITH e AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events) SELECT u.user_id, e.event_type, count(v.event_id) AS n FROM u CROSS JOIN e LEFT JOIN events v ON v.user_id = u.user_id AND v.event_type = e.event_type GROUP BY 1, 2")
def counts_with_zero_cells(spark, sf_dir):
    e = _events(spark, sf_dir)
    classes = F.broadcast(e.agg(F.collect_set("event_type").alias("all")))
    cells = e.groupBy("user_id", "event_type").count()
    by_user = cells.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))
    return by_user.join(classes).select("user_id", "m", F.explode("all").alias("event_type")).select("user_id", "event_type", F.coalesce(F.col("m")[F.col("event_type")], F.lit(0).cast("long")).alias("n"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(CASE WHEN count(value) > 1 THEN stddev_samp(value) / sqrt(count(value)) ELSE 0 END, 6) AS sem, round(median(value), 6) AS median, min(value) AS lowest, max(value) AS highest FROM events GROUP BY 1")
def summary_statistics(spark, sf_dir):
    n, e = F.count("value"), _events(spark, sf_dir).withColumn("value", tables.quiet(F.col("value")))
    sums = e.groupBy("event_type").agg(n.alias("n"), _r(F.avg("value")).alias("mean"), _r(F.stddev_samp("value")).alias("std"), _r(F.when(n > 1, F.stddev_samp("value") / F.sqrt(n)).otherwise(0.0)).alias("sem"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    middle = ranks.percentiles(e, ["event_type"], "value", [0.5]).select(F.col("event_type").alias("_k"), _r("p0").alias("median"))
    return sums.join(middle, F.col("event_type").eqNullSafe(F.col("_k")), "left").drop("_k")


@query("SELECT event_type, round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95, round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY 1")
def quantile_summary(spark, sf_dir):
    p = ranks.percentiles(_events(spark, sf_dir), ["event_type"], "value", [0.01, 0.5, 0.95, 0.99])
    return p.select("event_type", *[_r(f"p{i}").alias(n) for i, n in enumerate(("q01", "q50", "q95", "q99"))])


@query(f"WITH {_X} SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS n FROM x GROUP BY 1, 2")
def class_centroids(spark, sf_dir):
    return moments.centroids(tables.long_form(_windows(spark, sf_dir).select("label", "embedding")), "label").select("label", "dim", _r("mean").alias("mean"), _r("std").alias("std"), "n")


@query("WITH w AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), m AS (SELECT label, covar_samp(a, a) AS aa, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, covar_samp(b, b) AS bb, covar_samp(b, c) AS bc, covar_samp(c, c) AS cc FROM w GROUP BY 1) SELECT label, i, j, round(cov, 6) AS cov FROM (SELECT label, 0 AS i, 0 AS j, aa AS cov FROM m UNION ALL SELECT label, 0, 1, ab FROM m UNION ALL SELECT label, 0, 2, ac FROM m UNION ALL SELECT label, 1, 1, bb FROM m UNION ALL SELECT label, 1, 2, bc FROM m UNION ALL SELECT label, 2, 2, cc FROM m)")
def class_covariance(spark, sf_dir):
    return moments.covariance(_windows(spark, sf_dir), "embedding", 3, "label").withColumn("cov", _r("cov"))


@query(f"WITH {_X} SELECT a.label, CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, round(covar_samp(a.v, b.v), 6) AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY 1, 2, 3")
def class_covariance_whole(spark, sf_dir):
    """class_covariance over all components."""
    return moments.whole_covariance(_windows(spark, sf_dir).select("label", "embedding"), "embedding", "label").withColumn("cov", _r("cov"))


@query("WITH g AS (SELECT event_type, user_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1, 2), k AS (SELECT *, sum(n * m) OVER (PARTITION BY event_type) / sum(n) OVER (PARTITION BY event_type) AS mu FROM g) SELECT event_type, round(sum(n * v), 3) AS within, round(sum(n * (m - mu) * (m - mu)), 3) AS between, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1")
def variance_decomposition(spark, sf_dir):
    return moments.decomposition(_events(spark, sf_dir), "user_id", "value", "event_type").withColumns({"within": _r("within", 3), "between": _r("between", 3)})


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS n_states, round(avg(m), 4) AS balanced_mean, round(sum(n * m) / sum(n), 4) AS plain_mean FROM c GROUP BY 1")
def nested_weight_mean(spark, sf_dir):
    c = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return c.groupBy("user_id").agg(F.count("*").alias("n_states"), _r(F.avg("m"), 4).alias("balanced_mean"), _r(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 4).alias("plain_mean"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, round(sqrt(sum(value * value)), 4) AS root_energy FROM events GROUP BY ROLLUP (event_type)")
def rollup_energy(spark, sf_dir):
    return _events(spark, sf_dir).rollup("event_type").agg(F.count("*").alias("n"), _r(F.sum("value"), 3).alias("total"), _r(F.sqrt(F.sum(F.col("value") * F.col("value"))), 4).alias("root_energy"))


@query(f"WITH {_X}, v AS (SELECT label, dim, var_samp(v) AS s FROM x GROUP BY 1, 2) SELECT label, round(sum(s) * sum(s) / sum(s * s), 5) AS participation_ratio, round(exp(-sum(s / t * ln(s / t + 1e-30))), 5) AS effective_rank FROM (SELECT *, sum(s) OVER (PARTITION BY label) AS t FROM v) GROUP BY 1")
def participation(spark, sf_dir):
    v = tables.long_form(_windows(spark, sf_dir)).groupBy("label", "dim").agg(F.var_samp("v").alias("s")).withColumn("p", F.col("s") / F.sum("s").over(Window.partitionBy("label")))
    return v.groupBy("label").agg(_r(F.sum("s") * F.sum("s") / F.sum(F.col("s") * F.col("s")), 5).alias("participation_ratio"), _r(F.exp(-F.sum(F.col("p") * F.log(F.col("p") + 1e-30))), 5).alias("effective_rank"))


@query("SELECT user_id, count(DISTINCT event_type) AS n_types, count(DISTINCT event_type) = 1 AS single, min(event_type) AS first_type FROM events GROUP BY 1")
def distinct_per_key(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("event_type").alias("n_types"), (F.count_distinct("event_type") == 1).alias("single"), F.min("event_type").alias("first_type"))


# ordered sequences

_SEG = "g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment_id FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events))"


@query(f"WITH {_SEG} SELECT user_id, CAST(segment_id AS BIGINT) AS segment_id, count(*) AS n, min(event_id) AS first_event FROM g GROUP BY 1, 2 HAVING count(*) > 1")
def gap_segments(spark, sf_dir):
    e = _events(spark, sf_dir)
    w = sequence.order("user_id", by=["ts", "event_id"])
    far = F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL '6' HOUR")
    return sequence.segments(e, ["user_id"], ["ts", "event_id"], far).groupBy("user_id", "segment_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).where("n > 1")


@query(f"WITH {_T}, s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY t) THEN 0 ELSE 1 END AS b FROM t), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t) AS r FROM s), k AS (SELECT user_id, r, min(event_type) AS event_type, min(t) AS start, max(t) + 1 AS stop FROM g GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY stop - start DESC, start) AS i FROM k) SELECT user_id, event_type, start, stop FROM q WHERE i <= 3")
def longest_event_runs(spark, sf_dir):
    s = _samples(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("t")
    change = ~F.coalesce(F.col("event_type") == F.lag("event_type").over(w), F.lit(False))
    found = sequence.segments(s, ["user_id"], ["t"], change).groupBy("user_id", "segment_id").agg(F.min("event_type").alias("event_type"), F.min("t").cast("long").alias("start"), (F.max("t") + 1).cast("long").alias("stop"))
    best = F.row_number().over(Window.partitionBy("user_id").orderBy((F.col("stop") - F.col("start")).desc(), "start"))
    return found.withColumn("i", best).where("i <= 3").select("user_id", "event_type", "start", "stop")


@query(f"WITH {_T} SELECT user_id, event_id, t // 4 AS cell FROM t WHERE t >= 1 AND (t - 1) % 4 = 0")
def decimated_grid(spark, sf_dir):
    return sequence.decimated(_samples(spark, sf_dir), "t", 4, 1).select("user_id", "event_id", F.floor(F.col("t") / 4).alias("cell"))


@query(f"WITH {_T}, d AS (SELECT user_id, t, value, value - lag(value) OVER w AS v, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS c FROM t WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, count(v) AS n, round(avg(abs(v)), 6) AS velocity, round(avg(abs(c)), 6) AS curvature FROM d GROUP BY 1")
def velocity_curvature(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("t")
    x, a, b = F.col("value"), F.lag("value").over(w), F.lag("value", 2).over(w)
    return _samples(spark, sf_dir).withColumns({"v": x - a, "c": x - 2 * a + b}).groupBy("user_id").agg(F.count("v").alias("n"), _r(F.avg(F.abs("v"))).alias("velocity"), _r(F.avg(F.abs("c"))).alias("curvature"))


@query("WITH d AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT user_id, count(*) AS n, round(avg(d * d) / nullif(var_pop(value), 0), 6) AS jump_energy FROM d GROUP BY 1")
def jump_energy_ratio(spark, sf_dir):
    return sequence.jump_energy(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value").withColumn("jump_energy", _r("jump_energy"))


@query(f"WITH {_T}, m AS (SELECT user_id, max(t) AS last FROM t GROUP BY 1) SELECT t.user_id, s.s AS start, s.s + 4 AS centre, count(*) AS n, round(avg(t.value), 6) AS mean_value FROM t JOIN m USING (user_id), (SELECT unnest(range(0, 4000, 3)) AS s) s WHERE s.s + 8 <= m.last + 1 AND t.t >= s.s AND t.t < s.s + 8 GROUP BY 1, 2, 3")
def sliding_window_means(spark, sf_dir):
    return sequence.sliding_windows(_samples(spark, sf_dir).select("user_id", "t", "value"), "user_id", "t", 8, 3).groupBy("user_id", "start", "centre").agg(F.count("*").alias("n"), _r(F.avg("value")).alias("mean_value"))


@query(f"WITH {_T} SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS types, bool_and(ok) AS monotone FROM (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY t), true) AS ok FROM t) GROUP BY 1 HAVING count(*) >= 10")
def run_validity(spark, sf_dir):
    ok = F.coalesce(F.col("ts") >= F.lag("ts").over(Window.partitionBy("user_id").orderBy("t")), F.lit(True))
    return _samples(spark, sf_dir).withColumn("ok", ok).groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("types"), F.bool_and("ok").alias("monotone")).where("n >= 10")


_CURVE = f"{_X}, s AS (SELECT label, dim, var_samp(v) AS e FROM x GROUP BY 1, 2), k AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY e DESC, dim) AS k, sum(e) OVER (PARTITION BY label ORDER BY e DESC, dim) / sum(e) OVER (PARTITION BY label) AS q FROM s)"


def _curve(spark, sf_dir):
    v = tables.long_form(_windows(spark, sf_dir)).groupBy("label", "dim").agg(F.var_samp("v").alias("e"))
    w = Window.partitionBy("label").orderBy(F.col("e").desc(), "dim")
    return v.select("label", F.row_number().over(w).alias("k"), (F.sum("e").over(sequence.upto(w)) / F.sum("e").over(Window.partitionBy("label"))).alias("q"))


@query(f"WITH {_CURVE} SELECT label, CAST(k AS INTEGER) AS k, round(q, 6) AS q FROM k")
def cumulative_energy(spark, sf_dir):
    return _curve(spark, sf_dir).withColumn("q", _r("q"))


@query(f"WITH {_CURVE}, m AS (SELECT *, min(q) OVER (PARTITION BY label ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM k) SELECT label, CAST(min(k) FILTER (WHERE later >= 0.9) AS INTEGER) AS cutoff FROM m GROUP BY 1")
def stable_cutoff(spark, sf_dir):
    return sequence.stable_cutoff(_curve(spark, sf_dir), "label", "k", "q", 0.9)


@query(f"WITH {_CURVE}, l AS (SELECT *, lag(k) OVER (PARTITION BY label ORDER BY k) AS pk, lag(q) OVER (PARTITION BY label ORDER BY k) AS pq FROM k), f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k) AS i FROM l WHERE q >= 0.5 AND (pq IS NULL OR pq < 0.5)) SELECT label, round(CASE WHEN pq IS NULL THEN k ELSE pk + (0.5 - pq) / (q - pq) * (k - pk) END, 5) AS crossing FROM f WHERE i = 1")
def first_crossing(spark, sf_dir):
    return sequence.first_crossing(_curve(spark, sf_dir), "label", "k", "q", 0.5).withColumn("crossing", _r("crossing", 5))


@query(f"WITH {_T}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM t) SELECT a.user_id, a.event_id, b.event_type AS shifted FROM n a JOIN n b ON a.user_id = b.user_id AND b.t = (a.t + a.n // 2) % a.n")
def circular_shift(spark, sf_dir):
    s = _samples(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).withColumn("half", F.floor(F.col("n") / 2))
    to = s.select("user_id", F.pmod(F.col("t") - F.col("half"), F.col("n")).alias("t"), F.col("event_type").alias("shifted"))
    return s.select("user_id", F.col("t").cast("long").alias("t"), "event_id").join(to, ["user_id", "t"]).select("user_id", "event_id", "shifted")


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def top_per_key(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return tables.scan(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_custkey AS id, 'both' AS side FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT o_custkey, 'first' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def set_relations(spark, sf_dir):
    o = tables.scan(spark, sf_dir, "orders", "o_custkey", "o_orderstatus")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")) for s in "FO")
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.exceptAll(b).distinct().join(b, "id", "left_anti").withColumn("side", F.lit("first")))


# classification, metrics, nulls


@query(f"WITH {_C} SELECT label, count(*) AS support, round(avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END), 6) AS recall FROM p GROUP BY 1")
def nearest_centroid_recall(spark, sf_dir):
    p = moments.nearest_centroid(_windows(spark, sf_dir), "vec_id", "label", "embedding")
    return metrics.recalls(p, "label", "predicted").withColumn("recall", _r("recall"))


@query(f"WITH {_C} SELECT label, predicted, count(*) AS n FROM p GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(moments.nearest_centroid(_windows(spark, sf_dir), "vec_id", "label", "embedding"), "label", "predicted")


@query(f"WITH {_C} SELECT label, round(avg(margin), 6) AS mean_margin, round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM p GROUP BY 1")
def margin_summary(spark, sf_dir):
    p = moments.nearest_centroid(_windows(spark, sf_dir), "vec_id", "label", "embedding")
    return p.groupBy("label").agg(_r(F.avg("margin")).alias("mean_margin"), _r(F.avg(F.when(F.col("margin") > 0, 1.0).otherwise(0.0))).alias("positive"))


@query("WITH r AS (SELECT user_id, event_type, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS recall FROM events GROUP BY 1, 2), b AS (SELECT user_id, avg(recall) AS b FROM r GROUP BY 1) SELECT count(*) AS subjects, round(avg(b), 6) AS score, round((avg(b) - 0.2) / 0.8, 6) AS retention FROM b")
def subject_balanced_score(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("predicted", F.when(F.col("value") > 50, F.col("event_type")).otherwise("?"))
    b = metrics.balanced_accuracy(e, "event_type", "predicted", "user_id")
    return b.agg(F.count("*").alias("subjects"), _r(F.avg("balanced_accuracy")).alias("score"), _r(metrics.retention(F.avg("balanced_accuracy"), F.lit(1.0), 0.2)).alias("retention"))


@query("WITH v AS (SELECT event_type, floor(value) AS s, user_id % 2 = 0 AS pos FROM events), r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY s) + (count(*) OVER (PARTITION BY event_type, s) - 1) / 2.0 AS r FROM v), a AS (SELECT event_type, sum(r) FILTER (WHERE pos) AS r, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS q FROM r GROUP BY 1) SELECT event_type, round((r - p * (p + 1) / 2.0) / (p * q), 6) AS auc FROM a")
def rank_auc(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_type", F.floor("value").alias("s"), (F.col("user_id") % 2 == 0).alias("pos"))
    return metrics.auc(e, "s", "pos", "event_type").withColumn("auc", _r("auc"))


@query("SELECT event_id, floor(value) AS s, rank() OVER (PARTITION BY event_type ORDER BY floor(value)) + (count(*) OVER (PARTITION BY event_type, floor(value)) - 1) / 2.0 AS rank FROM events WHERE value IS NOT NULL")
def average_ranks(spark, sf_dir):
    e = _events(spark, sf_dir).where("value is not null").select("event_id", "event_type", F.floor("value").cast("double").alias("s"))
    return metrics.average_ranks(e, "s", "event_type").select("event_id", "s", "rank")


@query("WITH m AS (SELECT event_type, avg(value) AS real FROM events GROUP BY 1), u AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY 1, 2) SELECT event_type, round((count(*) FILTER (WHERE v >= real) + 1) / (count(*) + 1), 6) AS p_upper, round((count(*) FILTER (WHERE v <= real) + 1) / (count(*) + 1), 6) AS p_lower FROM u JOIN m USING (event_type) GROUP BY 1")
def permutation_p(spark, sf_dir):
    e = _events(spark, sf_dir)
    draws = e.groupBy("event_type", "user_id").agg(F.avg("value").alias("v")).join(e.groupBy("event_type").agg(F.avg("value").alias("real")), "event_type")
    return metrics.empirical_p(draws, "real", "v", "event_type").select("event_type", _r("p_upper").alias("p_upper"), _r("p_lower").alias("p_lower"))


_P = "p AS (SELECT event_type, user_id, (user_id * 37 % 101 + 1) / 102.0 / (1 + count(*)) AS p FROM events GROUP BY 1, 2)"


@query(f"WITH {_P}, r AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS m, count(*) OVER (PARTITION BY event_type ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM p) SELECT event_type, user_id, round(least(1.0, min(p * m / i) OVER (PARTITION BY event_type ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q FROM r")
def adjusted_p(spark, sf_dir):
    p = _events(spark, sf_dir).groupBy("event_type", "user_id").agg(((F.col("user_id") * 37 % 101 + 1) / 102.0 / (1 + F.count("*"))).alias("p"))
    return metrics.benjamini_hochberg(p, "p", "event_type").select("event_type", "user_id", _r("q", 8).alias("q"))


@query("WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, label, r <= CASE WHEN n > 1 THEN greatest(1, least(round_even(n * 0.25, 0), n - 1)) ELSE 0 END AS is_test FROM r")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(tables.scan(spark, sf_dir, "embeddings", "vec_id", "label"), "vec_id", ["label"], 0.25)


@query("WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('0|' || event_id), event_id) AS r FROM events) SELECT event_id, user_id, event_type FROM r WHERE r <= 4")
def balanced_cap(spark, sf_dir):
    return sampling.balanced_cap(_events(spark, sf_dir).select("event_id", "user_id", "event_type"), "event_id", ["user_id", "event_type"], 4)


@query(f"WITH {_X}, m AS (SELECT dim, avg(v) AS mu, stddev_pop(v) AS sd FROM x GROUP BY 1) SELECT vec_id, round(sum((v - mu) / sd), 5) AS z_sum, round(sum((v - mu) / sd * (v - mu) / sd), 5) AS z_energy FROM x JOIN m USING (dim) GROUP BY 1")
def standardised_energy(spark, sf_dir):
    x = tables.long_form(_windows(spark, sf_dir).select("vec_id", "embedding"))
    m = F.broadcast(x.groupBy("dim").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd")))
    z = F.when(F.col("sd") > 1e-12, (F.col("v") - F.col("mu")) / F.col("sd")).otherwise(0.0)
    return x.join(m, "dim").withColumn("z", z).groupBy("vec_id").agg(_r(F.sum("z"), 5).alias("z_sum"), _r(F.sum(F.col("z") * F.col("z")), 5).alias("z_energy"))


@query(f"WITH {_C}, e AS (SELECT vec_id, cl, exp(-(d2 - min(d2) OVER (PARTITION BY vec_id))) AS e FROM d) SELECT vec_id, cl AS class, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS weight FROM e")
def softmax_weights(spark, sf_dir):
    w = _windows(spark, sf_dir)
    d = moments.squared_distances(w.select("vec_id", "embedding"), moments.centre_arrays(w, "label", "embedding"), "embedding", "centre_of")
    own = Window.partitionBy("vec_id")
    e = d.withColumn("e", F.exp(F.min("d2").over(own) - F.col("d2")))
    return e.select("vec_id", F.col("centre_label").alias("class"), _r(F.col("e") / F.sum("e").over(own)).alias("weight"))


# solves: sums are distributed, the dense finish is small; tests compare them with NumPy


@query()
def linear_discriminant_recall(spark, sf_dir):
    return metrics.recalls(readout.linear_scores(_windows(spark, sf_dir), "vec_id", "label", "embedding"), "label", "predicted")


@query()
def ridge_readout_recall(spark, sf_dir):
    return metrics.recalls(readout.ridge_readout(_windows(spark, sf_dir), "vec_id", "label", "embedding"), "label", "predicted")


@query()
def quadratic_discriminant_recall(spark, sf_dir):
    rows = readout.quadratic_scores(_windows(spark, sf_dir), "vec_id", "label", "embedding", 0.5)
    return metrics.recalls(rows, "label", "predicted").withColumn("recall", _r("recall"))


@query()
def class_covariance_diagnostics(spark, sf_dir):
    return spark.createDataFrame(readout.covariance_diagnostics(moments.sufficient(_windows(spark, sf_dir), "embedding", "label")), "label long, n long, rank int, condition double, log_determinant double")


# paired tests

_D = "d AS (SELECT event_type, round(avg(value) - any_value(m), 6) AS d FROM events JOIN (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) u USING (user_id) GROUP BY event_type, user_id)"


def _differences(spark, sf_dir):
    """Each user's mean of a type less the user's mean."""
    e = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    w = Window.partitionBy("user_id")
    return e.select("event_type", _r(F.col("s") / F.col("n") - F.sum("s").over(w) / F.sum("n").over(w)).alias("d"))


@query(f"WITH {_D}, c AS (SELECT event_type, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d < 0) AS losses FROM d GROUP BY 1) SELECT event_type, wins, losses, round(least(1, 2 * sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2)))), 6) AS p FROM c JOIN range(0, 1000000) r(i) ON i <= least(wins, losses) GROUP BY 1, 2, 3")
def sign_test(spark, sf_dir):
    return paired.sign_test(_differences(spark, sf_dir), "d", "event_type").withColumn("p", _r("p"))


@query(f"WITH {_D}, r AS (SELECT event_type, d, rank() OVER (PARTITION BY event_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY event_type, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY event_type, abs(d)) AS t FROM d WHERE d <> 0), s AS (SELECT event_type, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sum(t * t - 1) AS ties FROM r GROUP BY 1) SELECT event_type, n, CAST(w_plus AS DOUBLE) AS w_plus, CAST(w_minus AS DOUBLE) AS w_minus, round((least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 5) AS z FROM s")
def signed_rank_test(spark, sf_dir):
    return paired.signed_ranks(_differences(spark, sf_dir), "d", "event_type").select("event_type", "n", "w_plus", "w_minus", _r("z", 5).alias("z"))


# alignment and slow features


@query(f"WITH {_X}, m AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY 1, 2), k AS (SELECT label, vec_id, sqrt(sum(m * m)) / sqrt(sum(v * v)) AS q FROM x JOIN m USING (label, dim) GROUP BY 1, 2) SELECT label, round(avg(q), 6) AS displacement FROM k GROUP BY 1")
def centring_displacement(spark, sf_dir):
    moved = align.centred_by(_windows(spark, sf_dir), "embedding", "label")
    return align.relative_displacement(moved, "embedding", "aligned", "label").withColumn("displacement", _r("displacement"))


@query()
def coral_displacement(spark, sf_dir):
    w = _windows(spark, sf_dir)
    source = w.where("label < 5")
    moved = align.affine(source, "embedding", *align.coral(source, w.where("label >= 5"), "embedding"))
    return align.relative_displacement(moved, "embedding", "aligned", "label").withColumn("displacement", _r("displacement"))


@query()
def slow_feature_gammas(spark, sf_dir):
    gammas, _ = align.slow_features(_windows(spark, sf_dir), "label", "vec_id", "embedding")
    return spark.createDataFrame([(i + 1, round(float(g), 6)) for i, g in enumerate(gammas)], "axis int, gamma double")


# update matrices: four consecutive embeddings stand for four tasks of a module, each an 8 x 8 matrix


def _updates(spark, sf_dir):
    return _windows(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 4).alias("module"), (F.col("vec_id") % 4).alias("task"), "embedding")


@query(f"WITH {_X}, s AS (SELECT vec_id, sum(v * v) AS e FROM x GROUP BY 1) SELECT d.vec_id // 4 AS module, d.vec_id % 4 AS task, round(d.e / nullif(b.e, 0), 6) AS energy FROM s d JOIN s b ON d.vec_id // 4 = b.vec_id // 4 AND b.vec_id % 4 = 0 AND d.vec_id % 4 <> 0")
def relative_update_energy(spark, sf_dir):
    u = _updates(spark, sf_dir)
    return updates.relative_energy(u.where("task <> 0"), u.where("task = 0"), "module", "embedding", "task").withColumn("energy", _r("energy"))


@query()
def singular_energy(spark, sf_dir):
    return updates.energy_curve(updates.components(_updates(spark, sf_dir), "vec_id", 8, 8, "embedding"), "vec_id").withColumn("energy", _r("energy"))


@query()
def task_interference(spark, sf_dir):
    u = _updates(spark, sf_dir)
    parts = updates.components(u, "vec_id", 8, 8, "embedding").select("*", F.floor(F.col("vec_id") / 4).alias("module"), (F.col("vec_id") % 4).alias("task"))
    return updates.interference(parts, "module", "task", 0.25).withColumn("interference", _r("interference"))


from . import contracts, curves, spaces, streams  # noqa: E402, F401  (they register their queries)
from . import models, reducers  # noqa: E402, F401, I001  (their SQL builds on that of the others)

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
