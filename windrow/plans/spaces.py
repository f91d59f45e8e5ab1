"""Queries over reduced spaces, discriminants, alignment and the geometry of components.

Where a solve has no SQL, the query's two components have a closed form, or its sums
are ones that any rotation keeps; the operators themselves take any number of dimensions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import align, metrics, moments, ranks, readout, spaces, subspaces, updates
from ..sources import tables
from .registry import LONG, events, query, rounded, windows

_UNIT = f"{LONG}, h AS (SELECT vec_id, label, dim, CASE WHEN dim < 32 THEN 0 ELSE 1 END AS side, v FROM x), n AS (SELECT vec_id, side, sqrt(sum(v * v)) AS s FROM h GROUP BY 1, 2), w AS (SELECT vec_id, label, side, dim % 32 AS k, v / s AS v, s FROM h JOIN n USING (vec_id, side))"


def _norm(lo: int):
    own = F.transform(F.slice("embedding", lo + 1, 32), lambda v: v.cast("double"))
    return own, F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, v: s + v * v))


def _rank_one(spark, sf_dir):
    """The two halves of an embedding as the unit vectors u, v of a rank-one operator, sigma the product of their norms."""
    (a, p), (b, q) = _norm(0), _norm(32)
    w = windows(spark, sf_dir).select("vec_id", "label", a.alias("a"), p.alias("p"), b.alias("b"), q.alias("q"))
    return w.select("vec_id", "label", (F.col("p") * F.col("q")).alias("sigma"), F.transform("a", lambda v: v / F.col("p")).alias("u"), F.transform("b", lambda v: v / F.col("q")).alias("v"))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


# spectra and reducers


@query(f"WITH {LONG}, c AS (SELECT a.label, a.dim AS i, b.dim AS j, covar_samp(a.v, b.v) AS c FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY 1, 2, 3) SELECT label, round(sum(c) FILTER (WHERE i = j), 6) AS total, round(sum(c * c), 8) AS energy, round(power(sum(c) FILTER (WHERE i = j), 2) / sum(c * c), 4) AS participation FROM c GROUP BY 1")
def eigenvalue_sums(spark, sf_dir):
    """Sum and sum of squares of the eigenvalues of each class's covariance, and their participation ratio."""
    values = spaces.spectrum(moments.sufficient(windows(spark, sf_dir), "embedding", "label"))
    rows = [(c, float(v.sum()), float((v * v).sum()), float(v.sum() ** 2 / (v * v).sum())) for c, v in values.items()]
    t = spark.createDataFrame(rows, "label int, total double, energy double, participation double")
    return t.select("label", rounded("total").alias("total"), rounded("energy", 8).alias("energy"), rounded("participation", 4).alias("participation"))


@query(f"WITH {LONG}, m AS (SELECT dim, avg(v) AS m FROM x GROUP BY 1) SELECT vec_id, round(sum((v - m) * (v - m)), 5) AS energy FROM x JOIN m USING (dim) GROUP BY 1")
def pca_energy(spark, sf_dir):
    """Squared length of each window's principal coordinates, all of them: its squared distance to the mean."""
    w = windows(spark, sf_dir)
    mean, axes, _ = spaces.reducer(moments.sufficient(w, "embedding", "label"), 64)
    z = align.affine(w.select("vec_id", "embedding"), "embedding", axes, -mean @ axes, "z")
    return z.select("vec_id", rounded(_dot("z", "z"), 5).alias("energy"))


@query(f"WITH {LONG}, k AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY 1, 2), m AS (SELECT dim, avg(m) AS m FROM k GROUP BY 1) SELECT x.label, round(avg(e), 5) AS mean_energy FROM (SELECT vec_id, label, sum((v - m) * (v - m)) AS e FROM x JOIN m USING (dim) GROUP BY 1, 2) x GROUP BY 1")
def balanced_reducer_energy(spark, sf_dir):
    """The same around the class-balanced mean, by class."""
    w = windows(spark, sf_dir)
    mean, axes, _ = spaces.reducer(moments.sufficient(w, "embedding", "label"), 64, balanced=True)
    z = align.affine(w.select("label", "embedding"), "embedding", axes, -mean @ axes, "z")
    return z.groupBy("label").agg(rounded(F.avg(_dot("z", "z")), 5).alias("mean_energy"))


@query("WITH e AS (SELECT CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, label FROM embeddings), m AS (SELECT var_pop(a) AS p, covar_pop(a, b) AS q, var_pop(b) AS r FROM e), l AS (SELECT (p + r) / 2 + sqrt((p - r) * (p - r) / 4 + q * q) AS hi, (p + r) / 2 - sqrt((p - r) * (p - r) / 4 + q * q) AS lo FROM m) SELECT round(hi / (hi + lo), 6) AS captured, round(sqrt(hi / lo), 5) AS condition FROM l")
def rank_diagnostics(spark, sf_dir):
    stats = moments.sufficient(windows(spark, sf_dir).withColumn("embedding", F.slice("embedding", 1, 2)), "embedding", "label")
    row = (spaces.captured(stats, 1)[0], spaces.captured(stats, 2)[1])
    return spark.createDataFrame([row], "captured double, condition double").select(rounded("captured").alias("captured"), rounded("condition", 5).alias("condition"))


@query(f"WITH {LONG}, w AS (SELECT vec_id, label, dim, v, 1.0 / count(*) OVER (PARTITION BY label, dim) AS w FROM x WHERE dim < 8), m AS (SELECT dim, sum(w * v) / sum(w) AS m FROM w GROUP BY 1) SELECT CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, round(sum(a.w * (a.v - p.m) * (b.v - q.m)) / sum(a.w), 8) AS cov FROM w a JOIN w b ON a.vec_id = b.vec_id AND a.dim <= b.dim JOIN m p ON p.dim = a.dim JOIN m q ON q.dim = b.dim GROUP BY 1, 2")
def weighted_covariance(spark, sf_dir):
    """Class-balanced covariance of eight components."""
    stats = moments.sufficient(windows(spark, sf_dir).withColumn("embedding", F.slice("embedding", 1, 8)), "embedding", "label")
    _, cov, _ = spaces.covariance_of(stats, balanced=True)
    return spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(8) for j in range(i, 8)], "i int, j int, cov double").withColumn("cov", rounded("cov", 8))


@query(f"WITH {LONG}, s AS (SELECT label, vec_id % 3 AS session, vec_id, dim, v FROM x), m AS (SELECT label, session, dim, avg(v) AS m, count(*) AS n FROM s GROUP BY 1, 2, 3), g AS (SELECT label, dim, avg(v) AS m FROM s GROUP BY 1, 2), w AS (SELECT s.label, sum((s.v - m.m) * (s.v - m.m)) AS w FROM s JOIN m USING (label, session, dim) GROUP BY 1), b AS (SELECT m.label, sum(m.n * (m.m - g.m) * (m.m - g.m)) AS b FROM m JOIN g USING (label, dim) GROUP BY 1) SELECT label, round(w, 5) AS within, round(b, 5) AS between FROM w JOIN b USING (label)")
def session_decomposition(spark, sf_dir):
    """Traces of the within- and between-session scatter matrices of each class; their sum is the class's scatter."""
    x = tables.long_form(windows(spark, sf_dir).withColumn("session", F.col("vec_id") % 3))
    parts = moments.decomposition(x, "session", "v", "label", "dim")
    return parts.groupBy("label").agg(rounded(F.sum("within"), 5).alias("within"), rounded(F.sum("between"), 5).alias("between"))


@query(f"WITH {LONG}, d AS (SELECT label, vec_id % 3 AS segment, dim, v - lag(v) OVER (PARTITION BY label, vec_id % 3, dim ORDER BY vec_id) AS d FROM x), s AS (SELECT label, segment, dim, avg(d * d) AS e FROM d WHERE d IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT label, dim, avg(e) AS e FROM s GROUP BY 1, 2) SELECT label, round(sum(e), 6) AS step_energy FROM r GROUP BY 1")
def step_energy(spark, sf_dir):
    """Trace of the covariance of steps, averaged over segments, then over the segments of a class."""
    x = tables.long_form(windows(spark, sf_dir).withColumn("segment", F.col("vec_id") % 3))
    d = F.col("v") - F.lag("v").over(Window.partitionBy("label", "segment", "dim").orderBy("vec_id"))
    s = x.withColumn("d", d).where("d is not null").groupBy("label", "segment", "dim").agg(F.avg(F.col("d") * F.col("d")).alias("e"))
    return s.groupBy("label", "dim").agg(F.avg("e").alias("e")).groupBy("label").agg(rounded(F.sum("e"), 6).alias("step_energy"))


# discriminants in two components

_TWO = "t AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings WHERE label < 2)"
_FIT = f"{_TWO}, m AS (SELECT label, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS p, covar_samp(a, b) AS q, var_samp(b) AS r FROM t GROUP BY 1), o AS (SELECT avg(p) AS p, avg(q) AS q, avg(r) AS r FROM m)"


def _pair(spark, sf_dir):
    return windows(spark, sf_dir).where("label < 2").withColumn("embedding", F.slice("embedding", 1, 2))


@query(f"WITH {_FIT}, w AS (SELECT sum((n - 1) * p) / (sum(n) - 2) AS p, sum((n - 1) * q) / (sum(n) - 2) AS q, sum((n - 1) * r) / (sum(n) - 2) AS r FROM m), l AS (SELECT p + 1e-4 * (p + r) / 2 AS p, q, r + 1e-4 * (p + r) / 2 AS r FROM w), d AS (SELECT max(ma) FILTER (WHERE label = 1) - max(ma) FILTER (WHERE label = 0) AS x, max(mb) FILTER (WHERE label = 1) - max(mb) FILTER (WHERE label = 0) AS y FROM m), k AS (SELECT (r * x - q * y) AS x, (p * y - q * x) AS y FROM l, d) SELECT round(abs(x) / sqrt(x * x + y * y), 5) AS first, round(abs(y) / sqrt(x * x + y * y), 5) AS second FROM k")
def fisher_axis(spark, sf_dir):
    axes, _ = readout.fisher_axes(moments.sufficient(_pair(spark, sf_dir), "embedding", "label"))
    return spark.createDataFrame([(float(abs(axes[0, 0])), float(abs(axes[1, 0])))], "first double, second double").select(rounded("first", 5).alias("first"), rounded("second", 5).alias("second"))


@query(f"WITH {_FIT}, g AS (SELECT m.label AS c, z.alpha, ma, mb, (1 - z.alpha) * m.p + z.alpha * o.p AS p, (1 - z.alpha) * m.q + z.alpha * o.q AS q, (1 - z.alpha) * m.r + z.alpha * o.r AS r FROM m, o, (SELECT unnest([0.0, 0.5, 1.0]) AS alpha) z), s AS (SELECT t.vec_id, t.label, g.alpha, g.c, -0.5 * (ln(p * r - q * q) + (r * (a - ma) * (a - ma) - 2 * q * (a - ma) * (b - mb) + p * (b - mb) * (b - mb)) / (p * r - q * q)) AS s FROM t, g), k AS (SELECT vec_id, label, alpha, arg_max(c, s) AS c FROM s GROUP BY 1, 2, 3) SELECT CAST(alpha AS DOUBLE) AS alpha, label, count(*) AS support, round(avg(CASE WHEN c = label THEN 1.0 ELSE 0.0 END), 6) AS recall FROM k GROUP BY 1, 2")
def quadratic_grid(spark, sf_dir):
    w = _pair(spark, sf_dir)
    weights = spaces.quadratic_weights(moments.sufficient(w, "embedding", "label"), [0.0, 0.5, 1.0])
    p = spaces.quadratic_grid(w, "vec_id", "label", "embedding", weights)
    return metrics.recalls(p, "label", "predicted", "alpha").withColumn("recall", rounded("recall"))


@query(f"WITH {_FIT} SELECT label, n, CAST(2 AS INTEGER) AS rank, round(((p + r) / 2 + sqrt((p - r) * (p - r) / 4 + q * q)) / ((p + r) / 2 - sqrt((p - r) * (p - r) / 4 + q * q)), 5) AS condition, round(ln(p * r - q * q), 5) AS log_determinant FROM m")
def pair_covariance_diagnostics(spark, sf_dir):
    rows = readout.covariance_diagnostics(moments.sufficient(_pair(spark, sf_dir), "embedding", "label"))
    t = spark.createDataFrame(rows, "label int, n long, rank int, condition double, log_determinant double")
    return t.withColumns({"condition": rounded("condition", 5), "log_determinant": rounded("log_determinant", 5)})


_AXES = "f AS (SELECT vec_id, label, vec_id % 2 = 0 AS train, CAST(embedding[1] AS DOUBLE) AS l, CAST(embedding[2] AS DOUBLE) AS q FROM embeddings), g AS (SELECT *, q - l AS r FROM f), s AS (SELECT avg(l) AS ml, stddev_pop(l) AS sl, avg(q) AS mq, stddev_pop(q) AS sq, avg(r) AS mr, stddev_pop(r) AS sr FROM g WHERE train), z AS (SELECT vec_id, train, (l - ml) / sl AS l, (q - mq) / sq AS q, (r - mr) / sr AS r FROM g, s), c AS (SELECT avg(l * r) AS m, stddev_pop(l * r) AS s FROM z WHERE train)"


@query(f"WITH {_AXES} SELECT vec_id, round(l, 5) AS f0, round(q, 5) AS f1, round(l + 2 * r, 5) AS f2, round(l + 2 * r + 3 * (l * r - m) / s, 5) AS f3 FROM z, c")
def feature_arms(spark, sf_dir):
    """The four arms for one linear and one quadratic score, each as a weighted sum of its features."""
    w = windows(spark, sf_dir).select("vec_id", F.col("embedding")[0].cast("double").alias("l"), F.col("embedding")[1].cast("double").alias("q"))
    arms = spaces.feature_arms(w, ["l"], ["q"], F.col("vec_id") % 2 == 0, ["vec_id"])
    total = lambda a: rounded(F.aggregate(F.transform(a, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 5)
    return arms.select("vec_id", *[total(f"f{i}").alias(f"f{i}") for i in range(4)])


@query(f"WITH {LONG}, c AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY 1, 2), p AS (SELECT a.label AS a, b.label AS b, a.dim, b.m - a.m AS w, (a.m + b.m) / 2 AS mid FROM c a JOIN c b ON a.dim = b.dim AND a.label < b.label), s AS (SELECT p.a, p.b, x.vec_id, x.label = p.b AS pos, round(sum((x.v - p.mid) * p.w), 9) AS s FROM x JOIN p ON x.dim = p.dim AND x.label IN (p.a, p.b) GROUP BY 1, 2, 3, 4), r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY s) + (count(*) OVER (PARTITION BY a, b, s) - 1) / 2.0 AS r FROM s) SELECT a, b, round((avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE pos) + avg(CASE WHEN s <= 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT pos)) / 2, 6) AS balanced_accuracy, round((sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc FROM r GROUP BY 1, 2")
def pairwise_axes(spark, sf_dir):
    """Each pair of classes on the axis between their centroids, cut at the midpoint."""
    w = windows(spark, sf_dir)
    c = moments.centre_arrays(w, "label", "embedding")
    pairs = c.select(F.col("centre_of").alias("a"), F.col("centre").alias("x")).join(c.select(F.col("centre_of").alias("b"), F.col("centre").alias("y")), F.col("a") < F.col("b"))
    sides = pairs.withColumn("side", F.explode(F.array("a", "b")))
    mid = F.zip_with("x", "y", lambda p, q: (p + q) / 2)
    score = _dot(F.zip_with("embedding", mid, lambda v, m: v.cast("double") - m), F.zip_with("x", "y", lambda p, q: q - p))
    s = w.join(F.broadcast(sides), F.col("label") == F.col("side")).select("a", "b", (F.col("label") == F.col("b")).alias("pos"), F.round(score, 9).alias("s"))
    share = lambda hit, pos: F.avg(F.when(F.col("pos") == pos, F.when(hit, 1.0).otherwise(0.0)))
    b = s.groupBy("a", "b").agg(rounded((share(F.col("s") > 0, True) + share(F.col("s") <= 0, False)) / 2).alias("balanced_accuracy"))
    return b.join(metrics.auc(s, "s", "pos", "a", "b").withColumn("auc", rounded("auc")), ["a", "b"])


@query(f"WITH {LONG}, c AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY 1, 2), p AS (SELECT a.label AS a, b.label AS b, a.dim, b.m - a.m AS w FROM c a JOIN c b ON a.dim = b.dim AND a.label < b.label), n AS (SELECT a, b, sqrt(sum(w * w)) AS n FROM p GROUP BY 1, 2) SELECT p.a, p.b, q.a AS c, q.b AS d, round(sum(p.w * q.w) / any_value(s.n * t.n), 5) AS cosine FROM p JOIN q AS q ON p.dim = q.dim AND (p.a, p.b) < (q.a, q.b) JOIN n s ON s.a = p.a AND s.b = p.b JOIN n t ON t.a = q.a AND t.b = q.b GROUP BY 1, 2, 3, 4".replace("p JOIN q AS q", "p JOIN p AS q"))
def axis_alignment(spark, sf_dir):
    """Cosines between the axes of all pairs of classes."""
    c = moments.centre_arrays(windows(spark, sf_dir), "label", "embedding")
    p = c.select(F.col("centre_of").alias("a"), F.col("centre").alias("x")).join(c.select(F.col("centre_of").alias("b"), F.col("centre").alias("y")), F.col("a") < F.col("b")).select("a", "b", F.zip_with("x", "y", lambda s, t: t - s).alias("w"))
    q = p.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("w").alias("z"))
    later = (F.col("a") < F.col("c")) | ((F.col("a") == F.col("c")) & (F.col("b") < F.col("d")))
    return p.join(q, later).select("a", "b", "c", "d", rounded(_dot("w", "z") / F.sqrt(_dot("w", "w") * _dot("z", "z")), 5).alias("cosine"))


@query(f"WITH {LONG}, t AS (SELECT label, dim, avg(v) AS m FROM x WHERE vec_id % 2 = 0 GROUP BY 1, 2), d AS (SELECT x.vec_id, x.label, t.label AS cl, sum((v - m) * (v - m)) AS d2 FROM x JOIN t USING (dim) WHERE vec_id % 2 = 1 GROUP BY 1, 2, 3), p AS (SELECT vec_id, label, arg_min(cl, (d2, cl)) AS c FROM d GROUP BY 1, 2), n AS (SELECT label, c, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE vec_id % 2 = 0) AS n0 FROM embeddings GROUP BY 1) SELECT p.label AS subject, count(*) AS n, round(avg(CASE WHEN c = p.label THEN 1.0 ELSE 0.0 END), 6) AS identified, (SELECT arg_max(c, (n.n, -c)) FROM n WHERE n.label = p.label) AS top FROM p GROUP BY 1")
def identity_probe(spark, sf_dir):
    """How often a held-out window is nearest to its own subject's centroid, and the subject most often found."""
    w = windows(spark, sf_dir)
    c = moments.centre_arrays(w.where("vec_id % 2 = 0"), "label", "embedding")
    d = moments.squared_distances(w.where("vec_id % 2 = 1"), c, "embedding", "centre_of")
    p = d.groupBy("vec_id", "label").agg(F.min_by("centre_label", F.struct("d2", "centre_label")).alias("c"))
    cells = p.groupBy("label", "c").agg(F.count("*").alias("n"))
    return cells.groupBy(F.col("label").alias("subject")).agg(F.sum("n").alias("n"), rounded(F.sum(F.when(F.col("c") == F.col("label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("identified"), F.max_by("c", F.struct(F.col("n"), -F.col("c"))).alias("top"))


@query("WITH s AS (SELECT user_id, event_type, event_id % 4 = 0 AS test, value FROM events), n AS (SELECT user_id, event_type, count(*) FILTER (WHERE NOT test) AS a, count(*) FILTER (WHERE test) AS b, avg(value) FILTER (WHERE NOT test) AS m FROM s GROUP BY 1, 2), u AS (SELECT user_id, count(*) FILTER (WHERE a > 0 AND b > 0) AS classes FROM n GROUP BY 1), d AS (SELECT s.user_id, s.event_type, s.value, arg_min(n.event_type, (round(abs(s.value - n.m), 9), n.event_type)) AS c FROM s JOIN n USING (user_id) WHERE s.test AND n.a > 0 AND n.b > 0 GROUP BY s.user_id, s.event_type, s.value), h AS (SELECT d.user_id, d.event_type, avg(CASE WHEN c = d.event_type THEN 1.0 ELSE 0.0 END) AS r FROM d JOIN n USING (user_id, event_type) WHERE n.a > 0 AND n.b > 0 GROUP BY 1, 2), k AS (SELECT user_id, avg(r) AS b FROM h GROUP BY 1) SELECT u.user_id, CASE WHEN u.classes < 2 THEN 'fewer than two classes' ELSE 'ok' END AS status, round(CASE WHEN u.classes >= 2 THEN k.b END, 6) AS balanced_accuracy FROM u LEFT JOIN k USING (user_id)")
def self_readout(spark, sf_dir):
    """Each subject's own classes read out of its own samples, with the reason where that cannot be."""
    e = events(spark, sf_dir).select("user_id", "event_type", (F.col("event_id") % 4 == 0).alias("test"), "value").distinct()
    raw = events(spark, sf_dir).withColumn("test", F.col("event_id") % 4 == 0)
    n = raw.groupBy("user_id", "event_type").agg(F.count_if(~F.col("test")).alias("a"), F.count_if("test").alias("b"), F.avg(F.when(~F.col("test"), F.col("value"))).alias("m"))
    both = n.where("a > 0 and b > 0")
    models = both.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("c"), "m")).alias("models"), F.count("*").alias("classes"))
    users = n.select("user_id").distinct().join(models, "user_id", "left").withColumn("classes", F.coalesce("classes", F.lit(0).cast("long")))
    found = F.array_min(F.transform("models", lambda x: F.struct(F.round(F.abs(F.col("value") - x["m"]), 9).alias("d"), x["c"].alias("c"))))["c"]
    p = e.where("test").join(users, "user_id").where(F.exists("models", lambda x: x["c"] == F.col("event_type"))).withColumn("c", found)
    b = metrics.balanced_accuracy(p, "event_type", "c", "user_id")
    return users.join(b, "user_id", "left").select("user_id", F.when(F.col("classes") < 2, "fewer than two classes").otherwise("ok").alias("status"), rounded(F.when(F.col("classes") >= 2, F.col("balanced_accuracy"))).alias("balanced_accuracy"))


_DRAWS = 3


@query(f"WITH {LONG}, o AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings), j AS (SELECT d.draw, vec_id, row_number() OVER (PARTITION BY d.draw ORDER BY md5(d.draw || '|' || vec_id), vec_id) AS i FROM embeddings, range(1, {_DRAWS + 1}) d(draw)), y AS (SELECT 0 AS draw, vec_id, label FROM o UNION ALL SELECT j.draw, j.vec_id, o.label FROM j JOIN o USING (i)), c AS (SELECT y.draw, y.label, dim, count(*) AS n, avg(v) AS m FROM x JOIN y USING (vec_id) GROUP BY 1, 2, 3), g AS (SELECT dim, avg(v) AS m FROM x GROUP BY 1) SELECT CAST(c.draw AS INTEGER) AS draw, round(sum(c.n * (c.m - g.m) * (c.m - g.m)), 4) AS between FROM c JOIN g USING (dim) GROUP BY 1".replace("y.label, dim, count(*)", "y.label, x.dim, count(*)"))
def between_class_null(spark, sf_dir):
    """Trace of the between-class scatter under permuted labels; draw 0 is the real one."""
    w = windows(spark, sf_dir)
    real = w.select("vec_id", "label", F.lit(0).alias("draw"))
    every = w.select("vec_id", "label", F.explode(F.sequence(F.lit(1), F.lit(_DRAWS))).alias("draw"))
    every = every.withColumn("_h", F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.col("vec_id").cast("string"))))
    own = ranks.places(ranks.places(every, ["draw"], ["vec_id"], "_i"), ["draw"], ["_h", "vec_id"], "_j")
    given = own.select("draw", F.col("_i").alias("_j"), "label")
    labels = real.union(own.select("draw", "vec_id", "_j").join(given, ["draw", "_j"]).select("vec_id", "label", "draw"))
    x = tables.long_form(w.select("vec_id", "embedding")).join(labels, "vec_id")
    parts = moments.decomposition(x, "label", "v", "draw", "dim")
    return parts.groupBy("draw").agg(rounded(F.sum("between"), 4).alias("between"))


# alignment


@query(f"WITH {LONG}, k AS (SELECT dim, CASE WHEN dim < 32 THEN 0 ELSE 1 END AS part, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY 1, 2), p AS (SELECT CASE WHEN dim < 32 THEN 0 ELSE 1 END AS part, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY 1), a AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM x) SELECT x.vec_id, round(sum(abs((x.v - a.m) / greatest(a.s, 1e-8))), 4) AS all_global, round(sum(abs((x.v - p.m) / greatest(p.s, 1e-8))), 4) AS part_global, round(sum(abs((x.v - k.m) / greatest(k.s, 1e-8))), 4) AS channelwise FROM x JOIN k USING (dim) JOIN p ON p.part = k.part, a GROUP BY 1")
def normalisation_modes(spark, sf_dir):
    """Size of each window after normalisation over all components, over each half, and component by component."""
    x = tables.long_form(windows(spark, sf_dir).select("vec_id", "embedding")).withColumn("part", F.when(F.col("dim") < 32, 0).otherwise(1))
    out = x
    for name, keys in (("all_global", []), ("part_global", ["part"]), ("channelwise", ["part", "dim"])):
        own = x.groupBy(*keys).agg(F.avg("v").alias(f"m_{name}"), F.stddev_pop("v").alias(f"s_{name}"))
        out = out.join(F.broadcast(own), keys) if keys else out.join(F.broadcast(own))
    z = lambda n: rounded(F.sum(F.abs((F.col("v") - F.col(f"m_{n}")) / F.greatest(F.col(f"s_{n}"), F.lit(1e-8)))), 4).alias(n)
    return out.groupBy("vec_id").agg(z("all_global"), z("part_global"), z("channelwise"))


@query(f"WITH {LONG}, e AS (SELECT vec_id, label, dim, v, row_number() OVER (PARTITION BY label, dim ORDER BY v) AS r FROM x WHERE label < 2 AND dim < 4), n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM embeddings WHERE label < 2 GROUP BY label)), k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings WHERE label < 2), s AS (SELECT x.label, x.dim, x.v, row_number() OVER (PARTITION BY x.label, x.dim ORDER BY x.v) AS r FROM x JOIN k ON k.vec_id = x.vec_id, n WHERE x.dim < 4 AND k.i <= n.n) SELECT CAST(a.dim AS INTEGER) AS direction, round(avg((a.v - b.v) * (a.v - b.v)), 7) AS distance FROM s a JOIN s b ON a.dim = b.dim AND a.r = b.r AND a.label = 0 AND b.label = 1 GROUP BY 1")
def sliced_distance(spark, sf_dir):
    """Sliced Wasserstein distances of two classes' equally many windows along four axes."""
    w = windows(spark, sf_dir).where("label < 2").withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    least = w.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n").alias("n"))
    w = w.join(F.broadcast(least)).where("i <= n")
    return spaces.sliced_wasserstein(w.where("label = 0"), w.where("label = 1"), "embedding", np.eye(64)[:4]).withColumn("distance", rounded("distance", 7))


@query(f"WITH {LONG}, c AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY 1, 2), g AS (SELECT dim, avg(v) AS m FROM x GROUP BY 1), o AS (SELECT vec_id % 10 AS subject, dim, avg(v) AS m FROM x GROUP BY 1, 2), f AS (SELECT o.subject, o.dim, o.m - g.m AS f FROM o JOIN g USING (dim)), p AS (SELECT a.label AS a, b.label AS b, a.dim, b.m - a.m AS w FROM c a JOIN c b ON a.dim = b.dim AND a.label < b.label) SELECT subject, a, b, round(sum(f * w) / sqrt(sum(w * w)), 6) AS along, round(sum(f * w) / sqrt(sum(w * w)) / sqrt(sum(f * f)), 5) AS share FROM f JOIN p USING (dim) GROUP BY 1, 2, 3")
def boundary_offsets(spark, sf_dir):
    """Each subject's offset from the grand mean along every difference of class centroids."""
    w = windows(spark, sf_dir).withColumn("subject", F.col("vec_id") % 10)
    c = moments.centre_arrays(w, "label", "embedding")
    p = c.select(F.col("centre_of").alias("a"), F.col("centre").alias("x")).join(c.select(F.col("centre_of").alias("b"), F.col("centre").alias("y")), F.col("a") < F.col("b")).select("a", "b", F.zip_with("x", "y", lambda s, t: t - s).alias("w"))
    grand = moments.centre_arrays(w.withColumn("_one", F.lit(0)), "_one", "embedding").select(F.col("centre").alias("g"))
    own = moments.centre_arrays(w, "subject", "embedding").join(F.broadcast(grand)).select(F.col("centre_of").alias("subject"), F.zip_with("centre", "g", lambda s, t: s - t).alias("f"))
    along = _dot("f", "w") / F.sqrt(_dot("w", "w"))
    # both tables hold a row for each of a few groups
    return own.crossJoin(F.broadcast(p)).select("subject", "a", "b", rounded(along).alias("along"), rounded(along / F.sqrt(_dot("f", "f")), 5).alias("share"))


# geometry of components

_CTX = f"{_UNIT}, z AS (SELECT label, min(vec_id) AS p, max(vec_id) AS q FROM embeddings GROUP BY 1), d AS (SELECT a.vec_id, b.vec_id AS other, a.side, sum(a.v * b.v) AS s FROM w a JOIN z ON z.label = (a.label + 1) % 10 JOIN w b ON b.side = a.side AND b.k = a.k AND b.vec_id IN (z.p, z.q) GROUP BY 1, 2, 3), i AS (SELECT vec_id, other, product(s) AS g FROM d GROUP BY 1, 2), c AS (SELECT z.label, product(s) AS c FROM (SELECT z.label, a.side, sum(a.v * b.v) AS s FROM z JOIN w a ON a.vec_id = z.p JOIN w b ON b.vec_id = z.q AND b.side = a.side AND b.k = a.k GROUP BY 1, 2) z GROUP BY 1), f AS (SELECT e.vec_id, e.label, (g1.g * g1.g + g2.g * g2.g - 2 * c.c * g1.g * g2.g) / (1 - c.c * c.c) AS p FROM embeddings e JOIN z ON z.label = (e.label + 1) % 10 JOIN c ON c.label = z.label JOIN i g1 ON g1.vec_id = e.vec_id AND g1.other = z.p JOIN i g2 ON g2.vec_id = e.vec_id AND g2.other = z.q WHERE z.p <> z.q)"


def _fractions(spark, sf_dir):
    """vec_id, label, sigma and the share of each rank-one operator in the span of two operators of the next class."""
    from collections.abc import Iterator

    import pandas as pd

    r = _rank_one(spark, sf_dir)
    ends = r.groupBy(((F.col("label") + 9) % 10).alias("label")).agg(F.min_by(F.struct("u", "v"), "vec_id").alias("p"), F.max_by(F.struct("u", "v"), "vec_id").alias("q"), (F.min("vec_id") != F.max("vec_id")).alias("two")).where("two")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, y, s, u, v, pu, pv, qu, qv in f.itertuples(index=False):
                p = spaces.projection_fractions(np.array(u)[:, None], np.array(v)[:, None], np.array([pu, qu]).T, np.array([pv, qv]).T)
                out.append((i, y, s, float(p[0])))
            yield pd.DataFrame(out, columns=["vec_id", "label", "sigma", "fraction"])

    met = r.join(F.broadcast(ends), "label").select("vec_id", "label", "sigma", "u", "v", F.col("p.u").alias("pu"), F.col("p.v").alias("pv"), F.col("q.u").alias("qu"), F.col("q.v").alias("qv"))
    return met.mapInPandas(run, "vec_id long, label int, sigma double, fraction double")


@query(f"WITH {_CTX} SELECT vec_id, round(greatest(0, least(1, p)), 6) AS fraction FROM f")
def projection_fractions(spark, sf_dir):
    return _fractions(spark, sf_dir).select("vec_id", rounded("fraction").alias("fraction"))


@query(f"WITH {_CTX}, s AS (SELECT vec_id, product(s) AS sigma FROM n GROUP BY 1), t AS (SELECT f.label, f.vec_id, s.sigma * s.sigma AS e, f.p FROM f JOIN s USING (vec_id)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(e, 10) DESC, vec_id) AS k FROM t) SELECT label, CAST(k AS INTEGER) AS k, round(sum(e * p) OVER (PARTITION BY label ORDER BY k) / sum(e) OVER (PARTITION BY label), 6) AS shared FROM r")
def shared_energy_spectrum(spark, sf_dir):
    """Energy of a class's components, by falling energy, that lies in the context's span, over all its energy."""
    f = _fractions(spark, sf_dir).withColumn("e", F.col("sigma") * F.col("sigma"))
    w = Window.partitionBy("label")
    r = f.withColumn("k", F.row_number().over(w.orderBy(F.round("e", 10).desc(), "vec_id")))
    run = F.sum(F.col("e") * F.col("fraction")).over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return r.select("label", "k", rounded(run / F.sum("e").over(w)).alias("shared"))


@query(f"WITH {_CTX}, a AS (SELECT label, vec_id, degrees(acos(sqrt(greatest(0, least(1, p))))) AS a FROM f) SELECT CAST(row_number() OVER (ORDER BY round(a, 6), vec_id) AS INTEGER) AS place, vec_id, round(a, 4) AS angle FROM a")
def angle_spectrum(spark, sf_dir):
    """Principal angles between each component and the context's span, pooled and sorted."""
    a = _fractions(spark, sf_dir).select("vec_id", F.degrees(F.acos(F.sqrt("fraction"))).alias("a"))
    # ranks by range-sorted parts: counts of the parts before give each its first place
    ordered = a.select("vec_id", F.round("a", 6).alias("r"), F.round("a", 4).alias("angle")).withColumn("part", F.floor("r"))
    before = ordered.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ordered.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("r", "vec_id"))).join(F.broadcast(before), "part")
    return placed.select((F.col("before") + F.col("i")).cast("int").alias("place"), "vec_id", "angle")


@query(f"WITH {LONG}, c AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1) SELECT a.label AS a, b.label AS b, round(degrees(acos(least(1, abs(sum(a.m * b.m) / any_value(s.n * t.n))))), 4) AS angle, round(power(sum(a.m * b.m) / any_value(s.n * t.n), 2), 6) AS overlap FROM c a JOIN c b ON a.dim = b.dim AND a.label < b.label JOIN n s ON s.label = a.label JOIN n t ON t.label = b.label GROUP BY 1, 2")
def principal_angles(spark, sf_dir):
    """Angle and overlap (mean squared cosine) of the lines through the class centroids, for each pair of classes."""
    c = moments.centre_arrays(windows(spark, sf_dir), "label", "embedding").where("centre_of is not null")
    spans = c.select(F.lit(0).alias("all"), "centre_of", F.array("centre").alias("basis"), F.lit(1).alias("support"), F.size("centre").alias("ambient"))
    t = subspaces.fold_stability(spans, ["all"], "centre_of", "basis").select(F.col("fold_a").alias("a"), F.col("fold_b").alias("b"), F.col("max_angle").alias("angle"))
    return t.select("a", "b", rounded("angle", 4).alias("angle"), rounded(F.pow(F.cos(F.radians("angle")), 2)).alias("overlap"))


@query("WITH q AS (SELECT i / 20.0 AS fraction FROM range(0, 21) r(i)), f AS (SELECT n_nationkey + 4 AS full_rank FROM nation) SELECT full_rank, CAST(ceil(full_rank * fraction - 1e-9) AS INTEGER) AS rank, CAST(min(fraction) AS DOUBLE) AS fraction FROM f, q GROUP BY 1, 2")
def natural_grid(spark, sf_dir):
    """The distinct ranks that a grid of fractions keeps of each full rank, with the least fraction of each."""
    q = F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: i / 20.0))
    f = tables.scan(spark, sf_dir, "nation", "n_nationkey").select((F.col("n_nationkey") + 4).cast("long").alias("full_rank"), q.alias("fraction"))
    return f.groupBy("full_rank", spaces.rank_for_fraction(F.col("full_rank"), F.col("fraction")).alias("rank")).agg(F.min("fraction").alias("fraction"))


@query("SELECT p_partkey, round(greatest(0, least(1, p_size / 64.0 + 1.6448536269514722 * sqrt(2.0 * p_size * (64 - p_size) / (64.0 * 64 * 66)))), 8) AS q95 FROM part")
def random_projection_bound(spark, sf_dir):
    p = tables.scan(spark, sf_dir, "part", "p_partkey", "p_size")
    return p.select("p_partkey", rounded(spaces.projection_quantile(1.6448536269514722, F.col("p_size"), F.lit(64)), 8).alias("q95"))


@query(f"WITH {LONG}, o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings), y AS (SELECT x.label, o.i, x.dim, x.v FROM x JOIN o USING (vec_id)), b AS (SELECT label, sqrt(sum(v * v)) AS n FROM y WHERE i = 1 GROUP BY 1) SELECT y.label, CAST(y.i AS INTEGER) AS epoch, round(sqrt(sum((y.v - z.v) * (y.v - z.v))) / any_value(b.n), 6) AS moved FROM y JOIN y z ON z.label = y.label AND z.dim = y.dim AND z.i = 1 JOIN b ON b.label = y.label GROUP BY 1, 2")
def update_norms(spark, sf_dir):
    """How far each state of a class's series has moved from the first, relative to the first."""
    w = windows(spark, sf_dir)
    own = Window.partitionBy("label").orderBy("vec_id")
    rows = w.withColumns({"epoch": F.row_number().over(own), "base": F.first("embedding").over(own)})
    return updates.moved(rows, "embedding", "base").select("label", "epoch", rounded("moved").alias("moved"))


# without SQL: compared with NumPy in the tests


@query()
def canonical_margins(spark, sf_dir):
    """Recall of each class by the nearest mean in the canonical space of session-balanced moments."""
    w = windows(spark, sf_dir).where("label is not null")
    stats = moments.sufficient(w.withColumn("cell", F.col("label") * 3 + F.col("vec_id") % 3), "embedding", "cell")
    axes, _, _ = spaces.canonical_axes({(c // 3, c % 3): s for c, s in stats.items()})
    z = align.affine(w.select("vec_id", "label", "embedding"), "embedding", axes, np.zeros(axes.shape[1]), "z")
    return metrics.recalls(moments.nearest_centroid(z, "vec_id", "label", "z"), "label", "predicted")


@query()
def matched_haar_null(spark, sf_dir):
    """Energy of each class's first components in random spans of the same shape, by draw."""
    r = _rank_one(spark, sf_dir)
    first = r.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("i <= 8")
    return spaces.matched_null(first, "label", 5, 11).withColumn("fraction", rounded("fraction"))


@query()
def gaussian_projection(spark, sf_dir):
    """Each window through a seeded matrix of normals to eight dimensions: the squared length it keeps."""
    z = align.affine(windows(spark, sf_dir).select("vec_id", "embedding"), "embedding", spaces.gaussian_projection(64, 8, 7) * np.sqrt(8.0), np.zeros(8), "z")
    return z.select("vec_id", rounded(_dot("z", "z")).alias("energy"))
