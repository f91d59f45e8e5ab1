"""Queries over spans of operators and states, stability, exact and eigenvalue nulls, nested selection and readouts.

Those with SQL have spans of one or two axes, whose projections have closed forms; tests hold the others against NumPy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import adapter, curves, moments, nulls, ranks, readout, selection, spaces, subspaces
from ..sources import tables
from .registry import LONG, ORACLES, events, query, rounded, windows
from .spaces import _UNIT, _dot, _rank_one

# spans of operators

_UPDATE = f"{_UNIT}, z AS (SELECT label, min(vec_id) AS p, max(vec_id) AS q FROM embeddings GROUP BY 1), g AS (SELECT vec_id, product(s) AS sigma FROM n GROUP BY 1), m AS (SELECT a.label, a.k AS i, b.k AS j, sum(g.sigma * a.v * b.v) AS m FROM w a JOIN w b ON b.vec_id = a.vec_id AND b.side = 1 JOIN g ON g.vec_id = a.vec_id WHERE a.side = 0 GROUP BY 1, 2, 3), t AS (SELECT label, sum(m * m) AS t FROM m GROUP BY 1), y AS (SELECT m.label, u.vec_id, sum(m.m * u.v * v.v) AS x FROM m JOIN z ON z.label = (m.label + 1) % 10 JOIN w u ON u.side = 0 AND u.k = m.i AND u.vec_id IN (z.p, z.q) JOIN w v ON v.side = 1 AND v.k = m.j AND v.vec_id = u.vec_id GROUP BY 1, 2), c AS (SELECT label, product(s) AS c FROM (SELECT z.label, a.side, sum(a.v * b.v) AS s FROM z JOIN w a ON a.vec_id = z.p JOIN w b ON b.vec_id = z.q AND b.side = a.side AND b.k = a.k GROUP BY 1, 2) GROUP BY 1)"


def _against_next(spark, sf_dir):
    """Each class's rank-one operators, and as its context the first and last operator of the next class, where those are two."""
    r = _rank_one(spark, sf_dir)
    ends = r.groupBy("label").agg(F.min("vec_id").alias("p"), F.max("vec_id").alias("q")).where("p < q")
    both = ends.select(((F.col("label") + 9) % 10).alias("label"), F.explode(F.array("p", "q")).alias("vec_id"))
    other = both.join(r.drop("label"), "vec_id").select("label", F.lit(True).alias("context"), "sigma", "u", "v")
    mine = r.join(both.select("label").distinct(), "label", "left_semi").select("label", F.lit(False).alias("context"), "sigma", "u", "v")
    return mine.union(other)


@query(f"WITH {_UPDATE} SELECT t.label, round((a.x * a.x + b.x * b.x - 2 * c.c * a.x * b.x) / (1 - c.c * c.c) / t.t, 6) AS kept FROM t JOIN z ON z.label = (t.label + 1) % 10 JOIN c ON c.label = z.label JOIN y a ON a.label = t.label AND a.vec_id = z.p JOIN y b ON b.label = t.label AND b.vec_id = z.q WHERE z.p < z.q")
def projected_update_energy(spark, sf_dir):
    """What a class's whole update keeps in the span of two operators of the next class."""
    return subspaces.kept_energy(_against_next(spark, sf_dir), "label").withColumn("kept", rounded("kept"))


@query()
def principal_directions(spark, sf_dir):
    """Principal cosines and coefficients between the spans of a class's and the next class's operators."""
    return subspaces.principal_directions(_against_next(spark, sf_dir), "label").withColumns({"cosine": rounded("cosine"), "coefficient": rounded(F.abs("coefficient"))})


# spans of states

_LINES = f"{LONG}, m AS (SELECT label, dim, avg(v) AS m FROM x GROUP BY 1, 2), g AS (SELECT dim, avg(v) AS g FROM x GROUP BY 1), h AS (SELECT sqrt(sum(g * g)) AS h FROM g), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1), d AS (SELECT m.label, sum(m.m * g.g) / any_value(n.n) / any_value(h.h) AS d FROM m JOIN g USING (dim) JOIN n USING (label), h GROUP BY 1), c AS (SELECT a.label AS a, b.label AS b, sum(a.m * b.m) / any_value(p.n) / any_value(q.n) AS c FROM m a JOIN m b ON a.dim = b.dim AND a.label < b.label JOIN n p ON p.label = a.label JOIN n q ON q.label = b.label GROUP BY 1, 2), u AS (SELECT a, b, x.d AS x, y.d AS y, (x.d * x.d + y.d * y.d - 2 * c * x.d * y.d) / (1 - c * c) AS u FROM c JOIN d x ON x.label = c.a JOIN d y ON y.label = c.b)"


@query(f"WITH {_LINES} SELECT a, b, s.state, round(CASE WHEN s.state = a THEN x * x ELSE y * y END, 6) AS marginal, round(u, 6) AS explained, round(u - CASE WHEN s.state = a THEN y * y ELSE x * x END, 6) AS own FROM u, LATERAL (SELECT unnest([a, b]) AS state) s")
def state_overlap(spark, sf_dir):
    """How far the grand mean lies in the lines of two classes' means: in each, in both, and in each alone, for every pair of classes."""
    w = windows(spark, sf_dir)
    c = moments.centre_arrays(w, "label", "embedding").where("centre_of is not null")
    grand = moments.centre_arrays(w.withColumn("_one", F.lit(0)), "_one", "embedding").select(F.col("centre").alias("g"))
    pairs = c.select(F.col("centre_of").alias("a"), F.col("centre").alias("x")).join(c.select(F.col("centre_of").alias("b"), F.col("centre").alias("y")), F.col("a") < F.col("b"))
    three = F.explode(F.array(F.struct(F.col("a").alias("state"), F.col("x").alias("axis")), F.struct(F.col("b").alias("state"), F.col("y").alias("axis")), F.struct(F.lit(None).cast("int").alias("state"), F.col("g").alias("axis"))))
    rows = pairs.join(F.broadcast(grand)).select((F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("pair"), three.alias("r")).select("pair", "r.state", "r.axis")  # one row is broadcast
    o = subspaces.overlaps(rows, "pair", "state", "axis")
    return o.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("b"), "state", rounded("marginal").alias("marginal"), rounded("union").alias("explained"), rounded("unique").alias("own"))


@query(f"WITH {LONG}, m AS (SELECT label, vec_id % 3 AS fold, dim, avg(v) AS m FROM x GROUP BY 1, 2, 3), n AS (SELECT label, fold, sqrt(sum(m * m)) AS n FROM m GROUP BY 1, 2), s AS (SELECT label, vec_id % 3 AS fold, count(*) AS support FROM embeddings GROUP BY 1, 2), c AS (SELECT a.label, a.fold AS fold_a, b.fold AS fold_b, least(1, abs(sum(a.m * b.m) / any_value(p.n) / any_value(q.n))) AS c FROM m a JOIN m b ON b.label = a.label AND b.dim = a.dim AND a.fold < b.fold JOIN n p ON p.label = a.label AND p.fold = a.fold JOIN n q ON q.label = b.label AND q.fold = b.fold GROUP BY 1, 2, 3) SELECT c.label, fold_a, fold_b, round(degrees(acos(c)), 4) AS angle, round(c * c, 6) AS shared, CASE WHEN s.support <= 1 THEN 'saturated_support' ELSE 'informative' END AS status FROM c JOIN s ON s.label = c.label AND s.fold = c.fold_a")
def fold_stability(spark, sf_dir):
    """Agreement of the line of a class's mean between folds."""
    w = windows(spark, sf_dir).where("label is not null").withColumn("fold", F.col("vec_id") % 3)
    long = w.select("label", "fold", F.posexplode("embedding").alias("dim", "v")).groupBy("label", "fold", "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    means = long.groupBy("label", "fold").agg(F.array(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"])).alias("basis"))
    spans = means.join(w.groupBy("label", "fold").agg(F.count("*").alias("support")), ["label", "fold"]).withColumn("ambient", F.lit(64))
    s = subspaces.fold_stability(spans, ["label"], "fold", "basis")
    return s.select("label", "fold_a", "fold_b", rounded("max_angle", 4).alias("angle"), rounded("shared").alias("shared"), F.col("status_a").alias("status"))


@query(f"WITH b AS ({ORACLES['spectral_blocks']}), e AS (SELECT label, o, max(o) OVER (PARTITION BY label, block) AS e, 1 + label * 7 AS requested, 20 + label * 3 AS feasible FROM b), r AS (SELECT label, any_value(requested) AS requested, any_value(feasible) AS feasible, max(o) AS l, max(e) FILTER (WHERE o = requested) AS w, coalesce(max(e) FILTER (WHERE e <= feasible), 0) AS i FROM e GROUP BY 1), f AS (SELECT *, CASE WHEN requested > l THEN l ELSE w END AS full_rank FROM r) SELECT label, requested, feasible, CAST(CASE WHEN full_rank <= feasible THEN full_rank ELSE i END AS INTEGER) AS rank FROM f")
def complete_ranks(spark, sf_dir):
    """Requested ranks extended to whole spectral blocks, or cut to the whole blocks that are feasible."""
    v = tables.long_form(windows(spark, sf_dir)).groupBy("label", "dim").agg(F.round(F.var_samp("v"), 8).alias("g"))
    placed = curves.spectral_blocks(v.withColumn("o", F.row_number().over(curves.Window.partitionBy("label").orderBy("g", "dim"))), ["label"], "o", "g")
    return subspaces.complete_rank(placed, ["label"], "o", "block", 1 + F.col("label") * 7, 20 + F.col("label") * 3)


# nulls

_PERMS = "l AS (SELECT unnest([0, 1, 2, 3]) AS l), q AS (SELECT row_number() OVER (ORDER BY a.l, b.l, c.l, d.l) - 1 AS draw, [a.l, b.l, c.l, d.l] AS ls FROM l a, l b, l c, l d WHERE a.l <> b.l AND a.l <> c.l AND a.l <> d.l AND b.l <> c.l AND b.l <> d.l AND c.l <> d.l)"


@query(f"WITH {_PERMS}, e AS (SELECT event_id % 4 AS run, floor(value) % 4 AS p, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2), r AS (SELECT draw, ls, ls[run + 1] AS label, sum(CASE WHEN p = ls[run + 1] THEN n ELSE 0 END) / sum(n) AS r FROM e, q GROUP BY 1, 2, 3) SELECT CAST(draw AS INTEGER) AS draw, ls = [0, 1, 2, 3] AS observed, round(avg(r), 6) AS balanced_accuracy FROM r GROUP BY 1, 2")
def exact_label_null(spark, sf_dir):
    """Balanced accuracy under all 24 assignments of four labels to four runs."""
    e = events(spark, sf_dir).where("value is not null").select((F.col("event_id") % 4).cast("int").alias("run"), (F.floor("value") % 4).cast("int").alias("p"))
    return nulls.exact_label_null(e.withColumn("truth", F.col("run")), "run", "truth", "p").withColumn("balanced_accuracy", rounded("balanced_accuracy"))


@query()
def eigenvalue_null(spark, sf_dir):
    """Discriminant eigenvalues against 50 keyed permutations of the labels."""
    t = nulls.eigenvalue_null(windows(spark, sf_dir), "vec_id", "label", "embedding", 50, 3)
    return t.withColumns({c: rounded(c) for c in ("real", "null95", "p")})


# models


@query()
def nested_models(spark, sf_dir):
    """alpha of the quadratic rule and lambda of the ridge readout that inner splits choose for each held-out session."""
    w = windows(spark, sf_dir).withColumn("session", F.col("vec_id") % 3)
    _, chosen = selection.nested_models(w, "session", "label", "embedding", [0.5, 0.9, 0.99, 1.0], [0.01, 1.0, 100.0])
    return chosen.withColumn("score", rounded("score"))


@query()
def internal_readouts(spark, sf_dir):
    """Readouts of two halves of the classes in the shared discriminant space and in one of their own."""
    w = windows(spark, sf_dir)
    t = selection.readouts(w.where("vec_id % 4 <> 0"), w.where("vec_id % 4 = 0"), "label", "embedding", {"all": None, "low": [0, 1, 2, 3, 4], "high": [5, 6, 7, 8, 9]})
    return t.withColumns({"accuracy": rounded("accuracy"), "balanced_accuracy": rounded("balanced_accuracy")})


@query()
def semantic_alignment(spark, sf_dir):
    """Squared alignment of the discriminant axes with every difference of class means."""
    stats = moments.sufficient(windows(spark, sf_dir), "embedding", "label")
    axes, values = readout.fisher_axes(stats)
    aligned, _, _ = selection.semantic_decomposition(stats, axes, values)
    t = spark.createDataFrame(aligned, "a int, b int, axis int, cosine double, coefficient double")
    return t.select("a", "b", "axis", rounded(F.col("cosine") * F.col("cosine")).alias("alignment"), rounded(F.abs("coefficient")).alias("coefficient"))


@query(f"WITH {LONG}, c AS (SELECT label, vec_id % 2 AS test, dim, avg(v) AS m FROM x GROUP BY 1, 2, 3), d AS (SELECT a.label AS a, b.label AS b, a.test, a.dim, b.m - a.m AS d, (a.m + b.m) / 2 AS mid, a.m AS ma, b.m AS mb FROM c a JOIN c b ON b.test = a.test AND b.dim = a.dim AND a.label < b.label) SELECT p.a, p.b, round(sum(p.d * q.d), 6) AS cross_distance, round(sum(p.d * q.d) / sqrt(sum(p.d * p.d) * sum(q.d * q.d)), 5) AS cosine, sum((q.ma - p.mid) * p.d) < 0 AND sum((q.mb - p.mid) * p.d) >= 0 AS centroids_right FROM d p JOIN d q ON q.a = p.a AND q.b = p.b AND q.dim = p.dim AND q.test = 1 WHERE p.test = 0 GROUP BY 1, 2")
def pair_transfer(spark, sf_dir):
    """Each pair of classes on the axis of its training means: how the test means differ along it, and whether they fall on their sides."""
    w = windows(spark, sf_dir).where("label is not null")
    train, test = (moments.centre_arrays(w.where(F.col("vec_id") % 2 == i), "label", "embedding") for i in (0, 1))
    both = train.withColumnRenamed("centre", "p").join(test.withColumnRenamed("centre", "q"), "centre_of")
    a, b = (both.select(F.col("centre_of").alias(n), F.col("p").alias(f"p{n}"), F.col("q").alias(f"q{n}")) for n in "ab")
    d = a.join(b, F.col("a") < F.col("b"))
    minus, mid = (lambda x, y: F.zip_with(x, y, lambda s, t: s - t)), F.zip_with("pa", "pb", lambda s, t: (s + t) / 2)
    p, q = minus("pb", "pa"), minus("qb", "qa")
    side = lambda own: _dot(minus(own, mid), p)
    return d.select("a", "b", rounded(_dot(p, q)).alias("cross_distance"), rounded(_dot(p, q) / F.sqrt(_dot(p, p) * _dot(q, q)), 5).alias("cosine"), ((side("qa") < 0) & (side("qb") >= 0)).alias("centroids_right"))


@query(f"WITH {LONG}, c AS (SELECT label, dim, avg(v) AS m FROM x WHERE vec_id % 2 = 0 GROUP BY 1, 2), g AS (SELECT label, vec_id % 7 AS part, dim, avg(v) AS m FROM x WHERE vec_id % 2 = 1 GROUP BY 1, 2, 3), d AS (SELECT g.label, g.part, c.label AS cl, sum((g.m - c.m) * (g.m - c.m)) AS d FROM g JOIN c USING (dim) GROUP BY 1, 2, 3), p AS (SELECT label, part, arg_min(cl, (d, cl)) AS p FROM d GROUP BY 1, 2) SELECT label, count(*) AS groups, round(avg(CASE WHEN p = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY 1")
def group_centroid_accuracy(spark, sf_dir):
    """How often the mean of a group of test windows is nearest to the training mean of its class."""
    w = windows(spark, sf_dir).where("label is not null")
    c = moments.centre_arrays(w.where("vec_id % 2 = 0"), "label", "embedding")
    g = moments.centre_arrays(w.where("vec_id % 2 = 1").withColumn("_g", F.col("label").cast("long") * 7 + F.col("vec_id") % 7), "_g", "embedding")
    d = moments.squared_distances(g.select(F.col("centre_of").alias("group"), F.col("centre").alias("mean")), c, "mean", "centre_of")
    p = d.groupBy("group").agg(F.min_by("centre_label", F.struct("d2", "centre_label")).alias("p"))
    label = F.floor(F.col("group") / 7).cast("int")
    return p.groupBy(label.alias("label")).agg(F.count("*").alias("groups"), rounded(F.avg(F.when(F.col("p") == F.floor(F.col("group") / 7), 1.0).otherwise(0.0))).alias("accuracy"))


@query()
def adapter_losses(spark, sf_dir):
    """The loss of an adapter that moves the even windows onto the odd ones, shifted by 0.1, before each step."""
    w = windows(spark, sf_dir)
    first = w.where("vec_id % 2 = 0").select(F.slice("embedding", 1, 8).alias("x"))
    second = w.where("vec_id % 2 = 1").select(F.transform(F.slice("embedding", 1, 8), lambda v: v + 0.1).alias("x"))
    net = adapter.fit_adapter(first, second, "x", epochs=10)
    return spark.createDataFrame([(i, v) for i, v in enumerate(net.losses)], "step int, loss double").withColumn("loss", rounded("loss", 5))


# spectra and shuffled draws


@query(f"WITH {_UNIT}, s AS (SELECT vec_id, product(s) AS sigma FROM n GROUP BY 1), r AS (SELECT label, sigma * sigma AS e, row_number() OVER (PARTITION BY label ORDER BY round(sigma * sigma, 10) DESC, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM s JOIN embeddings USING (vec_id)), g AS (SELECT CAST(i / 10.0 AS DOUBLE) AS f FROM range(0, 11) r(i)) SELECT label, f AS q, CAST(ceil(any_value(n) * f - 1e-9) AS INTEGER) AS rank, round(coalesce(sum(e) FILTER (WHERE k <= ceil(n * f - 1e-9)), 0) / sum(e), 6) AS energy FROM r, g GROUP BY label, f")
def energy_grid(spark, sf_dir):
    """Energy that a class's strongest components hold, for a grid of fractions of their number."""
    r = _rank_one(spark, sf_dir).select("label", "vec_id", (F.col("sigma") * F.col("sigma")).alias("e"), F.round(F.col("sigma") * F.col("sigma"), 10).alias("_o"), (-F.col("vec_id")).alias("_id"))
    placed = ranks.places(r, ["label"], ["_o", "_id"], "k", down=True)
    total = r.groupBy("label").agg(F.count("*").alias("n"), F.sum("e").alias("all"))
    grid = total.withColumn("q", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / 10.0))).withColumn("rank", spaces.rank_for_fraction(F.col("n"), F.col("q")))
    # a row meets the grid of its class only
    met = grid.join(placed, "label").groupBy("label", "q", "rank").agg((F.sum(F.when(F.col("k") < F.col("rank"), F.col("e")).otherwise(0.0)) / F.first("all")).alias("energy"))
    return met.select("label", "q", "rank", rounded("energy").alias("energy"))


_TEMPORAL = 9


@query(f"WITH e AS (SELECT user_id, event_type, event_id, value FROM events WHERE value IS NOT NULL), d AS (SELECT e.*, draw FROM e, range(0, {_TEMPORAL + 1}) d(draw)), w AS (SELECT *, row_number() OVER (PARTITION BY draw, user_id, event_type ORDER BY event_id) AS i, row_number() OVER (PARTITION BY draw, user_id, event_type ORDER BY CASE WHEN draw = 0 THEN '' ELSE md5(draw || '|' || event_id) END, event_id) AS j FROM d), g AS (SELECT a.draw, a.user_id, a.event_id, b.value FROM w a JOIN w b ON a.draw = b.draw AND a.user_id = b.user_id AND a.event_type = b.event_type AND a.i = b.j), s AS (SELECT draw, user_id, value, value - lag(value) OVER (PARTITION BY draw, user_id ORDER BY event_id) AS step FROM g), r AS (SELECT draw, user_id, avg(step * step) / nullif(var_pop(value), 0) AS ratio FROM s GROUP BY 1, 2), o AS (SELECT user_id, ratio AS real FROM r WHERE draw = 0) SELECT user_id, round(any_value(real), 6) AS jump_energy, round(avg(ratio), 6) AS null_mean, round((1 + count(*) FILTER (WHERE round(ratio, 9) <= round(real, 9))) / (1 + {_TEMPORAL}), 6) AS p FROM r JOIN o USING (user_id) WHERE draw > 0 AND ratio IS NOT NULL GROUP BY 1")
def temporal_null(spark, sf_dir):
    """Each subject's jump energy against values shuffled within its classes, by draw, and the share of draws that are as smooth.

    A draw keys its order by a digest of the draw and the sample. Rows are dealt once, by (draw, subject): all windows stand on
    that, and places meet by order, as rows of one window, where a join would deal them again.
    """
    e = events(spark, sf_dir).where("value is not null and user_id is not null and event_type is not null").select("user_id", "event_type", "event_id", "value")
    d = e.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(_TEMPORAL)))).repartition("draw", "user_id")
    d = d.withColumn("_h", F.when(F.col("draw") == 0, "").otherwise(F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.col("event_id").cast("string")))))
    own = curves.Window.partitionBy("draw", "user_id", "event_type")
    placed = d.withColumn("i", F.row_number().over(own.orderBy("event_id"))).withColumn("j", F.row_number().over(own.orderBy("_h", "event_id")))
    # the value of place j comes just before the sample of place i = j
    both = F.array(F.struct(F.col("j").alias("at"), F.lit(0).alias("kind"), F.col("value").alias("v")), F.struct(F.col("i").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("v")))
    halves = placed.select("draw", "user_id", "event_type", "event_id", F.explode(both).alias("r")).select("draw", "user_id", "event_type", "event_id", "r.*")
    shuffled = halves.withColumn("value", F.lag("v").over(own.orderBy("at", "kind"))).where("kind = 1")
    w = curves.Window.partitionBy("draw", "user_id").orderBy("event_id")
    steps = shuffled.withColumn("step", F.col("value") - F.lag("value").over(w))
    r = steps.groupBy("draw", "user_id").agg((F.avg(F.col("step") * F.col("step")) / F.nullif(F.var_pop("value"), F.lit(0.0))).alias("ratio"))
    # a row for each subject and draw
    real = F.max(F.when(F.col("draw") == 0, F.col("ratio"))).over(curves.Window.partitionBy("user_id"))
    met = r.withColumn("real", real).where("draw > 0 and ratio is not null")
    low = F.count_if(F.round("ratio", 9) <= F.round("real", 9))
    return met.groupBy("user_id").agg(rounded(F.first("real")).alias("jump_energy"), rounded(F.avg("ratio")).alias("null_mean"), rounded((1 + low) / (1 + _TEMPORAL)).alias("p"))


@query(f"WITH {LONG}, s AS (SELECT label, vec_id % 3 AS session, vec_id, dim, v FROM x), m AS (SELECT label, session, dim, avg(v) AS m, count(*) AS n FROM s GROUP BY 1, 2, 3), g AS (SELECT label, dim, avg(v) AS g FROM s GROUP BY 1, 2), d AS (SELECT s.label, s.vec_id, s.dim, s.v - m.m AS d FROM s JOIN m USING (label, session, dim)), w AS (SELECT a.label, a.dim AS i, b.dim AS j, sum(a.d * b.d) AS w FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY 1, 2, 3), o AS (SELECT m.label, m.session, m.dim, m.n, m.m - g.g AS d FROM m JOIN g USING (label, dim)), b AS (SELECT a.label, a.dim AS i, b.dim AS j, sum(a.n * a.d * b.d) AS b FROM o a JOIN o b ON a.label = b.label AND a.session = b.session AND a.dim <= b.dim GROUP BY 1, 2, 3) SELECT label, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(w, 5) AS within, round(b, 5) AS between FROM w JOIN b USING (label, i, j)")
def session_scatter(spark, sf_dir):
    """Within- and between-session scatter matrices of each class, upper triangles: every component with every other."""
    w = windows(spark, sf_dir).withColumn("session", F.col("vec_id") % 3)
    rows = []
    found = selection.session_moments(w, "session", "label", "embedding")
    for c in sorted({c for s in found.values() for c in s}):
        own = [s[c] for s in found.values() if c in s]
        total, n = sum(x[1] for x in own), sum(x[0] for x in own)
        inner = sum(x[2] - np.outer(x[1], x[1]) / x[0] for x in own)
        outer = sum(x[0] * np.outer(x[1] / x[0] - total / n, x[1] / x[0] - total / n) for x in own)
        rows += [(c, i, j, float(inner[i, j]), float(outer[i, j])) for i in range(len(total)) for j in range(i, len(total))]
    t = spark.createDataFrame(rows, "label int, i int, j int, within double, between double")
    return t.withColumns({"within": rounded("within", 5), "between": rounded("between", 5)})
