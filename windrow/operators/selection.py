"""Model selection and readouts from sums: one pass gathers moments by (session, class), one pass scores every model.

A split's training moments are sums of its sessions', so inner splits, grids and class subsets cost no further pass over the windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .moments import sufficient
from .readout import fisher_axes
from .spaces import quadratic_weights
from .sums import finite, matrix

#: Class labels are packed with the session into one number.
SESSIONS = 1 << 16


def session_moments(windows: DataFrame, session: str, label: str, vector: str) -> dict[int, dict[int, tuple]]:
    """{session: {class: (n, sum, sum of x x')}}; sessions are numbers from 0 to SESSIONS - 1, null ones take no part."""
    cell = F.when((F.col(session) >= 0) & (F.col(session) < SESSIONS), F.col(label).cast("long") * SESSIONS + F.col(session))
    out: dict[int, dict[int, tuple]] = {}
    for c, s in sufficient(windows.withColumn("_cell", cell), vector, "_cell").items():
        out.setdefault(c % SESSIONS, {})[c // SESSIONS] = s
    return out


def merged(parts: list[dict[int, tuple]]) -> dict[int, tuple]:
    """Moments of several sessions as one."""
    out: dict[int, tuple] = {}
    for p in parts:
        for c, (n, s, ss) in p.items():
            a = out.get(c, (0, 0.0, 0.0))
            out[c] = (a[0] + n, a[1] + s, a[2] + ss)
    return out


def ridge_weights(stats: dict[int, tuple], lam: float) -> tuple[list[int], np.ndarray]:
    """(classes, (d + 1) x classes weights) of the class-balanced ridge readout with a free intercept."""
    labels = sorted(stats)
    total, d = sum(stats[c][0] for c in labels), len(stats[labels[0]][1])
    gram, right = np.zeros((d + 1, d + 1)), np.zeros((d + 1, len(labels)))
    for j, c in enumerate(labels):
        n, s, ss = stats[c]
        w = total / (len(labels) * n)
        gram += w * np.block([[ss, s[:, None]], [s[None], np.array([[float(n)]])]])
        right[:, j] = w * np.r_[s, n]
    return labels, np.linalg.solve(gram + lam * np.diag(np.r_[np.ones(d), 0.0]), right)


def quadratic_rule(stats: dict[int, tuple], alpha: float) -> Callable[[np.ndarray], np.ndarray]:
    rows = quadratic_weights(stats, [alpha])[alpha]
    names = np.array([r[0] for r in rows])
    return lambda x: names[np.array([-0.5 * (logdet + (((x - m) @ inv) * (x - m)).sum(1)) for _, m, inv, logdet in rows]).argmax(0)]


def ridge_rule(stats: dict[int, tuple], lam: float) -> Callable[[np.ndarray], np.ndarray]:
    labels, weights = ridge_weights(stats, lam)
    return lambda x: np.array(labels)[(x @ weights[:-1] + weights[-1]).argmax(1)]


def score_rules(windows: DataFrame, group: str, label: str, vector: str, rules: dict[int, list[tuple[int, Callable]]], dim: int) -> DataFrame:
    """(rule, label, n, hits) over the windows of each group: every rule of the group's list scores every window, in one pass.

    A task adds up its hits: it sends a row for each rule and class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            g, y, x = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), dim)
            for name in np.unique(g).tolist():
                own = g == name
                for i, rule in rules.get(name, []):
                    hit = rule(x[own]) == y[own]
                    for c in np.unique(y[own]).tolist():
                        at = y[own] == c
                        t = held.setdefault((i, c), [0, 0])
                        t[0] += int(at.sum())
                        t[1] += int(hit[at].sum())
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=["rule", "label", "n", "hits"])

    good = windows.where(finite(vector) & F.col(label).isNotNull() & F.col(group).isNotNull())
    parts = good.select(F.col(group).cast("long"), F.col(label).cast("long"), vector).mapInArrow(run, "rule int, label long, n long, hits long")
    return parts.groupBy("rule", "label").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def nested_models(windows: DataFrame, session: str, label: str, vector: str, alphas: list[float], lambdas: list[float]) -> tuple[DataFrame, DataFrame]:
    """(grid, chosen): for each outer session, held out, the quadratic rule's alpha and the ridge readout's lambda by inner balanced accuracy.

    grid: (outer, inner, kind, value, score, problem); chosen: (outer, kind, value, score). Each other session is an inner split: trained on
    what is neither outer nor inner, scored on the inner one. A candidate whose fit fails in a split (a covariance that is not
    positive definite, a class without training rows) is rejected and says why; ties prefer the larger value, which is smoother. All
    splits and candidates are fitted from the sums of one pass and scored in another. Fewer than three sessions are an error.
    """
    spark, moments = windows.sparkSession, session_moments(windows, session, label, vector)
    sessions = sorted(moments)
    if len(sessions) < 3:
        raise ValueError("nested selection needs three sessions")
    classes = sorted({c for s in moments.values() for c in s})
    dim = len(next(iter(moments[sessions[0]].values()))[1])
    rules: dict[int, list[tuple[int, Callable]]] = {}
    rows = []
    for outer in sessions:
        for inner in sessions:
            if inner == outer:
                continue
            train = merged([moments[s] for s in sessions if s not in (outer, inner)])
            for kind, values, fit in (("alpha", alphas, quadratic_rule), ("lambda", lambdas, ridge_rule)):
                for value in values:
                    problem = ""
                    try:
                        if sorted(train) != classes:
                            raise ValueError("a class has no training rows")
                        rules.setdefault(inner, []).append((len(rows), fit(train, value)))
                    except (ValueError, np.linalg.LinAlgError) as why:
                        problem = str(why)
                    rows.append((len(rows), outer, inner, kind, float(value), problem))
    table = spark.createDataFrame(rows, "rule int, outer long, inner long, kind string, value double, problem string")
    hits = score_rules(windows, session, label, vector, rules, dim)
    score = hits.groupBy("rule").agg(F.avg(F.col("hits") / F.col("n")).alias("score"))
    grid = table.join(F.broadcast(score), "rule", "left").select("outer", "inner", "kind", "value", "score", "problem")  # a row for each candidate and split
    whole = grid.groupBy("outer", "kind", "value").agg(F.avg("score").alias("score"), F.count("score").alias("_n")).where(F.col("_n") == len(sessions) - 1)
    best = Window.partitionBy("outer", "kind").orderBy(F.round("score", 9).desc(), F.col("value").desc())
    return grid, whole.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("outer", "kind", "value", "score")


def readouts(train: DataFrame, test: DataFrame, label: str, vector: str, subsets: dict[str, list[int] | None], ridge: float = 1e-4) -> DataFrame:
    """(analysis, n, accuracy, balanced_accuracy): nearest-centroid readouts of one fitted space, for subsets of the classes.

    `shared_<name>` reads a subset in the axes of the discriminant of all classes, `internal_<name>` in those of one fitted to the subset; a subset of None is
    all classes, and has only the shared one. One pass over train gives the sums of all fits, one over test scores all readouts.
    """
    stats = sufficient(train, vector, label)
    dim = len(next(iter(stats.values()))[1])
    shared, _ = fisher_axes(stats, ridge)

    def rule(axes: np.ndarray, labels: list[int]) -> Callable:
        names, centres = np.array(labels), np.array([stats[c][1] / stats[c][0] @ axes for c in labels])
        # a window of another class is none of this readout's: it has no prediction and does not count
        return lambda x: names[(((x @ axes)[:, None] - centres[None]) ** 2).sum(2).argmin(1)]

    named: list[tuple[str, list[int], Callable]] = []
    for name, own in subsets.items():
        labels = sorted(stats) if own is None else sorted(c for c in own if c in stats)
        named.append((f"shared_{name}", labels, rule(shared, labels)))
        if own is not None:
            named.append((f"internal_{name}", labels, rule(fisher_axes({c: stats[c] for c in labels}, ridge)[0], labels)))
    spark = train.sparkSession
    hits = score_rules(test.withColumn("_all", F.lit(0)), "_all", label, vector, {0: [(i, r) for i, (_, _, r) in enumerate(named)]}, dim)
    member = spark.createDataFrame([(i, name, c) for i, (name, labels, _) in enumerate(named) for c in labels], "rule int, analysis string, label long")
    met = hits.join(F.broadcast(member), ["rule", "label"])  # readouts x classes
    return met.groupBy("analysis").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg(F.col("hits") / F.col("n")).alias("balanced_accuracy"))


def semantic_decomposition(stats: dict[int, tuple], axes: np.ndarray, values: np.ndarray, gap: float = 0.1) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """What discriminant axes mean, in the space that whitens the mean within covariance.

    (pair, axis, cosine, coefficient): alignment of each axis with each difference of class means, and the axis from all differences by
    coefficients of least norm; (k, singular value of the differences, angle of their k-th direction's span to the axes); (pair, block, energy): squared alignment summed over
    blocks of axes whose eigenvalues fall by less than `gap` of the one before.
    """
    labels = sorted(stats)
    within = np.mean([(s[2] - np.outer(s[1], s[1]) / s[0]) / max(1, s[0] - 1) for s in stats.values()], axis=0)
    low = np.linalg.cholesky(within)
    white = {c: np.linalg.solve(low, stats[c][1] / stats[c][0]) for c in labels}
    u = low.T @ axes
    u = u / np.linalg.norm(u, axis=0)
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i + 1 :]]
    delta = np.array([white[b] - white[a] for a, b in pairs]).T
    norms = np.linalg.norm(delta, axis=0)
    cosines = (delta / np.where(norms > 1e-12, norms, 1.0)).T @ u
    coefficients = np.linalg.pinv(delta, rcond=1e-10) @ u
    left, singular, _ = np.linalg.svd(delta, full_matrices=False)
    k = min(u.shape[1], int((singular > 1e-10 * singular[0]).sum()))
    base, _ = np.linalg.qr(u)
    angles = np.degrees(np.arccos(np.clip(np.linalg.svd(base.T @ left[:, :k], compute_uv=False), -1, 1)))
    blocks, start = [], 0
    for i in range(len(values)):
        if i + 1 == len(values) or (values[i] - values[i + 1]) / max(values[i], 1e-12) >= gap:
            blocks.append(range(start, i + 1))
            start = i + 1
    aligned = [(*p, j + 1, float(cosines[i, j]), float(coefficients[i, j])) for i, p in enumerate(pairs) for j in range(u.shape[1])]
    energy = [(*p, f"{b[0] + 1}-{b[-1] + 1}", float((cosines[i, list(b)] ** 2).sum())) for i, p in enumerate(pairs) for b in blocks]
    return aligned, [(i + 1, float(singular[i]), float(angles[i])) for i in range(k)], energy
