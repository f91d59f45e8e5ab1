"""Spans of operators and of slow axes: principal decomposition, overlap of named spans, stability across folds, block-complete ranks.

A group (a module, a pair of folds, a set of states) holds a few bases of bounded rank, and Spark deals
groups over tasks; inside one the algebra is a small SVD. Groups beyond MOST_PARTS rows are an error, but for
the candidates of a context, which are summed and may be any number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spaces import operator_gram, orthonormal
from .sums import matrix, summed_by

#: Basis vectors or rank-one operators of one group.
MOST_PARTS = 8192
#: Operators of a candidate that are compared one by one; more come as sums.
FEW_PARTS = 2048


def _columns(arrays: pd.Series) -> np.ndarray:
    return np.array(arrays.tolist(), float).T


def _checked(frame: pd.DataFrame) -> pd.DataFrame:
    if len(frame) > MOST_PARTS:
        raise ValueError(f"a group holds {len(frame)} parts, more than {MOST_PARTS}")
    return frame


def _orthonormalizer(gram: np.ndarray, tolerance: float) -> np.ndarray:
    """B with B' gram B = I on the support of gram."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > max(tolerance, len(gram) * np.finfo(float).eps) * max(values[-1], 0)
    return vectors[:, keep] / np.sqrt(values[keep])


def principal(u: np.ndarray, v: np.ndarray, s: np.ndarray, context_u: np.ndarray, context_v: np.ndarray, tolerance: float = 1e-12) -> dict[str, np.ndarray]:
    """The candidate span of operators u_i v_i' against a context's: cosines (falling), the coefficient of the update
    sum s_i u_i v_i' on each principal direction, and how each direction's image is made of the context's operators.

    Dependent operators of either side drop out; without an operator on a side there is no direction.
    """
    if not u.shape[1] or not context_u.shape[1]:
        return {"cosines": np.zeros(0), "coefficients": np.zeros(0), "context": np.zeros((context_u.shape[1], 0))}
    gram = operator_gram(u, v)
    mine, other = _orthonormalizer(gram, tolerance), _orthonormalizer(operator_gram(context_u, context_v), tolerance)
    left, cosines, right = np.linalg.svd(mine.T @ ((u.T @ context_u) * (v.T @ context_v)) @ other, full_matrices=False)
    return {"cosines": np.clip(cosines, 0, 1), "coefficients": (mine @ left).T @ gram @ s, "context": other @ right.T}


def projected_update(parts: dict[str, np.ndarray], context_u: np.ndarray, context_v: np.ndarray, pick: list[int] | None = None) -> np.ndarray:
    """The update's picked principal directions (all, if None) projected into the context's span, as a matrix."""
    at = np.arange(len(parts["cosines"])) if pick is None else np.asarray(pick, int)
    if len(at) and (at.min() < 0 or at.max() >= len(parts["cosines"])):
        raise IndexError("no such principal direction")
    weights = parts["context"][:, at] @ (parts["coefficients"][at] * parts["cosines"][at])
    return (context_u * weights) @ context_v.T


def _turned(cosines: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Coefficients after directions of equal cosine are turned within their span so that the first holds all of the update; 0 where the cosine is."""
    out = np.zeros(len(cosines))
    first = np.flatnonzero(np.r_[True, cosines[:-1] - cosines[1:] > 1e-9]) if len(cosines) else []
    for a, b in zip(first, [*first[1:], len(cosines)], strict=True):
        out[a] = coefficients[a] if b == a + 1 else np.sqrt((coefficients[a:b] ** 2).sum())
    return np.where(cosines > 1e-9, out, 0)


def _factors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u and v in rows, and sigma, of a batch (key, sigma, u, v)."""
    return matrix(batch.column(2)), matrix(batch.column(3)), batch.column(1).to_numpy(zero_copy_only=False).astype(float)


def _update(batch: pa.RecordBatch) -> np.ndarray:
    u, v, s = _factors(batch)
    return (u * s[:, None]).T @ v


def _moments(batch: pa.RecordBatch) -> np.ndarray:
    """The update, and the upper triangle of the sum of the flattened operators' outer squares."""
    u, v, _ = _factors(batch)
    total = 0.0
    for i in range(0, len(u), 512):
        x = (u[i : i + 512, :, None] * v[i : i + 512, None, :]).reshape(len(u[i : i + 512]), -1)
        total = total + x.T @ x
    return np.r_[_update(batch).ravel(), total[np.triu_indices(len(total))]]


def _against_context(parts: DataFrame, key: str, part, one, schema: str) -> DataFrame:
    """one(key value, sums of part over the key's candidate operators, context u, context v) for each key that has candidates: these are
    summed where they lie and may be any number, a context is at most MOST_PARTS operators."""
    sums = summed_by(parts.where(~F.col("context")).select(key, "sigma", "u", "v"), key, part)

    def meet(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({n: [] for n in _names(schema)})
        _checked(other)
        total = np.concatenate(mine.sort_values("i")["v"].tolist())
        return one(mine[key].iloc[0], total, *((_columns(other["u"]), _columns(other["v"])) if len(other) else (None, None)))

    return sums.groupBy(key).cogroup(parts.where("context").select(key, "u", "v").groupBy(key)).applyInPandas(meet, schema)


def _names(schema: str) -> list[str]:
    return [c.strip().rsplit(" ", 1)[0].strip("`") for c in schema.split(",")]


def principal_directions(parts: DataFrame, key: str, most: int = FEW_PARTS) -> DataFrame:
    """(key, k, cosine, coefficient) of each group of rank-one operators (key, context boolean, sigma, u, v): its candidate's
    principal directions to its context's span, by falling cosine.

    A candidate of up to `most` operators is compared operator by operator. A larger one, of any size, comes as the sums of its
    operators and of their outer squares, whose range is its span: (rows of u x rows of v)^2 / 2 numbers a group and task.
    Of directions of one cosine the first has the whole coefficient.
    """
    kind = parts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, k int, cosine double, coefficient double"

    def found(value, cosines: np.ndarray, coefficients: np.ndarray) -> pd.DataFrame:
        n = len(cosines)
        return pd.DataFrame({key: [value] * n, "k": range(1, n + 1), "cosine": cosines, "coefficient": _turned(cosines, coefficients)})

    def few(frame: pd.DataFrame) -> pd.DataFrame:
        _checked(frame)
        mine, other = frame[~frame["context"]], frame[frame["context"]]
        if not len(mine) or not len(other):
            return found(None, np.zeros(0), np.zeros(0))
        p = principal(_columns(mine["u"]), _columns(mine["v"]), mine["sigma"].to_numpy(float), _columns(other["u"]), _columns(other["v"]))
        return found(frame[key].iloc[0], p["cosines"], p["coefficients"])

    def many(value, total: np.ndarray, cu: np.ndarray | None, cv: np.ndarray | None) -> pd.DataFrame:
        if cu is None:
            return found(None, np.zeros(0), np.zeros(0))
        d = len(cu) * len(cv)
        square, upper = np.zeros((d, d)), np.triu_indices(d)
        square[upper] = total[d : d + len(upper[0])]
        square = square + np.triu(square, 1).T
        values, vectors = np.linalg.eigh(square)
        basis = vectors[:, values > max(1e-12, d * np.finfo(float).eps) * max(values[-1], 0)]
        axes = (cu[:, None] * cv[None]).reshape(d, -1) @ _orthonormalizer(operator_gram(cu, cv), 1e-12)
        left, cosines, _ = np.linalg.svd(axes.T @ basis, full_matrices=False)
        cosines = np.clip(cosines, 0, 1)
        # a direction's image in the context is the direction times its cosine, and the update lies in the candidate's span
        return found(value, cosines, (axes @ left).T @ total[:d] / np.where(cosines > 1e-9, cosines, 1))

    parts = parts.select(key, "context", "sigma", "u", "v")
    large = parts.where(~F.col("context")).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key)
    small = parts.join(large, key, "left_anti").groupBy(key).applyInPandas(few, schema)
    return small.union(_against_context(parts.join(large, key, "left_semi"), key, _moments, many, schema))


def kept_energy(parts: DataFrame, key: str) -> DataFrame:
    """(key, kept): the share of the energy of a group's update, sum sigma_i u_i v_i', that its projection into the context's span has."""
    kind = parts.schema[key].dataType.simpleString()

    def one(value, total: np.ndarray, cu: np.ndarray | None, cv: np.ndarray | None) -> pd.DataFrame:
        whole, kept = float((total**2).sum()), 0.0
        if cu is not None:
            update = total[: len(cu) * len(cv)].reshape(len(cu), len(cv))
            inner = (cu * (update @ cv)).sum(0)
            kept = float(((_orthonormalizer(operator_gram(cu, cv), 1e-12).T @ inner) ** 2).sum())
        return pd.DataFrame({key: [value], "kept": [kept / whole if whole > 0 else 0.0]})

    return _against_context(parts, key, _update, one, f"`{key}` {kind}, kept double")


# named spans


def root(metric: np.ndarray) -> np.ndarray:
    """The square root of a symmetric matrix; negative eigenvalues count as 0."""
    values, vectors = np.linalg.eigh((metric + metric.T) / 2)
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T


def overlap(axes: np.ndarray, states: dict, metric: np.ndarray | None = None) -> list[tuple[int, object, float, float, float]]:
    """(axis, state, marginal, union, unique) of axes (columns) and the states' axes in a common metric.

    marginal is the share of an axis in a state's span, union that in the span of all states, and unique what the union loses without
    the state. Axes have length 1 after the metric's root; zero axes give zeros.
    """
    half = np.eye(len(axes)) if metric is None else root(metric)
    g = half @ axes
    norms = np.linalg.norm(g, axis=0)
    g = np.where(norms > 1e-12, g / np.maximum(norms, 1e-300), 0.0)
    held = {s: half @ a for s, a in states.items()}

    def share(columns: list[np.ndarray]) -> np.ndarray:
        if not columns or not sum(c.shape[1] for c in columns):
            return np.zeros(g.shape[1])
        return ((orthonormal(np.hstack(columns)).T @ g) ** 2).sum(0)

    union = share(list(held.values()))
    out = []
    for s in sorted(held):
        marginal, without = share([held[s]]), share([a for t, a in held.items() if t != s])
        out += [(j, s, float(marginal[j]), float(union[j]), float(max(0.0, union[j] - without[j]))) for j in range(g.shape[1])]
    return out


def block_overlap(axes: np.ndarray, states: dict, blocks: list[list[int]], metric: np.ndarray | None = None) -> list[tuple[int, object, float]]:
    """(block, state, overlap): mean squared cosine of a block of axes to a state's span."""
    half = np.eye(len(axes)) if metric is None else root(metric)
    out = []
    for b, block in enumerate(blocks):
        q = orthonormal(half @ axes[:, block])
        out += [(b, s, float(((orthonormal(half @ states[s]).T @ q) ** 2).sum() / max(q.shape[1], 1))) for s in sorted(states)]
    return out


def least_norm(axes: np.ndarray, dictionary: np.ndarray, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, errors): each axis from the dictionary's unit columns by coefficients of least norm, and what is left over."""
    norms = np.linalg.norm(dictionary, axis=0)
    unit = dictionary / np.where(norms > 1e-12, norms, 1.0)
    u, s, vt = np.linalg.svd(unit, full_matrices=False)
    keep = s > tolerance * max(float(s[0]) if len(s) else 0.0, 1.0)
    coefficients = (vt[keep].T / s[keep]) @ (u[:, keep].T @ axes)
    return coefficients, np.linalg.norm(axes - unit @ coefficients, axis=0)


def overlaps(rows: DataFrame, key: str, state: str, axis: str) -> DataFrame:
    """(key, axis, state, marginal, union, unique) of each group's rows (key, state, axis array): those with a null state are the axes that
    the others' spans are to explain."""
    kind, named = (rows.schema[c].dataType.simpleString() for c in (key, state))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        _checked(frame)
        own = frame[frame[state].isna()]
        # beside a null pandas makes numbers of whole ones
        whole = named in ("tinyint", "smallint", "int", "bigint")
        states = {int(s) if whole else s: _columns(f[axis]) for s, f in frame[frame[state].notna()].groupby(state)}
        found = overlap(_columns(own[axis]), states) if len(own) and states else []
        return pd.DataFrame([(frame[key].iloc[0], *r) for r in found], columns=[key, "axis", state, "marginal", "union", "unique"])

    return rows.select(key, state, axis).groupBy(key).applyInPandas(one, f"`{key}` {kind}, axis int, `{state}` {named}, marginal double, union double, unique double")


# stability of folds


def span_status(rank: Column, support: Column, ambient: Column) -> Column:
    """What a retained rank can say: nothing at 0, and nothing of its own where it fills the space or its support."""
    return F.when(rank <= 0, "unavailable").when(rank >= ambient, "saturated_ambient").when(rank >= support, "saturated_support").otherwise("informative")


def fold_stability(spans: DataFrame, keys: list[str], fold: str, basis: str) -> DataFrame:
    """(keys, fold_a, fold_b, rank_a, rank_b, mean_angle, max_angle, shared, coverage_a, coverage_b, status_a, status_b) of each pair of folds.

    spans are (keys, fold, support, ambient, basis: array of axes); shared is the sum of squared cosines between two spans. The folds
    of a key are few: they meet in a join on the keys.
    """
    left = spans.select(*keys, F.col(fold).alias("fold_a"), F.col(basis).alias("_a"), F.col("support").alias("_sa"), F.col("ambient").alias("_na"))
    right = spans.select(*keys, F.col(fold).alias("fold_b"), F.col(basis).alias("_b"), F.col("support").alias("_sb"), F.col("ambient").alias("_nb"))
    pairs = left.join(right, keys).where("fold_a < fold_b")

    @F.pandas_udf("array<double>")
    def cosines(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            p, q = (orthonormal(np.array([list(c) for c in m], float).T) if len(m) else None for m in (x, y))
            return [] if p is None or q is None else np.clip(np.linalg.svd(p.T @ q, compute_uv=False), 0, 1).tolist()

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    met = pairs.withColumn("_c", cosines("_a", "_b")).withColumns({"rank_a": F.size("_a"), "rank_b": F.size("_b")})
    angles = F.transform("_c", lambda c: F.degrees(F.acos(c)))
    shared = F.aggregate("_c", F.lit(0.0), lambda s, c: s + c * c)
    return met.select(
        *keys,
        "fold_a",
        "fold_b",
        "rank_a",
        "rank_b",
        (F.aggregate(angles, F.lit(0.0), lambda s, c: s + c) / F.nullif(F.size("_c"), F.lit(0))).alias("mean_angle"),
        F.array_max(angles).alias("max_angle"),
        shared.alias("shared"),
        (shared / F.greatest(F.col("rank_a"), F.lit(1))).alias("coverage_a"),
        (shared / F.greatest(F.col("rank_b"), F.lit(1))).alias("coverage_b"),
        span_status(F.col("rank_a"), F.col("_sa"), F.col("_na")).alias("status_a"),
        span_status(F.col("rank_b"), F.col("_sb"), F.col("_nb")).alias("status_b"),
    )


def complete_rank(axes: DataFrame, keys: list[str], k: str, block: str, requested: Column, cap: Column) -> DataFrame:
    """(keys, requested, feasible, rank): the requested prefix of axes extended to the end of its spectral block, and where that is beyond
    the cap the longest prefix of whole blocks within it (0 if none).

    axes are (keys, k from 1, block); requested and cap may depend on the keys' columns.
    """
    w = Window.partitionBy(*keys, block)
    ends = axes.withColumns({"_end": F.max(k).over(w), "_want": requested, "_cap": cap})
    wanted = F.max(F.when(F.col(k) == F.least(F.col("_want"), F.lit(1 << 30)), F.col("_end")))
    last, within = F.max(k), F.max(F.when(F.col("_end") <= F.col("_cap"), F.col("_end")))
    out = ends.groupBy(*keys).agg(F.first("_want").alias("requested"), F.first("_cap").alias("feasible"), wanted.alias("_w"), last.alias("_l"), within.alias("_in"))
    full = F.when(F.col("requested") <= 0, 0).when(F.col("requested") > F.col("_l"), F.col("_l")).otherwise(F.col("_w"))
    return out.select(*keys, "requested", "feasible", F.when(full <= F.col("feasible"), full).otherwise(F.coalesce("_in", F.lit(0))).cast("int").alias("rank"))
