"""A residual adapter that moves one cloud of windows onto another: sliced Wasserstein loss by partition-summed gradients.

Clouds of any size stay in their tasks. In each epoch one pass counts the projections of the mapped windows in bins, which gives every
window its rank on every direction, and a second adds up the gradient towards the target's value of that rank. The target's quantiles
are counted once. The driver holds a network of a few hundred weights and takes the optimiser's steps.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sums import finite, matrix, summed

#: Bins of the projections on a direction.
BINS = 2048


@dataclass
class Adapter:
    """x + W3 g(W2 tanh(W1 x + b1) + b2) + b3 with g(z) = z sigmoid(z); W3 and b3 start at 0, so that it starts as the identity."""

    weights: dict[str, np.ndarray]
    losses: list[float] = field(default_factory=list)

    @classmethod
    def fresh(cls, dim: int, hidden: tuple[int, int], seed: int) -> Adapter:
        rng = np.random.default_rng(seed)
        shape = {"W1": (dim, hidden[0]), "W2": hidden}
        made = {n: rng.uniform(-1, 1, s) * np.sqrt(6 / sum(s)) for n, s in shape.items()}
        return cls(made | {"W3": np.zeros((hidden[1], dim)), "b1": np.zeros(hidden[0]), "b2": np.zeros(hidden[1]), "b3": np.zeros(dim)})

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.weights
        first = np.tanh(x @ w["W1"] + w["b1"])
        z = first @ w["W2"] + w["b2"]
        return first, z, z / (1 + np.exp(-z))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x + self.hidden(x)[2] @ self.weights["W3"] + self.weights["b3"]

    def gradient(self, x: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Gradient of sum(out * self(x)) by all weights, flat in the order of `flat`; out is the loss's gradient at each mapped row."""
        w = self.weights
        first, z, second = self.hidden(x)
        s = 1 / (1 + np.exp(-z))
        dz = (out @ w["W3"].T) * (s + z * s * (1 - s))
        dfirst = (dz @ w["W2"].T) * (1 - first**2)
        parts = {"W1": x.T @ dfirst, "b1": dfirst.sum(0), "W2": first.T @ dz, "b2": dz.sum(0), "W3": second.T @ out, "b3": out.sum(0)}
        return np.concatenate([parts[n].ravel() for n in w])

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.weights.values()])

    def moved(self, flat: np.ndarray) -> Adapter:
        out, at = {}, 0
        for n, v in self.weights.items():
            out[n] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        return Adapter(out, self.losses)


def _counts(rows: DataFrame, mapped, directions: np.ndarray, low: np.ndarray, high: np.ndarray, dim: int) -> np.ndarray:
    """How many rows fall into each of BINS bins between low and high on each direction; what lies beyond counts in the outer bins."""
    p = len(directions)

    def part(b: pa.RecordBatch) -> np.ndarray:
        at = (mapped(matrix(b.column(0), dim)) @ directions.T - low) / (high - low) * BINS
        at = np.clip(at.astype(np.int64), 0, BINS - 1) + np.arange(p) * BINS
        return np.bincount(at.ravel(), minlength=p * BINS).astype(float)

    return summed(rows, part, p * BINS).reshape(p, BINS)


def _edges(rows: DataFrame, directions: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, root mean square distance from it on each direction, and the number of rows."""

    def part(b: pa.RecordBatch) -> np.ndarray:
        z = matrix(b.column(0), dim) @ directions.T
        return np.concatenate([z.sum(0), (z * z).sum(0), [len(z)]])

    s = summed(rows, part, 2 * len(directions) + 1)
    n, p = int(s[-1]), len(directions)
    mean = s[:p] / max(n, 1)
    return mean, np.sqrt(np.maximum(s[p : 2 * p] / max(n, 1) - mean**2, 1e-12)), n


def fit_adapter(
    source: DataFrame, target: DataFrame, vector: str, anchors: DataFrame | None = None, hidden: tuple[int, int] = (16, 16), directions: int = 32, move: float = 0.01, anchor: float = 0.1, rate: float = 0.02, decay: float = 1e-4, clip: float = 1.0, epochs: int = 40, patience: int = 8, seed: int = 0
) -> Adapter:
    """The adapter of least loss: squared sliced Wasserstein distance of the mapped source to the target, plus `move` times the mean squared
    displacement of the source and `anchor` times that of the anchors, which are to stay where they are.

    AdamW with gradients clipped to length `clip`; it stops after `patience` epochs without a better loss and keeps the best weights.
    losses has the loss before each step. Rows with a null or non-finite component take no part; vectors of unlike length and an empty cloud are errors.
    """
    clouds = [df.where(finite(vector)).select(F.col(vector).alias("x")) for df in (source, target, *([anchors] if anchors is not None else []))]
    dim = clouds[0].agg(F.max(F.size("x")).alias("d")).first()["d"]
    if dim is None or clouds[1].isEmpty():
        raise ValueError("a cloud is empty")
    rng = np.random.default_rng(seed)
    theta = rng.standard_normal((directions, dim))
    theta /= np.linalg.norm(theta, axis=1, keepdims=True)
    (m0, s0, n), (m1, s1, _) = _edges(clouds[0], theta, dim), _edges(clouds[1], theta, dim)
    held = clouds[2] if anchors is not None else None
    n_anchors = held.count() if held is not None else 0
    low, high = np.minimum(m0 - 8 * s0, m1 - 8 * s1), np.maximum(m0 + 8 * s0, m1 + 8 * s1)
    centres = low[:, None] + (np.arange(BINS) + 0.5) / BINS * (high - low)[:, None]
    goal = np.cumsum(_counts(clouds[1], lambda x: x, theta, low, high, dim), axis=1)
    goal = (goal / goal[:, -1:]) + np.arange(BINS) * 1e-12  # strictly rising
    net, best, since = Adapter.fresh(dim, hidden, seed), None, 0
    first, second = np.zeros(len(net.flat())), np.zeros(len(net.flat()))
    losses: list[float] = []
    for step in range(1, epochs + 1):
        counts = _counts(clouds[0], net, theta, low, high, dim)
        share = (np.cumsum(counts, axis=1) - counts / 2) / n  # the middle rank of each bin
        wanted = np.array([np.interp(share[p], goal[p], centres[p]) for p in range(directions)])

        def part(b: pa.RecordBatch, net=net, wanted=wanted) -> np.ndarray:
            x = matrix(b.column(0), dim)
            y = net(x)
            z = y @ theta.T
            at = np.clip(((z - low) / (high - low) * BINS).astype(np.int64), 0, BINS - 1)
            off = z - wanted[np.arange(directions), at]
            out = 2 * (off @ theta) / directions + 2 * move * (y - x)
            return np.r_[(off**2).sum() / directions + move * ((y - x) ** 2).sum(), net.gradient(x, out)]

        def still(b: pa.RecordBatch, net=net) -> np.ndarray:
            x = matrix(b.column(0), dim)
            off = net(x) - x
            return np.r_[(off**2).sum(), net.gradient(x, 2 * off)]

        total = summed(clouds[0], part, len(first) + 1) / n
        if n_anchors:
            total += anchor * summed(held, still, len(first) + 1) / n_anchors
        losses.append(float(total[0]))
        if best is None or losses[-1] < best[0] - 1e-9:
            best, since = (losses[-1], net), 0
        else:
            since += 1
            if since >= patience:
                break
        slope = total[1:] * min(1.0, clip / max(np.linalg.norm(total[1:]), 1e-12))
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move_by = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        net = net.moved(net.flat() * (1 - rate * decay) - rate * move_by)
    return Adapter(best[1].weights, losses)


def apply_adapter(windows: DataFrame, vector: str, net: Adapter, out: str = "adapted") -> DataFrame:
    """Adds `out`, the mapped vector; null where the vector is null or holds a null or non-finite component."""
    dim = len(net.weights["b3"])

    @F.pandas_udf("array<double>")
    def mapped(column):
        import pandas as pd

        good = column.notna()
        made = pd.Series([None] * len(column), dtype=object)
        if good.any():
            values = net(np.array(column[good].tolist(), float).reshape(-1, dim))
            made[good.to_numpy()] = pd.Series(list(values), index=made.index[good.to_numpy()])
        return made

    return windows.withColumn(out, mapped(F.when(finite(vector) & (F.size(vector) == dim), F.col(vector).cast("array<double>"))))
