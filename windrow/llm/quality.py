"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import matrix, pool_adjacent, summed
from .textkit import LOWER, column_bytes, cut, given_back, slim, word_bounds

#: Random features, kernel width (in units of the root of the number of statistics), ridge, calibration bins.
FEATURES, WIDTH, RIDGE, BINS = 384, 1.0, 1.0, 512
THRESHOLD = 0.7
SEED = 7

_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(9, 14)]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 5
_CLASS[128:] = 6
_MARKS = [ord(c) for c in "|!#$%&*.,<>{}=_@"]


def statistics(text: bytes) -> list[float]:
    """Bounded statistics of one whole text; the language, source and id do not enter."""
    n = len(text)
    block = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_CLASS[block], minlength=7)[:7] if n else np.zeros(7)
    every = np.bincount(block, minlength=256) if n else np.zeros(256)
    words = text.translate(LOWER).split()
    m = len(words)
    starts, ends = word_bounds(block)
    lengths = ends - starts
    lines = [x for x in text.split(b"\n") if x.strip()]
    last = _CLASS[block[ends - 1]] if m else np.zeros(0)
    inner = _CLASS[block[starts]] if m else np.zeros(0)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    kinds_of_words = len(set(words))
    d, w = max(1, n), max(1, m)
    return [
        float(np.log1p(n)) / 10,
        float(np.log1p(m)) / 8,
        *(kinds / d).tolist(),
        *[float(np.sqrt(every[c] / d)) for c in _MARKS],
        float(np.log1p(lengths.mean())) if m else 0.0,
        float(np.log1p(lengths.std())) if m else 0.0,
        float(np.log1p(lengths.max())) / 4 if m else 0.0,
        repeats / w,
        pairs / max(1, m - 1),
        kinds_of_words / w,
        float(np.log1p(kinds_of_words)) / 8,
        float((last == 5).mean()) if m else 0.0,
        float((inner == 3).mean()) if m else 0.0,
        float((inner == 5).mean()) if m else 0.0,
        float((lengths == 1).mean()) if m else 0.0,
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(lines))) / 5,
        float(np.log1p(m / max(1, len(lines)))) / 6,
        float(kinds[3] / max(1, kinds[3] + kinds[4])),
        float(len(text.split(b". ")) / w),
    ]


SIZE = len(statistics(b""))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in column_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) for each row."""
    return slim(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(given_back(_statistics), "doc_id long, x array<double>")


class Kernel:
    """cos(Wx + b) features that approximate a Gaussian kernel on standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, size: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), size)) / (width * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)])


class Model:
    """Ridge weights over the kernel features and a non-decreasing map of scores to probabilities."""

    def __init__(self, kernel: Kernel, weights: np.ndarray, edges: np.ndarray, levels: np.ndarray):
        self.kernel, self.weights, self.edges, self.levels = kernel, weights, edges, levels

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.kernel(x) @ self.weights, self.edges, self.levels), 0, 1)


def fit(marked: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, bins: int = BINS, seed: int = SEED) -> Model:
    """Fits rows (x, y, calibrate): weights on the rows not set aside, calibration on those that are.

    Every labelled row counts. Sums of fixed size reach the driver: moments,
    normal equations and a histogram of scores. Without any labelled row every
    score is 0.5.
    """

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    s = summed(marked.select("x"), moments, 1 + 2 * SIZE)
    n = max(1.0, s[0])
    mean = s[1 : 1 + SIZE] / n
    spread = np.sqrt(np.maximum(0, s[1 + SIZE :] / n - mean**2))
    kernel = Kernel(mean, np.where(spread > 1e-9, spread, 1.0), features, width, seed)
    size = 1 + SIZE + features

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y = kernel(matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    e = summed(marked.where("not calibrate").select("x", "y"), equations, size * size + size)
    penalty = np.full(size, ridge)
    penalty[0] = 1e-6
    weights = np.linalg.solve(e[: size * size].reshape(size, size) + np.diag(penalty), e[size * size :])
    low, high = -0.5, 1.5

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        s = kernel(matrix(batch.column(0))) @ weights
        at = np.clip(((s - low) / (high - low) * bins).astype(int), 0, bins - 1)
        y = batch.column(1).to_numpy(zero_copy_only=False)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, y, minlength=bins)])

    h = summed(marked.where("calibrate").select("x", "y"), histogram, 2 * bins)
    count, good = h[:bins], h[bins:]
    if not count.any():
        return Model(kernel, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]) if s[0] else np.array([0.5, 0.5]))
    used = np.flatnonzero(count)
    rate = good.sum() / count.sum()
    levels = pool_adjacent(good[used] + 0.05 * rate, count[used] + 0.05)
    # bins of one level still rank by their score
    levels = np.clip(0.999 * levels + 0.001 * np.linspace(0, 1, len(levels)), 0, 1)
    return Model(kernel, weights, low + (used + 0.5) * (high - low) / bins, levels)


def score_documents(docs: DataFrame, labels: DataFrame, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not
    `held`; those with remainder 3 serve the calibration. A null or empty text
    has a score like any other; a row with a null id is scored but teaches
    nothing; repeated rows come back as often as they come, and repeated labels
    of one document count once (the larger). Texts of any length are read whole, other columns of docs are not read,
    whatever their names; empty docs give an empty table, and without labels every score is 0.5.
    """
    rest = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(4))
    stats = cut(document_statistics(docs, id_col, text_col))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    known = known.where(rest(F.col("doc_id")) != held)
    marked = cut(stats.join(known, "doc_id").select("x", "y", (rest(F.col("doc_id")) == (held + 1) % 4).alias("calibrate")))
    model = fit(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1))) if batch.num_rows else [], pa.float64())], names=["doc_id", "score"])

    scored = stats.mapInArrow(given_back(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(rest(F.col("doc_id")) == held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
