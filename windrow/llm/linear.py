"""Partition-summed normal equations: each task adds up its own small matrix, and Spark's sum adds the tasks' matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import given_back

#: Doubles of a matrix that travel as one row.
WIDE = 64


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of part(batch), an array of `size` doubles; one such array reaches the driver.

    A task sends its matrix as rows of WIDE doubles, which are added by place: no
    task ever holds more than its own matrix, however many tasks there are.
    """
    blocks = -(-size // WIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(blocks * WIDE), False
        for batch in batches:
            if batch.num_rows:
                total[:size] += part(batch)
                any_rows = True
        if any_rows:
            offsets = pa.array(np.arange(blocks + 1, dtype=np.int32) * WIDE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(total))], names=["i", "v"])

    sums = rows.mapInArrow(given_back(run), "i int, v array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(WIDE)]).alias("v")).collect()
    out = np.zeros(blocks * WIDE)
    for r in sums:
        out[r["i"] * WIDE : (r["i"] + 1) * WIDE] = r["v"]
    return out[:size]


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of doubles as rows of a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def pool_adjacent(sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic (non-decreasing) least-squares fit to the means sums / weights of ordered bins."""
    level: list[list[float]] = []
    for s, w in zip(sums.tolist(), weights.tolist(), strict=True):
        level.append([s, w, 1])
        while len(level) > 1 and level[-2][0] * level[-1][1] >= level[-1][0] * level[-2][1]:
            s2, w2, n2 = level.pop()
            level[-1] = [level[-1][0] + s2, level[-1][1] + w2, level[-1][2] + n2]
    return np.concatenate([np.full(int(n), s / w) for s, w, n in level]) if level else np.zeros(0)
