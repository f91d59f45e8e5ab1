"""Sums that tasks add up in arrays: each task sends its array as short rows, which Spark adds by place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Doubles that travel as one row.
WIDE = 64


def finite(vector: str) -> Column:
    """Whether a vector is there and holds no null, NaN or infinite component."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A column of lists as rows of doubles; lists of another length than dim, or than each other, are an error."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != (sizes[0] if dim is None else dim)).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(column) else dim or 0)


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of part(batch), `size` doubles, over all batches; a task holds one such array and one reaches the driver."""
    blocks = -(-size // WIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(blocks * WIDE), False
        for batch in batches:
            if batch.num_rows:
                total[:size] += part(batch).ravel()
                seen = True
        if seen:
            for at in range(0, blocks, 4096):
                held = total[at * WIDE : (at + 4096) * WIDE]
                n = len(held) // WIDE
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * WIDE), pa.array(held))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n, dtype=np.int64)), lists], names=["i", "v"])

    out = np.zeros(blocks * WIDE)
    for r in rows.mapInArrow(run, "i long, v array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(WIDE)]).alias("v")).collect():
        out[r["i"] * WIDE : (r["i"] + 1) * WIDE] = r["v"]
    return out[:size]


def summed_by(rows: DataFrame, key: str, part: Callable[[pa.RecordBatch], np.ndarray], most: int = 1 << 24) -> DataFrame:
    """(key, i, v): the sum of part(batch) over each key's rows, WIDE doubles a row by place i; a task holds about `most` doubles at a time."""
    at, kind = rows.columns.index(key), rows.schema[key].dataType.simpleString()

    def out(held: dict, like: pa.DataType) -> Iterator[pa.RecordBatch]:
        for k, total in held.items():
            blocks = -(-len(total) // WIDE)
            v = np.zeros(blocks * WIDE)
            v[: len(total)] = total
            lists = pa.ListArray.from_arrays(pa.array(np.arange(blocks + 1, dtype=np.int32) * WIDE), pa.array(v))
            yield pa.RecordBatch.from_arrays([pa.array([k] * blocks, like), pa.array(np.arange(blocks)), lists], names=[key, "i", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys = batch.column(at)
            codes = keys.dictionary_encode(null_encoding="encode")
            place = codes.indices.to_numpy()
            for j, k in enumerate(codes.dictionary.to_pylist()):
                more = part(batch.take(pa.array(np.flatnonzero(place == j)))).ravel()
                held[k] = held[k] + more if k in held else more
                if sum(map(len, held.values())) > most:
                    yield from out(held, keys.type)
                    held = {}
            if batch.num_rows:
                like = keys.type
        if held:
            yield from out(held, like)

    return rows.mapInArrow(run, f"`{key}` {kind}, i long, v array<double>").groupBy(key, "i").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(WIDE)]).alias("v"))


def triangular(rows: DataFrame, project: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """R of the QR decomposition of all rows of project(batch), up to signs: each task folds its rows into one R, and groups of 64 tasks fold theirs, twice."""

    def fold(held: np.ndarray, more: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([held, more]), mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                held = fold(held, project(batch))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() >> 6], pa.int64()), pa.array([held.ravel().tolist()], pa.list_(pa.float64()))], names=["slot", "r"])

    def meet(table: pa.Table) -> pa.Table:
        held = np.zeros((0, width))
        for r in table.column("r"):
            held = fold(held, np.array(r.as_py()).reshape(-1, width))
        return pa.table({"slot": pa.array([table.column("slot")[0].as_py() >> 6], pa.int64()), "r": pa.array([held.ravel().tolist()], pa.list_(pa.float64()))})

    parts, kind = rows.mapInArrow(run, "slot long, r array<double>"), "slot long, r array<double>"
    for _ in range(2):
        parts = parts.groupBy("slot").applyInArrow(meet, kind)
    held = np.zeros((0, width))
    for r in parts.collect():  # one matrix for each 4096 tasks
        held = fold(held, np.array(r["r"]).reshape(-1, width))
    return held
