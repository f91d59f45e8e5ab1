"""Array helpers shared by the text operators: batches, byte and word hashes.

Everything here works on one Arrow batch or one bounded block of text inside
a task; Spark does the partitioning, shuffling and joining.
"""

from __future__ import annotations

import ctypes
import inspect
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by these bytes: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        factors = np.full(size, base & _MASK, dtype=np.uint64)
        factors[0] = 1
        have = _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


class Prefix:
    """Polynomial prefix sums of a byte block: the hash of any slice in O(1)."""

    def __init__(self, block: np.ndarray):
        n = len(block)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=self.sums[1:])
        self.down = _power("down", _INV, n + 1)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def rolling(self, length: int) -> np.ndarray:
        """Hash of every slice of `length` bytes, by its start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        raw = (self.sums[length:] - self.sums[:n]) * self.down[:n]
        return mix(raw + np.uint64((length * 0xA24BAED4963EE407) & _MASK))


def release() -> None:
    """Gives memory that this worker no longer uses back to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def given_back(run: Callable) -> Callable:
    """A task's function that releases its memory when it ends: Spark keeps idle workers for its next stage."""

    def one(*tables):
        try:
            return run(*tables)
        finally:
            release()

    def each(batches):
        try:
            yield from run(batches)
        finally:
            release()

    # Spark tells the forms of a group's function apart by its arguments
    if inspect.isgeneratorfunction(run):
        return each
    return (lambda left, right: one(left, right)) if len(inspect.signature(run).parameters) == 2 else lambda table: one(table)


def word_bounds(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not white space."""
    if not len(block):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[block]
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[j : n + j]
        out ^= out >> np.uint64(29)
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values (block prefix and suffix minima)."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open bounds of the runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start+1, ... of the given lengths."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def column_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def column_longs(column: pa.Array, null: int = 0) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def binary_rows(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def text_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(row ids, texts) in blocks of about `most` bytes; a longer text is a block of its own."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, text in zip(column_longs(batch.column(0)).tolist(), column_bytes(batch.column(1)), strict=True):
            if texts and size + len(text) > most:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(text)
            size += len(text)
    if texts:
        yield np.array(ids, np.int64), texts


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte block, each text's start in it, and its length."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over the whole table; one number reaches the driver."""
    return int(docs.agg(F.sum(F.octet_length(F.col(column).cast("string"))).alias("n")).first()["n"] or 0)


def parts(spark: SparkSession, size: int, most: int, least: int = 48) -> int:
    """How many buckets keep each near `most` bytes of input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / most))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder that the session names; the shuffle files before it go."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and the master is local (tests, notebooks) a folder beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this library wrote and that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


class Tables:
    """Tables of one run in a folder of its own in the shared folder.

    A table read from files has its files' size, where a checkpoint has the product of the sizes of all that was joined to make it: in
    many rounds of joins that number alone fills the driver.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.held = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """df, written once and read again; one with a name stays when `clear` is called."""
        path = f"{self.folder}/{name}" if name else f"{self.folder}/steps/{self.held}"
        self.held += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes the tables without a name; what was read from them must have been kept under one."""
        removed(self.spark, f"{self.folder}/steps")


#: Rows of a batch that a Python worker is sent where the session leaves Spark's default: whole texts are long.
BATCH_ROWS = "500"


def slim(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are small; a size that the user has set, the default too, stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000" and df.sparkSession.sparkContext.getConf().get(key) is None:
        conf.set(key, BATCH_ROWS)
    return df
