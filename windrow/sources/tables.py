"""Typed scans: explicit columns, -1 as null where it means "not applicable", contracts checked by plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table's columns; only those reach the Parquet reader."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def with_sentinel(df: DataFrame, *columns: str, sentinel: int = -1) -> DataFrame:
    """A sentinel is null from here on."""
    return df.withColumns({c: F.when(F.col(c) != sentinel, F.col(c)) for c in columns})


def delimited(spark: SparkSession, path: str, schema: str, delimiter: str = ",", header: bool = False) -> DataFrame:
    """Delimited text under a declared schema; a bad row fails the read."""
    return spark.read.csv(path, schema=schema, sep=delimiter, header=header, mode="FAILFAST")


def sniffed(spark: SparkSession, path: str, candidates: str = ",;|\t") -> str:
    """The candidate that splits the first lines of a text file into most fields, as many in each; an error if none does."""
    lines = [r["value"] for r in spark.read.text(path).limit(20).collect() if r["value"].strip()]
    counts = {c: {line.count(c) for line in lines} for c in candidates}
    even = [c for c in candidates if len(counts[c]) == 1 and counts[c] != {0}]
    if not even:
        raise ValueError("no delimiter splits all lines alike")
    return max(even, key=lambda c: max(counts[c]))


def recording(spark: SparkSession, path: str, schema: str, time: str, flags: tuple[str, ...] = (), delimiter: str | None = None, header: bool = True) -> DataFrame:
    """Delimited samples under a declared schema, checked: another count of columns or a value of another type fails the read, a time that does not grow
    with the rows of its file, and a flag other than 0 or 1, fail the job that reads it.

    Rows keep their order within a file's splits; a split's first row is compared with no other.
    """
    from ..operators.contracts import demand

    rows = delimited(spark, path, schema, delimiter or sniffed(spark, path), header)
    return demand(_growing(rows, time), {f"{time} does not grow": F.col("_grows"), **{f"{c} is not 0 or 1": F.col(c).isin(0, 1) for c in flags}}).drop("_grows")


def _growing(rows: DataFrame, time: str) -> DataFrame:
    """rows of files with _grows, whether their time is beyond that of the row before them in their split; a task may read many files."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    at = rows.columns.index(time)
    split = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of = -np.inf, None
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column(at).cast(pa.float64()).to_numpy(zero_copy_only=False)
            s = b.column(b.num_columns - 1).to_numpy()
            new = np.r_[s[0] != of, s[1:] != s[:-1]]
            grows = np.where(new, -np.inf, np.r_[last, t[:-1]]) < t
            last, of = t[-1], s[-1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(grows)], names=[*b.schema.names[:-1], "_grows"])

    return rows.select("*", split.alias("_split")).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _grows boolean")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as samples: subject, class, value and position t in the subject's order."""
    return scan(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))


def long_form(windows: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row for each component: dim from 0, v in double."""
    rest = [c for c in windows.columns if c != vector]
    return windows.select(*rest, F.posexplode(vector).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))


def inspect(windows: DataFrame, vector: str, label: str) -> DataFrame:
    """One row: rows, classes, shortest and longest payload, null labels."""
    return windows.agg(F.count("*").alias("n_rows"), F.count_distinct(label).alias("n_classes"), F.min(F.size(vector)).cast("long").alias("min_dim"), F.max(F.size(vector)).cast("long").alias("max_dim"), F.count_if(F.col(label).isNull()).alias("null_labels"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace rows of old with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet, by partitions; readers see it whole once the commit marker is there."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def quiet(column: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(column), column)


def number(column: Column) -> Column:
    """Text as a double; empty or other text is null."""
    return F.nullif(column, F.lit("")).try_cast("double")


def union_sources(sources: list[tuple[str, DataFrame, list[int]]], vector: str, out: str) -> DataFrame:
    """The rows of several sources with the components that each one's montage names, in its order, and the source's name in `out`."""
    parts = [df.withColumn(vector, F.transform(F.array(*map(F.lit, montage)), lambda i: F.get(F.col(vector), i))).withColumn(out, F.lit(name)) for name, df, montage in sources]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole
