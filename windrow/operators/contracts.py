"""Contracts on tables: what is missing, unexpected or broken, as rows, so that a check is a query like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of each rule, a condition that every row must meet; null counts as broken. One pass."""
    sums = rows.agg(*[F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(n) for n, c in rules.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")).select("r.rule", "r.violations")


def demand(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows, where a row that breaks a rule fails the job that reads it."""
    broken = reduce(lambda a, b: a.when(~F.coalesce(b[1], F.lit(False)), F.lit(b[0])), rules.items(), F.when(F.lit(False), F.lit("")))
    return rows.where(F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit("contract broken: "), broken)).cast("boolean")).otherwise(F.lit(True)))


def missing_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations of the values of each key that no row has. The values of the keys after the first are gathered: they are classes, not subjects."""
    grid = rows.select(keys[0]).distinct()
    for k in keys[1:]:
        grid = grid.join(F.broadcast(rows.agg(F.collect_set(k).alias("_all")))).select(*grid.columns, F.explode("_all").alias(k))
    return grid.join(rows.select(*keys).distinct(), keys, "left_anti")


def unexpected(rows: DataFrame, column: str, expected: list) -> DataFrame:
    """(value, side): values that occur and are not expected, and expected ones that do not occur."""
    spark = rows.sparkSession
    kind = rows.schema[column].dataType.simpleString()
    want = spark.createDataFrame([(v,) for v in expected], f"value {kind}")
    have = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return have.join(want, "value", "left_anti").withColumn("side", F.lit("unexpected")).union(want.join(have, "value", "left_anti").withColumn("side", F.lit("absent")))


def label_names(spec: str) -> dict[int, str]:
    """Names by label from "0=Eyes open,1=..." or a JSON object or list, in lower case without anything but a-z and 0-9."""
    import json
    import re

    text = spec.strip()
    if text[:1] in "{[":
        made = json.loads(text)
        pairs = made.items() if isinstance(made, dict) else enumerate(made)
    else:
        pairs = (p.split("=", 1) for p in text.split(",") if p.strip())
    return {int(k): re.sub("[^a-z0-9]", "", str(v).lower()) for k, v in pairs}


def named(rows: DataFrame, label: str, names: dict[int, str], out: str = "name") -> DataFrame:
    """Adds a label's name; null where it has none."""
    mapping = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return rows.withColumn(out, mapping[F.col(label).cast("int")])


def state_labels(phase: Column, task: Column, tasks: list) -> Column:
    """0 in the baseline phase (0), 1.. by the task's place in phase 1, else -1, which a contract rejects."""
    place = F.array_position(F.array(*map(F.lit, tasks)), task).cast("int")
    return F.when(phase == 0, 0).when((phase == 1) & (place > 0), place).otherwise(-1)


def array_audit(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(keys, n, shortest, longest, not_finite, largest): arrays, their lengths, how many hold a null, NaN or infinity, and the largest size of a component."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    size = F.array_max(F.transform(vector, lambda v: F.when(~F.isnan(v), F.abs(v.cast("double")))))
    return rows.groupBy(*keys).agg(F.count(vector).alias("n"), F.min(F.size(vector)).cast("long").alias("shortest"), F.max(F.size(vector)).cast("long").alias("longest"), F.count_if(bad).alias("not_finite"), F.max(size).alias("largest"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, digest) of each table: the digest adds up the first 32 bits of each row's MD5, so it holds for any order and partitioning."""
    parts = []
    for name, t in sorted(tables.items()):
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(t.columns)])
        parts.append(t.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")).alias("digest")).select(F.lit(name).alias("name"), "n", F.coalesce("digest", F.lit(0).cast("long")).alias("digest")))
    return reduce(DataFrame.union, parts)


def seal(tables: dict[str, DataFrame], version: int) -> DataFrame:
    """(name, version, n, schema, digest) of each table.

    A row's SHA-256 is that of its JSON with all columns by name, nulls written out; the digest adds up its four
    quarters over all rows, so it holds for any order and partitioning, and counts repeated rows.
    """
    parts = []
    for name, t in sorted(tables.items()):
        columns = sorted(t.columns)
        own = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        quarter = lambda i: F.sum(F.conv(F.substring(own, 16 * i + 1, 15), 16, 10).cast("decimal(38,0)"))  # noqa: B023, E731
        kinds = ", ".join(f"{c} {t.schema[c].dataType.simpleString()}" for c in columns)
        sums = t.agg(F.count("*").alias("n"), *[F.coalesce(quarter(i), F.lit(0)).cast("string").alias(f"q{i}") for i in range(4)])
        parts.append(sums.select(F.lit(name).alias("name"), F.lit(version).alias("version"), "n", F.lit(kinds).alias("schema"), F.concat_ws("-", *[f"q{i}" for i in range(4)]).alias("digest")))
    return reduce(DataFrame.union, parts)


def export(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """Writes tables and, last, their seal as Parquet under path: a hand-off without a seal is not complete."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    seal({n: spark.read.parquet(f"{path}/{n}") for n in tables}, version).coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest_")


def load(spark, path: str, version: int = 1) -> dict[str, DataFrame]:
    """The tables of an export; another version than the one asked for, and a table whose rows or columns no longer match the seal, are errors."""
    want = {r["name"]: r for r in spark.read.parquet(f"{path}/_manifest_").collect()}  # one row a table
    other = {r["version"] for r in want.values()} - {version}
    if other:
        raise ValueError(f"the hand-off is of version {sorted(other)[0]}, not {version}")
    found = {n: spark.read.parquet(f"{path}/{n}") for n in want}
    have = {r["name"]: r for r in seal(found, version).collect()}
    if have != want:
        raise ValueError(f"tables differ from their manifest: {sorted(n for n in want if have[n] != want[n])}")
    return found


def looked_up(requests: DataFrame, ledger: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """requests with a ledger's columns by key; a request whose key the ledger lacks fails the job that reads it, and so does a ledger with a key twice."""
    once = ledger.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in columns])
    met = requests.join(once, keys, "left")
    rules = {"a key is not in the ledger": F.col("_n").isNotNull(), "a key is twice in the ledger": F.col("_n") == 1}
    return demand(met, rules).drop("_n")


def append(df: DataFrame, path: str, *partitions: str) -> None:
    """Appends to a Parquet table; columns other than the table's are an error."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).schema
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        have = None
    if have is not None:
        own = {(f.name, f.dataType.simpleString()) for f in df.schema}
        theirs = {(f.name, f.dataType.simpleString()) for f in have}
        if own != theirs:
            raise ValueError(f"columns differ from the table's: {sorted(own ^ theirs)}")
    df.write.mode("append").partitionBy(*partitions).parquet(path)
