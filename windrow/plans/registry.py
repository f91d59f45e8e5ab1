"""The register of queries and oracles, and the views of the tables that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sequence
from ..sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(column, digits: int = 6):
    return F.round(column, digits)


def events(spark, sf_dir) -> DataFrame:
    return tables.events(spark, sf_dir)


def samples(spark, sf_dir) -> DataFrame:
    return sequence.positions(events(spark, sf_dir), ["user_id"], ["ts", "event_id"])


def windows(spark, sf_dir) -> DataFrame:
    return tables.scan(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


POSITIONS = "t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)"
LONG = "x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
CENTRED = f"{LONG}, c AS (SELECT label AS cl, dim, avg(v) AS m FROM x GROUP BY 1, 2), d AS (SELECT vec_id, label, cl, sum((v - m) * (v - m)) AS d2 FROM x JOIN c USING (dim) GROUP BY 1, 2, 3), p AS (SELECT vec_id, label, arg_min(cl, d2) AS predicted, min(d2) FILTER (WHERE cl <> label) - min(d2) FILTER (WHERE cl = label) AS margin FROM d GROUP BY 1, 2)"
