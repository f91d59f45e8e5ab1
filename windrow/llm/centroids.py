"""Centroid clustering of integer vectors with Elkan's bounds.

Every vector keeps its centroid, an upper bound of its distance to that
centroid and a lower bound of its distance to each of the k centroids. When
centroids move, the bounds move by as much; a distance is computed only where
neither the vector's own lower bound nor half the distance between two
centroids rules the other centroid out. Bounds are rounded outwards and prune
only what is strictly farther, so ties are decided by exact integer distances.
Vectors and bounds stay in a table of the shared folder, one for each round;
the driver sees k centroids and their sums.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import given_back, removed, shared_folder

#: Below this, 64-bit sums of squares of 64 differences are exact; wider batches use Python's integers.
NARROW = 1 << 27
#: Rounding error of a square root and of the sums of bounds, generously.
SLACK = 2.0**-40
_LOW = (1 << 32) - 1


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64) -> DataFrame:
    """(vec_id, v array<long>): floor(256 x) of each component of the vectors with exactly `dim` components, none null or non-finite.

    A component of 2^54 or more in size, whose integer has no room in 64 bits, is an error.
    """
    x = F.col(vector_col)
    whole = x.isNotNull() & (F.size(x) == dim) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    narrow = lambda c: F.when(F.abs(c) < float(1 << 54), F.floor(c * 256)).otherwise(F.raise_error(F.lit("a component is too large for 64-bit integers")).cast("long"))
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.transform(x, lambda c: c.cast("double")), narrow).alias("v"))


def _up(x: np.ndarray) -> np.ndarray:
    """float32 values not below x, nor below what x stands for within SLACK."""
    x = x * (1 + SLACK)
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def _down(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x * (1 - SLACK), 0)
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def _squares(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances; object integers where 64 bits may be too few."""
    off = rows - centre
    return (off * off).sum(axis=-1)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def assign(v: np.ndarray, centres: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool) -> tuple[np.ndarray, int]:
    """One pass of Elkan's algorithm over rows; cluster, upper and lower change in place.

    Gives the squared distances to the clusters (right only where they were computed; all, if
    exact) and how many distances were computed.
    """
    if len(v) and max(np.abs(v).max(), np.abs(centres).max()) >= NARROW:
        v, centres = v.astype(object), centres.astype(object)
    half = np.stack([_down(_roots(_squares(centres, c)) / 2) for c in centres])
    own, tight = np.zeros(len(v), v.dtype), np.zeros(len(v), bool)
    computed = 0

    def tighten(rows: np.ndarray) -> None:
        nonlocal computed
        own[rows] = _squares(v[rows], centres[cluster[rows]])
        root = _roots(own[rows])
        upper[rows], lower[rows, cluster[rows]], tight[rows] = _up(root), _down(root), True
        computed += len(rows)

    for c in range(len(centres)):
        open_ = (cluster != c) & (upper >= lower[:, c]) & (upper >= half[cluster, c])
        loose = np.flatnonzero(open_ & ~tight)
        if len(loose):
            tighten(loose)
            open_[loose] = (upper[loose] >= lower[loose, c]) & (upper[loose] >= half[cluster[loose], c])
        rows = np.flatnonzero(open_)
        if not len(rows):
            continue
        other = _squares(v[rows], centres[c])
        computed += len(rows)
        lower[rows, c] = _down(_roots(other))
        better = ((other < own[rows]) | (other == own[rows]) & (c < cluster[rows])).astype(bool)
        moved = rows[better]
        cluster[moved], own[moved], upper[moved] = c, other[better], _up(_roots(other[better]))
    if exact and not tight.all():
        tighten(np.flatnonzero(~tight))
    return own, computed


def _matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dim)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _pass(rows: DataFrame, centres: np.ndarray, drift: np.ndarray | None, last: bool) -> DataFrame:
    """Rows with their state after one assignment; drift, how far each centroid has moved since, is None in the first pass."""
    k, dim = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = _matrix(batch.column(1), dim, np.int64)
            if drift is None:
                cluster, upper = np.zeros(n, np.int32), np.full(n, np.inf, np.float32)
                lower, before = np.zeros((n, k), np.float32), np.zeros(n, np.int64)
            else:
                cluster, before = batch.column(2).to_numpy().copy(), batch.column(5).to_numpy()
                upper = _up(batch.column(3).to_numpy().astype(np.float64) + drift[cluster])
                lower = _down(_matrix(batch.column(4), k, np.float64) - drift)
            # the count of a batch is shared out to its rows, the rest to the first
            own, computed = assign(v, centres, cluster, upper, lower, last)
            count = before + computed // n
            count[0] += computed % n
            if last:
                if len(own) and max(own) >= 1 << 63:
                    raise OverflowError("a squared distance is too large for 64-bit integers")
                columns = {"vec_id": batch.column(0), "cluster": cluster, "distance": own.astype(np.int64), "computed": count}
            else:
                columns = {"vec_id": batch.column(0), "v": batch.column(1), "cluster": cluster, "upper": upper, "lower": _lists(lower), "computed": count}
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))

    schema = "vec_id long, cluster int, distance long, computed long" if last else "vec_id long, v array<long>, cluster int, upper float, lower array<float>, computed long"
    return rows.mapInArrow(given_back(run), schema)


def _sums(state: DataFrame, k: int, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Count and exact component sums of each cluster; k rows reach the driver.

    Each task adds up its own rows; sums travel as two halves of 32 bits, which leave room for any number of tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch in batches:
            v, cluster = _matrix(batch.column(1), dim, np.int64), batch.column(0).to_numpy()
            if not len(v):
                continue
            order = np.argsort(cluster, kind="stable")
            which, start = np.unique(cluster[order], return_index=True)
            wide = np.abs(v).max() >= NARROW
            total[which] += np.add.reduceat((v.astype(object) if wide else v)[order], start, axis=0).astype(object)
            count += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(count)
        if len(used):
            halves = np.hstack([total[used] >> 32, total[used] & _LOW]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), _lists(halves)], names=["cluster", "n", "s"])

    parts = state.select("cluster", "v").mapInArrow(given_back(run), "cluster int, n long, s array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(2 * dim)]).alias("s")).collect()
    return {r["cluster"]: (r["n"], [(r["s"][i] << 32) + r["s"][dim + i] for i in range(dim)]) for r in rows}


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", dim: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, computed) of each row of whole_vectors.

    The first centroids are the k vectors whose `<seed>:<vec_id>` has the smallest SHA-256 (a null id comes last; of
    equal ids the smaller vector comes first), all vectors if there are fewer. Each round assigns every vector to the nearest
    centroid, ties to the smaller number, and moves every centroid that has vectors to the floor of their
    mean, component by component; then all are assigned once more. Repeated rows count as often as they come, equal
    centroids leave the later one empty, an empty table gives an empty one. Squared distances are exact; one beyond
    64 bits is an error. `computed` adds up, over any batch of rows, to the distances that were computed for it.
    """
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/centroids-{uuid.uuid4().hex}"
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(name.asc_nulls_last(), "v").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, computed long")
    centres, drift, rows = np.array([r["v"] for r in first], np.int64), None, vectors
    for i in range(rounds):
        _pass(rows, centres, drift, False).write.parquet(f"{folder}/{i}")
        if i:
            removed(spark, f"{folder}/{i - 1}")
        rows = spark.read.parquet(f"{folder}/{i}")
        sums = _sums(rows, len(centres), dim)
        moved = np.array([[s // sums[c][0] for s in sums[c][1]] if c in sums else centres[c].tolist() for c in range(len(centres))], np.int64)
        drift = np.nextafter(_roots(_squares(moved.astype(object), centres.astype(object))) * (1 + SLACK), np.inf)
        centres = moved
    _pass(rows, centres, drift, True).write.parquet(f"{folder}/last")
    if rounds:
        removed(spark, f"{folder}/{rounds - 1}")
    found = spark.read.parquet(f"{folder}/last")
    per = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    total = sum(per.values())
    table = [(c, s, total, hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in per.items()]
    clusters = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed")


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return cluster_vectors(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5) -> str:
    """SQL of the same rounds, one long table of components a step."""
    steps = [
        """kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)""",
        "x AS MATERIALIZED (SELECT r, vec_id, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM kept)",
        f"first AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, generate_subscripts(v, 1) AS dim, unnest(v) AS y FROM first)",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN c{i} USING (dim) GROUP BY r, c)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT c, dim, sum(x) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY c, dim)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, dim, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), y) AS y FROM c{i} LEFT JOIN m{i} USING (c, dim))")
    return f"""
WITH {', '.join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN h USING (c)
"""


ORACLE = _oracle()
