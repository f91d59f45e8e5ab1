"""Exact top-k inner products over an M-tree, visited best first.

Inner products become distances: with B the largest norm, a vector x gets one
coordinate more, sqrt(B^2 - |x|^2), and a query the coordinate 0; then
|q - x|^2 = |q|^2 + B^2 - 2 q.x, so the nearest are those of highest product.
`operators.metric` holds the tree: super nodes, nodes and pages with covering
radii, stored parent distances and entries sorted by their distance to the
page's centre. A query begins at the node of the lowest bound; then blocks of
neighbouring queries visit groups of nodes in the order of their bounds, in
rounds that grow eightfold. Each tightens the distance of a query's k-th best,
and what the triangle inequality puts beyond that is never compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metric
from .textkit import cut


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<double>): floor(256 x) for each component, which a double holds exactly; rows whose id or vector is null, or with a null or non-finite component, go."""
    x = F.col(vector_col)
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # the floor of a double beyond 2^53 is the double itself
    floor = lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)
    return vectors.where(F.col(id_col).isNotNull()).where(whole).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: floor(c.cast("double") * 256)).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, page: int = metric.PAGE, pivots: int = metric.PIVOTS, counted=None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with all vectors but its own id.

    vectors and queries are (id, v) as integer_vectors gives them. Ties go to the
    smaller id; with fewer than k candidates all are returned; repeated rows of
    one id count once (the first vector in order). An empty vector, or one shorter than the longest, is filled up
    with zeros. Scores are exact at any size of the components; one beyond 64 bits is an error. Other columns are not read, vectors
    of any length are whole. No vectors or no queries: an empty table. `counted`, an accumulator, gets the number of products computed.
    """
    spark = vectors.sparkSession
    vectors = vectors.groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    held = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("b"), F.max(F.size("v")).alias("d")).first()
    longest = queries.agg(F.max(F.size("v")).alias("d")).first()["d"]
    if not held["n"] or longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, bound = max(1, held["d"], longest), float(held["b"])
    full = lambda df: cut(df.select("id", F.concat("v", F.array_repeat(F.lit(0.0), dim - F.size("v"))).alias("x")))
    # of equal vectors only the k + 1 of smallest id can be among anyone's k best
    index = metric.indexed(cut(metric.firsts_of_copies(full(vectors), k + 1)), dim, cut, bound, 1 + bound**0.5, page, pivots)
    return metric.nearest(index, full(queries), k, product=True, counted=counted).withColumnRenamed("id", "vec_id")


def op5_topk(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
