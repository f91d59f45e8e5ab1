"""A corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet in the shared folder and reads again as the next stage's docs; a
stage's copy goes once the next is written. All
but the last return the columns of documents. A document without an id cannot
be named by a decision and leaves at the first stage; of rows with one id the
near-duplicate stage keeps the one whose text sorts first. Null text is empty,
repeated rows leave with the near copies, an empty table gives an empty one
at every stage, and further columns are carried along whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.llm import decontaminate, minhash, packing, passages, quality
from windrow.llm.textkit import removed, shared_folder, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    scored = quality.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = scored.where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(good, "doc_id", "left_semi")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies: five-word shingles, proposed by SimHash and what it misses by min-hashes, Jaccard 0.8 or more."""
    groups = minhash.near_copies(docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    left = docs.join(first, "doc_id", "left_semi")
    # of rows with one id the one whose text, then other columns, sort first
    order = Window.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    rank = unused(left, "_keep_first")
    return left.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; n_chars follows the text."""
    kept = passages.without_repeats(docs, passages.repeated_passages(docs))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    leaks = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", keep_first),
    ("substring_dedup", drop_passages),
    ("benchmark_decontamination", drop_benchmark),
    ("packing", pack),
]

#: The stages fit models and hash words, which SQL does not express. Tests compare the near-duplicate stage with all
#: pairs, the passages and the leaks with brute force, and the packing with the tokenizer; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:  # the stage has read all of it
            removed(spark, before)
        before = out
    return docs
