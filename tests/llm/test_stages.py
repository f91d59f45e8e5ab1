"""The pipeline's stages, and operators on documents, where columns clash, values are null and rows repeat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from windrow.llm import decontaminate, minhash, passages, suffix_dedup

COMMON = " ".join(f"shared{i}" for i in range(60))
TEXTS = [
    (1, "one two three four five six seven " + COMMON),
    (2, COMMON + " another ending of a text altogether that goes on a bit"),
    (3, "nothing in common with anybody else here at all"),
    (3, "nothing in common with anybody else here at all"),
    (4, None),
    (5, ""),
    (None, COMMON),
    (7, "word " * 30_000 + "end"),
]
EXTRA = ["_cut_id", "_CUT_SPANS", "_keep_first", "spans", "doc", "start", "end", "component_id", "score", "predicted", "item_id", "_r", "_bucket"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    rows = [(i, t, "en", None if i == 3 else "s", len(t or ""), *[f"{c}{n}" for c in EXTRA]) for n, (i, t) in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_first_of_group_keeps_columns(spark, docs):
    got = corpus_pipeline.keep_first(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 3, 4, 7]
    assert all(r["_keep_first"].startswith("_keep_first") for r in got.collect())
    assert corpus_pipeline.keep_first(spark, docs.limit(0), "").count() == 0


def test_passages_are_cut_whatever_the_columns(spark, docs):
    got = corpus_pipeline.drop_passages(spark, docs, "")
    assert got.columns == docs.columns
    text = {r["doc_id"]: r for r in got.where("doc_id is not null").collect()}
    assert text[1]["text"] == TEXTS[0][1] and text[2]["text"].strip() == "another ending of a text altogether that goes on a bit"
    assert text[2]["n_chars"] == len(text[2]["text"]) and text[2]["_cut_id"] == "_cut_id1" and text[2]["_CUT_SPANS"] == "_CUT_SPANS1"
    assert got.where("doc_id is null").count() == 1 and got.where("doc_id = 3").count() == 2
    assert corpus_pipeline.drop_passages(spark, docs.limit(0), "").count() == 0


def test_leaks_go_whatever_the_columns(spark, docs, tmp_path):
    bench = [(1, "nothing in common with anybody else here"), (2, None), (None, COMMON), (1, "nothing in common with anybody else here")]
    spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(9)).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and got.count() == len(TEXTS) - 2
    found = decontaminate.matches(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in found.collect()] == [(3, 1, 0)] * 2
    assert decontaminate.matches(docs.limit(0), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0


def test_packing_and_bytes_whatever_the_columns(spark, docs):
    packed = corpus_pipeline.pack(spark, docs, "")
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert packed.where("start = 0").count() == len(TEXTS) and corpus_pipeline.pack(spark, docs.limit(0), "").count() == 0
    assert suffix_dedup.repeated_bytes(docs).count() == len(TEXTS)


def test_stage_copies_go(spark, tmp_path):
    from pathlib import Path

    from windrow.llm.textkit import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://").removeprefix("file:"))
    before = set(folder.glob("pipeline-*"))
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    (own,) = set(folder.glob("pipeline-*")) - before
    assert got.count() > 0 and [x.name for x in own.iterdir()] == [corpus_pipeline.STAGES[-1][0]]


def test_links_of_very_many_pairs_stay_apart():
    import numpy as np

    n = 1 << 18
    doc = np.arange(n)
    links = np.stack([doc + 1, doc * 0, doc * 0 + 90, doc * 0, doc * 0, doc * 0 + 90])
    assert passages._joined(links).shape == links.shape and passages._chained(links).shape == links.shape
    twice = np.hstack([links, links + np.array([0, 50, 50, 0, 50, 50])[:, None]])
    out = passages._joined(twice)
    assert out.shape[1] == n and (out[2] == 140).all() and (out[5] == 140).all()


@pytest.mark.parametrize("buckets, shares", [(48, 48), (5000, 3000)])
def test_repeated_bytes_at_any_number_of_buckets(spark, tmp_path, monkeypatch, buckets, shares):
    import random

    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(300))
    rows = [(i, "".join(rng.choice("ghijkl ") for _ in range(200)) + (passage[rng.randrange(100) :] if i % 3 else "") + f"{i}") for i in range(60)] + [(60, passage), (61, passage), (62, ""), (63, None)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    counts = iter([buckets, shares])
    monkeypatch.setattr(suffix_dedup, "parts", lambda *a, **k: next(counts))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_bytes(spark.read.parquet(path)).collect()}
    seen: set[bytes] = set()
    for i, text in rows:
        data = (text or "").encode()
        own = [data[k : k + 50] for k in range(len(data) - 49)]
        covered = {b for k, s in enumerate(own) if s in seen for b in range(k, k + 50)}
        assert got[i] == len(covered)
        seen.update(own)


def _joined(n, p, q):
    label = list(range(n))
    for a, b in zip(p.tolist(), q.tolist(), strict=True):
        x, y = label[a], label[b]
        label = [min(x, y) if c in (x, y) else c for c in label]
    return label


def test_windows_of_few_distinct_shingles_are_linked():
    marks = np.random.default_rng(0).integers(1, 256, (12, passages.SPAN)).astype(np.uint8)
    marks[10] = marks[11] = np.resize(np.arange(1, 7), passages.SPAN)  # a phrase again and again
    label = _joined(12, *passages._pairs(marks, np.arange(12))[:2])
    assert label[10] == label[11]


def test_windows_stay_linked_when_the_largest_component_gets_another_name():
    rng = np.random.default_rng(1)
    n, half = 700, passages.REACH
    marks = rng.integers(1, 256, (n, passages.SPAN)).astype(np.uint8)
    marks[8:400] = marks[7]  # the largest component, centre 7
    marks[8, :half] = rng.integers(1, 256, half)
    marks[9, :half] = rng.integers(1, 256, half)
    marks[:, half] = 77
    marks[410, :half], marks[410, half:] = marks[9, :half], marks[3, half:]  # like 3 and, on the other side, like 9: now 3 names all
    marks[n - 1, :half] = marks[8, :half]
    label = _joined(n, *passages._pairs(marks, np.arange(n))[:2])
    assert label[410] == label[3] == label[9] == label[7] and label[n - 1] == label[8]


def test_simhash_proposes_near_copies_without_bands(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(30):
        text = rng.choice(words, 1500).tolist()
        rows += [(10 * i, " ".join(text)), (10 * i + 1, " ".join(text[:-1] + ["other"]))]
    rows += [(1000 + i, " ".join(rng.choice(words, 1500).tolist())) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(minhash, "PIVOTS", 0)
    monkeypatch.setattr(minhash, "_last_links", lambda *_: spark.createDataFrame([], "u long, v long"))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(df).collect()}
    assert all(got[i] == i for i in range(0, 300, 10)) and all(got[1000 + i] == 1000 + i for i in range(30))
    assert sum(got[10 * i + 1] == 10 * i for i in range(30)) >= 25
