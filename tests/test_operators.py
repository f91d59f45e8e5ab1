"""Small fixtures whose results can be worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import metrics, moments, readout, relate, sampling, sequence
from windrow.sources import tables


def test_balanced_accuracy_variants(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "y int, p int")
    assert metrics.balanced_accuracy(df, "y", "p").first()[0] == pytest.approx(5 / 6)
    assert metrics.balanced_accuracy(df, "y", "p", classes=3).first()[0] == pytest.approx(5 / 9)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False), (3.0, True)], "s double, pos boolean")
    assert metrics.auc(df, "s", "pos").first()["auc"] == pytest.approx(0.875)


def test_adjusted_p_skips_nan(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (float("nan"),)], "p double")
    assert {round(r["p"], 2): r["q"] for r in metrics.benjamini_hochberg(df, "p").where("q is not null").collect()} == pytest.approx({0.01: 0.03, 0.03: 0.04, 0.04: 0.04})


def test_empirical_p(spark):
    df = spark.createDataFrame([(3.0, float(i)) for i in range(1, 5)], "real double, null double")
    r = metrics.empirical_p(df, "real", "null").first()
    assert (r["p_upper"], r["p_lower"]) == pytest.approx((0.6, 0.8))


def test_stable_cutoff_is_not_the_first_crossing(spark):
    df = spark.createDataFrame([("m", 0.0, 0.5), ("m", 0.5, 0.99), ("m", 0.7, 0.9), ("m", 1.0, 1.0)], "k string, q double, y double")
    assert sequence.stable_cutoff(df, "k", "q", "y", 0.95).first()["cutoff"] == 1.0
    assert 0 < sequence.first_crossing(df, "k", "q", "y", 0.95).first()["crossing"] < 0.5


def test_jump_energy(spark):
    df = spark.createDataFrame([("a", i, float(i % 2)) for i in range(4)], "k string, t int, x double")
    assert sequence.jump_energy(df, "k", ["t"], "x").first()["jump_energy"] == pytest.approx(4.0)


def test_gap_segments(spark):
    df = spark.createDataFrame([("a", s) for s in (0, 1, 2, 5, 6, 9)], "k string, s int")
    w = sequence.order("k", by=["s"])
    got = sequence.segments(df, ["k"], ["s"], F.col("s") - F.lag("s").over(w) > 1).groupBy("segment_id").count().where("count > 1")
    assert sorted(r["count"] for r in got.collect()) == [2, 3]


def test_sliding_windows(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)], "k string, t int")
    got = {r["start"]: r["count"] for r in sequence.sliding_windows(df, "k", "t", 4, 3).groupBy("start").count().collect()}
    assert got == {0: 4, 3: 4, 6: 4}


def test_range_join_matches_brute_force(spark):
    s = spark.createDataFrame([("a", i) for i in range(50)], "k string, t long")
    i = spark.createDataFrame([("a", 3, 9), ("a", 8, 30), ("b", 0, 50)], "k string, start long, stop long")
    assert relate.in_intervals(s, i, "k", "t", "start", "stop", 7).count() == 6 + 22


def test_ledger_difference(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert relate.ledger_difference(a, a, "k", ["v"]).first()["status"] == "pass"
    b = spark.createDataFrame([(1, "y"), (2, None)], "k int, v string")
    assert relate.ledger_difference(a, b, "k", ["v"]).first()["mismatches"] == 1


def test_solves_match_numpy(spark):
    rng = np.random.default_rng(5)
    y = np.repeat([0, 1, 2], 40)
    x = (rng.standard_normal((120, 5)) + 3 * np.eye(3, 5)[y]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "id long, label int, v array<double>")
    stats = moments.sufficient(df, "v", "label")
    _, means, covs, pooled = readout.class_statistics(stats)
    assert np.allclose(covs[1], np.cov(x[y == 1].T)) and np.allclose(means[2], x[y == 2].mean(0))
    axes, values = readout.fisher_axes(stats)
    assert axes.shape == (5, 2) and (values[:1] >= values[1:]).all()
    k = np.linalg.inv(pooled + 1e-3 * np.trace(pooled) / 5 * np.eye(5))
    want = np.argmax(x @ k @ means.T - 0.5 * np.einsum("ci,ij,cj->c", means, k, means), axis=1)
    got = {r["id"]: r["predicted"] for r in readout.linear_scores(df, "id", "label", "v").collect()}
    assert [got[i] for i in range(120)] == want.tolist()
    assert metrics.balanced_accuracy(readout.ridge_readout(df, "id", "label", "v"), "label", "predicted").first()[0] > 0.9


def test_greedy_folds_and_upsert(spark):
    assert sampling.greedy_folds([(5, 2), (4, 1), (1, 1)], 2) == {5: [(0, 1), (1, 1)], 4: [(0, 1)], 1: [(1, 1)]}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = tables.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_streaming_windows(spark, tmp_path):
    from windrow.streaming import windows

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = windows.sliding_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("sliding").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "10 minutes", "5 minutes"), "event_type").count().count()
    assert spark.table("sliding").count() == want


def test_catalog_covers_all_components_and_positions(spark, tmp_path):
    """Every one of 64 components, and a user of 5000 samples, past the fixed ends of the hand-written SQL."""
    from windrow.plans import catalog

    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 64)).astype(np.float32)
    spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.range(5000).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "id div 4990 as user_id", "'a' as event_type", "double(id) as value").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["label"], r["i"], r["j"]): r["cov"] for r in catalog.QUERIES["class_covariance_whole"](spark, str(tmp_path)).collect()}
    assert len(got) == 2 * 2080
    for c in (0, 1):
        want = np.cov(x[c::2].astype(float), rowvar=False)
        assert all(abs(got[c, i, j] - want[i, j]) < 2e-6 for i in range(64) for j in range(i, 64))
    n = {(r["user_id"], r["interval_no"]): r["n"] for r in catalog.QUERIES["samples_in_all_intervals"](spark, str(tmp_path)).collect()}
    want = {}
    for u, size in ((0, 4990), (1, 10)):
        for t in range(size):
            if t % 7 < 5:
                want[u, t // 7] = want.get((u, t // 7), 0) + 1
    assert n == want
    starts = sorted(r["start"] for r in catalog.QUERIES["sliding_window_means"](spark, str(tmp_path)).where("user_id = 0").select("start").collect())
    assert starts == list(range(0, 4990 - 8 + 1, 3))
