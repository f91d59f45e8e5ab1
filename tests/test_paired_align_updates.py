"""Paired tests, alignment, slow features and update matrices against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import align, paired, readout, updates


def test_sign_test(spark):
    df = spark.createDataFrame([("a", d) for d in (1.0, 2.0, 3.0, 4.0, -1.0, 0.0, None)] + [("b", 0.0)], "k string, d double")
    got = {r["k"]: (r["wins"], r["losses"], r["p"]) for r in paired.sign_test(df, "d", "k").collect()}
    assert got["a"] == (4, 1, pytest.approx(2 * (1 + 5) / 32))
    assert got["b"] == (0, 0, 1.0)


def test_signed_rank_p_is_exact(spark):
    d = [0.5, -1.5, 2.5, 3.5, -0.25, 4.5, 6.0]
    ranks = [sorted(map(abs, d)).index(abs(x)) + 1 for x in d]
    least = min(sum(r for r, x in zip(ranks, d) if x > 0), sum(r for r, x in zip(ranks, d) if x < 0))
    below = sum(sum(r for r, s in zip(ranks, signs) if s) <= least for signs in itertools.product((0, 1), repeat=len(d)))
    row = paired.signed_ranks(spark.createDataFrame([("a", x) for x in d], "k string, d double"), "d", "k").first()
    assert min(row["w_plus"], row["w_minus"]) == least
    assert row["p"] == pytest.approx(2 * below / 2 ** len(d))


def test_signed_rank_ties_and_zeros(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (2.0,), (0.0,), (2.0,), (None,)], "d double")
    row = paired.signed_ranks(df, "d").first()
    assert (row["n"], row["w_plus"], row["w_minus"]) == (4, 8.5, 1.5)
    z = (1.5 - 5) / math.sqrt(4 * 5 * 9 / 24 - 12 / 48)
    assert row["z"] == pytest.approx(z) and row["p"] == pytest.approx(math.erfc(-z / math.sqrt(2)))


def frame(spark, x, **more):
    return spark.createDataFrame([(i, *(int(v[i]) for v in more.values()), x[i].tolist()) for i in range(len(x))], ", ".join(["id long", *(f"{k} long" for k in more), "x array<double>"]))


def test_coral_gives_target_moments(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 2, rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    source = frame(spark, a)
    moved = align.affine(source, "x", *align.coral(source, frame(spark, b), "x", 0.0))
    got = np.array([r["aligned"] for r in moved.collect()])
    assert np.allclose(got.mean(0), b.mean(0)) and np.allclose(np.cov(got.T), np.cov(b.T))


def test_affine_keeps_null_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, 2.0]), (3, [1.0])], "id long, x array<double>")
    got = {r["id"]: r["aligned"] for r in align.affine(df, "x", np.eye(2) * 2, np.ones(2)).collect()}
    assert got == {1: None, 2: [3.0, 5.0], 3: None}


def test_procrustes_recovers_a_rotation(spark):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([(r.tolist(), (1.5 * r @ q + 2).tolist()) for r in x], "x array<double>, y array<double>")
    matrix, shift = align.procrustes(df, "x", "y")
    assert np.allclose(matrix, 1.5 * q) and np.allclose(shift, 2)


def test_slow_features(spark):
    rng = np.random.default_rng(7)
    x = np.c_[np.sin(np.arange(80) / 9), rng.normal(size=(80, 2))] @ rng.normal(size=(3, 3))
    s = np.arange(80) // 40
    gammas, weights = align.slow_features(frame(spark, x, s=s), "s", "id", "x")
    d = np.vstack([np.diff(x[s == k], axis=0) for k in (0, 1)])
    want = np.sort(np.linalg.eigvals(np.linalg.solve(np.cov(x.T), d.T @ d / len(d))).real)
    assert np.allclose(gammas, want) and np.allclose(weights.T @ np.cov(x.T) @ weights, np.eye(3))


def test_quadratic_rule_at_one_is_the_linear_rule(spark):
    rng = np.random.default_rng(9)
    y = np.arange(90) % 3
    df = frame(spark, rng.normal(size=(90, 4)) * (1 + y[:, None]) + y[:, None], y=y)
    q = {r["id"]: r["predicted"] for r in readout.quadratic_scores(df, "id", "y", "x", 1.0).collect()}
    assert q == {r["id"]: r["predicted"] for r in readout.linear_scores(df, "id", "y", "x").collect()}


def test_components_and_energy(spark):
    df = spark.createDataFrame([(1, np.diag([3.0, 4.0]).ravel().tolist()), (2, None)], "id long, m array<double>")
    parts = updates.components(df, "id", 2, 2, "m")
    assert [(r["k"], r["energy"]) for r in updates.energy_curve(parts, "id").orderBy("k").collect()] == [(1, pytest.approx(0.64)), (2, pytest.approx(1.0))]


def interference(spark, first, second):
    df = spark.createDataFrame([(0, 0, first.ravel().tolist()), (1, 0, second.ravel().tolist())], "task long, module long, m array<double>")
    parts = updates.components(df, "task", *first.shape, "m").withColumn("module", F.lit(0))
    return updates.interference(parts, "module", "task", 0.5).first()["interference"]


def test_interference(spark):
    left, right = np.diag([2.0, 1.0, 0, 0]), np.diag([0, 0, 3.0, 0.5])
    assert interference(spark, left, right) == pytest.approx(0, abs=1e-9)
    assert interference(spark, left, left) > 1
