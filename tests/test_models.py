"""Reducers, neighbours, ranks, spans, nulls and selection against NumPy and plain Python."""

import itertools
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import adapter, align, moments, nulls, rangefinder, ranks, readout, relate, selection, spaces, subspaces
from windrow.sources.scratch import shared_folder


def windows(spark, x, labels=None, **more):
    rows = [(i, v.tolist(), int(labels[i]) if labels is not None else 0, *[int(c[i]) for c in more.values()]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "key long, x array<double>, label int" + "".join(f", {n} int" for n in more)).repartition(5)


# reducers


def test_range_finder_of_long_vectors(spark):
    rng = np.random.default_rng(0)
    n, d, rank = 60, 20_000, 4
    left, right = np.linalg.qr(rng.standard_normal((n, 12)))[0], np.linalg.qr(rng.standard_normal((d, 12)))[0]
    x = (left * (40 * 0.6 ** np.arange(12))) @ right.T + 0.3
    weights = rng.uniform(0.5, 2, n)
    df = spark.createDataFrame([(v.tolist(), float(w)) for v, w in zip(x, weights, strict=True)] + [(None, 1.0), (x[0].tolist(), None), (x[0].tolist(), 0.0)], "x array<double>, w double").repartition(4)
    mean, axes, values, total = rangefinder.range_finder(df, "x", rank, "w")
    centre = weights @ x / weights.sum()
    scaled = (x - centre) * np.sqrt(weights)[:, None]
    _, want, vt = np.linalg.svd(scaled, full_matrices=False)
    assert np.allclose(mean, centre, atol=1e-9) and np.allclose(values, want[:rank], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(axes * vt[:rank].T, axis=0)), 1, atol=1e-6) and abs(total - (scaled**2).sum()) < 1e-6 * total


def test_short_vectors_of_a_flat_spectrum(spark, tmp_path):
    from windrow.plans import reducers

    x = np.random.default_rng(8).standard_normal((3000, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    off = x.astype(float) - x.astype(float).mean(0)
    energy = ((off @ np.linalg.eigh(off.T @ off)[1][:, -3:]) ** 2).sum(1)
    got = {r["vec_id"]: r["energy"] for r in reducers.sketched_energy(spark, str(tmp_path)).collect()}
    assert max(abs(got[i] - e) for i, e in enumerate(energy)) < 6e-7


def test_infeasible_ranks_are_errors(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((9, 6)), np.repeat([0, 1, 2], 3)
    df = windows(spark, x, y)
    stats = moments.sufficient(df, "x", "label")
    assert spaces.feasible_rank(stats, 6) == 6
    few = {0: stats[0], 1: stats[1]}
    with pytest.raises(ValueError, match="not feasible: at most 4"):
        spaces.reducer(few, 5)
    with pytest.raises(ValueError, match="not feasible"):
        rangefinder.range_finder(df, "x", 7)
    with pytest.raises(Exception, match="differ in length"):
        rangefinder.range_finder(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "x array<double>"), "x", 1)
    mean, axes, s = spaces.reducer(stats, 2, balanced=True)
    w = np.repeat(1 / 9, 9)
    _, want, vt = np.linalg.svd((x - w @ x) * np.sqrt(w)[:, None], full_matrices=False)
    assert np.allclose(np.abs(np.sum(axes * vt[:2].T, axis=0)), 1) and np.allclose(s / np.sqrt(9), want[:2])


# neighbours


def test_neighbours_match_brute_force_and_skip_most_pairs(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((50, 6)) * 100, 60, axis=0) + rng.standard_normal((3000, 6))
    x[7:40] = x[7]
    df = windows(spark, x).select("key", "x")
    odd = spark.createDataFrame([(9000, None), (9001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9002, [1.0]), (None, [0.0] * 6), (9003, [float("nan")] * 6), (5, [1e9] * 6)], "key long, x array<double>")
    counted = spark.sparkContext.accumulator(0)
    got = relate.nearest_neighbours(df.union(odd), df.where("key % 25 = 0"), "key", "x", 4, page=32, counted=counted).collect()
    for q in range(0, 3000, 25):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(3000), d)) if j != q][:4]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["neighbour"] for r in own] == order and np.allclose([r["distance"] for r in own], d[order])
    assert 0 < counted.value < 0.1 * 120 * 3000
    assert relate.nearest_neighbours(df.limit(0), df, "key", "x", 4).count() == 0


def test_neighbours_shuffle_in_proportion_where_bounds_prune_nothing(spark):
    """Random vectors, a quarter of them asked for: every page is compared, by several blocks and groups; whole numbers have many ties."""
    shuffled, rng = [], np.random.default_rng(3)
    # tables too large to broadcast
    conf, threshold = spark.conf, "spark.sql.autoBroadcastJoinThreshold"
    old = conf.get(threshold)
    conf.set(threshold, "-1")
    try:
        for n, x in ((1500, rng.standard_normal((1500, 24))), (4500, rng.standard_normal((4500, 24))), (1500, rng.integers(0, 3, (1500, 24)).astype(float))):
            df = windows(spark, x).select("key", "x").localCheckpoint()
            written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
            before, counted = written(), spark.sparkContext.accumulator(0)
            got = {tuple(r) for r in relate.nearest_neighbours(df, df.where("key % 4 = 0"), "key", "x", 5, page=32, counted=counted).select("query_id", "rank", "neighbour").collect()}
            shuffled.append(written() - before)
            d = ((x[::4, None] - x[None]) ** 2).sum(2)
            d[np.arange(len(d)), np.arange(0, n, 4)] = np.inf
            assert got == {(4 * q, r + 1, int(j)) for q, row in enumerate(d) for r, j in enumerate(np.lexsort((np.arange(n), row))[:5])}
            assert counted.value > 0.5 * n * n / 4
    finally:
        conf.set(threshold, old)
    assert shuffled[1] < 4 * shuffled[0], shuffled


# ranks


def test_places_and_percentiles_of_a_hot_key(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 17 == 0 else "hot" if i % 3 else f"k{i % 5}", None if i % 29 == 0 else float(rng.integers(0, 40)), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, v double, i long").repartition(7)
    got = {(r["k"], r["i"]): r["place"] for r in ranks.places(df, ["k"], ["v", "i"], "place").collect()}
    down = {(r["k"], r["i"]): r["place"] for r in ranks.places(df, ["k"], ["v", "i"], "place", down=True).collect()}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[k, r[2]] for r in own] == list(range(len(own))) == [down[k, r[2]] for r in reversed(own)]
    quantiles = {r["k"]: r for r in ranks.percentiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    for k in {r[0] for r in rows}:
        want = np.percentile([r[1] for r in rows if r[0] == k and r[1] is not None], [0, 25, 50, 99, 100])
        assert np.allclose([quantiles[k][f"p{i}"] for i in range(5)], want)
    whole = ranks.percentiles(df, [], "v", [0.5]).first()["p0"]
    assert whole == np.median([r[1] for r in rows if r[1] is not None])
    assert ranks.places(df.limit(0), ["k"], ["v"], "place").count() == 0


# spans


def random_parts(rng, d, r):
    return np.linalg.qr(rng.standard_normal((d, r)))[0], np.linalg.qr(rng.standard_normal((d, r)))[0], rng.uniform(1, 3, r)


def test_principal_directions_within_a_context(spark):
    rng = np.random.default_rng(4)
    u, v, s = random_parts(rng, 9, 3)
    more_u, more_v, _ = random_parts(rng, 9, 2)
    cu, cv = np.hstack([more_u, u]), np.hstack([more_v, v])
    p = subspaces.principal(u, v, s, cu, cv)
    assert np.allclose(p["cosines"], 1) and np.allclose(subspaces.projected_update(p, cu, cv), (u * s) @ v.T)
    part = subspaces.projected_update(p, cu, cv, [0, 1]) + subspaces.projected_update(p, cu, cv, [2])
    assert np.allclose(part, (u * s) @ v.T)
    with pytest.raises(IndexError):
        subspaces.projected_update(p, cu, cv, [3])
    # against the plain projection of flattened matrices
    flat = lambda a, b: np.einsum("ik,jk->ijk", a, b).reshape(-1, a.shape[1])
    p = subspaces.principal(u, v, s, more_u, more_v)
    q = np.linalg.qr(flat(more_u, more_v))[0]
    want = (q @ (q.T @ ((u * s) @ v.T).ravel())).reshape(9, 9)
    assert np.allclose(subspaces.projected_update(p, more_u, more_v), want)
    assert np.allclose(np.degrees(np.arccos(p["cosines"])), spaces.principal_angles(flat(u, v), flat(more_u, more_v))[: len(p["cosines"])])
    rows = [(m, c, float(w), a.tolist(), b.tolist()) for m in (1, 2) for c, (x, y, z) in ((False, (u, v, s)), (True, (cu, cv, np.ones(5)))) for a, b, w in zip(x.T, y.T, z, strict=True)]
    got = subspaces.principal_directions(spark.createDataFrame(rows, "m long, context boolean, sigma double, u array<double>, v array<double>"), "m").collect()
    assert len(got) == 6 and all(abs(r["cosine"] - 1) < 1e-9 for r in got)
    assert abs(sum(r["coefficient"] ** 2 for r in got) - 2 * (s**2).sum()) < 1e-9


def test_candidates_of_any_number_against_a_context(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for m, n in ((1, 5), (2, 40)):  # group 2 spans all 12 dimensions: its cosines are 1 and the first direction has the update's image
        u, v, s = rng.standard_normal((3, n)), rng.standard_normal((4, n)), rng.uniform(1, 3, n)
        cu, cv = rng.standard_normal((3, 2)), rng.standard_normal((4, 2))
        rows += [(m, c, float(w), a.tolist(), b.tolist()) for c, (x, y, z) in ((False, (u, v, s)), (True, (cu, cv, np.ones(2)))) for a, b, w in zip(x.T, y.T, z, strict=True)]
        q = np.linalg.qr(np.einsum("ik,jk->ijk", cu, cv).reshape(12, 2))[0]
        update = ((u * s) @ v.T).ravel()
        want[m] = ((q.T @ update) ** 2).sum() / (update**2).sum(), (update**2).sum()
    df = spark.createDataFrame(rows, "m long, context boolean, sigma double, u array<double>, v array<double>").repartition(3)
    one = {(r["m"], r["k"]): (r["cosine"], abs(r["coefficient"])) for r in subspaces.principal_directions(df, "m").collect()}
    summed = {(r["m"], r["k"]): (r["cosine"], abs(r["coefficient"])) for r in subspaces.principal_directions(df, "m", most=1).collect()}
    assert one.keys() == summed.keys() and len(one) == 4 and all(np.allclose(one[k], summed[k], atol=1e-7) for k in one)
    assert np.isclose(one[2, 1][1] ** 2 / want[2][1], want[2][0]) and one[2, 2][1] == 0 and np.allclose([one[2, 1][0], one[2, 2][0]], 1)
    monkeypatch.setattr(subspaces, "MOST_PARTS", 3)  # a context's limit is none of its candidates'
    kept = {r["m"]: r["kept"] for r in subspaces.kept_energy(df, "m").collect()}
    assert all(np.isclose(kept[m], want[m][0]) for m in want)
    assert len(subspaces.principal_directions(df, "m", most=1).collect()) == 4


def test_overlap_of_known_spans():
    e = np.eye(6)
    axes = np.stack([e[0], (e[0] + e[1]) / np.sqrt(2), e[5], e[2]], axis=1)
    got = {(j, s): (m, u, o) for j, s, m, u, o in subspaces.overlap(axes, {"a": e[:, [0, 2]], "b": e[:, [1]], "c": e[:, [2, 3]]})}
    assert np.allclose(got[0, "a"], (1, 1, 1)) and np.allclose(got[1, "a"], (0.5, 1, 0.5)) and np.allclose(got[1, "b"], (0.5, 1, 0.5))
    assert np.allclose(got[2, "a"], (0, 0, 0)) and np.allclose(got[3, "a"], (1, 1, 0)) and np.allclose(got[3, "c"], (1, 1, 0))  # both hold it: neither alone
    rng = np.random.default_rng(5)
    metric = rng.standard_normal((6, 6))
    metric = metric @ metric.T
    half = subspaces.root(metric)
    assert np.allclose(half @ half, metric)
    g, a = rng.standard_normal((6, 2)), rng.standard_normal((6, 3))
    q, h = np.linalg.qr(half @ a)[0], half @ g / np.linalg.norm(half @ g, axis=0)
    assert np.allclose([m for _, _, m, _, _ in subspaces.overlap(g, {0: a}, metric)], ((q.T @ h) ** 2).sum(0))
    ((_, _, block),) = subspaces.block_overlap(g, {0: a}, [[0, 1]], metric)
    assert np.isclose(block, ((q.T @ np.linalg.qr(half @ g)[0]) ** 2).sum() / 2)
    dictionary = np.hstack([a, a[:, :1]])  # a repeated column: of all solutions the one of least norm
    coefficients, left = subspaces.least_norm(a[:, :1], dictionary)
    assert left[0] < 1e-9 and np.allclose(coefficients[0], coefficients[3])


def test_fold_stability_and_ranks(spark):
    e = np.eye(5)
    spans = [(0, 0, [e[0].tolist(), e[1].tolist()], 4, 5), (0, 1, [e[0].tolist(), e[2].tolist()], 2, 5), (0, 2, [], 3, 5)]
    got = {(r["fold_a"], r["fold_b"]): r for r in subspaces.fold_stability(spark.createDataFrame(spans, "mode int, fold int, basis array<array<double>>, support int, ambient int"), ["mode"], "fold", "basis").collect()}
    r = got[0, 1]
    assert (round(r["mean_angle"], 6), round(r["max_angle"], 6), round(r["shared"], 6), r["coverage_a"], r["status_a"], r["status_b"]) == (45, 90, 1, 0.5, "informative", "saturated_support")
    assert got[0, 2]["shared"] == 0 and got[0, 2]["status_b"] == "unavailable" and got[0, 2]["max_angle"] is None
    blocks = spark.createDataFrame([("a", k, b) for k, b in ((1, 1), (2, 1), (3, 2), (4, 3), (5, 3))], "m string, k int, block int")
    rank = lambda want, cap: subspaces.complete_rank(blocks, ["m"], "k", "block", F.lit(want), F.lit(cap)).first()["rank"]
    assert [rank(1, 9), rank(3, 9), rank(4, 9), rank(4, 4), rank(9, 9), rank(0, 9), rank(1, 1)] == [2, 3, 5, 3, 5, 0, 0]


# nulls


def test_exact_label_null(spark):
    rng = np.random.default_rng(6)
    rows = [(run, run * 10, int(rng.choice([0, 10, 20, 30])) if rng.random() < 0.6 else run * 10) for run in range(4) for _ in range(20 + run)]
    got = {r["draw"]: r for r in nulls.exact_label_null(spark.createDataFrame(rows, "run int, truth int, p int"), "run", "truth", "p").collect()}
    for d, labels in enumerate(itertools.permutations([0, 10, 20, 30])):
        want = np.mean([np.mean([p == labels[r] for run, _, p in rows if run == r]) for r in range(4)])
        assert abs(got[d]["balanced_accuracy"] - want) < 1e-12 and got[d]["observed"] == (labels == (0, 10, 20, 30))
    with pytest.raises(ValueError):
        nulls.exact_label_null(spark.createDataFrame([(0, 1, 1), (0, 2, 1)], "run int, truth int, p int"), "run", "truth", "p")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_keyed_permutations(n):
    seen = {tuple(nulls.permuted(np.arange(n), n, d, 5)) for d in range(4)}
    assert all(sorted(p) == list(range(n)) for p in seen) and (n < 10 or len(seen) == 4)


def test_eigenvalue_null_matches_numpy(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 200) * 5
    x = rng.standard_normal((200, 4)) + (y == 5)[:, None] * [2, 0, 0, 0]
    got = nulls.eigenvalue_null(windows(spark, x, y), "key", "label", "x", 19, seed=9).orderBy("k").collect()

    def values(labels):
        stats = {c: (int((labels == c).sum()), x[labels == c].sum(0), x[labels == c].T @ x[labels == c]) for c in np.unique(labels)}
        return readout.fisher_axes({int(c): s for c, s in stats.items()})[1]

    placed = np.sort(y)
    null = np.array([values(placed[nulls.permuted(np.arange(200), 200, d, 9)]) for d in range(1, 20)])
    real = values(y)
    assert np.allclose([r["real"] for r in got], real) and np.allclose([r["null95"] for r in got], np.percentile(null, 95, axis=0))
    assert np.allclose([r["p"] for r in got], (1 + (null >= real).sum(0)) / 20) and got[0]["p"] == 0.05


@pytest.mark.parametrize("kind", ["energy", "angle", "sti"])
def test_draws_are_made_once(spark, kind):
    rng = np.random.default_rng(8)
    u, v, s = random_parts(rng, 6, 2)
    rows = [(m, float(w), a.tolist(), b.tolist()) for m in (1, 2) for a, b, w in zip(u.T, v.T, s, strict=True)]
    rows += [(3, float(w), a.tolist(), b.tolist()) for a, b, w in zip(*(z.T for z in random_parts(rng, 6, 2)[:2]), [1.0, 2.0], strict=True)]
    df = spark.createDataFrame(rows[::-1], "m long, sigma double, u array<double>, v array<double>")
    folder, counts = f"{shared_folder(spark)}/{uuid.uuid4().hex}", []

    def values(frame, draws):
        made = spark.sparkContext.accumulator(0)
        out = {(r["m"], r["draw"]): r["value"] for r in nulls.cached_null(frame, "m", kind, draws, 4, folder, drawn=made).collect()}
        counts.append(made.value)
        return out

    first, again, more = values(df, 3), values(df.repartition(3), 3), values(df, 5)
    assert counts == [6, 0, 4] and again == first and len(more) == 15  # 1 and 2 have equal components
    assert all(more[k] == first[k] for k in first) and all(more[1, d] == more[2, d] for d in range(1, 6)) and more[1, 1] != more[3, 1]
    low, high = (0, 1) if kind == "energy" else (0, 90) if kind == "angle" else (0, 1e3)
    assert all(low <= x <= high for x in more.values())


# selection and readouts


def moments_of(x, y):
    return {int(c): (int((y == c).sum()), x[y == c].sum(0), x[y == c].T @ x[y == c]) for c in np.unique(y)}


def test_nested_selection_fits_models(spark):
    rng = np.random.default_rng(9)
    y, session = rng.integers(0, 3, 360), rng.integers(0, 4, 360)
    x = rng.standard_normal((360, 3)) * (1 + y[:, None]) + y[:, None] * 0.5
    x[session == 3, 2] = x[session == 3, 1]  # alone or not, a session of flat covariance
    grid, chosen = selection.nested_models(windows(spark, x, y, session=session), "session", "label", "x", [0.0, 0.5, 1.0], [0.1, 10.0])
    rows = grid.collect()
    assert len(rows) == 4 * 3 * 5
    for r in rows:
        train = (session != r["outer"]) & (session != r["inner"])
        rule = (selection.quadratic_rule if r["kind"] == "alpha" else selection.ridge_rule)(moments_of(x[train], y[train]), r["value"])
        test = session == r["inner"]
        want = np.mean([np.mean(rule(x[test & (y == c)]) == c) for c in range(3)])
        assert abs(r["score"] - want) < 1e-9 and r["problem"] == ""
    for c in chosen.collect():
        mean = {v: np.mean([r["score"] for r in rows if (r["outer"], r["kind"], r["value"]) == (c["outer"], c["kind"], v)]) for v in {r["value"] for r in rows if r["kind"] == c["kind"]}}
        assert c["value"] == max(mean, key=lambda v: (round(mean[v], 9), v))


def test_nested_selection_rejects_splits_that_do_not_fit(spark):
    rng = np.random.default_rng(10)
    y, session = np.tile([0, 1], 45), np.repeat([0, 1, 2], 30)
    x = rng.standard_normal((90, 2)) + y[:, None]
    x[(session == 0) & (y == 0)] = 1.0  # trained on session 0 alone, class 0 has no spread
    grid, chosen = selection.nested_models(windows(spark, x, y, session=session), "session", "label", "x", [0.0, 1.0], [1.0])
    bad = {(r["outer"], r["inner"], r["value"]) for r in grid.where("problem <> ''").collect()}
    assert bad == {(1, 2, 0.0), (2, 1, 0.0)}
    assert all(r["value"] == 1.0 for r in chosen.where("kind = 'alpha' and outer > 0").collect())
    with pytest.raises(ValueError):
        selection.nested_models(windows(spark, x, y, session=session % 2), "session", "label", "x", [0.5], [1.0])


def test_readouts_and_semantic_decomposition(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 4, 400)
    x = rng.standard_normal((400, 5)) + np.eye(5)[y] * 1.5
    test = np.arange(400) % 3 == 0
    got = {r["analysis"]: r for r in selection.readouts(windows(spark, x[~test], y[~test]), windows(spark, x[test], y[test]), "label", "x", {"all": None, "low": [0, 1], "high": [2, 3]}).collect()}
    stats = moments_of(x[~test], y[~test])
    for name, classes, own in (("shared_all", range(4), range(4)), ("shared_low", range(4), (0, 1)), ("internal_high", (2, 3), (2, 3))):
        axes, _ = readout.fisher_axes({c: stats[c] for c in classes})
        at = np.isin(y[test], list(own))
        centres = np.array([stats[c][1] / stats[c][0] @ axes for c in own])
        p = np.array(own)[((x[test][at] @ axes)[:, None] - centres[None] ** 1).__pow__(2).sum(2).argmin(1)]
        assert got[name]["n"] == at.sum() and abs(got[name]["accuracy"] - (p == y[test][at]).mean()) < 1e-12
    assert set(got) == {"shared_all", "shared_low", "internal_low", "shared_high", "internal_high"}
    axes, values = readout.fisher_axes(stats)
    aligned, singular, energy = selection.semantic_decomposition(stats, axes, values, gap=0.0)
    assert len(aligned) == 18 and len(singular) == 3 and all(a < 5 for _, _, a in singular)  # differences of means span the axes
    assert abs(sum(e for _, _, b, e in energy if b == "1-1") - sum(c * c for _, _, j, c, _ in aligned if j == 1)) < 1e-9
    low = np.linalg.cholesky(np.mean([(s[2] - np.outer(s[1], s[1]) / s[0]) / (s[0] - 1) for s in stats.values()], axis=0))
    white = [np.linalg.solve(low, stats[c][1] / stats[c][0]) for c in range(4)]
    made = sum(c * (white[b] - white[a]) for a, b, j, _, c in aligned if j == 1)
    u = low.T @ axes[:, 0] / np.linalg.norm(low.T @ axes[:, 0])
    delta = np.array([white[b] - white[a] for a, b in itertools.combinations(range(4), 2)]).T
    assert np.allclose(made, delta @ np.linalg.pinv(delta) @ u) and np.linalg.norm(made - u) < 0.1


# spaces that have no SQL


def test_canonical_axes_scale_with_the_data():
    rng = np.random.default_rng(12)
    y, session = rng.integers(0, 3, 300), rng.integers(0, 2, 300)
    x = rng.standard_normal((300, 4)) + np.eye(4)[y]
    cells = lambda z: {(c, s): ((m := (y == c) & (session == s)).sum(), z[m].sum(0), z[m].T @ z[m]) for c in range(3) for s in range(2)}
    axes, values, means = spaces.canonical_axes(cells(x))
    small, small_values, _ = spaces.canonical_axes(cells(x * 1e-7))
    assert np.allclose(values, small_values, rtol=1e-6) and np.allclose(axes, small * 1e-7, rtol=1e-5)
    within = 0
    for c in range(3):
        own = [x[(y == c) & (session == s)] for s in range(2)]
        centre = np.array([o.mean(0) for o in own])
        within = within + sum(np.cov(o.T, bias=True) for o in own) / 2 + np.cov(centre.T, bias=True)
    within = within / 3
    within = 0.1 * within + (0.9 + 1e-10) * np.trace(within) / 4 * np.eye(4)
    between = np.cov(np.array([means[c] for c in range(3)]).T)
    for j in range(2):
        assert np.allclose(between @ axes[:, j], values[j] * within @ axes[:, j], atol=1e-9)


def test_gaussian_projection_and_affine(spark):
    g = spaces.gaussian_projection(64, 8, 7)
    assert g.shape == (64, 8) and (g == spaces.gaussian_projection(64, 8, 7)).all() and abs((g**2).sum() - 8) < 1.5
    x = np.random.default_rng(13).standard_normal((20, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, None), (21, [1.0]), (22, [None] * 64), (23, [])]
    df = spark.createDataFrame(rows, "key long, x array<double>").repartition(3)
    got = {r["key"]: r["z"] for r in align.affine(df, "x", g, np.ones(8), "z").collect()}
    assert np.allclose([got[i] for i in range(20)], x @ g + 1) and [got[i] for i in range(20, 24)] == [None] * 4


def test_matched_null_matches_plain_projection(spark):
    rng = np.random.default_rng(14)
    u, v, s = random_parts(rng, 5, 3)
    df = spark.createDataFrame([(4, float(w), a.tolist(), b.tolist()) for a, b, w in zip(u.T, v.T, s, strict=True)], "m long, sigma double, u array<double>, v array<double>")
    got = {r["draw"]: r["fraction"] for r in spaces.matched_null(df, "m", 3, 11).collect()}
    for d in range(1, 4):
        order = np.random.default_rng([11, 4, d])
        a, b = spaces.haar_basis(5, 2, order), spaces.haar_basis(5, 2, order)
        flat = np.linalg.qr(np.einsum("ik,jk->ijk", a, b).reshape(25, 2))[0]
        want = sum(w * w * ((flat.T @ np.outer(p, q).ravel()) ** 2).sum() for p, q, w in zip(u.T, v.T, s, strict=True)) / (s**2).sum()
        assert abs(got[d] - want) < 1e-9


def test_grid_and_scores_leave_out_bad_vectors(spark):
    rng = np.random.default_rng(15)
    y = np.tile([0, 1], 30)
    x = rng.standard_normal((60, 2)) + y[:, None]
    df = windows(spark, x, y).select("key", "x", "label")
    odd = spark.createDataFrame([(90, None, 0), (91, [1.0, None], 0), (92, [float("inf"), 0.0], 1)], "key long, x array<double>, label int")
    weights = spaces.quadratic_weights(moments.sufficient(df, "x", "label"), [0.5])
    assert spaces.quadratic_grid(df.union(odd), "key", "label", "x", weights).count() == 60
    assert readout.quadratic_scores(df.union(odd), "key", "label", "x", 0.5).count() == 60
    with pytest.raises(Exception, match="differ in length"):
        spaces.quadratic_grid(df.union(spark.createDataFrame([(93, [1.0], 0)], "key long, x array<double>, label int")), "key", "label", "x", weights).collect()


# adapter


def test_adapter_gradient_is_the_slope():
    rng = np.random.default_rng(16)
    net = adapter.Adapter.fresh(3, (4, 5), 1)
    net = net.moved(net.flat() + rng.standard_normal(len(net.flat())) * 0.3)
    x, out = rng.standard_normal((6, 3)), rng.standard_normal((6, 3))
    got, flat = net.gradient(x, out), net.flat()
    for i in range(0, len(flat), 7):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        slope = ((net.moved(flat + step)(x) - net.moved(flat - step)(x)) * out).sum() / 2e-6
        assert abs(slope - got[i]) < 1e-6 * max(1, abs(slope))


def sliced(x, y, theta):
    """Squared sliced Wasserstein distance by sorting, of equally many rows."""
    return np.mean([((np.sort(x @ t) - np.sort(y @ t)) ** 2).mean() for t in theta])


def test_adapter_moves_a_cloud_onto_another(spark):
    rng = np.random.default_rng(17)
    x = rng.standard_normal((400, 3))
    y = rng.standard_normal((400, 3)) * [1.5, 0.7, 1.0] + [1.0, -0.5, 0.0]
    df = lambda z: spark.createDataFrame([(v.tolist(),) for v in z] + [(None,), ([None, 1.0, 2.0],)], "x array<double>").repartition(3)
    theta = np.random.default_rng(5).standard_normal((32, 3))
    theta /= np.linalg.norm(theta, axis=1, keepdims=True)
    net = adapter.fit_adapter(df(x), df(y), "x", epochs=30, rate=0.05, move=0.0, seed=5)
    assert abs(net.losses[0] - sliced(x, y, theta)) < 0.02 * net.losses[0]  # bins against sorting
    assert min(net.losses) < 0.1 * net.losses[0] and abs(min(net.losses) - sliced(net(x), y, theta)) < 0.02 * net.losses[0]
    got = adapter.apply_adapter(df(x), "x", net).collect()
    assert sum(r["adapted"] is None for r in got) == 2
    first = next(r for r in got if r["x"] == x[0].tolist())
    assert np.allclose(first["adapted"], net(x[:1])[0])
    held = adapter.fit_adapter(df(x), df(y), "x", anchors=df(x), anchor=100.0, epochs=6, seed=5)
    assert ((held(x) - x) ** 2).mean() < 0.2 * ((net(x) - x) ** 2).mean()  # anchors stay where they are
    with pytest.raises(ValueError, match="empty"):
        adapter.fit_adapter(df(x), df(x).limit(0), "x")


def test_temporal_null_deals_its_draws_once(spark):
    from windrow.plans import catalog

    plan = catalog.QUERIES["temporal_null"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(draw") == 1
