"""Chains of regressions, decoders, group tests and spectra of models, on simulated data and against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.functions.special import digamma, kl_dirichlet, kl_gamma
from tidemark.operators import decoders as dc
from tidemark.operators import divergence as v
from tidemark.operators import dynamics as d
from tidemark.operators import group_tests as gt
from tidemark.operators import preprocess as p
from tidemark.operators import regression_chain as rc
from tidemark.operators import spectra_model as sp
from tidemark.operators import state_models as sm
from tidemark.operators import stats, train
from tidemark.operators.spectra import autoregressive, directed_coherence

SERIES = "series_id bigint, segment_id bigint, t int"


@pytest.fixture(scope="module")
def two_states(spark):
    rng = np.random.default_rng(0)
    lag = [np.array([[0.9, 0.0], [0.0, 0.2]]), np.array([[-0.6, 0.3], [0.1, 0.7]])]
    rows, truth = [], {}
    for series in range(4):
        x, state = np.zeros((250, 2)), 0
        for t in range(250):
            state = 1 - state if rng.random() < 0.02 else state
            truth[series, t + 1] = state
            x[t] = (lag[state] @ x[t - 1] if t else 0) + rng.standard_normal(2) * (0.5, 1.0)
        rows += [(series, 1, t + 1, x[t].tolist()) for t in range(250)]
    rows.append((9, 1, 1, [0.0, 0.0]))  # too short for a lag
    return spark.createDataFrame(rows, f"{SERIES}, x array<double>").cache(), truth, lag


@pytest.mark.parametrize("covariance", rc.COVARIANCES)
def test_regression_chain_recovers_its_states(two_states, covariance):
    data, truth, lag = two_states
    model = rc.fit_best(data, rc.Family((1,), True, covariance), 2, 2, 4, 20)
    rest = model.history[4:]
    assert all(a >= b - 1e-6 * abs(b) for a, b in zip(rest, rest[1:]))
    found = rc.decode(data, model, "path").collect()
    share = np.mean([truth[r.series_id, r.t] == r.state - 1 for r in found])
    order = [0, 1] if share > 0.5 else [1, 0]
    assert len(found) == 4 * 249 and max(share, 1 - share) > 0.93
    assert max(np.abs(model.w[order[k]][1:].T - lag[k]).max() for k in (0, 1)) < 0.15
    assert rc.stable(model) == [True, True]


def test_spare_states_go(two_states):
    data = two_states[0]
    assert rc.without_spare_states(data, rc.fit(data, rc.Family((1,)), 3, 8), 6).k == 2


def test_one_state_is_least_squares(two_states):
    data = two_states[0]
    model = rc.fit(data, rc.Family((1,), True, "full", False), 1, 3)
    rows = sorted((r.series_id, r.t, r.x) for r in data.collect())
    x = np.array([[1, *a[2]] for a, b in zip(rows, rows[1:]) if a[0] == b[0]])
    y = np.array([b[2] for a, b in zip(rows, rows[1:]) if a[0] == b[0]])
    assert np.abs(model.w[0] - np.linalg.lstsq(x, y, rcond=None)[0]).max() < 1e-3


def test_window_start_covers_every_sample(two_states):
    data, truth, _ = two_states
    got = rc.window_start(data.filter("series_id < 9"), rc.Family((1,)), 40, 2).collect()
    assert sorted((r.series_id, r.t) for r in got) == sorted(truth)
    share = np.mean([truth[r.series_id, r.t] == r.state - 1 for r in got])
    assert max(share, 1 - share) > 0.7


def test_decoder_finds_when_the_map_changes(spark):
    rng, rows = np.random.default_rng(1), []
    for trial in range(60):
        for t in range(1, 21):
            x = rng.standard_normal(3)
            w = np.array([1.0, -1.0, 0.5]) if t <= 10 else np.array([-1.0, 0.5, 1.0])
            rows.append((trial, 1, t, x.tolist(), [float(x @ w + 0.2 * rng.standard_normal())]))
    data = spark.createDataFrame(rows, f"{SERIES}, x array<double>, y array<double>").cache()
    family = rc.Family((), True, "shareddiag")
    model = rc.fit_best(data, family, 2, 2, 4, 15)
    path = rc.decode(data, model, "path").groupBy((F.col("t") <= 10).alias("early")).agg(F.mode("state").alias("s"), F.count_distinct("state").alias("n")).collect()
    assert len({r.s for r in path}) == 2
    r2 = {r.t: r.r2 for r in rc.cross_validated(data, family, 2, 3, 8).collect()}
    assert min(r2[t] for t in (2, 5, 8, 13, 16, 19)) > 0.8
    wide = data.select("series_id", "segment_id", "t", *(F.col("x")[i].alias(f"x{i}") for i in range(3)), F.col("y")[0].alias("y"))
    for method in ("regression", "hierarchical"):
        states = {r.t: r.state for r in dc.cluster_decoding(wide, ["x0", "x1", "x2"], "y", 2, method).collect()}
        assert len({states[t] for t in range(1, 11)}) == 1 and len({states[t] for t in range(11, 21)}) == 1 and states[1] != states[20]


def test_column_functions(spark):
    df = spark.createDataFrame([(x,) for x in (0.01, 0.5, 1.0, 3.7, 50.0, 1e5)], "x double")
    for x, g, psi in df.select("x", c.log_gamma(F.col("x")), c.digamma(F.col("x"))).collect():
        assert g == pytest.approx(math.lgamma(x), abs=1e-9, rel=1e-11) and psi == pytest.approx(digamma(x), rel=1e-9)
    row = spark.range(1).select(c.kl_gamma(F.lit(2.0), F.lit(3.0), F.lit(1.5), F.lit(0.5)), c.log_sigmoid(F.lit(-800.0)), c.bound_slope(F.lit(0.0))).first()
    assert row[0] == pytest.approx(kl_gamma(2.0, 3.0, 1.5, 0.5)) and row[1] == -800.0 and row[2] == 0.125


def test_dirichlet_rows_leave_out_empty_entries(spark):
    rows = [(1, 2.0, 3.0), (1, 4.0, 1.0), (1, 0.0, 5.0), (2, 1.0, 1.0)]
    got = dict(v.dirichlet_divergence(spark.createDataFrame(rows, "k int, q double, p double"), ["k"]).collect())
    assert got[1] == pytest.approx(kl_dirichlet([2, 4], [3, 1])) and got[2] == pytest.approx(0, abs=1e-9)


def test_divergence_matrix_equals_the_models(spark):
    rng = np.random.default_rng(2)
    models = {
        s: train.Model(rng.random(2) + 1, rng.random((2, 2)) + 1, rng.random((2, 3)), rng.random(2) + 1, rng.random(2) + 5, np.stack([np.eye(3) * (1 + rng.random()) for _ in range(2)])) for s in range(4)
    }
    rows = [(s, *r) for s, m in models.items() for r in m.rows()]
    got = v.divergence_matrix(spark.createDataFrame(rows, "series_id bigint, state int, param string, i int, j int, value double"), 2, 3).collect()
    assert len(got) == 6
    for r in got:
        want = 0.5 * (v.chain_divergence(models[r.a], models[r.b]) + v.chain_divergence(models[r.b], models[r.a]))
        assert r.divergence == pytest.approx(want) and want > 0


def test_epoch_test_by_brute_force(spark):
    rng = np.random.default_rng(3)
    gamma = [(f"{n}", t, k, float(x)) for n in range(12) for t in (1, 2) for k, x in enumerate(rng.dirichlet(np.ones(3)), 1)]
    trials = [(f"{n}", float(rng.random())) for n in range(12)]
    g, y = spark.createDataFrame(gamma, "trial string, t int, state int, p double"), spark.createDataFrame(trials, "trial string, y double")
    got = {r.t: r for r in gt.epoch_test(g, y, 3, 20).collect()}
    values = np.array([v for _, v in trials])
    z = (values - values.mean()) / values.std(ddof=1)
    for t in (1, 2):
        m = np.array([[x for n2, t2, k, x in gamma if (n2, t2) == (f"{n}", t)] for n in range(12)])
        b = np.linalg.solve(m.T @ m + 1e-5 * np.eye(3), m.T @ z)
        assert got[t].observed == pytest.approx(1 - ((z - m @ b) ** 2).sum() / (z**2).sum()) and 1 / 21 <= got[t].p <= 1


def test_ridge_out_of_fold_by_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 3))
    y = x @ [1.0, 0.0, -2.0] + 0.1 * rng.standard_normal(40)
    rows = [(n, n % 4, *map(float, x[n]), float(y[n])) for n in range(40)]
    wide = spark.createDataFrame(rows, "series_id bigint, fold int, a double, b double, c double, y double")
    got = {r.series_id: r.yhat for r in dc.ridge_out_of_fold(wide, ["a", "b", "c"], "y", [0.1]).collect()}
    for n in range(40):
        rest = np.arange(40) % 4 != n % 4
        mx, my = x[rest].mean(0), y[rest].mean()
        beta = np.linalg.solve((x[rest] - mx).T @ (x[rest] - mx) + 0.1 * np.eye(3), (x[rest] - mx).T @ (y[rest] - my))
        assert got[n] == pytest.approx(my + (x[n] - mx) @ beta)
    many = dc.prediction_scores(dc.ridge_out_of_fold(wide, ["a", "b", "c"], "y", [1e-3, 1e3])).first()
    assert many.cod > 0.95 and many.r > 0.97


def test_logistic_by_time_converges(spark):
    rng = np.random.default_rng(5)
    rows = [(t, float(x), int(rng.random() < 1 / (1 + math.exp(-(0.5 + (t - 1) * x))))) for t in (1, 2) for x in rng.standard_normal(800)]
    betas = {(r.t, r.term): r.beta for r in dc.logistic_by_time(spark.createDataFrame(rows, "t int, x double, y int"), ["x"], "y").collect()}
    for t in (1, 2):
        x, y = np.array([(a, b) for s, a, b in rows if s == t]).T
        p_ = 1 / (1 + np.exp(-(betas[t, 0] + betas[t, 1] * x)))
        assert abs((y - p_).sum() - 1e-3 * betas[t, 0]) < 1e-6 and abs((x * (y - p_)).sum() - 1e-3 * betas[t, 1]) < 1e-6


def test_clusters_of_times(spark):
    rng = np.random.default_rng(6)
    seen = [(t, 0.9 if 4 <= t <= 9 else 0.5) for t in range(1, 13)]
    dealt = [(u, k, t, float(0.5 + 0.05 * rng.standard_normal())) for u in range(6) for k in range(1, 9) for t in range(1, 13)]
    got = {r.t: r for r in gt.cluster_test(spark.createDataFrame(seen, "t int, accuracy double"), spark.createDataFrame(dealt, "unit int, perm int, t int, accuracy double"), 60).collect()}
    assert [got[t].size for t in (3, 4, 9, 10)] == [None, 6, 6, None] and got[5].p < 0.1 and got[3].p is None


def test_spectral_test_finds_the_strong_channel(spark):
    rows = [(u, 1, ch, 1.0, 5.0 * (ch == 2) + 0.01 * u) for u in range(8) for ch in range(1, 6)]
    got = {r.channel: r for r in gt.spectral_test(spark.createDataFrame(rows, "unit int, state int, channel int, f double, value double"), 60).collect()}
    assert got[2].higher < 0.05 and got[2].lower > 0.9 and got[1].higher > 0.2 and got[2].higher_corrected >= got[2].higher


def test_factorised_spectra():
    lag, noise = np.array([[0.5, 0.2], [-0.3, 0.4]]), np.array([[1, 0.3], [0.3, 2.0]])
    f, coef = np.linspace(0, 0.5, 65), np.vstack([np.zeros(2), lag.T])
    psd = autoregressive(coef, noise, [1], 1.0, f)
    h, z = sp.factorised(psd)
    assert np.abs(h @ z @ h.conj().transpose(0, 2, 1) - psd).max() < 1e-9 and np.abs(z - noise).max() < 1e-9
    pdc, dtf = sp.directed_measures(psd)
    assert np.abs((pdc - directed_coherence(coef, [1], 1.0, f))[:, ~np.eye(2, dtype=bool)]).max() < 1e-9 and (dtf[:, 0, 0] == 0).all()


def test_wavelets_see_the_states_rhythm(spark):
    t = np.arange(400)
    x = np.where(t < 200, np.sin(2 * np.pi * 0.1 * t), np.sin(2 * np.pi * 0.25 * t))
    obs = spark.createDataFrame([(1, 1, int(i) + 1, [float(v)]) for i, v in enumerate(x)], f"{SERIES}, x array<double>")
    gamma = spark.createDataFrame([(1, 1, int(i) + 1, 1 if i < 200 else 2, 1.0) for i in t], f"{SERIES}, state int, p double")
    got = {(r.state, r.f): r.re for r in sp.wavelet_spectra(obs, gamma, 1.0, [0.1, 0.25]).collect()}
    assert got[1, 0.1] > 10 * got[1, 0.25] and got[2, 0.25] > 10 * got[2, 0.1]


def test_components_of_non_negative_spectra():
    x = np.array([[1, 0, 0, 2, 3.0], [2, 0, 0, 4, 6], [0, 5, 1, 0, 0]])
    profiles, loadings = sp.non_negative_factors(x, 2)
    assert np.abs(loadings @ profiles - x).max() < 1e-2 and profiles.sum(1) == pytest.approx([1, 1])


def test_coherence_limits_hold_the_value(spark):
    rng = np.random.default_rng(7)
    rows = [(1, n, 2.0 + rng.random(), 3.0 + rng.random(), 1.0 + 0.3 * rng.standard_normal(), 0.2) for n in range(9)]
    got = sp.coherence_errors(spark.createDataFrame(rows, "k int, unit int, sii double, sjj double, re double, im double"), ["k"]).first()
    assert 0 < got.low < got.value < got.high < 1


def test_lag_orders_round_their_gaps():
    assert p.lag_orders(1, 12, 1.2) == [1, 2, 3, 4, 6, 8, 10] and p.lag_orders(2, 7) == [1, 3, 5, 7]


def test_sides_of_a_difference(spark):
    units = spark.createDataFrame([(n, n % 2) for n in range(12)], "u int, label int")
    values = spark.createDataFrame([(n, float(n % 2) + 0.01 * n) for n in range(12)], "u int, value double")
    for side, want in ((0, 1), (1, 1), (-1, -1)):
        got = stats.difference_test(units, values, "u", "label", 99, side=side).first()
        assert got.side == want and (got.p == 1.0 if side < 0 else got.p < 0.03)


def test_random_groups_and_draws(spark):
    got = sm.random_groups(spark.range(25).withColumnRenamed("id", "u"), "u", 4, 1).groupBy("part").count().collect()
    assert sorted(r["count"] for r in got) == [6, 6, 6, 7] and {r.part: r["count"] for r in got}[4] == 7
    drawn = sm.multinomial(spark.range(50).withColumnRenamed("id", "u"), ["u"], [0.5, 0.5], 20).groupBy("k").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in drawn) == 1000 and min(r.n for r in drawn) > 400


def test_life_times_and_diagonals(spark):
    assert sm.life_time_of(sm.diagonal_for(12.0, 4), 4) == pytest.approx(12.0) and sm.diagonal_for(0.1, 4) == 1.0
    got = sm.simulated_life_times(spark, 20.0, 2, 60, 600, 3).collect()
    assert all(r.life_time == pytest.approx(21.0, rel=0.2) for r in got)


def test_confident_path(spark):
    gamma = spark.createDataFrame([(1, 1, t, k, q if k == 1 else 1 - q) for t, q in enumerate((0.9, 0.8, 0.5, 0.1, 0.9), 1) for k in (1, 2)], f"{SERIES}, state int, p double")
    path = d.confident_path(gamma)
    assert [r.state for r in path.orderBy("t").collect()] == [1, 1, None, 2, 1]
    assert sorted((r.state, r.life_time) for r in d.life_times(path).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert [(r.state, r.interval) for r in d.interval_times(path).collect()] == [(1, 2)]


def test_points_and_distances():
    points = np.random.default_rng(8).random((5, 2))
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    assert dc.is_euclidean(distance) and not dc.is_euclidean(np.array([[0, 1, 5.0], [1, 0, 1], [5, 1, 0]]))


def test_classes_are_decoded_and_encoded(spark):
    rng, rows = np.random.default_rng(20), []
    for trial in range(40):
        label = trial % 2
        for t in range(1, 9):
            turn = 1.0 if t <= 4 else -1.0
            x = rng.standard_normal(2) + np.array([2.0 * turn * (2 * label - 1), 0.0])
            rows.append((trial, 1, t, x.tolist(), label))
    data = dc.class_targets(spark.createDataFrame(rows, f"{SERIES}, x array<double>, label int"), "label", [0, 1]).cache()
    model = rc.fit_best(data.drop("label"), rc.Family((), False, "shareddiag"), 2, 2, 4, 10)
    right = dc.decoded_classes(rc.predict(data.drop("label"), model), [0, 1]).agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0]
    assert right > 0.9
    turned = dc.class_targets(data, "label", [0, 1], 0.0).select("series_id", "segment_id", "t", F.col("y").alias("x"), F.col("x").alias("y"))
    encoder = rc.fit_best(turned, rc.Family((), True, "sharedfull"), 2, 2, 4, 10)
    course = rc.decode(turned, encoder).groupBy("t", "state").agg(F.avg("p").alias("p"))
    found = dc.discriminate_by_states(data, encoder, course, [0, 1])
    best = found.filter("p > 0.5").join(data, ["series_id", "segment_id", "t"]).agg(F.avg((F.col("class") == F.col("label")).cast("double")), F.count("*")).first()
    assert best[0] > 0.9 and best[1] == 320 and found.groupBy("series_id", "t").agg(F.sum("p").alias("s")).filter("abs(s - 1) > 1e-9").isEmpty()
    tested = dc.chain_permutations(data.drop("label"), rc.Family((), False, "shareddiag"), 2, 2, 2, 15)
    assert tested.filter("i = 1 AND t = 2 AND observed > 0.4").count() == 1
    ready, kept = dc.prepared(data.withColumn("s", F.col("label").cast("double")).filter("t <= 4").select("series_id", "segment_id", "t", "x", "s"), "s", 1)
    assert kept == [1] and len(ready.first()["x"]) == 2


def test_one_response_of_several(two_states):
    data = two_states[0]
    model = rc.fit(data, rc.Family((1,), True, "diag"), 2, 3)
    parts = [rc.marginal(model, i) for i in (1, 2)]
    x, y = np.random.default_rng(21).standard_normal((5, 3)), np.random.default_rng(22).standard_normal((5, 2))
    assert sum(part.log_likelihood(x, y[:, i : i + 1]) for i, part in enumerate(parts)) == pytest.approx(model.log_likelihood(x, y))
    assert rc.with_response(rc.perturbed(model, 1.0), parts[0], 1).w[:, :, 0] == pytest.approx(model.w[:, :, 0])
    assert rc.with_chain(rc.perturbed(model), model).transition() == pytest.approx(model.transition())
    with pytest.raises(ValueError):
        rc.marginal(rc.fit(data, rc.Family((1,)), 2, 1), 1)


def test_models_from_courses_and_batches(spark):
    rng, rows, courses = np.random.default_rng(23), [], []
    for series in range(6):
        for t in range(1, 101):
            state = 1 if (t // 25) % 2 else 2
            rows.append((series, 1, t, [float((3.0 if state == 1 else -3.0) + rng.standard_normal())]))
            courses += [(series, 1, t, k, 1.0 if k == state else 0.0) for k in (1, 2)]
    data = spark.createDataFrame(rows, f"{SERIES}, x array<double>").cache()
    gamma = spark.createDataFrame(courses, f"{SERIES}, state int, p double")
    model = train.from_courses(data, gamma, 2)
    assert model.mean[:, 0] == pytest.approx([3.0, -3.0], abs=0.2)
    steps = {(r.i, r.j): r.n for r in d.transitions(gamma.filter("p = 1").select("series_id", "segment_id", "t", "state")).collect()}
    assert model.counts - model.prior["counts"] == pytest.approx(np.array([[steps[1, 1], steps[1, 2]], [steps[2, 1], steps[2, 2]]]))
    start = train.start_by_batches(data, 3, k=2, cycles=6)
    assert sorted(start.mean[:, 0]) == pytest.approx([-3.0, 3.0], abs=0.4)
    again = train.reordered(start, [1, 0])
    assert [int(i) for i in __import__("tidemark.operators.pairs", fromlist=["assign"]).assign(train.state_distances(start, again))] == [1, 0]


def test_traits_from_chains(spark):
    rng, rows, traits = np.random.default_rng(24), [], []
    for series in range(16):
        shift = float(rng.standard_normal())
        rows += [(series, 1, t, [float(shift + 0.3 * rng.standard_normal() + (4 if (t // 10) % 2 else 0))]) for t in range(1, 61)]
        traits.append((series, shift))
    got = dc.phenotype_from_chains(spark.createDataFrame(rows, f"{SERIES}, x array<double>"), spark.createDataFrame(traits, "series_id bigint, y double"), 2, 4, [0.01, 1.0], cycles=6)
    assert dc.prediction_scores(got).first().r > 0.8 and got.count() == 16


def test_family_wise_and_combined(spark):
    rows = [(perm, k, float(9 if perm == 0 and k == 1 else (perm * 7 + k * 3) % 5)) for perm in range(20) for k in (1, 2, 3)]
    stat = spark.createDataFrame(rows, "perm int, k int, stat double")
    got = {r.k: r.p for r in stats.family_wise(stat, ["k"]).collect()}
    tops = [max(s for q, _, s in rows if q == perm) for perm in range(20)]
    assert got == pytest.approx({k: np.mean([t >= s for t in tops]) for perm, k, s in rows if perm == 0})
    assert got[1] == 0.05 and stats.combined(stat, [], ["k"]).first().p <= 0.5
