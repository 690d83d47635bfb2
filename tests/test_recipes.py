"""Episodes, flips, reductions, simulation, the preprocessing chain, whole jobs and figures' tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import episodic, flips, pairs, recipes, reduce, simulate, spectra, train, views
from tidemark.operators import preprocess as p
from tidemark.operators import regression_chain as rc

SERIES = "series_id bigint, segment_id bigint, t int"


def test_episodes_are_found_over_the_baseline(spark):
    rng = np.random.default_rng(0)
    base, extra = np.diag([0.3, 0.3]), [np.diag([0.6, 0.0]), np.diag([0.0, -0.9])]
    rows, truth = [(9, 1, 1, [0.0, 0.0])], {}
    for series in range(5):
        x, on = np.zeros((400, 2)), [0, 0]
        for t in range(400):
            on = [1 - v if rng.random() < (0.05 if v else 0.03) else v for v in on]
            truth[series, t + 1] = tuple(on)
            lag = base + sum(v * e for v, e in zip(on, extra))
            x[t] = (lag @ x[t - 1] if t else 0) + rng.standard_normal(2)
        rows += [(series, 1, t + 1, x[t].tolist()) for t in range(400)]
    data = spark.createDataFrame(rows, f"{SERIES}, x array<double>").cache()
    model, gamma = episodic.fit(data, rc.Family((1,)), 2, 10)
    got = {(r.series_id, r.t, r.state): r.p for r in gamma.collect()}
    assert len(got) == 2 * 5 * 399 and all(0 <= v <= 1 for v in got.values())
    keys = sorted({k[:2] for k in got})
    course = np.array([[got[(*k, 1)], got[(*k, 2)], *truth[k]] for k in keys])
    r = np.corrcoef(course.T)[:2, 2:]
    assert max(min(r[0, 0], r[1, 1]), min(r[0, 1], r[1, 0])) > 0.6
    assert episodic.chain_divergence(model) > 0 and episodic.step_likelihood(model, model.counts) < 0
    kept, _ = episodic.fit(data, rc.Family((1,)), 1, 2, keep_baseline=True)
    assert np.abs(kept.baseline - episodic.baseline_weights(data, rc.Family((1,)))[0]).max() < 1e-9


def test_flips_are_undone(spark):
    rng = np.random.default_rng(1)
    mix, rows, signs = rng.standard_normal((4, 4)), [], {}
    for series in range(8):
        sign = rng.choice([-1, 1], 4) if series else np.ones(4)
        signs[series] = sign
        x = (rng.standard_normal((300, 4)) @ mix) * sign
        rows += [(series, 1, t + 1, c + 1, float(x[t, c])) for t in range(300) for c in range(4)]
    tensor = pairs.lagged_correlation(spark.createDataFrame(rows, f"{SERIES}, channel int, value double"), 1)
    for found in (flips.flip_posteriors(tensor, 4), flips.find_flips(tensor, 4)):
        got = {(r.series_id, r.channel): 1 - 2 * r.flip for r in found.collect()}
        total = [np.array([signs[s][c] * got[s, c + 1] for c in range(4)]) for s in range(8)]
        assert all(abs(v @ total[0]) == 4 for v in total)  # all series agree up to one overall sign


def test_segments_are_aligned_to_events(spark):
    rng, rows = np.random.default_rng(2), []
    for n in range(6):
        sign = -1 if n in (2, 5) else 1
        for t in range(1, 31):
            rows.append((n, 1, t, [sign * (5.0 if t in (10, 20) else 0.0) + 0.1 * float(rng.standard_normal())]))
    events = spark.createDataFrame([(n, 1, t) for n in range(5) for t in (10, 20, 30)] + [(5, 1, 30)], SERIES)
    got = {r.series_id: r.flip for r in flips.align_to_events(spark.createDataFrame(rows, f"{SERIES}, x array<double>"), events, (-1, 2)).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0}


def test_delays_have_their_covariance(spark):
    want = np.array([[2, 0.5, 1.0, 0.2], [0.5, 1, 0.3, 0.4], [1.0, 0.3, 2, 0.5], [0.2, 0.4, 0.5, 1]])
    rows = simulate.delay_series(simulate.segment_grid(spark, 1, 1, 20000), want, 2).orderBy("t").collect()
    x = np.array([r.x for r in rows])
    assert np.abs(np.cov(np.c_[x[:-1], x[1:]].T) - want).max() < 0.1


def test_series_like_the_observed(spark):
    rng, x = np.random.default_rng(3), np.zeros((3000, 2))
    for t in range(1, 3000):
        x[t] = [1.0, 2.0] + np.array([[0.5, 0.2], [0.0, 0.4]]) @ x[t - 1] + rng.standard_normal(2)
    seen = spark.createDataFrame([(1, 1, t + 1, float(a), float(b)) for t, (a, b) in enumerate(x)], f"{SERIES}, a double, b double")
    for order in (0, 1):
        got = np.array([r.x for r in simulate.like_observed(seen, ["a", "b"], order, simulate.segment_grid(spark, 1, 1, 6000)).collect()])
        assert np.abs(got.mean(0) - x[50:].mean(0)).max() < 0.25 and np.abs(np.cov(got.T) - np.cov(x[50:].T)).max() < 0.25


def test_orthogonal_channels_are_near(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 3)) @ np.array([[1, 0.5, 0.2], [0, 1, 0.3], [0, 0, 2.0]])
    y = x @ reduce.orthogonal_transform(x.T @ x)
    gram = y.T @ y
    assert np.abs(gram - np.diag(np.diag(gram))).max() < 1e-6
    norms = np.diag(gram) ** 0.5
    other = np.linalg.qr(x)[0] * norms * np.sign(np.diag(np.linalg.qr(x)[1]))
    assert ((x - y) ** 2).sum() < ((x - other) ** 2).sum()
    wide = spark.createDataFrame([(1, 1, t + 1, *map(float, r)) for t, r in enumerate(x)], f"{SERIES}, a double, b double, c double")
    for order in (0, 1):
        assert reduce.leakage_corrected(wide, ["a", "b", "c"], order).columns == wide.columns


def test_masks_orders_and_states():
    assert reduce.tiled_mask([[1, 0], [1, 1]], [1, 2], False).tolist() == [[1, 0], [1, 1], [1, 0], [1, 1]]
    order, spacing = reduce.order_for(1.0, 200.0, 10)
    assert order == 200 and len(p.lag_orders(1, order, spacing)) == 10
    with pytest.raises(ValueError):
        reduce.order_for(50.0, 100.0, 40)
    assert reduce.valid_channels([[1, 1], [1, 1]], [False] * 2) == [1, 2] and reduce.valid_channels([[-1, 1], [-1, -1]], [True, False]) == []
    w, noise = reduce.principal_state(np.diag([50.0, 10.0, 10.0]), 10, 1)
    assert noise == pytest.approx(1.0) and w.ravel() == pytest.approx([2.0, 0.0, 0.0])
    assert recipes.state_options(rc.Family((1, 3)), 2)["columns"] == 5 and recipes.without_stochastic({"batch": 3, "k": 2}) == {"k": 2}


def test_options_are_checked():
    assert recipes.checked_spectra(200.0, [500, 900])["window"] == 500 and recipes.checked_spectra(200.0, [500], least_hz=4)["window"] == 200
    with pytest.raises(ValueError, match="did you mean window"):
        recipes.checked_spectra(200.0, [500], windw=3)
    assert recipes.checked_states("full", False, 0, 1)["covariance"] == "diag"
    for bad in (("sharedfull", True, 0, 3), ("round", False, 1, 3)):
        with pytest.raises(ValueError):
            recipes.checked_states(*bad)


def test_chain_runs_in_its_order(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2, 64, 3)).cumsum(1)
    long = spark.createDataFrame([(1, s + 1, t + 1, c + 1, float(x[s, t, c])) for s in range(2) for t in range(64) for c in range(3)], f"{SERIES}, channel int, value double")
    recipe = recipes.Recipe(standardise=True, detrend=True, leakage=True, lags=(0, 1), pca=2, standardise_components=True, downsample=(1, 2), fs=100.0)
    out, rest = recipes.preprocessed(long, recipe)
    rows = out.groupBy("segment_id", "channel").agg(F.count("*").alias("n")).collect()
    assert {r.channel for r in rows} == {1, 2} and {r.n for r in rows} == {32} and rest == recipes.Recipe(fs=50.0)
    wide = recipes.preprocessed(long, recipes.Recipe(envelope=True, band=(0.0, 20.0), fs=100.0))[0]
    assert wide.count() == long.count() and recipes.preprocessed(long, recipes.Recipe())[0].count() == long.count()
    phases = recipes.preprocessed(long, recipes.Recipe(leading_phases=True, pca_channels=2))[0]
    assert phases.count() == 2 * 64 * 2


def test_jobs_from_series_to_measures(spark):
    rng, rows = np.random.default_rng(6), []
    for series in range(4):
        for t in range(120):
            low = (t // 20) % 2
            rows += [(series, 1, t + 1, c + 1, float((4.0 if low else -4.0) * (c == 0) + rng.standard_normal())) for c in range(2)]
    long = spark.createDataFrame(rows, f"{SERIES}, channel int, value double").cache()
    found = recipes.gaussian_states(long, repetitions=1, k=2, cycles=8)
    path = {(r.series_id, r.t): r.state for r in found.path.collect()}
    early, late = {path[s, t] for s in range(4) for t in range(2, 20)}, {path[s, t] for s in range(4) for t in range(22, 40)}
    assert len(early) == len(late) == 1 and early != late
    assert {r.life_time for r in found.measures["life_times"].collect()} == {20}
    assert recipes.gaussian_states(long, batch=2, k=2, cycles=4).gamma.count() == 4 * 120 * 2
    mar = recipes.autoregressive_states(long, recipes.Recipe(standardise=True), rc.Family((1,)), 2, (0.1,), repetitions=1, cycles=3)
    assert mar.measures["spectra"].count() == 2 * 4
    delays = recipes.delay_embedded_states(long, (-1, 0, 1), 2, 32, k=2, cycles=3)
    assert {"occupancy", "spectra"} <= set(delays.measures)
    units = spark.createDataFrame([(s, s % 2) for s in range(4)], "series_id bigint, label int")
    grid = recipes.condition_grid(long, units, [recipes.Recipe(standardise=True)], [2], 20, cycles=3)
    assert {r.k for r in grid.collect()} == {2}
    assert recipes.series_distances(long, recipes.Recipe(standardise=True), 2, cycles=3).count() == 6


def test_states_that_hold_nothing_are_dropped(spark):
    rng = np.random.default_rng(7)
    rows = [(1, 1, t + 1, [float(v)]) for t, v in enumerate(rng.standard_normal(300))]
    data = spark.createDataFrame(rows, f"{SERIES}, x array<double>")
    assert train.fit(data, k=4, cycles=25, drop_states=True, least_mass=40.0).k < 4 and train.fit(data, k=4, cycles=3).k == 4
    moved = recipes.perturbed_model(train.fit(data, k=2, cycles=3), 1.0, 3)
    assert moved.mean.shape == (2, 1)


def test_long_segments_do_not_widen_short_ones(spark):
    import pyarrow as pa

    from tidemark.operators.inference import of_like_length

    batch = pa.RecordBatch.from_pydict({"t": [[1] * n for n in (1000, 3, 2, 900, 4)], "k": [0, 1, 2, 3, 4]})
    parts = [p_.column("k").to_pylist() for p_ in of_like_length(batch, 1500)]
    assert parts == [[0], [3], [4, 1, 2]] and sorted(sum(parts, [])) == list(range(5))


def test_median_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(pairs, "EXACT_VALUES", 3)
    monkeypatch.setattr(pairs, "RANGES", 4)
    rng = np.random.default_rng(11)
    for values in ([5.0], [1.0, 2.0], [2.0] * 9, [0.0] * 5 + [9.0] * 5, list(map(float, rng.standard_normal(101) ** 3)), list(map(float, rng.integers(0, 6, 60)))):
        assert pairs.exact_median(spark.createDataFrame([(v,) for v in values] + [(None,)], "d double"), "d") == pytest.approx(np.median(values))
    assert pairs.exact_median(spark.createDataFrame([], "d double"), "d") is None


def test_filters_of_many_series_are_those_of_one():
    rng = np.random.default_rng(12)
    b, a = p.butterworth(3, (2.0, 8.0), 50.0)
    rows = [rng.standard_normal(n) for n in (200, 31, 60, 200)]
    for x, y in zip(rows, p.zero_phases(b, a, rows)):
        assert y == pytest.approx(p.zero_phase(b, a, x))


def test_phase_locking_by_state(spark):
    t = np.arange(512)
    a, b = np.sin(2 * np.pi * t / 16), np.where(t < 256, np.sin(2 * np.pi * t / 16 + 1), np.random.default_rng(8).standard_normal(512))
    obs = spark.createDataFrame([(1, 1, int(i) + 1, [float(a[i]), float(b[i])]) for i in t], f"{SERIES}, x array<double>")
    gamma = spark.createDataFrame([(1, 1, int(i) + 1, 1 if i < 256 else 2, 1.0) for i in t], f"{SERIES}, state int, p double")
    got = {r.state: r.plv for r in spectra.phase_locking(obs, gamma).collect()}
    assert got[1] > 0.9 > 0.5 > got[2] and got[2] < spectra.phase_locking(obs).first().plv < got[1]


def test_orders_edges_and_maps(spark):
    values = spark.createDataFrame([(n, 1, float((7 * n) % 50)) for n in range(300)], "series_id bigint, segment_id bigint, y double")
    places = [r.series_id for r in views.trial_order(None, values).orderBy("place").collect()]
    assert places == sorted(range(300), key=lambda n: ((7 * n) % 50, n))
    edges = spark.createDataFrame([(1, 1, 2, 0.9), (1, 1, 3, -0.8), (1, 2, 3, 0.1)], "state int, i int, j int, w double")
    assert {(r.i, r.j) for r in views.strongest_edges(edges, 0.5).collect()} == {(1, 2), (1, 3)}
    assert {r.node: r.value for r in views.node_map(edges, 3).collect()} == pytest.approx({1: 0.9, 2: 1.0, 3: 0.1})
    lead = {r.node: r.value for r in views.node_map(edges, 3, "eigen").collect()}
    m = np.array([[1, 0.9, -0.8], [0.9, 1, 0.1], [-0.8, 0.1, 1]])
    v = np.array([lead[n] for n in (1, 2, 3)])
    assert m @ v == pytest.approx(np.linalg.eigvalsh(m)[-1] * v)
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (1, 4.0, 2.0, 0.0, 3.0)], "region int, x double, y double, z double, w double")
    assert tuple(views.region_centres(points).first())[1:] == (3.0, 1.5, 0.0) and tuple(views.region_centres(points, True).first())[1:] == (2.0, 1.0, 0.0)
