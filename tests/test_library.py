"""Properties of the numeric parts, and hand-checked cases."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import decode_task, dynamics, emissions, inference, moments, pairs, preprocess, simulate, spectra, stats, train
from tidemark.sources import series


def one_path(spark, states):
    return spark.createDataFrame([(1, 1, t, s) for t, s in enumerate(states, 1)], "series_id bigint, segment_id bigint, t int, state int")


def lists(df, value):
    out = {}
    for r in df.collect():
        out.setdefault(r["state"], []).append(r[value])
    return {k: sorted(v) for k, v in out.items()}


def test_hand_cases(spark):
    path = one_path(spark, [1, 1, 2, 2, 2, 1, 3])
    assert lists(dynamics.life_times(path), "life_time") == {1: [1, 2], 2: [3], 3: [1]}
    assert lists(dynamics.interval_times(path), "interval") == {1: [3]}
    assert lists(dynamics.onsets(path), "onset") == {1: [1, 6], 2: [3], 3: [7]}
    assert lists(dynamics.life_times(path, 2), "life_time") == {1: [2], 2: [3]}
    assert lists(dynamics.life_times(one_path(spark, [2, 2, 1, 1]), 2), "life_time") == {2: [2]}
    assert [round(r.fo, 6) for r in dynamics.fractional_occupancy(dynamics.one_hot(path, 3)).orderBy("state").collect()] == [0.428571, 0.428571, 0.142857]
    assert dynamics.switching_rate(dynamics.one_hot(path, 3)).first().rate == pytest.approx(0.5)
    assert dynamics.life_times(one_path(spark, [1])).count() == 0
    p = spark.createDataFrame([(i, j, v) for i, row in enumerate([[0.8, 0.1, 0.1], [0.2, 0.6, 0.2], [0.3, 0.3, 0.4]], 1) for j, v in enumerate(row, 1)], "i int, j int, p double")
    assert all(r.p == pytest.approx(0.5) for r in dynamics.without_diagonal(p).collect())


def test_embedding_and_design(spark):
    long = spark.createDataFrame([(1, 1, t, 1, float(t)) for t in range(1, 6)], "series_id bigint, segment_id bigint, t int, channel int, value double")
    got = {(r.t, r.lag): r.value for r in preprocess.embed(long, [-1, 0, 1]).collect()}
    assert [[got[t, lag] for lag in (-1, 0, 1)] for t in (2, 3, 4)] == [[3, 2, 1], [4, 3, 2], [5, 4, 3]] and len(got) == 9
    design = {(r.t, r.column): r.value for r in preprocess.lag_design(long, [1, 2]).collect()}
    assert [[design[t, c] for c in (1, 2)] for t in (3, 4, 5)] == [[2, 1], [3, 2], [4, 3]]
    with pytest.raises(Exception, match="variance"):
        preprocess.standardise(long.withColumn("value", F.lit(1.0))).collect()


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 3), st.integers(1, 6), st.integers(0, 10**6))
def test_recursions_against_enumeration(k, n, seed):
    rng = np.random.default_rng(seed)
    p, pi, ll = rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(k)), rng.normal(0, 3, (n, k))
    scores = {s: math.log(pi[s[0]]) + sum(math.log(p[a, b]) for a, b in zip(s, s[1:])) + sum(ll[t, x] for t, x in enumerate(s)) for s in itertools.product(range(k), repeat=n)}
    gamma, evidence, xi = inference.forward_backward(np.stack([np.vstack([ll, np.zeros((2, k))])]), np.array([n]), p, pi)
    total = special.log_sum_exp(np.array(list(scores.values())))
    assert evidence[0] == pytest.approx(total)
    for t, x in itertools.product(range(n), range(k)):
        assert gamma[0, t, x] == pytest.approx(sum(math.exp(v - total) for s, v in scores.items() if s[t] == x), abs=1e-9)
    assert xi[0].sum() == pytest.approx(n - 1)
    assert tuple(inference.viterbi(ll[None], np.array([n]), p, pi)[0] - 1) == max(scores, key=scores.get)


def test_special_functions():
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329) and special.digamma(0.5) == pytest.approx(-1.9635100260214235)
    assert special.student_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert special.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert special.kl_dirichlet([1, 2], [1, 2]) == pytest.approx(0) and special.kl_gamma(2, 3, 2, 3) == pytest.approx(0)
    r = np.array([[2.0, 0.3], [0.3, 1.0]])
    assert special.kl_wishart(4, r, 4, r) == pytest.approx(0) and special.kl_wishart(4, r, 5, r) > 0 and special.kl_normal([0, 1], r, [0, 0], r) > 0
    x, h = 3.7, 1e-5
    assert special.digamma(x) == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), abs=1e-8)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 5), st.integers(0, 2), st.integers(0, 10**6))
def test_assignment_against_enumeration(n, more, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, n + more)).astype(float)
    got = pairs.assign(cost)
    best = min(sum(cost[i, j] for i, j in enumerate(c)) for c in itertools.permutations(range(n + more), n))
    assert len(set(got)) == n and sum(cost[i, j] for i, j in enumerate(got)) == best


def test_filters():
    t = np.arange(2000) / 200
    slow, fast = np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 60 * t)
    for band, keep in (((0, 20), slow), ((20, np.inf), fast), ((2, 20), slow)):
        b, a = preprocess.butterworth(4, band, 200.0)
        assert np.abs(preprocess.zero_phase(b, a, slow + fast) - keep)[300:-300].max() < 0.02
    assert np.abs(np.abs(preprocess.analytic(np.cos(2 * np.pi * np.arange(256) / 16))) - 1).max() < 1e-9


def test_spectrum_of_an_autoregression(spark):
    grid = simulate.segment_grid(spark, 4, 2, 4096)
    x = simulate.autoregressive_series(grid, [[[0.7]]], [[1.0]], [1])
    wide = x.select("series_id", "segment_id", "t", F.col("x")[0].alias("x1"))
    fit = moments.fit_mar(wide, ["x1"], [1])
    assert fit["coef"][1, 0] == pytest.approx(0.7, abs=0.02) and fit["cov"][0, 0] == pytest.approx(1, abs=0.04) and fit["explained"][0] == pytest.approx(0.49, abs=0.03)
    f = np.array([0.0, 10.0, 40.0])
    psd = spectra.autoregressive(fit["coef"], fit["cov"], [1], 100.0, f)[:, 0, 0].real
    want = 1 / (100 * np.abs(1 - 0.7 * np.exp(-2j * np.pi * f / 100)) ** 2)
    assert np.allclose(psd, want, rtol=0.15)
    tapered = {round(r.f, 3): r.re for r in spectra.multitaper(x, 256, 100.0).groupBy("f").agg(F.avg("re").alias("re")).collect()}
    near = [v for k, v in tapered.items() if 9 < k < 11]
    assert np.mean(near) == pytest.approx(want[1], rel=0.2)
    assert np.allclose(spectra.slepian(64, 2.0, 3).T @ spectra.slepian(64, 2.0, 3), np.eye(3), atol=1e-9)


def test_multitaper_reads_the_last_window_and_weighs_states(spark):
    rng, taper = np.random.default_rng(3), spectra.slepian(64, 2.0, 3)
    x, p = {1: rng.normal(size=(100, 2)), 2: rng.normal(size=(40, 2))}, {1: rng.random(100), 2: rng.random(40)}

    def want(segment, weight):
        total, n = 0, 0
        for part, w in ((x[segment][i : i + 64], weight[i : i + 64]) for i in (0, 64)):
            if len(part):
                z = np.zeros((64, 2))
                before = math.ceil((64 - len(part)) / 2)
                z[before : before + len(part)] = (part - part.mean(0)) * w[:, None]
                total, n = total + sum(np.abs(np.fft.rfft(z[:, 0] * taper[:, k])) ** 2 for k in range(3)), n + 3
        return total / n / np.mean(weight**2)

    rows = [(s, s, t, v.tolist()) for s in x for t, v in enumerate(x[s], 1)]
    data = spark.createDataFrame(rows, "series_id bigint, segment_id bigint, t int, x array<double>")
    cells = [(s, s, t, k, float(v if k == 1 else 1 - v)) for s in p for t, v in enumerate(p[s], 1) for k in (1, 2)]
    gamma = spark.createDataFrame(cells, "series_id bigint, segment_id bigint, t int, state int, p double")
    plain = spectra.multitaper(data, 64, 1.0).filter("i = 1 AND j = 1").orderBy("series_id", "f").collect()
    weighed = spectra.multitaper(data, 64, 1.0, gamma=gamma).filter("i = 1 AND j = 1").orderBy("series_id", "state", "f").collect()
    for s in x:
        assert np.allclose([r.re for r in plain if r.series_id == s], want(s, np.ones(len(x[s]))))
        for k, w in ((1, p[s]), (2, 1 - p[s])):
            assert np.allclose([r.re for r in weighed if (r.series_id, r.state) == (s, k)], want(s, w))


def test_zeros_and_thin_times_have_defined_results(spark):
    parts = spark.createDataFrame([(1, 0.0), (1, 2.0), (1, 4.0), (2, 0.0), (2, 0.0), (2, 3.0)], "channel int, value double")
    got = {r.channel: r for r in spectra.jackknife(parts, ["channel"]).collect()}
    assert got[1].value == pytest.approx(2) and 0 < got[1].low < 2 < got[1].high
    assert got[2].value == pytest.approx(1) and got[2].low is None and got[2].high is None
    rows = [(1, f, float(v), 2.0 * v) for v in range(6) for f in (0, 1)] + [(2, 0, 1.0, 2.0), (2, 0, 2.0, 3.0), (3, 0, 1.0, 5.0), (3, 1, 2.0, 5.0)]
    wide = spark.createDataFrame(rows, "t int, fold int, a double, y double")
    cv = {r.t: r.r2 for r in decode_task.cross_validated(wide, ["a"], "y", 1e-9).collect()}
    assert cv[1] == pytest.approx(1) and cv[2] is None and cv[3] is None


def test_training_recovers_states_and_lowers_free_energy(spark):
    truth = [[0.95, 0.05], [0.1, 0.9]]
    x = simulate.gaussian_series(simulate.segment_grid(spark, 6, 2, 150), truth, [0.5, 0.5], [[0, 0], [3, 2]], [np.eye(2), np.eye(2) * 0.5], seed=4).cache()
    model = train.fit(x, k=2, cycles=25, seed=3)
    assert all(b <= a + 1e-6 * abs(a) for a, b in zip(model.history, model.history[1:])) and len(model.history) > 2
    order = np.argsort(model.mean[:, 0])
    assert np.allclose(model.mean[order], [[0, 0], [3, 2]], atol=0.25)
    assert np.allclose(model.transition()[np.ix_(order, order)], truth, atol=0.06)
    found = train.decode(x, model, "path").join(x.select("series_id", "segment_id", "t", F.col("state").alias("true")), ["series_id", "segment_id", "t"])
    agree = found.agg(F.avg((F.col("state") == F.col("true")).cast("double"))).first()[0]
    assert max(agree, 1 - agree) > 0.93
    again = series.model_from(series.model_table(spark, model))
    assert np.allclose(again.mean, model.mean) and np.allclose(again.counts, model.counts) and np.allclose(again.b, model.b)
    duals = train.dual_estimates(x, model)
    assert duals.select("series_id").distinct().count() == 6
    assert train.symmetric_divergence(model, model) == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError, match="did you mean cycles"):
        train.fit(x, cycels=3)


def test_permutation_p_values_and_corrections(spark):
    units = spark.createDataFrame([(i, float(i % 7), int(i < 15)) for i in range(30)], "u bigint, target double, label int")
    strong = units.select("u", F.col("label").cast("double").alias("value"))
    assert stats.difference_test(units, strong, "u", "label", 99).first().p == pytest.approx(0.01)
    dealt = stats.permuted(units, "u", "target", 20)
    assert dealt.filter("perm = 0").select("u", "target").exceptAll(units.select("u", "target")).count() == 0
    assert dealt.groupBy("perm").agg(F.sum("target").alias("s")).select("s").distinct().count() == 1
    tests = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "i int, p double")
    assert [round(r.q, 6) for r in stats.benjamini_hochberg(tests).orderBy("i").collect()] == [0.04, 0.053333, 0.053333, 0.5]
    kept = stats.folds(units.withColumn("fam", F.col("u") % 9), "u", 3, family="fam").groupBy("fam").agg(F.count_distinct("fold").alias("n"))
    assert kept.filter("n > 1").count() == 0
    y, coef = stats.deconfound(units, "target", ["label"])
    back = stats.confound(y, "target", ["label"], coef).orderBy("u").collect()
    assert [r.target for r in back] == pytest.approx([float(i % 7) for i in range(30)])


def test_regressions_are_exact_without_noise(spark):
    rows = [(i, t, float(i), float((i * i) % 5), 2.0 + 3.0 * i - ((i * i) % 5) * t) for i in range(12) for t in (1, 2)]
    wide = spark.createDataFrame(rows, "id bigint, t int, a double, b double, y double")
    betas = decode_task.regression_by_time(wide, ["a", "b"], "y", 0.0)
    assert {(r.t, r.term): round(r.beta, 6) for r in betas.collect()} == {(t, i): v for t in (1, 2) for i, v in enumerate((2.0, 3.0, -float(t)))}
    scored = decode_task.predicted_by_time(wide, ["a", "b"], betas)
    assert all(r.r2 == pytest.approx(1) for r in decode_task.r_squared(scored).collect())
    cv = decode_task.cross_validated(wide.withColumn("fold", (F.col("id") % 3).cast("int")), ["a", "b"], "y", 1e-9)
    assert all(r.r2 == pytest.approx(1) for r in cv.collect())


def test_logistic_bound_is_a_bound(spark):
    df = spark.createDataFrame([(x / 4, y, abs(p) / 4) for x in range(-20, 21, 5) for y in (-1, 1) for p in (0, 3, 9)], "x double, y int, psi double")
    rows = df.select("x", "y", "psi", emissions.logistic_bound(F.col("x"), F.col("y"), F.col("psi")).alias("b")).collect()
    for r in rows:
        exact = -math.log1p(math.exp(-r.x * r.y))
        assert r.b <= exact + 1e-12 and (abs(abs(r.x) - r.psi) > 1e-9 or r.b == pytest.approx(exact))


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5.0, 1.0), (1, 4.0, 2.0), (2, 1.0, None)], "s bigint, at double, v double")
    obs = series.keyed(rows, "s", ["at"], ["v"])
    assert [(r.series_id, r.t, r.x) for r in obs.orderBy("series_id", "t").collect()] == [(1, 1, [2.0]), (1, 2, [1.0]), (2, 1, [None])]
    assert [(r.series_id, r.short, r.bad_values) for r in series.faults(obs, 1).collect()] == [(2, True, True)]
    with pytest.raises(ValueError, match="series 2"):
        series.checked(obs)
    good = obs.filter("series_id = 1")
    assert series.from_long(series.to_long(good)).exceptAll(good).count() == 0
    for kind in ("parquet", "csv", "json"):
        series.write(series.to_long(good), f"{tmp_path}/{kind}", kind)
        assert series.read(spark, f"{tmp_path}/{kind}", kind).count() == 2
    with pytest.raises(ValueError, match="unknown format"):
        series.read(spark, "x", "xls")


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming import online

    p, pi = [[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5]
    rng = np.random.default_rng(0)
    rows = [(s, 1, t, rng.normal(0, 2, 2).tolist()) for s in (1, 2) for t in range(1, 13)]
    schema = "series_id bigint, segment_id bigint, t int, ll array<double>"
    for n, part in enumerate(([r for r in rows if r[2] <= 5], [r for r in rows if r[2] > 5])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = online.filter_states(stream, p, pi).writeStream.format("memory").queryName("filtered").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.series_id, r.t): r.p for r in spark.table("filtered").collect()}
    for s in (1, 2):
        a = np.array(pi)
        for t in range(1, 13):
            ll = next(r[3] for r in rows if r[0] == s and r[2] == t)
            a = (a if t == 1 else a @ np.array(p)) * np.exp(ll)
            a /= a.sum()
            assert np.allclose(got[s, t], a)


def test_flips_are_undone(spark):
    from tidemark.operators import flips

    rng = np.random.default_rng(1)
    root = np.array([[1.0, 0, 0, 0], [0.8, 0.6, 0, 0], [0.5, 0.5, 0.7, 0], [0.6, -0.5, 0.3, 0.5]])
    rows, signs = [], {}
    for s in range(8):
        signs[s] = np.where(rng.random(4) < 0.4, -1, 1) if s else np.ones(4)
        x = (rng.standard_normal((400, 4)) @ root.T) * signs[s]
        r = np.corrcoef(x.T)
        rows += [(s, i + 1, j + 1, 0, float(r[i, j])) for i in range(4) for j in range(4)]
    found = flips.find_flips(spark.createDataFrame(rows, "series_id bigint, i int, j int, lag int, r double"), 4)
    got = {}
    for r in found.collect():
        got.setdefault(r.series_id, np.ones(4))[r.channel - 1] = 1 - 2 * r.flip
    total = [np.outer(got[s] * signs[s], got[s] * signs[s]) for s in range(8)]
    assert sum(np.array_equal(t, total[0]) for t in total) >= 7


def test_mat_files(spark, tmp_path):
    import struct
    import zlib

    from tidemark.sources import matfile

    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    def array(name, values):
        values = np.asarray(values, float)
        flags = element(6, struct.pack("<II", 6, 0))
        return element(14, flags + element(5, struct.pack("<ii", *values.shape)) + element(1, name.encode()) + element(9, values.tobytes("F")))

    packed = zlib.compress(array("T", [[3.0]]))
    raw = b"x".ljust(124) + b"\0\1IM" + array("X", [[1, 2], [3, 4], [5, 6]]) + struct.pack("<II", 15, len(packed)) + packed
    assert [(n, a.tolist()) for n, a in matfile.arrays(raw)] == [("X", [[1, 2], [3, 4], [5, 6]]), ("T", [[3]])]
    (tmp_path / "a.mat").write_bytes(raw)
    spark.dataSource.register(matfile.MatSource)
    got = spark.read.format("mat").option("path", f"{tmp_path}/*.mat").load()
    assert [(r.name, r.row, r.column, r.value) for r in got.filter("name = 'X'").orderBy("row", "column").collect()] == [("X", i + 1, j + 1, 2.0 * i + j + 1) for i in range(3) for j in range(2)]


def test_scatter_divergence(spark):
    rows = [(s, t, math.sin(t * (s % 2 + 1)) * (1 + s % 2), math.cos(t + s % 2)) for s in range(4) for t in range(50)]
    got = {(r.a, r.b): r.divergence for r in pairs.scatter_divergence(spark.createDataFrame(rows, "series_id bigint, t int, u double, v double"), ["u", "v"]).collect()}
    assert got[0, 2] == pytest.approx(0, abs=1e-9) and got[0, 1] > 1 and len(got) == 6


def test_repeated_fits_agree(spark):
    x = simulate.gaussian_series(simulate.segment_grid(spark, 4, 2, 80), [[0.95, 0.05], [0.1, 0.9]], [0.5, 0.5], [[0, 0], [4, 3]], [np.eye(2)] * 2, seed=2).cache()
    best = train.fit_best(x, 2, short=3, k=2, cycles=8)
    other = train.fit(x, k=2, cycles=10, seed=11)
    shares = train.agreement(train.decode(x, best), train.decode(x, other), 2).collect()
    assert len(shares) == 4 and all(r.agreement > 0.95 for r in shares)
    behaviour = x.groupBy("series_id", "segment_id").agg(F.avg((F.col("state") == 1).cast("double")).alias("y"))
    r2 = train.behaviour_association(train.decode(x, best), behaviour, 2)
    assert r2.count() == 80 and r2.filter("r2 > 1.000001").count() == 0
