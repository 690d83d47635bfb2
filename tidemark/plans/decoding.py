"""Queries over chains of regressions, decoders, encoders, group tests and spectra of models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import decoders as dc
from tidemark.operators import dynamics as d
from tidemark.operators import group_tests as gt
from tidemark.operators import moments as m
from tidemark.operators import regression_chain as rc
from tidemark.operators import spectra_model as sp
from tidemark.operators import state_models as sm
from tidemark.operators.spectra import autoregressive
from tidemark.plans.dynamics import _r
from tidemark.plans.tables import SQL, K, gamma, observations, path, samples, sql, suppliers
from tidemark.session import table

FREQS = (0.05, 0.1, 0.2, 0.4)
# A fixed autoregression of two channels: to, from; noise.
LAG_ONE = np.array([[0.5, 0.2], [-0.3, 0.4]])
NOISE = np.array([[1.0, 0.3], [0.3, 2.0]])


def _pairs_data(s, p) -> DataFrame:
    """Channels x2, x3 of users' weeks."""
    return observations(s, p).select("series_id", "segment_id", "t", F.array(F.col("x")[1], F.col("x")[2]).alias("x"))


def _design_data(s, p) -> DataFrame:
    """x2, x3 as design of the value's logarithm and parameter: x3 predicts x2."""
    return samples(s, p).select("series_id", "segment_id", "t", F.array("x3").alias("x"), F.array("x2").alias("y"))


def _table(s, model) -> DataFrame:
    return s.createDataFrame(model.rows(), "state int, param string, i int, j int, value double")


def _mar(s, p, covariance="full") -> rc.RegressionModel:
    return rc.fit(_pairs_data(s, p), rc.Family((1,), True, covariance), 2, cycles=8, seed=1)


def _one_state(s, p) -> DataFrame:
    """Weights of one state without relevance and with a prior too weak to matter."""
    held = rc.segments(_pairs_data(s, p).select("series_id", "segment_id", "t", F.array(F.col("x")[0]).alias("x")))
    from tidemark.session import stage

    held = stage(held, "segments")
    model = rc.initial_model(held, rc.Family((1,), True, "diag", False), 1, 0)
    model.prior["fixed"] = model.prior["intercept"] = 1e-10
    model = rc.update_weights(model, rc.statistics(held, model))
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(model.w[0][:, 0])], "term int, beta double")


def _soft(s, p) -> DataFrame:
    return gamma(s, p).join(samples(s, p).drop("state"), ["series_id", "segment_id", "t"])


def _labelled(s, p) -> DataFrame:
    """Samples in six groups of times, three folds of users, purchases and signups against the rest."""
    return samples(s, p).select(
        "series_id", "segment_id", F.col("t").alias("sample"), (F.col("t") % 6).alias("t"), (F.col("series_id") % 3).cast("int").alias("fold"), (F.col("state").isin(3, 4)).cast("int").alias("label"), "x2", "x3"
    )


def _discriminants(s, p) -> DataFrame:
    found = dc.discriminants(dc.class_moments(_labelled(s, p), ["x2", "x3"], "label", ["t"]), ["t"])
    return found.select("t", "class", "bias", F.col("weights")[0].alias("w1"), F.col("weights")[1].alias("w2"))


def _logistic(s, p) -> DataFrame:
    return dc.logistic_by_time(_labelled(s, p), ["x2"], "label", 8)


def _shares(s, p) -> DataFrame:
    n = d.series_transitions(path(s, p))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("series_id")))


def _behaviour(s, p) -> DataFrame:
    return samples(s, p).groupBy("series_id").agg(F.avg("x1").alias("y"))


def _phenotype(s, p) -> DataFrame:
    from tidemark.session import stage

    fo = d.fractional_occupancy(gamma(s, p)).groupBy("series_id").agg(*(F.sum(F.when(F.col("state") == k, F.col("fo"))).alias(f"f{k}") for k in range(1, K)))
    wide = fo.join(_behaviour(s, p), "series_id").withColumn("fold", (F.col("series_id") % 5).cast("int"))
    return dc.prediction_scores(dc.ridge_out_of_fold(stage(wide, "phenotype"), [f"f{k}" for k in range(1, K)], "y", [1e-4, 1e-2, 1.0]))


def _centroid_check(s, p) -> DataFrame:
    one = table(s, p, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    a, b = one.select(F.col("label").alias("a"), "i", F.col("v").alias("x")), one.select(F.col("label").alias("b"), "i", F.col("v").alias("y"))
    rows = a.join(b, "i").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("d")).collect()
    names = sorted({r.a for r in rows})
    matrix = np.zeros((len(names), len(names)))
    for r in rows:
        matrix[names.index(r.a), names.index(r.b)] = r.d
    return s.createDataFrame([(dc.is_euclidean(matrix),)], "euclidean boolean")


def _trials(s, p) -> DataFrame:
    units = samples(s, p).groupBy("series_id", "segment_id").agg(F.avg("x1").alias("y"))
    return units.select(F.concat_ws("/", "series_id", "segment_id").alias("trial"), "y")


def _epoch(s, p) -> DataFrame:
    g = gamma(s, p).filter("t <= 8").select(F.concat_ws("/", "series_id", "segment_id").alias("trial"), "t", "state", "p")
    return gt.epoch_test(g, _trials(s, p), K, 50, seed=1)


def _unit_spectra(s, p) -> DataFrame:
    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"x{c}").alias("v")) for c in (1, 2, 3))))
    return samples(s, p).select("series_id", "state", cells).groupBy(F.col("series_id").alias("unit"), "state", "channel").agg(F.avg("v").alias("value")).withColumn("f", F.lit(1.0))


def _connectivity(s, p) -> DataFrame:
    return _r(gt.connectivity_test(samples(s, p).drop("state"), path(s, p), ["x2", "x3"], 10, seed=2), "distance", "p")


def _clusters(s, p) -> DataFrame:
    """Accuracy: share of values above 20 at the first twelve times; under chance each user's times are turned."""
    base = samples(s, p).filter("t <= 12")
    seen = base.groupBy("t").agg(F.avg((F.col("x1") > 20).cast("double")).alias("accuracy"))
    many = base.select("series_id", "t", (F.col("x1") > 20).cast("double").alias("hit"), F.explode(F.sequence(F.lit(1), F.lit(11))).alias("perm"))
    dealt = many.select(F.col("series_id").alias("unit"), "perm", ((F.col("t") + F.col("perm") - 1) % 12 + 1).cast("int").alias("t"), "hit").groupBy("unit", "perm", "t").agg(F.avg("hit").alias("accuracy"))
    return gt.cluster_test(seen, dealt, 100, 0.3)


def _gradient(s, p) -> DataFrame:
    starts = path(s, p).filter("t = 1").groupBy("series_id", "state").agg(F.count("*").alias("n"))
    whole = path(s, p).filter("t = 1").groupBy("state").agg(F.count("*").alias("n"))
    share = whole.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).drop("n")  # K rows
    return gt.chain_gradient(starts, d.series_transitions(path(s, p)), share, d.transitions(path(s, p)).select("i", "j", "p"))


def _state_spectrum(s, p) -> DataFrame:
    """Spectra of each state's line of x2 on the sample before."""
    before = m.lagged(samples(s, p).drop("state"), ["x2"], [1])[0]
    wide = gamma(s, p).join(before, ["series_id", "segment_id", "t"])
    betas = sm.regression_by_state(wide, ["x2_1"], "x2", F.col("p")).groupBy("state").pivot("term", [0, 1]).agg(F.first("beta")).toDF("state", "b0", "b1")
    e = F.col("x2") - F.col("b0") - F.col("b1") * F.col("x2_1")
    found = wide.join(betas, "state").groupBy("state").agg(F.first("b1").alias("b1"), (F.sum(F.col("p") * e * e) / F.sum("p")).alias("v")).collect()  # K rows
    rows = []
    for r in found:
        psd = autoregressive(np.array([[0.0], [r.b1]]), np.array([[r.v]]), [1], 1.0, np.array(FREQS))
        rows += [(r.state, f, float(v[0, 0].real)) for f, v in zip(FREQS, psd, strict=True)]
    return s.createDataFrame(rows, "state int, f double, psd double")


def _directed(s, p) -> DataFrame:
    """Directed measures of the fixed autoregression, from its spectra alone, at every fourth of 65 frequencies."""
    f = np.linspace(0, 0.5, 65)
    pdc, dtf = sp.directed_measures(autoregressive(np.vstack([np.zeros(2), LAG_ONE.T]), NOISE, [1], 1.0, f))
    rows = [(float(f[n]), i + 1, j + 1, round(float(pdc[n, i, j]), 6), round(float(dtf[n, i, j]), 6)) for n in range(0, 65, 4) for i in (0, 1) for j in (0, 1)]
    return s.createDataFrame(rows, "f double, i int, j int, pdc double, dtf double")


def _power(s, p) -> DataFrame:
    bins = samples(s, p).select("state", F.floor(F.col("x1") / 10).cast("double").alias("f"), F.inline(F.array(F.struct(F.lit(1).alias("i"), F.col("x2").alias("v")), F.struct(F.lit(2).alias("i"), F.col("x3").alias("v")))))
    return bins.groupBy("state", "i", "f").agg(F.avg("v").alias("value"))


def _prior() -> np.ndarray:
    from tidemark.operators import train

    return train.chain_prior(3, 10.0, 1.0, [[1, 1, 0], [0, 1, 1], [0, 0, 1]], 2.0)


def _class_data(s, p, low: float = -1.0) -> DataFrame:
    x = samples(s, p).select("series_id", "segment_id", "t", F.array("x2", "x3").alias("x"), F.col("state").isin(3, 4).cast("int").alias("label"))
    return dc.class_targets(x, "label", [0, 1], low)


def _class_decoder(s, p) -> DataFrame:
    data = _class_data(s, p).drop("label")
    return dc.decoded_classes(rc.predict(data, rc.fit(data, rc.Family((), False, "shareddiag"), 2, cycles=5, seed=1)), [0, 1])


def _encoder(s, p):
    turned = _class_data(s, p, 0.0).select("series_id", "segment_id", "t", F.array(F.col("y")[1]).alias("x"), F.col("x").alias("y"))
    return turned, rc.fit(turned, rc.Family((), True, "sharedfull"), 2, cycles=5, seed=1)


def _encoded_classes(s, p) -> DataFrame:
    """Classes by an encoder with a column for each class."""
    turned = _class_data(s, p, 0.0).select("series_id", "segment_id", "t", F.col("y").alias("x"), F.col("x").alias("y"))
    model = rc.fit(turned, rc.Family((), True, "sharedfull"), 2, cycles=5, seed=1)
    course = rc.decode(turned, model).groupBy("t", "state").agg(F.avg("p").alias("p"))
    return dc.discriminate_by_states(_class_data(s, p), model, course, [0, 1])


def _unsupervised(s, p) -> DataFrame:
    from tidemark.operators import train

    x = _pairs_data(s, p)
    return train.decode(x, train.from_courses(x, gamma(s, p), K), "path")


def _prepared(s, p) -> DataFrame:
    data, _ = dc.prepared(observations(s, p).join(samples(s, p).select("series_id", "segment_id", "t", F.col("x2").alias("y")), ["series_id", "segment_id", "t"]), "y", 2)
    return data.select("series_id", "segment_id", "t", F.round(F.col("x")[0], 6).alias("one"), F.round(F.col("x")[1], 6).alias("first"), F.round(F.col("x")[2], 6).alias("second"))


def _by_batches(s, p) -> DataFrame:
    from tidemark.operators import train

    return s.createDataFrame(train.start_by_batches(_pairs_data(s, p), 3, k=2, cycles=4, seed=1).rows(), "state int, param string, i int, j int, value double")


def _trial_decoding(s, p) -> DataFrame:
    wide = samples(s, p).filter("t <= 6").select(F.concat_ws("/", "series_id", "segment_id").alias("trial"), "t", "x2")
    return _r(dc.decoding_permutations(wide, ["x2"], _trials(s, p), 20, seed=1), "observed", "p")


QUERIES = {
    "dec03_class_decoder": _class_decoder,
    "dec20_encoded_classes": _encoded_classes,
    "dec21_encoder": lambda s, p: _table(s, _encoder(s, p)[1]),
    "dec28_unsupervised_states": _unsupervised,
    "dec30_decoding_permutations": _trial_decoding,
    "dec31_chain_permutations": lambda s, p: dc.chain_permutations(_design_data(s, p), rc.Family((), True, "shareddiag"), 2, 2, 2, 2),
    "pre21_prepared": _prepared,
    "train03_chain_prior": lambda s, p: s.createDataFrame([(i + 1, k + 1, float(v)) for (i, k), v in np.ndenumerate(_prior())], "i int, j int, alpha double"),
    "train13_start_by_batches": _by_batches,
    "stat19_phenotype_from_chains": lambda s, p: dc.phenotype_from_chains(_pairs_data(s, p), _behaviour(s, p), 2, 2, [1.0, 100.0], cycles=3),
    "train02_regression_chain": lambda s, p: _table(s, _mar(s, p)),
    "obs11_shared_noise_chain": lambda s, p: _table(s, _mar(s, p, "sharedfull")),
    "obs12_single_state_weights": lambda s, p: _one_state(s, p).withColumn("beta", F.round("beta", 5)),
    "obs14_relevance": lambda s, p: s.createDataFrame([(k + 1, n + 1, float(x)) for model in [_mar(s, p, "diag")] for (k, n), x in np.ndenumerate(model.alpha[0] / model.alpha[1])], "state int, lag int, alpha double"),
    "train09_window_start": lambda s, p: rc.window_start(suppliers(s, p).select("series_id", "segment_id", "t", F.array("x2").alias("x")), rc.Family((1,)), 100, 3),
    "dec01_time_varying_decoder": lambda s, p: _table(s, rc.fit(_design_data(s, p), rc.Family((), True, "shareddiag"), 2, cycles=8, seed=1)),
    "dec05_decode": lambda s, p: rc.predict(_design_data(s, p), rc.fit(_design_data(s, p), rc.Family((), True, "shareddiag"), 2, cycles=8, seed=1)),
    "dec06_cross_validated_decoder": lambda s, p: rc.cross_validated(_design_data(s, p), rc.Family((), True, "shareddiag"), 2, 2, 4),
    "dec11_encoding_by_state": lambda s, p: _r(dc.encoding_by_state(_soft(s, p), ["x1", "x3"], "x2", F.col("p")), "beta", "r2"),
    "dec12_behaviour": lambda s, p: dc.behaviour_by_transitions(_shares(s, p), _behaviour(s, p), K, 5),
    "dec13_sparsified": lambda s, p: _r(dc.sparsified(gamma(s, p), 0.05), "p"),
    "dec14_sequential_clusters": lambda s, p: dc.cluster_decoding(samples(s, p), ["x2"], "x1", 4, "sequential"),
    "dec14_regression_clusters": lambda s, p: dc.cluster_decoding(samples(s, p), ["x2"], "x1", 3, "regression"),
    "dec14_hierarchical_clusters": lambda s, p: dc.cluster_decoding(samples(s, p), ["x2"], "x1", 3, "hierarchical"),
    "dec16_encoding_by_time": lambda s, p: _r(dc.encoding_by_time(samples(s, p), ["x1", "x3"], "x2"), "r2"),
    "dec17_classification_by_time": lambda s, p: _r(dc.classification_by_time(_labelled(s, p), ["x2"], "label", ["series_id", "segment_id", "sample"]), "accuracy"),
    "dec18_discriminants": lambda s, p: _r(_discriminants(s, p), "bias", "w1", "w2"),
    "dec18_logistic_by_time": lambda s, p: _logistic(s, p),
    "dec26_euclidean": _centroid_check,
    "stat01_epoch_test": _epoch,
    "stat06_spectral_test": lambda s, p: _r(gt.spectral_test(_unit_spectra(s, p), 50), "value", "lower", "higher", "lower_corrected", "higher_corrected"),
    "stat07_channels_dealt": lambda s, p: _r(gt.spectral_test(_unit_spectra(s, p), 50, "state").drop("lower_corrected", "higher_corrected"), "value", "lower", "higher"),
    "stat08_states_dealt": lambda s, p: _r(gt.spectral_test(_unit_spectra(s, p), 50, "channel").drop("lower_corrected", "higher_corrected"), "value", "lower", "higher"),
    "stat11_connectivity_test": _connectivity,
    "stat12_cluster_test": lambda s, p: _r(_clusters(s, p), "accuracy", "chance", "p"),
    "stat13_chain_gradient": lambda s, p: _r(_gradient(s, p), "value"),
    "stat14_phenotype": _phenotype,
    "spec05_state_spectra": lambda s, p: _r(_state_spectrum(s, p), "psd"),
    "spec05_model_spectra": lambda s, p: sp.model_spectra(s, _mar(s, p), 1.0, FREQS),
    "spec07_wavelet_spectra": lambda s, p: sp.wavelet_spectra(observations(s, p), gamma(s, p), 1.0, FREQS),
    "spec11_components": lambda s, p: sp.spectral_components(_power(s, p), 2),
    "spec14_directed": _directed,
    "spec17_rising_orders": lambda s, p: _r(sp.autoregressive_fit(suppliers(s, p), "x2", [1, 2, 5]), "residual", "explained"),
}


def _with(extra: str, query: str) -> str:
    return f"WITH {SQL}, {extra} {query}"


_SOFT = "soft AS (SELECT g.series_id, g.segment_id, g.t, g.state, p, x1, x2, x3 FROM g JOIN s USING (series_id, segment_id, t))"
_MAR_STATE = (
    _SOFT + ", lq AS (SELECT *, lag(x2) OVER (PARTITION BY series_id, segment_id, state ORDER BY t) AS x FROM soft), "
    "wq AS (SELECT state, sum(p) AS n, sum(p * x) AS sx, sum(p * x * x) AS sxx, sum(p * x2) AS sy, sum(p * x * x2) AS sxy FROM lq WHERE x IS NOT NULL GROUP BY 1), "
    "bq AS (SELECT state, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM wq), "
    "vq AS (SELECT state, any_value(b1) AS b1, sum(p * (x2 - b0 - b1 * x) ** 2) / sum(p) AS v FROM lq JOIN bq USING (state) WHERE x IS NOT NULL GROUP BY 1)"
)
_LABELLED = "lb AS (SELECT series_id, segment_id, t AS sample, t % 6 AS t, series_id % 3 AS fold, (state IN (3, 4))::INT AS label, x2, x3 FROM s)"
# Weighted lines of a channel, less its mean, on x2 in each state.
_ENCODED = (
    _SOFT + ", ch AS (SELECT state, p, x2 AS y, unnest([1, 2]) AS channel, unnest([x1 - m1, x3 - m3]) AS x FROM soft, (SELECT avg(x1) AS m1, avg(x3) AS m3 FROM soft)), "
    "cs AS (SELECT state, channel, sum(p) + 1e-6::DOUBLE AS a, sum(p * y) AS b, sum(p * y * y) + 1e-6::DOUBLE AS c, sum(p * x) AS u, sum(p * x * y) AS v, sum(p * x * x) AS q FROM ch GROUP BY 1, 2), "
    "cb AS (SELECT state, channel, q, (c * u - b * v) / (a * c - b * b) AS b0, (a * v - b * u) / (a * c - b * b) AS b1 FROM cs)"
)


def _dealt(within: str, mixed: str) -> str:
    """Means of units' spectra with one key dealt anew 50 times by MD5."""
    return _with(
        "us AS (SELECT series_id AS unit, state, channel, 1.0::DOUBLE AS f, avg(v) AS value FROM (SELECT series_id, state, unnest([1, 2, 3]) AS channel, unnest([x1, x2, x3]) AS v FROM s) GROUP BY 1, 2, 3), "
        f"pl AS (SELECT us.*, perm, row_number() OVER (PARTITION BY unit, {within}, perm ORDER BY {mixed}) AS home, "
        f"row_number() OVER (PARTITION BY unit, {within}, perm ORDER BY CASE WHEN perm > 0 THEN md5(unit || ':' || {within} || ':' || {mixed} || ':' || perm || ':0') END, {mixed}) AS place FROM us, range(0, 51) r(perm)), "
        f"mn AS (SELECT a.state, a.channel, a.f, a.perm, avg(b.value) AS m FROM pl a JOIN pl b ON a.unit = b.unit AND a.{within} = b.{within} AND a.perm = b.perm AND a.home = b.place GROUP BY 1, 2, 3, 4)",
        "SELECT state, channel, f, round(value, 6) AS value, round(avg((-m >= -value - (1e-9 * abs(value) + 1e-12))::INT), 6) AS lower, round(avg((m >= value - (1e-9 * abs(value) + 1e-12))::INT), 6) AS higher FROM mn JOIN (SELECT state, channel, m AS value FROM mn WHERE perm = 0) "
        "USING (state, channel) GROUP BY state, channel, f, value",
    )


def _closed_form() -> str:
    """Directed measures of the fixed autoregression from its coefficients."""
    rows = []
    for n in range(0, 65, 4):
        f = n / 128
        a = np.eye(2) - LAG_ONE * np.exp(-2j * np.pi * f)
        h = np.linalg.inv(a)
        for i in (0, 1):
            for k in (0, 1):
                pdc = abs(a[i, k]) / np.sqrt((np.abs(a[:, k]) ** 2).sum()) * (i != k)
                dtf = abs(h[i, k]) / np.sqrt((np.abs(h[i]) ** 2).sum()) * (i != k)
                rows.append(f"({f}::DOUBLE, {i + 1}, {k + 1}, {round(float(pdc), 6)}::DOUBLE, {round(float(dtf), 6)}::DOUBLE)")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) q(f, i, j, pdc, dtf)"


_SURROGATE = (
    "sh AS (SELECT state, sum(count(*)) OVER (ORDER BY state) / sum(count(*)) OVER () AS top FROM s GROUP BY 1), "
    "dr AS (SELECT runs.*, perm, ('0x' || substr(md5(series_id || ':' || segment_id || ':' || start_t || ':' || perm || ':2'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM runs, range(0, 11) r(perm)), "
    "dn AS (SELECT series_id, segment_id, start_t, end_t, perm, CASE WHEN perm = 0 THEN state ELSE (SELECT min(sh.state) FROM sh WHERE u < top OR sh.state = 5) END AS state FROM dr), "
    "cv AS (SELECT perm, dn.state, count(*) AS n, var_pop(x2) AS a, covar_pop(x2, x3) AS b, var_pop(x3) AS c FROM dn JOIN s ON dn.series_id = s.series_id AND dn.segment_id = s.segment_id AND s.t BETWEEN start_t AND end_t GROUP BY 1, 2), "
    "pr AS (SELECT x.perm, x.state AS i, y.state AS j, (x.a * y.c - 2 * x.b * y.b + x.c * y.a) / (y.a * y.c - y.b * y.b) AS tr, (x.a * x.c - x.b * x.b) / (y.a * y.c - y.b * y.b) AS de FROM cv x JOIN cv y ON x.perm = y.perm "
    "AND x.state < y.state AND x.n > 2 AND y.n > 2), "
    "ds AS (SELECT perm, i, j, sqrt(ln((tr + sqrt(greatest(tr * tr - 4 * de, 0))) / 2) ** 2 + ln((tr - sqrt(greatest(tr * tr - 4 * de, 0))) / 2) ** 2) AS d FROM pr)"
)

ORACLES = {
    "train03_chain_prior": "SELECT * FROM (VALUES (1, 1, 20.0::DOUBLE), (1, 2, 2.0), (1, 3, 0.0), (2, 1, 0.0), (2, 2, 20.0), (2, 3, 2.0), (3, 1, 0.0), (3, 2, 0.0), (3, 3, 20.0)) q(i, j, alpha)",
    # x2 follows itself; of the other two x1, whose square root of explained variance is larger, stays beside it.
    "pre21_prepared": _with(
        "mm AS (SELECT t, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3 FROM s GROUP BY 1), ct AS (SELECT s.*, x1 - m1 AS a, x2 - m2 AS b, x3 - m3 AS c FROM s JOIN mm USING (t)), "
        "rr AS (SELECT regr_r2(a, x2) >= regr_r2(c, x2) AS first FROM ct)",
        "SELECT series_id, segment_id, t, 1.0::DOUBLE AS one, round(CASE WHEN first THEN a ELSE b END, 6) AS first, round(CASE WHEN first THEN b ELSE c END, 6) AS second FROM ct, rr",
    ),
    "dec30_decoding_permutations": _with(
        "tr AS (SELECT series_id || '/' || segment_id AS trial, avg(x1) AS y FROM s GROUP BY 1), "
        "pl AS (SELECT perm, tr.*, row_number() OVER (PARTITION BY perm ORDER BY trial) AS home, row_number() OVER (PARTITION BY perm ORDER BY CASE WHEN perm > 0 THEN md5(trial || ':' || perm || ':1') END, trial) AS place FROM tr, range(0, 21) r(perm)), "
        "dl AS (SELECT a.perm, a.trial, b.y FROM pl a JOIN pl b ON a.perm = b.perm AND a.home = b.place), "
        "q AS (SELECT perm, t, count(*) AS n0, count(*) + 1e-4::DOUBLE AS n, sum(x2) AS sx, sum(x2 * x2) AS sxx0, sum(x2 * x2) + 1e-4::DOUBLE AS sxx, sum(y) AS sy, sum(x2 * y) AS sxy, sum(y * y) AS syy FROM s JOIN dl ON trial = series_id || '/' || segment_id WHERE t <= 6 GROUP BY 1, 2), "
        "b AS (SELECT *, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM q), "
        "st AS (SELECT perm, t, 1 - (syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n0 + 2 * b0 * b1 * sx + b1 * b1 * sxx0) / (syy - sy * sy / n0) AS d FROM b)",
        "SELECT t, round(o.d, 6) AS observed, round(avg((st.d >= o.d - (1e-9 * abs(o.d) + 1e-12))::INT), 6) AS p FROM st JOIN (SELECT t, d FROM st WHERE perm = 0) o USING (t) GROUP BY t, o.d",
    ),
    "obs12_single_state_weights": _with(
        "b4 AS (SELECT x2, lag(x2) OVER (PARTITION BY series_id, segment_id ORDER BY t) AS x FROM s)",
        "SELECT unnest([0, 1]) AS term, round(unnest([regr_intercept(x2, x), regr_slope(x2, x)]), 5) AS beta FROM b4 WHERE x IS NOT NULL",
    ),
    "dec11_encoding_by_state": _with(
        _ENCODED, "SELECT state, channel, round(any_value(b1), 6) AS beta, round(1 - sum(p * (x - b0 - b1 * y) ** 2) / any_value(q), 6) AS r2 FROM ch JOIN cb USING (state, channel) GROUP BY 1, 2"
    ),
    "dec13_sparsified": _with(
        "mc AS (SELECT state, t, avg(p) AS p FROM g GROUP BY 1, 2), ft AS (SELECT state, sum(p * t) / sum(p) AS m, sum(p * t * t) / sum(p) AS q FROM mc GROUP BY 1), "
        "kp AS (SELECT g.*, CASE WHEN exp(-0.5 * (t - m) ** 2 / greatest(q - m * m, 1e-12)) >= 0.05 THEN p ELSE 0 END AS kept FROM g JOIN ft USING (state)), "
        "tt AS (SELECT *, sum(kept) OVER (PARTITION BY series_id, segment_id, t) AS total FROM kp)",
        "SELECT series_id, segment_id, t, state, round(CASE WHEN total > 0 THEN kept / total ELSE p END, 6) AS p FROM tt",
    ),
    "dec14_sequential_clusters": sql("SELECT t, ((4 * row_number() OVER (ORDER BY t) + n - 1) // n)::INT AS state FROM (SELECT DISTINCT t, (SELECT count(DISTINCT t) FROM s) AS n FROM s)"),
    "dec16_encoding_by_time": sql("SELECT t, unnest([1, 2]) AS channel, round(unnest([regr_r2(x1, x2), regr_r2(x3, x2)]), 6) AS r2 FROM s GROUP BY t"),
    "dec17_classification_by_time": _with(
        _LABELLED + ", al AS (SELECT t, label, count(*) AS n, sum(x2) AS sx, sum(x2 * x2) AS sxx FROM lb GROUP BY 1, 2), ow AS (SELECT t, label, fold, count(*) AS n, sum(x2) AS sx, sum(x2 * x2) AS sxx FROM lb GROUP BY 1, 2, 3), "
        "rs AS (SELECT t, label, fold, al.n - coalesce(ow.n, 0) AS n, al.sx - coalesce(ow.sx, 0) AS sx, al.sxx - coalesce(ow.sxx, 0) AS sxx FROM al CROSS JOIN range(0, 3) r(fold) LEFT JOIN ow USING (t, label, fold)), "
        "cv AS (SELECT t, fold, sum(sxx - sx * sx / n) / sum(n) + 1e-6 AS v FROM rs WHERE n > 0 GROUP BY 1, 2), "
        "sc AS (SELECT series_id, segment_id, sample, lb.t, lb.label, rs.label AS c, x2 * (sx / n) / v - 0.5 * (sx / n) ** 2 / v AS score FROM lb JOIN rs ON lb.t = rs.t AND lb.fold = rs.fold AND n > 0 JOIN cv ON cv.t = lb.t AND cv.fold = lb.fold), "
        "bs AS (SELECT t, label, arg_max(c, score) AS c FROM sc GROUP BY series_id, segment_id, sample, t, label)",
        "SELECT t, round(avg((c = label)::INT), 6) AS accuracy, count(*) AS n FROM bs GROUP BY 1",
    ),
    "dec18_discriminants": _with(
        _LABELLED + ", cm AS (SELECT t, label, count(*) AS n, avg(x2) AS a, avg(x3) AS b, sum(x2 * x2) AS aa, sum(x2 * x3) AS ab, sum(x3 * x3) AS bb FROM lb GROUP BY 1, 2), "
        "cv AS (SELECT t, sum(aa - n * a * a) / sum(n) + 1e-6 AS p, sum(ab - n * a * b) / sum(n) AS q, sum(bb - n * b * b) / sum(n) + 1e-6 AS r FROM cm GROUP BY 1), "
        "ws AS (SELECT t, label, a, b, (r * a - q * b) / (p * r - q * q) AS w1, (p * b - q * a) / (p * r - q * q) AS w2 FROM cm JOIN cv USING (t))",
        "SELECT t, label AS class, round(-0.5 * (w1 * a + w2 * b), 6) AS bias, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM ws",
    ),
    "dec26_euclidean": "SELECT true AS euclidean",
    "stat06_spectral_test": "WITH ts AS ("
    + _dealt("state", "channel")
    + "), rk AS (SELECT *, row_number() OVER (ORDER BY lower) AS rl, row_number() OVER (ORDER BY higher) AS rh, count(*) OVER () AS n FROM ts) SELECT state, channel, f, value, lower, higher, "
    "round(least(1, min(lower * n / rl) OVER (ORDER BY rl DESC)), 6) AS lower_corrected, round(least(1, min(higher * n / rh) OVER (ORDER BY rh DESC)), 6) AS higher_corrected FROM rk",
    "stat12_cluster_test": _with(
        "bs AS (SELECT series_id, t, (x1 > 20)::INT AS hit FROM s WHERE t <= 12), ac AS (SELECT t, avg(hit) AS accuracy FROM bs GROUP BY 1), "
        "de AS (SELECT series_id AS unit, perm, ((t + perm - 1) % 12 + 1)::INT AS t, avg(hit) AS accuracy FROM bs, range(1, 12) r(perm) GROUP BY ALL), "
        "pk AS (SELECT unit, draw, (floor(('0x' || substr(md5(unit || ':' || draw || ':0'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * 11) + 1)::INT AS perm FROM (SELECT DISTINCT unit FROM de), range(1, 101) q(draw)), "
        "mn AS (SELECT draw, t, avg(accuracy) AS accuracy FROM pk JOIN de USING (unit, perm) GROUP BY 1, 2), ch AS (SELECT t, quantile_cont(accuracy, 0.7) AS chance FROM mn GROUP BY 1), "
        "nu AS (SELECT *, sum(c) OVER (PARTITION BY draw ORDER BY t) AS k FROM (SELECT *, CASE WHEN lag(above) OVER (PARTITION BY draw ORDER BY t) = above THEN 0 ELSE 1 END AS c FROM (SELECT mn.*, mn.accuracy > chance AS above FROM mn JOIN ch USING (t)))), "
        "lo AS (SELECT draw, coalesce(max(size), 0) AS longest FROM (SELECT DISTINCT draw FROM pk) LEFT JOIN (SELECT draw, k, count(*) AS size FROM nu WHERE above GROUP BY 1, 2) USING (draw) GROUP BY 1), "
        "se AS (SELECT *, sum(c) OVER (ORDER BY t) AS k FROM (SELECT *, CASE WHEN lag(above) OVER (ORDER BY t) = above THEN 0 ELSE 1 END AS c FROM (SELECT ac.*, chance, ac.accuracy > chance AS above FROM ac JOIN ch USING (t)))), "
        "sz AS (SELECT *, count(*) OVER (PARTITION BY k) AS size FROM se)",
        "SELECT t, round(accuracy, 6) AS accuracy, round(chance, 6) AS chance, CASE WHEN above THEN k END::BIGINT AS cluster, CASE WHEN above THEN sz.size END AS size, "
        "CASE WHEN above THEN round((SELECT avg((longest >= sz.size)::INT) FROM lo), 6) END AS p FROM sz",
    ),
    "stat07_channels_dealt": _dealt("state", "channel"),
    "stat08_states_dealt": _dealt("channel", "state"),
    "stat11_connectivity_test": _with(
        _SURROGATE, "SELECT i, j, round(o.d, 6) AS distance, round(avg((ds.d >= o.d - (1e-9 * o.d + 1e-12))::INT), 6) AS p FROM ds JOIN (SELECT i, j, d FROM ds WHERE perm = 0) o USING (i, j) GROUP BY i, j, o.d"
    ),
    "stat13_chain_gradient": _with(
        "fs AS (SELECT state, count(*) / sum(count(*)) OVER () AS p FROM s WHERE t = 1 GROUP BY 1), os AS (SELECT series_id, state, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS share FROM s WHERE t = 1 GROUP BY 1, 2), "
        "os2 AS (SELECT series_id, i, j, count(*) / sum(count(*)) OVER (PARTITION BY series_id, i) AS share FROM (SELECT * FROM (SELECT series_id, lag(state) OVER (PARTITION BY series_id, segment_id ORDER BY t) AS i, state AS j FROM s) WHERE i IS NOT NULL) GROUP BY 1, 2, 3)",
        "SELECT series_id, 'start_' || state AS feature, round(share / p, 6) AS value FROM os JOIN fs USING (state) UNION ALL SELECT series_id, 'step_' || i || '_' || j, round(share / p, 6) FROM os2 JOIN trans USING (i, j)",
    ),
    "spec05_state_spectra": _with(_MAR_STATE, "SELECT state, f, round(v / (1 - 2 * b1 * cos(2 * pi() * f) + b1 * b1), 6) AS psd FROM vq, (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.4)) q(f)"),
    "spec14_directed": _closed_form(),
}
