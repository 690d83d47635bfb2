"""Queries over statistics, decoding, spectra, training and simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import decode_task as dec
from tidemark.operators import dynamics as d
from tidemark.operators import pairs, simulate, spectra, stats, train
from tidemark.operators import preprocess as pre
from tidemark.plans.dynamics import _r
from tidemark.plans.tables import SQL, K, gamma, long, observations, path, samples, sql, suppliers
from tidemark.session import table

BETA = ((1, 0, 0.5), (1, 1, 1.5), (2, 0, -0.25), (2, 1, 2.0), (3, 0, 0.0), (3, 1, 0.75), (4, 0, 1.0), (4, 1, -1.0), (5, 0, 0.1), (5, 1, 0.2))


def _tests(s, p) -> DataFrame:
    """Shares of transitions in the place of p-values."""
    return d.transitions(path(s, p)).select("i", "j", "p")


def _state_spectra(s, p) -> DataFrame:
    bins = samples(s, p).groupBy("state", F.floor(F.col("x1") / 10).cast("double").alias("f")).agg(F.avg("x3").alias("value"))
    return bins.select("state", "f", F.lit(1).alias("i"), "value")


def _scored(s, p) -> DataFrame:
    """Purchases as labels, the value rounded to whole numbers as score: many ties."""
    return samples(s, p).select("series_id", F.round("x1").alias("score"), (F.col("state") == 3).cast("int").alias("label"))


def _logits(s, p) -> DataFrame:
    base = samples(s, p).select("series_id", "segment_id", "t", "x1", "x2", "x3")
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("logit")) for a, b, v in ((1, 2, F.col("x2") - 2), (1, 3, F.col("x3") / 4 - 1), (2, 3, F.col("x1") / 20 - 1))]
    return base.select("series_id", "segment_id", "t", F.inline(F.array(*cells)))


def _r2(s, p) -> DataFrame:
    wide = samples(s, p)
    betas = dec.regression_by_time(wide, ["x2"], "x1")
    return dec.r_squared(dec.predicted_by_time(wide.withColumn("y", F.col("x1")), ["x2"], betas))


def _centred(s, p) -> DataFrame:
    """Predictions of x1 less 40 at each time."""
    wide = samples(s, p).withColumn("y", F.col("x1") - 40)
    return dec.predicted_by_time(wide, ["x2"], dec.regression_by_time(wide, ["x2"], "y"))


def _measures(s, p) -> tuple[DataFrame, DataFrame]:
    """Occupancies of each state per user, and users labelled by the median of their mean value."""
    fo = d.fractional_occupancy(gamma(s, p)).select("series_id", "state", F.col("fo").alias("value"))
    users = samples(s, p).groupBy("series_id").agg(F.avg("x1").alias("target"))
    middle = users.agg(F.percentile("target", F.lit(0.5)).alias("middle"))
    return users.join(F.broadcast(middle)).select("series_id", "target", (F.col("target") > F.col("middle")).cast("int").alias("label")), fo


def _difference(s, p) -> DataFrame:
    units, fo = _measures(s, p)
    return _r(stats.difference_test(units, fo, "series_id", "label", 200, ["state"], 1), "observed", "p")


def _correlation(s, p) -> DataFrame:
    units, fo = _measures(s, p)
    return _r(stats.correlation_test(units, fo, "series_id", "target", 200, ["state"], 1), "observed", "p")


def _hmm(s, p) -> DataFrame:
    model = train.fit(observations(s, p).select("series_id", "segment_id", "t", F.array(F.col("x")[1], F.col("x")[2]).alias("x")), k=3, cycles=15, seed=1)
    return s.createDataFrame(model.rows(), "state int, param string, i int, j int, value double")


def _hmm_gamma(s, p) -> DataFrame:
    x = observations(s, p).select("series_id", "segment_id", "t", F.array(F.col("x")[1], F.col("x")[2]).alias("x"))
    return train.decode(x, train.fit(x, k=2, cycles=8, seed=1))


def _dual(s, p) -> DataFrame:
    x = observations(s, p).select("series_id", "segment_id", "t", F.array(F.col("x")[1], F.col("x")[2]).alias("x"))
    return train.dual_estimates(x, train.fit(x, k=2, cycles=8, seed=1))


def _stochastic(s, p) -> DataFrame:
    x = observations(s, p).select("series_id", "segment_id", "t", F.array(F.col("x")[1], F.col("x")[2]).alias("x"))
    model = train.fit_stochastic(x, batch=50, k=2, cycles=8, seed=1)
    return s.createDataFrame(model.rows(), "state int, param string, i int, j int, value double")


def _supplier_arrays(s, p) -> DataFrame:
    return suppliers(s, p).select("series_id", "segment_id", "t", F.array("x1", "x2", "x3").alias("x"))


def _price(s, p) -> DataFrame:
    return suppliers(s, p).select("series_id", "segment_id", "t", F.lit(1).alias("channel"), F.col("x2").alias("value"))


def _occupancies(s, p) -> list[float]:
    found = dict(path(s, p).groupBy("state").count().collect())
    return [found.get(k, 0) / sum(found.values()) for k in range(1, K + 1)]


QUERIES = {
    "stat09_benjamini_hochberg": lambda s, p: _r(stats.benjamini_hochberg(_tests(s, p), ["i"]), "p", "q"),
    "stat10_significance": lambda s, p: _r(stats.significant(_tests(s, p), 0.2), "p"),
    "stat17_deconfound": lambda s, p: _r(
        stats.deconfound(table(s, p, "customer").select("c_custkey", F.col("c_acctbal").alias("y"), F.col("c_nationkey").cast("double").alias("n")), "y", ["n"], 0.0)[0].select("c_custkey", "y"), "y"
    ),
    "stat25_one_hot": lambda s, p: stats.class_columns(table(s, p, "embeddings").select("vec_id", "label"), "label", list(range(10))).select("vec_id", F.array_join("onehot", "").alias("onehot")),
    "stat26_class_label": lambda s, p: stats.class_label(stats.class_columns(table(s, p, "embeddings").select("vec_id", F.col("label").alias("l")), "l", list(range(10))), list(range(10))).select("vec_id", "label"),
    "stat04_difference_test": _difference,
    "stat02_correlation_test": _correlation,
    "stat24_folds": lambda s, p: stats.folds(table(s, p, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey", 5, stratify="c_mktsegment"),
    "dec25_mean_gamma": lambda s, p: _r(dec.mean_gamma(gamma(s, p)), "p"),
    "dec09_mixed_coefficients": lambda s, p: _r(dec.mixed_coefficients(dec.mean_gamma(gamma(s, p)), s.createDataFrame(BETA, "state int, term int, beta double")), "beta"),
    "dec29_class_scores": lambda s, p: _r(dec.class_scores(_logits(s, p), ["series_id", "segment_id", "t"]), "p"),
    "dec07_auc": lambda s, p: _r(dec.auc(_scored(s, p), ["series_id"]), "auc"),
    "dec02_r_squared_by_time": lambda s, p: _r(_r2(s, p), "r2"),
    "dec15_regression_by_time": lambda s, p: _r(dec.regression_by_time(samples(s, p), ["x2"], "x1"), "beta"),
    "dec15_scores": lambda s, p: _r(dec.scores(_centred(s, p)), "r", "accuracy"),
    "dec15_generalisation": lambda s, p: _r(dec.generalisation(samples(s, p).filter("t <= 12"), ["x2"], "x1"), "r2"),
    "dec15_cross_validated": lambda s, p: dec.cross_validated(samples(s, p).withColumn("fold", (F.col("series_id") % 4).cast("int")), ["x2", "x3"], "x1"),
    "spec03_frequency_grid": lambda s, p: _r(spectra.frequency_grid(s, 200.0, 256, 1.0, 90.0), "f"),
    "spec09_time_frequency": lambda s, p: _r(spectra.time_frequency(gamma(s, p), _state_spectra(s, p)), "value"),
    "spec18_sum_of_squares": lambda s, p: _r(spectra.sum_of_squares(long(s, p), ["series_id", "channel"]).withColumn("value", F.col("value") / 1000), "value"),
    "spec02_multitaper": lambda s, p: spectra.multitaper(_supplier_arrays(s, p), 64, 1.0),
    "spec08_phase_locking": lambda s, p: spectra.phase_locking(_supplier_arrays(s, p)),
    "spec08_phase_locking_by_state": lambda s, p: spectra.phase_locking(observations(s, p), gamma(s, p)),
    "spec13_jackknife": lambda s, p: spectra.jackknife(long(s, p).groupBy("segment_id", "channel").agg(F.avg("value").alias("value")), ["channel"]),
    "pre03_band_filter": lambda s, p: pre.band_filter(_price(s, p), (0.0, 0.1), 1.0),
    "pre05_envelope": lambda s, p: pre.envelope(_price(s, p)),
    "pre06_leading_phases": lambda s, p: pre.leading_phases(_supplier_arrays(s, p)),
    "pre13_resample": lambda s, p: pre.resample(_price(s, p), 2, 3),
    "train08_sequential_states": lambda s, p: path(s, p).select(
        "series_id", "segment_id", "t", F.ceil(K * F.col("t") / F.count("*").over(Window.partitionBy("series_id", "segment_id"))).cast("int").alias("state")
    ),
    "train39_edit_distance": lambda s, p: table(s, p, "customer").select("c_mktsegment").distinct().select("c_mktsegment", F.levenshtein("c_mktsegment", F.lit("MACHINES")).alias("distance")),
    "train42_mean_life_time": lambda s, p: _r(
        d.transitions(path(s, p)).filter("i = j").select(F.col("i").alias("state"), (1 - (F.col("p") - 1) / F.pow(F.log("p"), F.lit(2.0))).alias("life_time")), "life_time"
    ),
    "train02_fit_chain": _hmm,
    "train12_fit_stochastic": _stochastic,
    "train19_dual_estimates": _dual,
    "win15_infer_chain": _hmm_gamma,
    "agg05_dirichlet_counts": lambda s, p: d.transitions(path(s, p)).select("i", "j", (F.col("n") + F.when(F.col("i") == F.col("j"), 10.0).otherwise(1.0)).alias("alpha")),
    "viz15_node_strength": lambda s, p: _r(
        pairs.static_connectivity(long(s, p)).select("series_id", F.explode(F.array("i", "j")).alias("node"), F.greatest("r", F.lit(0.0)).alias("w")).groupBy("series_id", "node").agg(F.sum("w").alias("strength")), "strength"
    ),
    "win07_surrogate_path": lambda s, p: simulate.surrogate_path(d.visits(path(s, p)), _occupancies(s, p)),
    "sim01_state_paths": lambda s, p: simulate.paths(simulate.segment_grid(s, 20, 3, 100), [[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5]),
    "sim02_gaussian_series": lambda s, p: simulate.gaussian_series(simulate.segment_grid(s, 20, 3, 100), [[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5], [[0, 0], [3, 1]], [[[1, 0.3], [0.3, 1]]] * 2),
    "sim03_autoregressive_series": lambda s, p: simulate.autoregressive_series(simulate.segment_grid(s, 20, 3, 100), [[[0.5, 0.1], [0.0, 0.4]]], [[1, 0], [0, 1]], [1]),
}

_TESTS = "tests AS (SELECT i, j, p FROM trans)"
_EDGES = "edges AS (SELECT a.series_id, a.channel AS i, b.channel AS j, corr(a.value, b.value) AS r FROM o a JOIN o b USING (series_id, segment_id, t) WHERE a.channel < b.channel GROUP BY 1, 2, 3)"
# Ridge regression of x1 on x2 at each time: 1e-4 on the diagonal of the two normal equations.
_BY_TIME = (
    "q AS (SELECT t, count(*) + 1e-4::DOUBLE AS n, sum(x2) AS sx, sum(x2 * x2) + 1e-4::DOUBLE AS sxx, sum(x1) AS sy, sum(x1 * x2) AS sxy FROM s GROUP BY 1), "
    "bt AS (SELECT t, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM q)"
)
_SPEC = "sp AS (SELECT state, floor(x1 / 10) AS f, avg(x3) AS value FROM s GROUP BY 1, 2)"
_BETA = "beta(state, term, beta) AS (VALUES " + ", ".join(f"({a}, {b}, {c}::DOUBLE)" for a, b, c in BETA) + ")"
_LOGIT = (
    "lg AS (SELECT series_id, segment_id, t, c, sum(-ln(1 + exp(-v))) AS l FROM (SELECT series_id, segment_id, t, unnest([1, 2, 1, 3, 2, 3]) AS c, "
    "unnest([x2 - 2, 2 - x2, x3 / 4 - 1, 1 - x3 / 4, x1 / 20 - 1, 1 - x1 / 20]) AS v FROM s) GROUP BY 1, 2, 3, 4)"
)


def _with(extra: str, query: str) -> str:
    return f"WITH {SQL}, {extra} {query}"


# Units dealt anew 200 times, in the order of MD5 of unit, permutation and seed 1; permutation 0 is the data.
_PERM = (
    "fo AS (SELECT series_id, state, sum(p) / sum(sum(p)) OVER (PARTITION BY series_id) AS value FROM g GROUP BY series_id, state), "
    "un AS (SELECT series_id, target, (target > median(target) OVER ())::INT AS label FROM (SELECT series_id, avg(x1) AS target FROM s GROUP BY 1)), "
    "pl AS (SELECT perm, un.*, row_number() OVER (PARTITION BY perm ORDER BY series_id) AS home, "
    "row_number() OVER (PARTITION BY perm ORDER BY CASE WHEN perm > 0 THEN md5(series_id || ':' || perm || ':1') END, series_id) AS place FROM un, range(0, 201) r(perm)), "
    "dl AS (SELECT a.perm, a.series_id, b.label, b.target FROM pl a JOIN pl b ON a.perm = b.perm AND a.home = b.place)"
)
ORACLES = {
    "stat04_difference_test": _with(
        _PERM + ", st AS (SELECT perm, state, avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0) AS d FROM dl JOIN fo USING (series_id) GROUP BY 1, 2), "
        "sd AS (SELECT state, CASE WHEN d > 0 THEN 1 ELSE -1 END AS side, abs(d) AS observed FROM st WHERE perm = 0)",
        "SELECT state, side, round(observed, 6) AS observed, round(avg((d * side >= observed - (1e-9 * observed + 1e-12))::INT), 6) AS p FROM st JOIN sd USING (state) GROUP BY 1, 2, 3",
    ),
    "stat02_correlation_test": _with(
        _PERM + ", st AS (SELECT perm, state, corr(value, target) ** 2 AS d FROM dl JOIN fo USING (series_id) GROUP BY 1, 2), ob AS (SELECT state, d AS observed FROM st WHERE perm = 0)",
        "SELECT state, round(observed, 6) AS observed, round(avg((d >= observed - (1e-9 * observed + 1e-12))::INT), 6) AS p FROM st JOIN ob USING (state) GROUP BY 1, 2",
    ),
    "stat24_folds": "SELECT c_custkey, c_nationkey, c_mktsegment, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':0')[1:12], c_custkey) - 1) % 5 + 1)::INT AS fold FROM customer",
    "win07_surrogate_path": _with(
        "sh AS (SELECT state, sum(count(*)) OVER (ORDER BY state) / sum(count(*)) OVER () AS top FROM s GROUP BY 1), "
        "dr AS (SELECT *, ('0x' || substr(md5(series_id || ':' || segment_id || ':' || start_t || ':0'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM runs)",
        "SELECT series_id, segment_id, start_t, end_t, length, is_last, (SELECT min(state) FROM sh WHERE u < top OR state = 5)::INT AS state FROM dr",
    ),
    "stat09_benjamini_hochberg": _with(
        _TESTS,
        "SELECT i, j, round(p, 6) AS p, round(least(1, min(p * n / r) OVER (PARTITION BY i ORDER BY r DESC)), 6) AS q FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY p) AS r, count(*) OVER (PARTITION BY i) AS n FROM tests)",
    ),
    "stat10_significance": _with(_TESTS, "SELECT i, j, round(p, 6) AS p, p < 0.2 AS significant FROM tests"),
    "stat17_deconfound": "SELECT c_custkey, round(c_acctbal - a - b * c_nationkey, 6) AS y FROM customer, (SELECT regr_intercept(c_acctbal, c_nationkey) AS a, regr_slope(c_acctbal, c_nationkey) AS b FROM customer)",
    "stat25_one_hot": "SELECT vec_id, string_agg((label = k)::INT::VARCHAR, '' ORDER BY k) AS onehot FROM embeddings, range(0, 10) r(k) GROUP BY 1",
    "stat26_class_label": "SELECT vec_id, label FROM embeddings",
    "dec25_mean_gamma": sql("SELECT t, state, round(avg(p), 6) AS p FROM g GROUP BY 1, 2"),
    "dec09_mixed_coefficients": _with(_BETA, "SELECT t, term, round(sum(m * beta), 6) AS beta FROM (SELECT t, state, avg(p) AS m FROM g GROUP BY 1, 2) JOIN beta USING (state) GROUP BY 1, 2"),
    "dec29_class_scores": _with(_LOGIT, "SELECT series_id, segment_id, t, c AS class, round(exp(l) / sum(exp(l)) OVER (PARTITION BY series_id, segment_id, t), 6) AS p FROM lg"),
    "dec07_auc": _with(
        "z AS (SELECT series_id, round(x1) AS score, state = 3 AS label FROM s)",
        "SELECT series_id, round(sum(CASE WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0 END) / count(a), 6)::DOUBLE AS auc FROM (SELECT u.series_id, u.score AS a, v.score AS b FROM z u JOIN z v "
        "ON u.series_id = v.series_id AND u.label AND NOT v.label) GROUP BY 1",
    ),
    "dec02_r_squared_by_time": _with(_BY_TIME, "SELECT t, round(1 - avg((x1 - b0 - b1 * x2) ** 2) / nullif(var_pop(x1), 0), 6) AS r2 FROM s JOIN bt USING (t) GROUP BY 1"),
    "dec15_regression_by_time": _with(
        _BY_TIME, "SELECT t, unnest([0, 1]) AS term, round(unnest([b0, b1]), 6) AS beta FROM bt"
    ),
    "dec15_scores": _with(
        _BY_TIME.replace("x1", "(x1 - 40)"),
        "SELECT t, round(corr(x1 - 40, b0 + b1 * x2), 6) AS r, round(avg(((x1 - 40 >= 0) = (b0 + b1 * x2 >= 0))::INT), 6) AS accuracy FROM s JOIN bt USING (t) GROUP BY 1",
    ),
    "dec15_generalisation": _with(
        "sm AS (SELECT t, count(*) AS n, sum(x2) AS sx, sum(x2 * x2) AS sxx, sum(x1) AS sy, sum(x1 * x2) AS sxy, sum(x1 * x1) AS syy FROM s WHERE t <= 12 GROUP BY 1), "
        "bb AS (SELECT t, ((sxx + 1e-4) * sy - sx * sxy) / ((n + 1e-4) * (sxx + 1e-4) - sx * sx) AS b0, ((n + 1e-4) * sxy - sx * sy) / ((n + 1e-4) * (sxx + 1e-4) - sx * sx) AS b1 FROM sm)",
        "SELECT bb.t AS train_t, sm.t AS test_t, round(1 - (syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx) / (syy - sy * sy / n), 6) AS r2 FROM bb, sm",
    ),
    "spec03_frequency_grid": "SELECT i::INT AS \"index\", round(i * 200.0 / 256, 6)::DOUBLE AS f FROM range(0, 129) r(i) WHERE i * 200.0 / 256 BETWEEN 1 AND 90",
    "spec09_time_frequency": _with(
        _SPEC, "SELECT t, f, 1 AS i, round(sum(m * value), 6) AS value FROM (SELECT t, state, avg(p) AS m FROM g GROUP BY 1, 2) JOIN sp USING (state) GROUP BY 1, 2"
    ),
    "spec18_sum_of_squares": sql("SELECT series_id, channel, round(sum(value * value) / 1000, 6) AS value FROM o GROUP BY 1, 2"),
    "train08_sequential_states": sql("SELECT series_id, segment_id, t, ((5 * t + n - 1) // n)::INT AS state FROM (SELECT *, count(*) OVER (PARTITION BY series_id, segment_id) AS n FROM s)"),
    "train39_edit_distance": "SELECT DISTINCT c_mktsegment, levenshtein(c_mktsegment, 'MACHINES')::INT AS distance FROM customer",
    "train42_mean_life_time": sql("SELECT i AS state, round(1 - (p - 1) / ln(p) ** 2, 6) AS life_time FROM trans WHERE i = j"),
    "agg05_dirichlet_counts": sql("SELECT i, j, (n + CASE WHEN i = j THEN 10 ELSE 1 END)::DOUBLE AS alpha FROM trans"),
    "viz15_node_strength": _with(_EDGES, "SELECT series_id, node, round(sum(greatest(r, 0)), 6) AS strength FROM (SELECT series_id, r, unnest([i, j]) AS node FROM edges) GROUP BY 1, 2"),
}
