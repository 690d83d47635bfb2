"""Queries over divergences, expected likelihoods, seeded draws, state models and soft visits."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.functions.special import kl_normal, kl_wishart
from tidemark.operators import divergence as v
from tidemark.operators import dynamics as d
from tidemark.operators import moments as m
from tidemark.operators import pairs as j
from tidemark.operators import state_models as sm
from tidemark.operators import train
from tidemark.plans.dynamics import _r
from tidemark.plans.tables import SQL, K, gamma, long, observations, path, samples, sql
from tidemark.session import table

LOADING = ((0.8, 0.6), (-0.6, 0.8))
WEIGHTS = ((0.4, -0.2), (0.1, 0.3))
MEANS, SDS = (1.0, 2.0, 3.0, 4.0, 5.0), (0.5, 1.0, 1.5, 2.0, 2.5)
LIFE_TIMES = (2.0, 5.0, 20.0, 100.0)


def _series_counts(s, p) -> DataFrame:
    """Steps of each series and state pair, with one added, against a hundredth of all series' with ten added on the diagonal."""
    steps = d.series_transitions(path(s, p))
    every = steps.groupBy("i", "j").agg(F.sum("n").alias("all"))
    return steps.join(every, ["i", "j"]).select(
        "series_id", "i", "j", (F.col("n") + 1.0).alias("q"), (F.col("all") / 100 + F.when(F.col("i") == F.col("j"), 10.0).otherwise(1.0)).alias("p")
    )


def _shapes(s, p) -> DataFrame:
    """Shape and rate of a series' values beside those of all."""
    own = samples(s, p).groupBy("series_id").agg((F.count("*") + 1.0).alias("a"), (F.sum("x1") + 1).alias("b"), F.count_if(F.col("state") == 3).alias("buys"), F.count("*").alias("n"))
    whole = samples(s, p).agg((F.count("*") / 100 + 1).alias("a0"), (F.sum("x1") / 100 + 1).alias("b0"))
    return own.join(F.broadcast(whole))


def _two(s, p, by) -> DataFrame:
    return v.covariances(samples(s, p), ["x2", "x3"], by)


def _against_all(s, p) -> DataFrame:
    own = _two(s, p, ["series_id"]).filter("n > 3")
    whole = _two(s, p, []).select(F.col("mean").alias("mean0"), F.col("cov").alias("cov0"))
    return own.join(F.broadcast(whole))


def _state_pairs(s, p) -> DataFrame:
    one = _two(s, p, ["state"])
    a, b = (one.select(F.col("state").alias(x), F.col("n").alias(f"n{x}"), F.col("cov").alias(f"c{x}")) for x in ("i", "j"))
    return a.join(b, F.col("i") < F.col("j"))


def _state_wishart(s, p) -> DataFrame:
    measure = lambda na, ca, nb, cb: v.wishart_symmetric(na / 2, ca * na / 2, nb / 2, cb * nb / 2)
    return v.measured(_state_pairs(s, p), ["i", "j"], ["ni", "ci", "nj", "cj"], measure)


def _stationary(s, p) -> DataFrame:
    matrix = np.zeros((K, K))
    for r in d.transitions(path(s, p)).collect():  # K * K rows
        matrix[r.i - 1, r.j - 1] = r.p
    return s.createDataFrame([(k + 1, float(x)) for k, x in enumerate(v.stationary(matrix))], "state int, p double")


def _path_likelihood(s, p) -> DataFrame:
    steps = d.series_transitions(path(s, p))
    starts = path(s, p).filter("t = 1").groupBy("series_id", "state").agg(F.count("*").alias("n"))
    alpha = d.transitions(path(s, p)).select("i", "j", (F.col("n") + 1.0).alias("alpha"))
    start_alpha = path(s, p).filter("t = 1").groupBy("state").agg((F.count("*") + 1.0).alias("alpha"))
    return v.expected_path_likelihood(starts, steps, alpha, start_alpha, ["series_id"])


def _logistic(s, p) -> DataFrame:
    """Class labels of purchases with a fixed line over x2, x3 as logit and a fixed spread."""
    x = samples(s, p).select("series_id", "segment_id", "t", F.array(F.lit(1.0), "x2", "x3").alias("x"), F.when(F.col("state") == 3, 1.0).otherwise(-1.0).alias("y"))
    mean = F.array(*(F.lit(w) for w in (0.5, -0.3, 0.05)))
    second = F.array(*(F.lit(float(0.01 * (a == b) + u * w)) for a, u in enumerate((0.5, -0.3, 0.05)) for b, w in enumerate((0.5, -0.3, 0.05))))
    return sm.logistic_points(x.select("*", mean.alias("mean"), second.alias("second")))


def _state_means(s, p) -> DataFrame:
    return sm.projected_means(sm.state_means(_soft(s, p), ["x2", "x3"], F.col("p")), LOADING)


def _soft(s, p) -> DataFrame:
    return gamma(s, p).join(samples(s, p).drop("state"), ["series_id", "segment_id", "t"])


def _mar_by_state(s, p) -> DataFrame:
    before = m.lagged(samples(s, p).drop("state"), ["x2"], [1])[0]
    return sm.regression_by_state(gamma(s, p).join(before, ["series_id", "segment_id", "t"]), ["x2_1"], "x2", F.col("p"))


def _stability(s, p) -> DataFrame:
    before = m.lagged(samples(s, p), ["x2"], [1])[0]
    return sm.stability(sm.regression_by_state(before, ["x2_1"], "x2", F.lit(1.0), ["series_id"]).filter("term > 0"), ["series_id"])


def _measures(s, p):
    from tidemark.plans.tasks import _measures as found

    return found(s, p)


def _noise(s, p) -> DataFrame:
    return sm.gaussian_noise(gamma(s, p), MEANS, SDS, seed=7)


def _groups(s, p) -> DataFrame:
    return sm.random_groups(table(s, p, "customer").select("c_custkey"), "c_custkey", 7, seed=3)


def _lagged_products(s, p) -> DataFrame:
    return sm.autocovariances(long(s, p), 3)


def _chain_matrix(s, p) -> DataFrame:
    x = observations(s, p).select("series_id", "segment_id", "t", F.array(F.col("x")[1], F.col("x")[2]).alias("x"))
    return v.divergence_matrix(train.dual_estimates(x, train.fit(x, k=2, cycles=8, seed=1)), 2, 2)


QUERIES = {
    "eval15_dirichlet_kl": lambda s, p: _r(v.dirichlet_divergence(_series_counts(s, p), ["series_id", "i"]), "kl"),
    "eval12_transition_kl": lambda s, p: _r(v.dirichlet_divergence(_series_counts(s, p), ["series_id", "i"]).groupBy("series_id").agg(F.sum("kl").alias("kl")), "kl"),
    "eval16_gamma_kl": lambda s, p: _r(_shapes(s, p).select("series_id", c.kl_gamma(F.col("a"), F.col("b"), F.col("a0"), F.col("b0")).alias("kl")), "kl"),
    "eval17_beta_kl": lambda s, p: _r(_shapes(s, p).select("series_id", c.kl_beta(F.col("buys") + 1.0, F.col("n") - F.col("buys") + 1.0, F.lit(2.0), F.lit(7.0)).alias("kl")), "kl"),
    "eval18_gauss_kl": lambda s, p: _r(v.measured(_against_all(s, p), ["series_id"], ["mean", "cov", "mean0", "cov0"], kl_normal), "value"),
    "eval19_wishart_kl": lambda s, p: _r(
        v.measured(_against_all(s, p), ["series_id"], ["n", "cov", "cov0"], lambda n, a, b: kl_wishart(n / 2, a * n / 2, 10.0, b * 10.0)), "value"
    ),
    "eval20_symmetric_kl": lambda s, p: _state_wishart(s, p).withColumn("value", F.round("value", 3)),
    "eval22_stationary": lambda s, p: _r(_stationary(s, p), "p"),
    "eval23_riemannian": lambda s, p: _r(v.measured(_against_all(s, p), ["series_id"], ["cov", "cov0"], v.riemannian), "value"),
    "eval24_log_determinant": lambda s, p: _r(v.measured(v.covariances(samples(s, p), ["x1", "x2", "x3"], ["state"]), ["state"], ["cov"], v.log_det), "value"),
    "eval29_whitened": lambda s, p: v.measured(_against_all(s, p), ["series_id"], ["cov", "cov0"], v.whitened, "w", "array<double>").select(
        "series_id", F.posexplode(F.transform("w", lambda x: F.round(x, 6))).alias("k", "value")
    ),
    "eval06_path_likelihood": lambda s, p: _r(_path_likelihood(s, p), "value"),
    "eval10_logistic_likelihood": lambda s, p: _r(_logistic(s, p).select("series_id", "segment_id", "t", "likelihood"), "likelihood"),
    "eval31_multinomial": lambda s, p: sm.multinomial(table(s, p, "customer").select("c_custkey"), ["c_custkey"], [0.1, 0.2, 0.3, 0.4], 10, seed=5),
    "eval32_random_groups": _groups,
    "obs18_logistic_point": lambda s, p: _r(_logistic(s, p).select("series_id", "segment_id", "t", "psi"), "psi"),
    "obs26_trace_by_code": lambda s, p: _r(sm.quadratic_by_code(samples(s, p).select("series_id", "segment_id", "t", F.array(F.lit(1.0), F.col("state").cast("double")).alias("x")), [[0.5, 0.1], [0.1, 0.3]]), "trace"),
    "obs29_regression_by_state": lambda s, p: _r(_mar_by_state(s, p), "beta"),
    "agg09_gamma_square": lambda s, p: _r(sm.gamma_square(gamma(s, p)), "p"),
    "agg11_row_products": lambda s, p: sm.row_products(
        samples(s, p).select("series_id", "segment_id", "t", F.array("x2", "x3").alias("a"), F.array(F.array("x1", F.lit(1.0)), F.array(F.lit(2.0), "x2")).alias("b"), (1 / (1 + F.col("x1"))).alias("g"))
    ).select("series_id", "segment_id", "t", F.round(F.col("c")[0], 6).alias("c1"), F.round(F.col("c")[1], 6).alias("c2")),
    "agg22_state_means": lambda s, p: _r(_state_means(s, p), "mean"),
    "agg23_state_connectivity": lambda s, p: _r(sm.connectivity(m.weighted_covariance(_soft(s, p), ["x1", "x2", "x3"], F.col("p"), ["state"]), 3), "r", "partial"),
    "agg24_autocovariance": lambda s, p: _r(_lagged_products(s, p), "c"),
    "agg25_projected_coefficients": lambda s, p: _r(sm.projected_coefficients(s, WEIGHTS, LOADING), "w"),
    "spec06_lagged_spectrum": lambda s, p: _r(sm.spectrum_of_autocovariances(_lagged_products(s, p).filter("i = j"), [0.05, 0.1, 0.2, 0.4]), "psd"),
    "eval09_stability": _stability,
    "train07_left_to_right": lambda s, p: d.left_to_right(d.transitions(path(s, p))),
    "train35_symmetry": lambda s, p: v.measured(_two(s, p, ["state"]), ["state"], ["cov"], v.is_symmetric, "symmetric", "boolean"),
    "train40_diagonal_for_life_time": lambda s, p: s.createDataFrame([(t, float(round(sm.life_time_of(sm.diagonal_for(t, K), K), 6))) for t in LIFE_TIMES], "target double, reached double"),
    "train41_life_time_of_diagonal": lambda s, p: _r(s.range(1, 101).select(F.col("id").alias("diagonal"), sm.life_time_column(F.col("id").cast("double"), K).alias("life_time")), "life_time"),
    "train44_simulated_life_times": lambda s, p: sm.simulated_life_times(s, 10.0, 3, 50, 400, seed=1),
    "win01_soft_life_times": lambda s, p: d.life_times(d.confident_path(gamma(s, p), 0.4)),
    "win03_soft_interval_times": lambda s, p: d.interval_times(d.confident_path(gamma(s, p), 0.4)),
    "sim04_gaussian_noise": lambda s, p: _r(_noise(s, p), "x"),
    "join04_divergence_matrix": _chain_matrix,
    "join14_autocorrelation": lambda s, p: _r(j.lagged_correlation(long(s, p), 3).filter("i = j").select("series_id", "i", "lag", "r"), "r"),
}


def _with(extra: str, query: str) -> str:
    return f"WITH {SQL}, {extra} {query}"


def _psi(x: str) -> str:
    """Digamma of a SQL expression."""
    y = f"(({x}) + 8)"
    down = " + ".join(f"1 / (({x}) + {k}.0)" for k in range(8))
    return f"(ln({y}) - 0.5 / {y} - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) + 1 / (240 * pow({y}, 8)) - 1 / (132 * pow({y}, 10)) - ({down}))"


_COUNTS = (
    "st AS (SELECT series_id, i, j, count(*) AS n FROM steps2 GROUP BY 1, 2, 3), "
    "cn AS (SELECT series_id, st.i, st.j, st.n + 1.0::DOUBLE AS q, trans.n / 100 + CASE WHEN st.i = st.j THEN 10 ELSE 1 END::DOUBLE AS p FROM st JOIN trans USING (i, j)), "
    f"ds AS (SELECT series_id, i, sum(q) AS q, sum(p) AS p, sum(-lgamma(q) + lgamma(p) + (q - p) * {_psi('q')}) AS s FROM cn GROUP BY 1, 2), "
    f"dk AS (SELECT series_id, i, lgamma(q) - lgamma(p) + s - (q - p) * {_psi('q')} AS kl FROM ds)"
)
_STEPS2 = "steps2 AS (SELECT * FROM (SELECT series_id, lag(state) OVER (PARTITION BY series_id, segment_id ORDER BY t) AS i, state AS j FROM s) WHERE i IS NOT NULL)"
_SHAPE = "sh AS (SELECT *, (SELECT count(*) / 100 + 1 FROM s)::DOUBLE AS a0, (SELECT sum(x1) / 100 + 1 FROM s) AS b0 FROM (SELECT series_id, count(*) + 1.0::DOUBLE AS a, sum(x1) + 1 AS b, count(*) FILTER (state = 3) AS buys, count(*) AS n FROM s GROUP BY 1))"
_ALL = (
    "z AS (SELECT avg(x2) AS m2, avg(x3) AS m3, var_pop(x2) AS b11, covar_pop(x2, x3) AS b12, var_pop(x3) AS b22 FROM s), "
    "own AS (SELECT series_id, count(*) AS n, avg(x2) AS u2, avg(x3) AS u3, var_pop(x2) AS a11, covar_pop(x2, x3) AS a12, var_pop(x3) AS a22 FROM s GROUP BY 1 HAVING count(*) > 3), "
    "aa AS (SELECT *, a11 * a22 - a12 * a12 AS da, b11 * b22 - b12 * b12 AS db, (a11 * b22 - 2 * a12 * b12 + a22 * b11) / (b11 * b22 - b12 * b12) AS tr FROM own, z)"
)
_SOFT = "soft AS (SELECT g.series_id, g.segment_id, g.t, g.state, p, x1, x2, x3 FROM g JOIN s USING (series_id, segment_id, t))"


def _uniform(*keys: str, seed: int) -> str:
    text = " || ':' || ".join([*(f"({k})::VARCHAR" for k in keys), f"'{seed}'"])
    return f"(('0x' || substr(md5({text}), 1, 12))::BIGINT / {float(1 << 48)!r}::DOUBLE)"


def _wishart(aq: str, detq: str, ap: str, detp: str, trace: str) -> str:
    """Divergence of 2-by-2 Wisharts of shapes aq and ap, log-determinants of the rates and trace(rate_p rate_q^-1)."""
    norm = lambda a, ld: f"({a} * {ld} - (0.5 * ln(pi()) + lgamma({a}) + lgamma({a} - 0.5)))"
    mean_log = f"({_psi(aq)} + {_psi(aq + ' - 0.5')} - {detq})"
    return f"({norm(aq, detq)} - {norm(ap, detp)} + ({aq} - {ap}) * {mean_log} - (2 * {aq} - {aq} * {trace}))"


_W = "(n / 2.0)", "(ln(da) + 2 * ln(n / 2.0))", "10.0", "(ln(db) + 2 * ln(10.0))"
_STATE_W = (
    "sw AS (SELECT state, count(*) AS n, var_pop(x2) AS a, covar_pop(x2, x3) AS b, var_pop(x3) AS c FROM s GROUP BY 1), "
    "pw AS (SELECT x.state AS i, y.state AS j, x.n / 2.0 AS na, y.n / 2.0 AS nb, ln(x.a * x.c - x.b * x.b) + 2 * ln(x.n / 2.0) AS la, ln(y.a * y.c - y.b * y.b) + 2 * ln(y.n / 2.0) AS lb, "
    "(y.a * x.c - 2 * x.b * y.b + y.c * x.a) / (x.a * x.c - x.b * x.b) * y.n / x.n AS ta, (x.a * y.c - 2 * x.b * y.b + x.c * y.a) / (y.a * y.c - y.b * y.b) * x.n / y.n AS tb FROM sw x JOIN sw y ON x.state < y.state)"
)
# The states of probability above 0.4, one at most, and their runs.
_CONF = (
    "cf AS (SELECT series_id, segment_id, t, max(CASE WHEN p > 0.4 THEN state END) AS state FROM g GROUP BY 1, 2, 3), "
    "cr AS (SELECT series_id, segment_id, state, min(t) AS start_t, max(t) AS end_t, count(*) AS length, run = max(run) OVER (PARTITION BY series_id, segment_id) AS is_last, "
    "sum(count(*)) OVER (PARTITION BY series_id, segment_id) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY series_id, segment_id ORDER BY t) AS run FROM "
    "(SELECT *, CASE WHEN lag(state) OVER (PARTITION BY series_id, segment_id ORDER BY t) = state THEN 0 ELSE 1 END AS c FROM cf)) GROUP BY series_id, segment_id, state, run)"
)
_LIFE = "(1 - (p - 1) / ln(p) ** 2)"
_GROUP_SQL = f"(SELECT c_custkey, row_number() OVER (ORDER BY {_uniform('c_custkey', seed=3)}, c_custkey) AS r, (SELECT count(*) FROM customer) AS n FROM customer)"
_Z = f"sqrt(-2 * ln(1 - {_uniform('series_id', 'segment_id', 't', 'state', '1', seed=7)})) * cos(2 * pi() * {_uniform('series_id', 'segment_id', 't', 'state', '2', seed=7)})"
_AUTO = (
    "ac AS (SELECT a.channel AS i, b.channel AS j, (b.t - a.t)::INT AS lag, covar_pop(a.value, b.value) AS c FROM o a JOIN o b ON a.series_id = b.series_id AND a.segment_id = b.segment_id "
    "AND b.t - a.t BETWEEN 0 AND 3 GROUP BY 1, 2, 3)"
)
_LOGIT = "lg AS (SELECT series_id, segment_id, t, 0.5 - 0.3 * x2 + 0.05 * x3 AS l, CASE WHEN state = 3 THEN 1 ELSE -1 END AS y, sqrt(0.01 * (1 + x2 * x2 + x3 * x3) + (0.5 - 0.3 * x2 + 0.05 * x3) ** 2) AS psi FROM s)"
_CUMULATIVE = (0.1, 0.1 + 0.2, 0.1 + 0.2 + 0.3)

ORACLES = {
    "eval15_dirichlet_kl": _with(f"{_STEPS2}, {_COUNTS}", "SELECT series_id, i, round(kl, 6) AS kl FROM dk"),
    "eval12_transition_kl": _with(f"{_STEPS2}, {_COUNTS}", "SELECT series_id, round(sum(kl), 6) AS kl FROM dk GROUP BY 1"),
    "eval16_gamma_kl": _with(_SHAPE, f"SELECT series_id, round((a - a0) * {_psi('a')} - lgamma(a) + lgamma(a0) + a0 * (ln(b) - ln(b0)) + a * (b0 - b) / b, 6) AS kl FROM sh"),
    "eval17_beta_kl": _with(
        _SHAPE,
        f"SELECT series_id, round(lgamma(2) + lgamma(7) - lgamma(9) + lgamma(n + 2) - lgamma(buys + 1) - lgamma(n - buys + 1) + (buys + 1 - 2) * {_psi('buys + 1')} + (n - buys + 1 - 7) * {_psi('n - buys + 1')} "
        f"+ (9 - (n + 2)) * {_psi('n + 2')}, 6) AS kl FROM sh",
    ),
    "eval18_gauss_kl": _with(
        _ALL, "SELECT series_id, round(0.5 * (ln(db) - ln(da) - 2 + tr + ((u2 - m2) ** 2 * b22 - 2 * (u2 - m2) * (u3 - m3) * b12 + (u3 - m3) ** 2 * b11) / db), 6) AS value FROM aa"
    ),
    "eval19_wishart_kl": _with(_ALL, f"SELECT series_id, round({_wishart(*_W, '((b11 * a22 - 2 * a12 * b12 + b22 * a11) / da * 20.0 / n)')}, 6) AS value FROM aa"),
    "eval20_symmetric_kl": _with(_STATE_W, f"SELECT i, j, round(0.5 * {_wishart('na', 'la', 'nb', 'lb', 'ta')} + 0.5 * {_wishart('nb', 'lb', 'na', 'la', 'tb')}, 3) AS value FROM pw"),
    "eval22_stationary": f"WITH RECURSIVE {SQL}, v AS (SELECT 0 AS it, k::INT AS k, 0.2::DOUBLE AS p FROM range(1, 6) r(k) UNION ALL SELECT it + 1, j, sum(v.p * trans.p) FROM v JOIN trans ON trans.i = v.k WHERE it < 100 GROUP BY it, j) "
    "SELECT k AS state, round(p, 6) AS p FROM v WHERE it = 100",
    "eval23_riemannian": _with(_ALL, "SELECT series_id, round(sqrt(ln((tr + sqrt(tr * tr - 4 * da / db)) / 2) ** 2 + ln((tr - sqrt(tr * tr - 4 * da / db)) / 2) ** 2), 6) AS value FROM aa"),
    "eval24_log_determinant": _with(
        "k AS (SELECT state, var_pop(x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x1, x3) AS c, var_pop(x2) AS e, covar_pop(x2, x3) AS f, var_pop(x3) AS i FROM s GROUP BY 1)",
        "SELECT state, round(ln(a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c)), 6) AS value FROM k",
    ),
    # The root of a 2-by-2 matrix is (A + sqrt(det) I) / sqrt(trace + 2 sqrt(det)).
    "eval29_whitened": _with(
        _ALL + ", rt AS (SELECT *, sqrt(db) AS sd, sqrt(b11 + b22 + 2 * sqrt(db)) AS tt FROM aa), iv AS (SELECT *, (b22 + sd) / (tt * sd) AS p, -b12 / (tt * sd) AS q, (b11 + sd) / (tt * sd) AS r FROM rt), "
        "h AS (SELECT *, p * a11 + q * a12 AS e, p * a12 + q * a22 AS f, q * a11 + r * a12 AS g0, q * a12 + r * a22 AS h0 FROM iv)",
        "SELECT series_id, unnest([0, 1, 2, 3])::INT AS k, round(unnest([e * p + f * q, e * q + f * r, g0 * p + h0 * q, g0 * q + h0 * r]), 6) AS value FROM h",
    ),
    "eval06_path_likelihood": _with(
        f"{_STEPS2}, ps AS (SELECT i, j, {_psi('n + 1')} - {_psi('t')} AS psi FROM (SELECT *, sum(n + 1) OVER (PARTITION BY i) AS t FROM trans)), "
        f"fs AS (SELECT state, {_psi('n + 1')} - {_psi('t')} AS psi FROM (SELECT state, count(*) AS n, sum(count(*) + 1) OVER () AS t FROM s WHERE t = 1 GROUP BY 1))",
        "SELECT series_id, round(sum(v), 6) AS value FROM (SELECT series_id, psi AS v FROM steps2 JOIN ps USING (i, j) UNION ALL SELECT series_id, psi FROM s JOIN fs USING (state) WHERE t = 1) GROUP BY 1",
    ),
    "eval10_logistic_likelihood": _with(
        _LOGIT, "SELECT series_id, segment_id, t, round(-ln(1 + exp(-psi)) + (y * l - psi) / 2 - (1 / (1 + exp(-psi)) - 0.5) / (2 * psi) * (psi * psi - psi * psi), 6) AS likelihood FROM lg"
    ),
    "eval31_multinomial": "SELECT c_custkey, k::INT AS k, count(*) FILTER (c = k) AS n FROM (SELECT c_custkey, CASE "
    + " ".join(f"WHEN u < {x!r}::DOUBLE THEN {k}" for k, x in enumerate(_CUMULATIVE, 1))
    + f" ELSE 4 END AS c FROM (SELECT c_custkey, {_uniform('c_custkey', 'd', seed=5)} AS u FROM customer, range(1, 11) r(d))), range(1, 5) q(k) GROUP BY 1, 2",
    "eval32_random_groups": f"SELECT c_custkey, (least((r - 1) // (n // 7), 6) + 1)::INT AS part FROM {_GROUP_SQL}",
    "obs18_logistic_point": _with(_LOGIT, "SELECT series_id, segment_id, t, round(psi, 6) AS psi FROM lg"),
    "obs26_trace_by_code": sql("SELECT series_id, segment_id, t, round(0.5 + 0.2 * state + 0.3 * state * state, 6)::DOUBLE AS trace FROM s"),
    "obs29_regression_by_state": _with(
        _SOFT + ", lq AS (SELECT *, lag(x2) OVER (PARTITION BY series_id, segment_id, state ORDER BY t) AS x FROM soft), "
        "wq AS (SELECT state, sum(p) AS n, sum(p * x) AS sx, sum(p * x * x) AS sxx, sum(p * x2) AS sy, sum(p * x * x2) AS sxy FROM lq WHERE x IS NOT NULL GROUP BY 1)",
        "SELECT state, unnest([0, 1]) AS term, round(unnest([(sxx * sy - sx * sxy) / (n * sxx - sx * sx), (n * sxy - sx * sy) / (n * sxx - sx * sx)]), 6) AS beta FROM wq",
    ),
    "agg09_gamma_square": sql("SELECT series_id, segment_id, t, state, round(p, 6) AS p FROM g"),
    "agg11_row_products": sql("SELECT series_id, segment_id, t, round((x2 * x1 + x3 * 2) / (1 + x1), 6) AS c1, round((x2 + x3 * x2) / (1 + x1), 6) AS c2 FROM s"),
    "agg22_state_means": _with(
        _SOFT, "SELECT state, unnest([1, 2]) AS channel, round(unnest([0.8 * a + 0.6 * b, -0.6 * a + 0.8 * b]), 6) AS mean FROM (SELECT state, sum(p * x2) / sum(p) AS a, sum(p * x3) / sum(p) AS b FROM soft GROUP BY 1)"
    ),
    "agg23_state_connectivity": _with(
        _SOFT
        + ", mo AS (SELECT state, sum(p) AS n, sum(p * x1) / sum(p) AS m1, sum(p * x2) / sum(p) AS m2, sum(p * x3) / sum(p) AS m3 FROM soft GROUP BY 1), "
        "cv AS (SELECT state, sum(p * (x1 - m1) ** 2) AS a, sum(p * (x2 - m2) ** 2) AS b, sum(p * (x3 - m3) ** 2) AS c, sum(p * (x1 - m1) * (x2 - m2)) AS ab, sum(p * (x1 - m1) * (x3 - m3)) AS ac, "
        "sum(p * (x2 - m2) * (x3 - m3)) AS bc FROM soft JOIN mo USING (state) GROUP BY 1), "
        "rr AS (SELECT state, ab / sqrt(a * b) AS x, ac / sqrt(a * c) AS y, bc / sqrt(b * c) AS z FROM cv)",
        "SELECT state, unnest([1, 1, 2]) AS i, unnest([2, 3, 3]) AS j, round(unnest([x, y, z]), 6) AS r, "
        "round(unnest([(x - y * z) / sqrt((1 - y * y) * (1 - z * z)), (y - x * z) / sqrt((1 - x * x) * (1 - z * z)), (z - x * y) / sqrt((1 - x * x) * (1 - y * y))]), 6) AS partial FROM rr",
    ),
    "agg24_autocovariance": _with(_AUTO, "SELECT i, j, lag, round(c, 6) AS c FROM ac"),
    "agg25_projected_coefficients": "SELECT * FROM (VALUES " + ", ".join(
        f"({r + 1}, {k + 1}, {round(float(x), 6)}::DOUBLE)" for (r, k), x in np.ndenumerate(np.array(LOADING) @ np.array(WEIGHTS) @ np.array(LOADING).T)
    ) + ') t("to", "from", w)',
    "spec06_lagged_spectrum": _with(
        _AUTO, "SELECT i, f, round(sum(c * CASE WHEN lag = 0 THEN 1 ELSE 2 * cos(2 * pi() * f * lag) END), 6) AS psd FROM ac, (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.4)) q(f) WHERE i = j GROUP BY 1, 2"
    ),
    "eval09_stability": _with(
        "b4 AS (SELECT *, lag(x2) OVER (PARTITION BY series_id, segment_id ORDER BY t) AS x FROM s)",
        "SELECT series_id, abs(covar_pop(x2, x) / nullif(var_pop(x), 0)) < 1 AS stable FROM b4 WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) > 1 AND var_pop(x) > 0",
    ),
    "train07_left_to_right": sql("SELECT bool_and(j = i OR j = i + 1) AS is_chain FROM trans"),
    "train35_symmetry": sql("SELECT DISTINCT state, true AS symmetric FROM s"),
    "train40_diagonal_for_life_time": "SELECT t::DOUBLE AS target, t::DOUBLE AS reached FROM (VALUES " + ", ".join(f"({t})" for t in LIFE_TIMES) + ") q(t)",
    "train41_life_time_of_diagonal": f"SELECT k AS diagonal, round({_LIFE}, 6) AS life_time FROM (SELECT k, k / (k + {K} - 1)::DOUBLE AS p FROM range(1, 101) r(k))",
    "win01_soft_life_times": _with(_CONF, "SELECT series_id, segment_id, state, start_t, length AS life_time FROM cr WHERE state IS NOT NULL AND n > 1 AND CASE WHEN is_last THEN length > 0 ELSE length >= 0 END"),
    "win03_soft_interval_times": _with(
        _CONF,
        "SELECT series_id, segment_id, state, start_t, interval FROM (SELECT *, start_t - lag(end_t) OVER (PARTITION BY series_id, segment_id, state ORDER BY start_t) - 1 AS interval FROM cr WHERE state IS NOT NULL) WHERE interval >= 0",
    ),
    "sim04_gaussian_noise": sql(f"SELECT series_id, segment_id, t, round(sum(p * (state + state / 2.0 * {_Z})), 6) AS x FROM g GROUP BY 1, 2, 3"),
    "join14_autocorrelation": sql(
        "SELECT a.series_id, a.channel AS i, (b.t - a.t)::INT AS lag, round(corr(a.value, b.value), 6) AS r FROM o a JOIN o b ON a.series_id = b.series_id AND a.segment_id = b.segment_id "
        "AND a.channel = b.channel AND b.t - a.t BETWEEN 0 AND 3 GROUP BY 1, 2, 3"
    ),
}
