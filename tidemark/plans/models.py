"""Queries over moments, likelihoods, chain inference and prediction errors, with fixed parameters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.special import digamma
from tidemark.operators import emissions as e
from tidemark.operators import inference as h
from tidemark.operators import moments as m
from tidemark.plans.dynamics import _r
from tidemark.plans.tables import SQL, gamma, samples, sql, suppliers

# A fixed model of two states over x2 = ln(1 + value): means, standard deviations and chain.
MEANS, SDS, START = (1.0, 3.0), (0.9, 1.1), (0.6, 0.4)
TRANSITION = ((0.85, 0.15), (0.25, 0.75))
# A fixed autoregression of suppliers' prices on two lags.
AR = (12.0, 0.3, 0.1)


def log_likelihoods(s, d) -> DataFrame:
    """(series_id, segment_id, t, ll) of the fixed two-state model."""
    x = samples(s, d)
    cells = [e.gaussian([F.col("x2")], [mu], [[sd * sd]]) for mu, sd in zip(MEANS, SDS, strict=True)]
    return x.select("series_id", "segment_id", "t", F.array(*cells).alias("ll"))


def weighted(s, d) -> DataFrame:
    """Samples joined with the soft time-course."""
    return gamma(s, d).join(samples(s, d).drop("state"), ["series_id", "segment_id", "t"])


def predicted(s, d) -> DataFrame:
    wide, _ = m.lagged(suppliers(s, d), ["x2"], [1, 2])
    return wide.select("series_id", "t", F.col("x2").alias("y"), (AR[0] + AR[1] * F.col("x2_1") + AR[2] * F.col("x2_2")).alias("yhat"))


def _mixture(s, d) -> DataFrame:
    x = samples(s, d)
    cells = [e.gaussian([F.col("x2")], [mu], [[sd * sd]]) for mu, sd in zip(MEANS, SDS, strict=True)]
    first, second = e.posterior(cells, START)
    return x.select("series_id", "segment_id", "t", first.alias("p1"), second.alias("p2"))


def _explained(s, d) -> DataFrame:
    fit = m.fit_mar(suppliers(s, d), ["x1", "x2", "x3"], [1, 2])
    rows = [(n, float(v)) for n, v in zip(("x1", "x2", "x3"), fit["explained"], strict=True)]
    return s.createDataFrame(rows, "channel string, explained double")


def _pca(s, d) -> DataFrame:
    loadings, share = m.pca(suppliers(s, d), ["x1", "x2", "x3"], 3)
    rows = [(c + 1, r + 1, float(loadings[r, c]), float(share[c])) for c in range(3) for r in range(3)]
    return s.createDataFrame(rows, "component int, channel int, loading double, share double")


QUERIES = {
    "agg10_weighted_covariance": lambda s, d: _r(m.weighted_covariance(weighted(s, d), ["x1", "x2", "x3"], F.col("p"), ["state"]), "cov"),
    "pre40_weighted_gram": lambda s, d: m.products(weighted(s, d), ["x1", "x2", "x3"], F.col("p"), ["state"]).withColumn("s", F.round("s", 3)),
    "obs28_normal_equations": lambda s, d: m.products(m.lagged(suppliers(s, d), ["x1", "x2"], [1, 2])[0], ["x1_1", "x2_1", "x1_2", "x2_2", "x2"]).withColumn("s", F.round("s", 2)),
    "agg27_explained_single_mar": lambda s, d: _r(_explained(s, d), "explained"),
    "pre16_pca": _pca,
    "obs01_gaussian": lambda s, d: _r(
        samples(s, d).select("series_id", "segment_id", "t", e.gaussian([F.col("x2"), F.col("x3")], [2.0, 5.0], [[2.0, 0.5], [0.5, 9.0]]).alias("ll")), "ll"
    ),
    "obs02_bernoulli": lambda s, d: _r(
        samples(s, d).select("series_id", "segment_id", "t", e.bernoulli([(F.col("x1") > 10).cast("double"), (F.col("x3") > 4).cast("double")], [2.0, 3.0], [4.0, 1.5]).alias("ll")), "ll"
    ),
    "obs03_poisson": lambda s, d: _r(samples(s, d).select("series_id", "segment_id", "t", e.poisson([F.col("x3")], [5.0], [1.2]).alias("ll")), "ll"),
    "win13_mixture_posterior": lambda s, d: _r(_mixture(s, d), "p1", "p2"),
    "win11_forward_backward": lambda s, d: _r(h.decode_posterior(log_likelihoods(s, d), TRANSITION, START), "p"),
    "win10_viterbi": lambda s, d: h.decode_path(log_likelihoods(s, d), TRANSITION, START),
    "win18_log_evidence": lambda s, d: _r(h.evidence(log_likelihoods(s, d), TRANSITION, START), "log_evidence"),
    "eval08_prediction_error": lambda s, d: _r(m.prediction_error(predicted(s, d), ["series_id"]), "mse", "fraction", "explained"),
    "eval27_log_sum_exp": lambda s, d: _r(samples(s, d).select("series_id", "segment_id", "t", e.log_sum_exp([F.col("x1"), F.col("x2"), F.col("x3")]).alias("v")), "v"),
    "eval28_sigmoid": lambda s, d: _r(samples(s, d).select("series_id", "segment_id", "t", e.sigmoid(F.col("x2") - 2).alias("v")), "v"),
    "eval30_row_division": lambda s, d: _r(samples(s, d).select("series_id", "segment_id", "t", *((F.col(c) / F.nullif(F.col("x1") + F.col("x2") + F.col("x3"), F.lit(0.0))).alias(c) for c in ("x1", "x2", "x3"))), "x1", "x2", "x3"),
    "win17_smoothed_likelihood": lambda s, d: _r(
        log_likelihoods(s, d).select(
            "series_id", "segment_id", "t",
            *(F.avg(F.col("ll")[k]).over(Window.partitionBy("series_id", "segment_id").orderBy("t").rowsBetween(-2, 2)).alias(f"ll{k + 1}") for k in range(2)),
        ), "ll1", "ll2",
    ),
}

_LL = ", ".join(f"-ln({sd}) - 0.5 * ln(2 * pi()) - 0.5 * pow((x2 - {mu}) / {sd}, 2) AS l{k}" for k, (mu, sd) in enumerate(zip(MEANS, SDS, strict=True), 1))
((P11, P12), (P21, P22)), (S1, S2) = TRANSITION, START
_CHAIN = f"""
ll AS (SELECT series_id, segment_id, t, {_LL} FROM s),
lik AS (SELECT *, exp(l1) AS b1, exp(l2) AS b2, max(t) OVER (PARTITION BY series_id, segment_id) AS n FROM ll),
fwd AS (
  SELECT series_id, segment_id, t, {S1} * b1 / ({S1} * b1 + {S2} * b2) AS a1, {S2} * b2 / ({S1} * b1 + {S2} * b2) AS a2, ln({S1} * b1 + {S2} * b2) AS c FROM lik WHERE t = 1
  UNION ALL
  SELECT series_id, segment_id, t, u1 / (u1 + u2), u2 / (u1 + u2), c + ln(u1 + u2) FROM (
    SELECT l.series_id, l.segment_id, l.t, f.c, (f.a1 * {P11} + f.a2 * {P21}) * b1 AS u1, (f.a1 * {P12} + f.a2 * {P22}) * b2 AS u2
    FROM fwd f JOIN lik l ON l.series_id = f.series_id AND l.segment_id = f.segment_id AND l.t = f.t + 1)
),
bwd AS (
  SELECT series_id, segment_id, t, 0.5::DOUBLE AS z1, 0.5::DOUBLE AS z2 FROM lik WHERE t = n
  UNION ALL
  SELECT series_id, segment_id, t, v1 / (v1 + v2), v2 / (v1 + v2) FROM (
    SELECT l.series_id, l.segment_id, l.t - 1 AS t, {P11} * b1 * z1 + {P12} * b2 * z2 AS v1, {P21} * b1 * z1 + {P22} * b2 * z2 AS v2
    FROM bwd w JOIN lik l ON l.series_id = w.series_id AND l.segment_id = w.segment_id AND l.t = w.t WHERE l.t > 1)
)"""
_VITERBI = f"""
ll AS (SELECT series_id, segment_id, t, {_LL}, max(t) OVER (PARTITION BY series_id, segment_id) AS n FROM s),
del AS (
  SELECT series_id, segment_id, t, n, ln({S1}) + l1 AS d1, ln({S2}) + l2 AS d2, 0 AS k1, 0 AS k2 FROM ll WHERE t = 1
  UNION ALL
  SELECT l.series_id, l.segment_id, l.t, l.n, greatest(d1 + ln({P11}), d2 + ln({P21})) + l1, greatest(d1 + ln({P12}), d2 + ln({P22})) + l2,
         CASE WHEN d1 + ln({P11}) >= d2 + ln({P21}) THEN 1 ELSE 2 END, CASE WHEN d1 + ln({P12}) >= d2 + ln({P22}) THEN 1 ELSE 2 END
  FROM del f JOIN ll l ON l.series_id = f.series_id AND l.segment_id = f.segment_id AND l.t = f.t + 1
),
best AS (
  SELECT series_id, segment_id, t, CASE WHEN d1 >= d2 THEN 1 ELSE 2 END AS state FROM del WHERE t = n
  UNION ALL
  SELECT b.series_id, b.segment_id, b.t - 1, CASE WHEN b.state = 1 THEN k1 ELSE k2 END
  FROM best b JOIN del f ON f.series_id = b.series_id AND f.segment_id = b.segment_id AND f.t = b.t WHERE b.t > 1
)"""


def _with(extra: str, query: str) -> str:
    return f"WITH RECURSIVE {SQL}, {extra} {query}"


_JOINED = "w AS (SELECT g.state, g.p, s.x1, s.x2, s.x3 FROM g JOIN s USING (series_id, segment_id, t))"
_NAMES = ("x1", "x2", "x3")
_GRAM = " UNION ALL ".join(
    ["SELECT state, 0 AS i, 0 AS j, round(sum(p), 3) AS s FROM w GROUP BY state"]
    + [f"SELECT state, 0, {j}, round(sum(p * {n}), 3) FROM w GROUP BY state" for j, n in enumerate(_NAMES, 1)]
    + [f"SELECT state, {i}, {j}, round(sum(p * {_NAMES[i - 1]} * {_NAMES[j - 1]}), 3) FROM w GROUP BY state" for i in (1, 2, 3) for j in range(i, 4)]
)
_COV = " UNION ALL ".join(
    f"SELECT state, {i} AS i, {j} AS j, round((sum(p * {_NAMES[i - 1]} * {_NAMES[j - 1]}) - sum(p * {_NAMES[i - 1]}) * sum(p * {_NAMES[j - 1]}) / sum(p)) / sum(p), 6) AS cov FROM w GROUP BY state"
    for i in (1, 2, 3)
    for j in range(i, 4)
)
_LAGS = "lg AS (SELECT * FROM (SELECT x2, t, lag(x1) OVER q AS a, lag(x2) OVER q AS b, lag(x1, 2) OVER q AS c, lag(x2, 2) OVER q AS d FROM l WINDOW q AS (PARTITION BY series_id ORDER BY t)) WHERE t > 2)"
_D = ("a", "b", "c", "d", "x2")
_NORMAL = " UNION ALL ".join(
    ["SELECT 0 AS i, 0 AS j, round(count(*)::DOUBLE, 2) AS s FROM lg"]
    + [f"SELECT 0, {j}, round(sum({n}), 2) FROM lg" for j, n in enumerate(_D, 1)]
    + [f"SELECT {i}, {j}, round(sum({_D[i - 1]} * {_D[j - 1]}), 2) FROM lg" for i in range(1, 6) for j in range(i, 6)]
)


def _psi(x: float) -> float:
    return float(digamma(x))


_BER = " + ".join(f"{c} * {_psi(a) - _psi(a + b)!r} + (1::DOUBLE - {c}) * {_psi(b) - _psi(a + b)!r}" for c, a, b in (("(x1 > 10)::INT::DOUBLE", 2.0, 4.0), ("(x3 > 4)::INT::DOUBLE", 3.0, 1.5)))

ORACLES = {
    "agg10_weighted_covariance": _with(_JOINED, _COV),
    "pre40_weighted_gram": _with(_JOINED, _GRAM),
    "obs28_normal_equations": _with(_LAGS, _NORMAL),
    "obs01_gaussian": sql(
        "SELECT series_id, segment_id, t, round(-0.5 * (2 * ln(2 * pi()) + ln(17.75)) - 0.5 * (9 * (x2 - 2) ** 2 - (x2 - 2) * (x3 - 5) + 2 * (x3 - 5) ** 2) / 17.75, 6) AS ll FROM s"
    ),
    "obs02_bernoulli": sql(f"SELECT series_id, segment_id, t, round(({_BER})::DOUBLE, 6) AS ll FROM s"),
    "obs03_poisson": sql(f"SELECT series_id, segment_id, t, round(x3 * {_psi(5.0) - math.log(1.2)!r} - {5.0 / 1.2!r} - lgamma(x3 + 1), 6) AS ll FROM s"),
    "win13_mixture_posterior": _with(
        f"ll AS (SELECT series_id, segment_id, t, {_LL} FROM s)",
        f"SELECT series_id, segment_id, t, round({S1} * exp(l1) / ({S1} * exp(l1) + {S2} * exp(l2)), 6) AS p1, round({S2} * exp(l2) / ({S1} * exp(l1) + {S2} * exp(l2)), 6) AS p2 FROM ll",
    ),
    "win11_forward_backward": _with(
        _CHAIN,
        "SELECT series_id, segment_id, t, k::INT AS state, round(CASE k WHEN 1 THEN a1 * z1 ELSE a2 * z2 END / (a1 * z1 + a2 * z2), 6) AS p FROM fwd JOIN bwd USING (series_id, segment_id, t), range(1, 3) r(k)",
    ),
    "win10_viterbi": _with(_VITERBI, "SELECT series_id, segment_id, t, state FROM best"),
    "win18_log_evidence": _with(_CHAIN, "SELECT series_id, segment_id, round(arg_max(c, t), 6) AS log_evidence FROM fwd GROUP BY 1, 2"),
    "eval08_prediction_error": _with(
        f"y AS (SELECT series_id, x2 AS y, {AR[0]} + {AR[1]} * b + {AR[2]} * d AS yhat FROM (SELECT series_id, x2, t, lag(x2) OVER q AS b, lag(x2, 2) OVER q AS d FROM l WINDOW q AS (PARTITION BY series_id ORDER BY t)) WHERE t > 2)",
        "SELECT series_id, round(avg((y - yhat) ** 2), 6) AS mse, round(avg((y - yhat) ** 2) / var_pop(y), 6) AS fraction, round(1 - avg((y - yhat) ** 2) / var_pop(y), 6) AS explained FROM y GROUP BY 1",
    ),
    "eval27_log_sum_exp": sql("SELECT series_id, segment_id, t, round(greatest(x1, x2, x3) + ln(exp(x1 - greatest(x1, x2, x3)) + exp(x2 - greatest(x1, x2, x3)) + exp(x3 - greatest(x1, x2, x3))), 6) AS v FROM s"),
    "eval28_sigmoid": sql("SELECT series_id, segment_id, t, round(1 / (1 + exp(2 - x2)), 6) AS v FROM s"),
    "eval30_row_division": sql("SELECT series_id, segment_id, t, round(x1 / nullif(x1 + x2 + x3, 0), 6) AS x1, round(x2 / nullif(x1 + x2 + x3, 0), 6) AS x2, round(x3 / nullif(x1 + x2 + x3, 0), 6) AS x3 FROM s"),
    "win17_smoothed_likelihood": _with(
        f"ll AS (SELECT series_id, segment_id, t, {_LL} FROM s)",
        "SELECT series_id, segment_id, t, round(avg(l1) OVER w, 6) AS ll1, round(avg(l2) OVER w, 6) AS ll2 FROM ll WINDOW w AS (PARTITION BY series_id, segment_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    ),
}
