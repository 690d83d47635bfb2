"""Queries over the preprocessing chain, reductions, episodes, flips, simulation and figures' tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import mean_in_order
from tidemark.operators import dynamics as d
from tidemark.operators import episodic, flips, recipes, reduce, simulate, spectra_model, views
from tidemark.operators import pairs as j
from tidemark.operators import preprocess as p
from tidemark.operators import regression_chain as rc
from tidemark.operators import state_models as sm
from tidemark.plans.dynamics import _r
from tidemark.plans.tables import SQL, K, gamma, long, observations, path, samples, sql, suppliers
from tidemark.session import table

# Covariance of two samples of two channels, the older first.
DELAYS = ((2.0, 0.5, 1.0, 0.2), (0.5, 1.0, 0.3, 0.4), (1.0, 0.3, 2.0, 0.5), (0.2, 0.4, 0.5, 1.0))


def _leakage(s, f) -> DataFrame:
    """Cosines of the corrected channels with each other."""
    wide = reduce.leakage_corrected(samples(s, f).select("series_id", "segment_id", "t", "x1", "x2", "x3"), ["x1", "x2", "x3"])
    pairs = [(1, 2), (1, 3), (2, 3)]
    cells = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), (F.sum(F.col(f"x{a}") * F.col(f"x{b}")) / F.sqrt(F.sum(F.col(f"x{a}") * F.col(f"x{a}")) * F.sum(F.col(f"x{b}") * F.col(f"x{b}")))).alias("r")) for a, b in pairs]
    return wide.agg(F.array(*cells).alias("c")).select(F.inline("c")).withColumn("r", F.abs(F.round("r", 6)))


def _axes(s, f) -> DataFrame:
    """Spread of the channels on two supervised axes: one by construction."""
    axes = reduce.supervised_axes(samples(s, f), ["x2", "x3"], "x1", 2)
    cells = [F.struct(F.lit(k + 1).alias("axis"), F.stddev_samp(F.col("x2") * float(axes[0, k]) + F.col("x3") * float(axes[1, k])).alias("sd")) for k in range(2)]
    return samples(s, f).agg(F.array(*cells).alias("c")).select(F.inline("c"))


def _bases(s, f) -> DataFrame:
    found = reduce.lag_bases(suppliers(s, f), ["x1", "x2", "x3"], [1, 2], 2)
    rows = [(lag + 1, c + 1, i + 1, float(u[i, c]), float(strength[c])) for lag, (u, strength, _) in enumerate(found) for c in range(2) for i in range(3)]
    return s.createDataFrame(rows, "lag int, component int, channel int, weight double, strength double")


def _predictors(s, f) -> DataFrame:
    u = reduce.predictor_basis(suppliers(s, f), ["x1", "x2"], [1, 2], 2)
    return s.createDataFrame([(r + 1, c + 1, float(v)) for (r, c), v in np.ndenumerate(u)], "row int, component int, weight double")


def _episodes(s, f) -> DataFrame:
    x = observations(s, f).select("series_id", "segment_id", "t", F.array(F.col("x")[1], F.col("x")[2]).alias("x"))
    return episodic.fit(x, rc.Family((1,)), 2, 4, seed=1)[1]


def _posteriors(s, f) -> DataFrame:
    return flips.flip_posteriors(j.lagged_correlation(long(s, f), 1), 3)


def _aligned(s, f) -> DataFrame:
    buys = path(s, f).filter("state = 3").select("series_id", "segment_id", "t")
    return flips.align_to_events(observations(s, f).select("series_id", "segment_id", "t", F.array(F.col("x")[1] - 3).alias("x")), buys, (-1, 1))


def _embedded(s, f) -> DataFrame:
    return recipes.preprocessed(long(s, f), recipes.Recipe(detrend=True, lags=(-1, 0, 1)))[0]


def _loaded(s, f) -> DataFrame:
    """Scaled channels of segments that have a spread, every lag up to two as a design."""
    ready = recipes.preprocessed(p.clean(long(s, f)), recipes.Recipe(standardise=True))[0]
    return p.lag_design(ready, [1, 2])


def _edges(s, f) -> DataFrame:
    return j.static_connectivity(long(s, f)).withColumnRenamed("r", "w")


def _eigen_map(s, f) -> DataFrame:
    mean = _edges(s, f).groupBy("i", "j").agg(F.avg("w").alias("w"))
    return views.node_map(mean, 3, "eigen")


def _panels(s, f) -> DataFrame:
    from tidemark.plans.decoding import _mar

    found = spectra_model.model_spectra(s, _mar(s, f), 1.0, (0.1, 0.2))
    return views.spectral_panels(found.select("state", "f", "i", "j", "re", "im"))


def _regions(s, f) -> DataFrame:
    """Order lines as points: quantity, discount and tax as coordinates, price as weight, ship mode as region."""
    return table(s, f, "lineitem").select((F.col("l_suppkey") % 7).alias("region"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), F.col("l_extendedprice").alias("w"))


def _state_map(s, f) -> DataFrame:
    values = samples(s, f).groupBy("state", F.lit(1).alias("region")).agg(F.avg("x2").alias("v")).unionAll(samples(s, f).groupBy("state", F.lit(2)).agg(F.avg("x3")))
    weights = s.createDataFrame([(r, q, 1.0 / (r + q)) for r in (1, 2) for q in range(1, 5)], "region int, point int, w double")
    return views.projected_map(values, weights)


def _metastates(s, f) -> DataFrame:
    return recipes.metastates(path(s, f), K)


def _job(s, f) -> DataFrame:
    """Occupancies of the states that the front door finds."""
    return recipes.gaussian_states(p.clean(long(s, f)), recipes.Recipe(standardise=True), 1, k=3, cycles=5, seed=1).measures["occupancy"]


def _mar_job(s, f) -> DataFrame:
    return recipes.autoregressive_states(p.clean(long(s, f)), recipes.Recipe(standardise=True), rc.Family((1,)), 2, (0.1, 0.2), repetitions=1, cycles=5).measures["spectra"]


def _delay_job(s, f) -> DataFrame:
    prices = suppliers(s, f).select("series_id", "segment_id", "t", F.posexplode(F.array("x1", "x2")).alias("c", "value")).select("series_id", "segment_id", "t", (F.col("c") + 1).alias("channel"), "value")
    return recipes.delay_embedded_states(prices, (-1, 0, 1), 3, 64, k=2, cycles=4, seed=1).measures["spectra"]


def _grid_job(s, f) -> DataFrame:
    from tidemark.plans.tasks import _measures

    units, _ = _measures(s, f)
    return recipes.condition_grid(p.clean(long(s, f)), units.select("series_id", "label"), [recipes.Recipe(standardise=True)], [2, 3], 50, cycles=4, seed=1)


def _distance_job(s, f) -> DataFrame:
    """Distances of the z-scores of segments that have a spread."""
    return recipes.segment_distances(recipes.scored_segments(observations(s, f)), 2, cycles=4, seed=1)


def _order(s, f) -> DataFrame:
    """Segments by their mean value, added up in time: where segments are alike, their keys decide and not the partitions."""
    return views.trial_order(gamma(s, f), samples(s, f).groupBy("series_id", "segment_id").agg(mean_in_order("t", "x1").alias("y")))


QUERIES = {
    "src01_load_and_design": lambda s, f: _r(_loaded(s, f), "value"),
    "src14_gaussian_job": _job,
    "pre08_leakage": _leakage,
    "pre17_lag_bases": _bases,
    "pre18_predictor_basis": _predictors,
    "pre19_supervised_axes": lambda s, f: _r(_axes(s, f), "sd"),
    "pre20_chain": lambda s, f: _r(_embedded(s, f), "value"),
    "pre31_tiled_mask": lambda s, f: s.createDataFrame([(r + 1, c + 1, int(v)) for (r, c), v in np.ndenumerate(reduce.tiled_mask([[1, 0], [1, 1]], [1, 2], True))], "row int, channel int, used int"),
    "pre34_residual_range": lambda s, f: _r(reduce.residual_range(samples(s, f), "x2", 1), "lowest", "highest", "spread"),
    "pre35_order_for": lambda s, f: s.createDataFrame([(n, len(p.lag_orders(1, *reduce.order_for(1.0, 100.0, n)))) for n in (5, 8, 12)], "wanted int, found int"),
    "join02_align_to_events": _aligned,
    "train24_episodes": _episodes,
    "stat35_flip_posteriors": lambda s, f: _r(_posteriors(s, f), "p_unflipped"),
    "sim05_like_observed": lambda s, f: simulate.like_observed(suppliers(s, f), ["x1", "x2"], 1, simulate.segment_grid(s, 5, 2, 80), seed=2),
    "sim07_delay_series": lambda s, f: simulate.delay_series(simulate.segment_grid(s, 5, 2, 80), DELAYS, 2, seed=2),
    "viz01_trial_order": lambda s, f: _order(s, f),
    "viz01_course_table": lambda s, f: _r(views.course_table(gamma(s, f), _order(s, f)), "low", "high"),
    "viz02_path_table": lambda s, f: views.course_table(d.one_hot(path(s, f), K), _order(s, f)),
    "viz04_spectral_panels": _panels,
    "viz06_projected_map": lambda s, f: _r(_state_map(s, f), "value"),
    "viz08_strongest_edges": lambda s, f: _r(views.strongest_edges(_edges(s, f), 0.4, ["series_id"], True), "w"),
    "viz14_region_centres": lambda s, f: _r(views.region_centres(_regions(s, f)), "x", "y", "z"),
    "viz15_eigen_map": lambda s, f: _r(_eigen_map(s, f), "value"),
    "viz17_condition_grid": _grid_job,
    "viz18_delay_job": _delay_job,
    "viz19_autoregressive_job": _mar_job,
    "viz20_series_distances": _distance_job,
    "viz22_metastates": lambda s, f: _r(_metastates(s, f), "r"),
    "train43_tested_life_times": lambda s, f: _r(sm.simulated_life_times(s, 5.0, 4, 30, 200, 2), "life_time"),
}


def _with(extra: str, query: str) -> str:
    return f"WITH {SQL}, {extra} {query}"


_EDGES = "edges AS (SELECT a.series_id, a.channel AS i, b.channel AS j, corr(a.value, b.value) AS w FROM o a JOIN o b USING (series_id, segment_id, t) WHERE a.channel < b.channel GROUP BY 1, 2, 3)"
_PLACE = "pl AS (SELECT series_id, segment_id, row_number() OVER (ORDER BY y, series_id, segment_id) AS place FROM (SELECT series_id, segment_id, avg(x1) AS y FROM s GROUP BY 1, 2))"
_CLEANED = (
    "ok AS (SELECT series_id, segment_id FROM (SELECT series_id, segment_id, channel, stddev_samp(value) AS sd FROM o GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING bool_and(coalesce(sd, 0) <> 0)), "
    "sc AS (SELECT series_id, segment_id, t, channel, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM o JOIN ok USING (series_id, segment_id) WINDOW w AS (PARTITION BY series_id, segment_id, channel))"
)

ORACLES = {
    "src01_load_and_design": _with(
        _CLEANED,
        'SELECT series_id, segment_id, t, ((k - 1) * 3 + channel)::INT AS "column", round(value, 6) AS value FROM (SELECT series_id, segment_id, t, channel, unnest([1, 2]) AS k, unnest([a, b]) AS value FROM '
        "(SELECT *, lag(value) OVER w AS a, lag(value, 2) OVER w AS b FROM sc WINDOW w AS (PARTITION BY series_id, segment_id, channel ORDER BY t)) WHERE t > 2)",
    ),
    "pre08_leakage": "SELECT * FROM (VALUES (1, 2, 0.0::DOUBLE), (1, 3, 0.0), (2, 3, 0.0)) q(i, j, r)",
    "pre19_supervised_axes": "SELECT * FROM (VALUES (1, 1.0::DOUBLE), (2, 1.0)) q(axis, sd)",
    "pre20_chain": _with(
        "dt AS (SELECT series_id, segment_id, t, channel, value - (avg(value) OVER w + coalesce(covar_pop(t, value) OVER w / nullif(var_pop(t) OVER w, 0), 0) * (t - avg(t) OVER w)) AS value FROM o "
        "WINDOW w AS (PARTITION BY series_id, segment_id, channel))",
        "SELECT series_id, segment_id, t, ((channel - 1) * 3 + k)::INT AS channel, round(value, 6) AS value FROM (SELECT series_id, segment_id, t, channel, unnest([1, 2, 3]) AS k, unnest([a, value, b]) AS value FROM "
        "(SELECT *, lead(value) OVER w AS a, lag(value) OVER w AS b FROM dt WINDOW w AS (PARTITION BY series_id, segment_id, channel ORDER BY t)) WHERE a IS NOT NULL AND b IS NOT NULL)",
    ),
    "pre31_tiled_mask": 'SELECT * FROM (VALUES (1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 0), (3, 1, 1), (3, 2, 1), (4, 1, 1), (4, 2, 0), (5, 1, 1), (5, 2, 1)) q("row", channel, used)',
    "pre34_residual_range": _with(
        "b4 AS (SELECT x2, lag(x2) OVER (PARTITION BY series_id, segment_id ORDER BY t) AS x FROM s), be AS (SELECT sum(x * x2) / (sum(x * x) + 0.01) AS b FROM b4 WHERE x IS NOT NULL)",
        "SELECT round(min(x2 - b * x), 6) AS lowest, round(max(x2 - b * x), 6) AS highest, round(max(x2 - b * x) - min(x2 - b * x), 6) AS spread FROM b4, be WHERE x IS NOT NULL",
    ),
    "pre35_order_for": "SELECT n AS wanted, n AS found FROM (VALUES (5), (8), (12)) q(n)",
    "viz01_trial_order": _with(_PLACE, "SELECT series_id, segment_id, place FROM pl"),
    "viz01_course_table": _with(
        _PLACE, "SELECT place, t, state, round(sum(p) OVER w - p, 6) AS low, round(sum(p) OVER w, 6) AS high FROM g JOIN pl USING (series_id, segment_id) WINDOW w AS (PARTITION BY place, t ORDER BY state)"
    ),
    "viz02_path_table": _with(
        _PLACE, "SELECT place, t, k::INT AS state, CASE WHEN s.state < k THEN 1 ELSE 0 END::DOUBLE AS low, CASE WHEN s.state <= k THEN 1 ELSE 0 END::DOUBLE AS high FROM s JOIN pl USING (series_id, segment_id), range(1, 6) r(k)"
    ),
    "viz06_projected_map": sql("SELECT state, q::INT AS point, round(avg(x2) / (1 + q) + avg(x3) / (2 + q), 6) AS value FROM s, range(1, 5) r(q) GROUP BY state, q"),
    "viz08_strongest_edges": _with(
        _EDGES + ", ce AS (SELECT series_id, i, j, w - avg(w) OVER (PARTITION BY i, j) AS w FROM edges), li AS (SELECT series_id, quantile_cont(abs(w), 0.6) AS lim FROM ce GROUP BY 1)",
        "SELECT series_id, i, j, round(w, 6) AS w FROM ce JOIN li USING (series_id) WHERE abs(w) >= lim",
    ),
    "viz14_region_centres": "SELECT l_suppkey % 7 AS region, round(sum(l_extendedprice * l_quantity) / sum(l_extendedprice), 6) AS x, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS y, "
    "round(sum(l_extendedprice * l_tax) / sum(l_extendedprice), 6) AS z FROM lineitem GROUP BY 1",
    # Power iteration on the matrix with one more on its diagonal, which keeps its vectors.
    "viz15_eigen_map": f"WITH RECURSIVE {SQL}, {_EDGES}, mw AS (SELECT avg(w) FILTER (i = 1 AND j = 2) AS p, avg(w) FILTER (i = 1 AND j = 3) AS q, avg(w) FILTER (i = 2 AND j = 3) AS r FROM edges), "
    "it AS (SELECT 0 AS n, p, q, r, 0.6::DOUBLE AS a, 0.5::DOUBLE AS b, 0.4::DOUBLE AS c FROM mw UNION ALL SELECT n + 1, p, q, r, x / sqrt(x * x + y * y + z * z), y / sqrt(x * x + y * y + z * z), z / sqrt(x * x + y * y + z * z) "
    "FROM (SELECT *, 2 * a + p * b + q * c AS x, p * a + 2 * b + r * c AS y, q * a + r * b + 2 * c AS z FROM it WHERE n < 2000)), "
    "le AS (SELECT a, b, c, sign(CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN a WHEN abs(b) >= abs(c) THEN b ELSE c END) AS s FROM it WHERE n = 2000) "
    "SELECT unnest([1, 2, 3]) AS node, round(unnest([a * s, b * s, c * s]), 6) AS value FROM le",
    "viz22_metastates": _with(
        "oc AS (SELECT series_id, k AS state, count(*) FILTER (s.state = k) / count(*) AS v FROM s, range(1, 6) r(k) GROUP BY 1, 2)",
        "SELECT a.state::INT AS state, b.state::INT AS other, round(corr(a.v, b.v), 6) AS r FROM oc a JOIN oc b USING (series_id) WHERE a.state < b.state GROUP BY 1, 2",
    ),
}
