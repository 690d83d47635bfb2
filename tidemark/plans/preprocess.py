"""Queries over preprocessing and pairwise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pairs as j
from tidemark.operators import preprocess as p
from tidemark.plans.dynamics import _r
from tidemark.plans.tables import SQL, gamma, long, path, samples, sql, suppliers
from tidemark.session import table

def _purchases(s, d):
    return path(s, d).filter("state = 3").select("series_id", "segment_id", "t")


def _features(s, d):
    return gamma(s, d).groupBy("series_id", F.col("state").alias("feature")).agg(F.avg("p").alias("value"))


def _edges(s, d):
    return j.static_connectivity(long(s, d))


def _flips(s, d):
    return s.range(1, 4).select(F.col("id").cast("int").alias("channel")).withColumn("k", F.lit(1)).join(
        samples(s, d).select("series_id").distinct().withColumn("k", F.lit(1)), "k"
    ).select("series_id", "channel", ((F.col("series_id") + F.col("channel")) % 2).cast("int").alias("flip"))


def _labels(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))


def _spectra(s, d):
    """A table in the shape of spectra: mean channel products by state and bins of the value."""
    return samples(s, d).groupBy("state", F.floor(F.col("x1") / 10).cast("double").alias("f"), F.lit(1).alias("i"), F.lit(1).alias("j")).agg(F.avg("x3").alias("value"))


def _good(s, d):
    return samples(s, d).select("series_id", "segment_id", "t", "x1", (F.col("state") != 2).alias("good"))


QUERIES = {
    "src03_mask_segments": lambda s, d: p.mask_segments(_good(s, d)),
    "src06_constraint_check": lambda s, d: long(s, d).groupBy("series_id", "segment_id").agg(
        F.countDistinct("t").alias("n"), F.max(F.col("value").isNull() | F.isnan("value")).alias("bad")
    ),
    "src10_flip": lambda s, d: _r(j.flip(long(s, d), _flips(s, d)), "value"),
    "pre01_standardise": lambda s, d: _r(p.standardise(p.clean(long(s, d))), "value"),
    "pre02_detrend": lambda s, d: _r(p.detrend(long(s, d)), "value"),
    "pre02_detrend_suppliers": lambda s, d: _r(p.detrend(suppliers(s, d).select("series_id", "segment_id", "t", F.lit(1).alias("channel"), F.col("x2").alias("value"))), "value"),
    "pre09_embedding": lambda s, d: _r(p.embed(long(s, d), [-1, 0, 1, 2]), "value"),
    "pre12_unwrap_embedding": lambda s, d: _r(p.unwrap_embedding(p.embed(long(s, d), [-1, 0, 1])), "value"),
    "pre13_decimate": lambda s, d: _r(p.decimate(long(s, d), 3), "value"),
    "pre14_clean": lambda s, d: _r(p.clean(long(s, d)), "value"),
    "pre23_pairwise_classes": lambda s, d: p.pairwise_classes(_labels(s, d), list(range(10))),
    "pre28_hard_max": lambda s, d: gamma(s, d).groupBy("series_id", "segment_id", "t").agg(F.sort_array(F.collect_list(F.struct("state", F.col("p").alias("v")))).alias("c"))
    .select("series_id", "segment_id", "t", F.expr("transform(c, x -> x.v)").alias("scores")).transform(p.hard_max).select("series_id", "segment_id", "t", F.array_join("hard", "").alias("hard")),
    "pre30_lag_design": lambda s, d: _r(p.lag_design(long(s, d), [1, 2], True), "value"),
    "pre32_aligned_response": lambda s, d: _r(p.aligned_response(long(s, d), [1, 2]), "value"),
    "join01_event_locked": lambda s, d: _r(j.event_locked(gamma(s, d), _purchases(s, d), 3), "p"),
    "join03_masked_transitions": lambda s, d: _r(j.masked_transitions(path(s, d), samples(s, d).filter("x1 > 20").select("series_id", "segment_id", "t")), "p"),
    "join07_static_connectivity": lambda s, d: _r(_edges(s, d), "r"),
    "join07_edge_similarity": lambda s, d: _r(j.edge_similarity(_edges(s, d)), "similarity"),
    "join08_state_overlap": lambda s, d: _r(j.state_overlap(gamma(s, d), gamma(s, d).withColumn("p", F.col("p") * F.col("p"))), "overlap"),
    "join11_linear_kernel": lambda s, d: _r(j.linear_kernel(_features(s, d)), "k"),
    "join11_linear_kernel_normalised": lambda s, d: _r(j.linear_kernel(_features(s, d), True), "k"),
    "join13_lagged_correlation": lambda s, d: _r(j.lagged_correlation(long(s, d), 2), "r"),
    "stat15_gaussian_kernel": lambda s, d: _r(j.gaussian_kernel(j.distances(_features(s, d)), 0.5), "k"),
    "stat16_median_distance": lambda s, d: _r(j.median_of_distances(_features(s, d)), "sigma"),
    "stat32_sign_score": lambda s, d: _r(j.sign_score(_edges(s, d)), "score"),
    "stat33_apply_signs": lambda s, d: _r(j.apply_signs(_edges(s, d), _flips(s, d)), "r"),
    "spec10_bands": lambda s, d: _r(j.bands(_spectra(s, d), [(0.0, 2.0), (2.0, 5.0), (4.0, 9.0)]), "value"),
    "spec12_relative_spectra": lambda s, d: _r(j.relative_spectra(_spectra(s, d)), "value"),
}

_EDGES = "edges AS (SELECT a.series_id, a.channel AS i, b.channel AS j, corr(a.value, b.value) AS r FROM o a JOIN o b USING (series_id, segment_id, t) WHERE a.channel < b.channel GROUP BY 1, 2, 3)"
_FEATURES = "f AS (SELECT series_id, state AS feature, avg(p) AS value FROM g GROUP BY 1, 2)"
_DIST = f"{_FEATURES}, dist AS (SELECT x.series_id AS a, y.series_id AS b, sum((x.value - y.value) ** 2) AS d FROM f x JOIN f y USING (feature) WHERE x.series_id < y.series_id GROUP BY 1, 2)"
_SPEC = "sp AS (SELECT state, floor(x1 / 10) AS f, 1 AS i, 1 AS j, avg(x3) AS value FROM s GROUP BY 1, 2)"
_CLEAN = "SELECT series_id, segment_id FROM (SELECT series_id, segment_id, channel, stddev_samp(value) AS sd FROM {} GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING bool_and(coalesce(sd, 0) <> 0)"


def _with(extra: str, query: str) -> str:
    return f"WITH {SQL}, {extra} {query}"


_TREND = "round(value - (avg(value) OVER w + coalesce(covar_pop(t, value) OVER w / nullif(var_pop(t) OVER w, 0), 0) * (t - avg(t) OVER w)), 6) AS value"

ORACLES = {
    "src03_mask_segments": sql(
        "SELECT series_id, segment_id, x1, (dense_rank() OVER (PARTITION BY series_id, segment_id ORDER BY run))::INT AS run, "
        "(row_number() OVER (PARTITION BY series_id, segment_id, run ORDER BY t))::INT AS t FROM (SELECT *, t - row_number() OVER (PARTITION BY series_id, segment_id ORDER BY t) AS run FROM s WHERE state <> 2)"
    ),
    "src06_constraint_check": sql("SELECT series_id, segment_id, count(DISTINCT t) AS n, bool_or(value IS NULL OR isnan(value)) AS bad FROM o GROUP BY 1, 2"),
    "src10_flip": sql("SELECT series_id, segment_id, t, channel, round(value * CASE WHEN (series_id + channel) % 2 = 1 THEN -1 ELSE 1 END, 6) AS value FROM o"),
    "pre01_standardise": sql(
        "SELECT series_id, segment_id, t, channel, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS value FROM o WHERE (series_id, segment_id) IN "
        f"({_CLEAN.format('o')}) WINDOW w AS (PARTITION BY series_id, segment_id, channel)",
    ),
    "pre02_detrend": sql(f"SELECT series_id, segment_id, t, channel, {_TREND} FROM o WINDOW w AS (PARTITION BY series_id, segment_id, channel)"),
    "pre02_detrend_suppliers": sql(f"SELECT series_id, segment_id, t, 1 AS channel, {_TREND.replace('value', 'x2').replace('AS x2', 'AS value')} FROM l WINDOW w AS (PARTITION BY series_id, segment_id)"),
    "pre09_embedding": sql(
        "SELECT series_id, segment_id, channel, t, lag::INT AS lag, round(value, 6) AS value FROM (SELECT series_id, segment_id, channel, t, unnest([-1, 0, 1, 2]) AS lag, unnest([ahead, value, b1, b2]) AS value "
        "FROM (SELECT *, lead(value) OVER w AS ahead, lag(value) OVER w AS b1, lag(value, 2) OVER w AS b2, count(*) OVER (PARTITION BY series_id, segment_id, channel) AS n FROM o "
        "WINDOW w AS (PARTITION BY series_id, segment_id, channel ORDER BY t)) WHERE t > 2 AND t <= n - 1)"
    ),
    "pre12_unwrap_embedding": sql(
        "SELECT o.series_id, o.segment_id, o.channel, o.t, round(o.value, 6) AS value, count(*) AS n_copies FROM (SELECT *, count(*) OVER (PARTITION BY series_id, segment_id, channel) AS n FROM o) o, "
        "range(-1, 2) r(k) WHERE o.t + k > 1 AND o.t + k <= o.n - 1 GROUP BY ALL"
    ),
    "pre13_decimate": sql("SELECT series_id, segment_id, ((t - 1) // 3 + 1)::INT AS t, channel, round(value, 6) AS value FROM o WHERE (t - 1) % 3 = 0"),
    "pre14_clean": sql(f"SELECT series_id, segment_id, t, channel, round(value, 6) AS value FROM o WHERE (series_id, segment_id) IN ({_CLEAN.format('o')})"),
    "pre23_pairwise_classes": "SELECT vec_id, label, a::INT AS a, b::INT AS b, (CASE label WHEN a THEN 1 WHEN b THEN -1 ELSE 0 END)::INT AS code FROM embeddings, range(0, 10) x(a), range(0, 10) y(b) WHERE a < b",
    "pre28_hard_max": sql(
        "SELECT series_id, segment_id, t, string_agg((p = m)::INT::VARCHAR, '' ORDER BY state) AS hard FROM (SELECT *, max(p) OVER (PARTITION BY series_id, segment_id, t) AS m FROM g) GROUP BY 1, 2, 3"
    ),
    "pre30_lag_design": sql(
        'SELECT a.series_id, a.segment_id, a.t, ((k - 1) * 3 + b.channel)::INT AS "column", round(b.value, 6) AS value FROM s a, range(1, 3) r(k), o b WHERE a.t > 2 AND b.series_id = a.series_id AND '
        "b.segment_id = a.segment_id AND b.t = a.t - k UNION ALL SELECT series_id, segment_id, t, 0, 1.0 FROM s WHERE t > 2"
    ),
    "pre32_aligned_response": sql("SELECT series_id, segment_id, t, channel, round(value, 6) AS value FROM o WHERE t > 2"),
    "join01_event_locked": sql(
        'SELECT (g.t - e.t)::INT AS "offset", g.state, round(avg(p), 6) AS p, count(*) AS n FROM s e JOIN g ON g.series_id = e.series_id AND g.segment_id = e.segment_id AND g.t BETWEEN e.t - 3 AND e.t + 3 '
        "WHERE e.state = 3 GROUP BY 1, 2"
    ),
    "join03_masked_transitions": sql(
        "SELECT i, j, n, round(n / sum(n) OVER (PARTITION BY i), 6) AS p FROM (SELECT i, j, count(*) AS n FROM (SELECT state AS i, x1, lead(state) OVER (PARTITION BY series_id, segment_id ORDER BY t) AS j FROM s) "
        "WHERE j IS NOT NULL AND x1 > 20 GROUP BY 1, 2)"
    ),
    "join07_static_connectivity": _with(_EDGES, "SELECT series_id, i, j, round(r, 6) AS r FROM edges"),
    "join07_edge_similarity": _with(
        _EDGES, "SELECT a.series_id AS a, b.series_id AS b, round(corr(a.r, b.r), 6) AS similarity FROM edges a JOIN edges b USING (i, j) WHERE a.series_id < b.series_id GROUP BY 1, 2"
    ),
    "join08_state_overlap": sql("SELECT a.state AS i, b.state AS j, round(sum(least(a.p, b.p * b.p)), 6) AS overlap FROM g a JOIN g b USING (series_id, segment_id, t) GROUP BY 1, 2"),
    "join11_linear_kernel": _with(_FEATURES, "SELECT x.series_id AS a, y.series_id AS b, round(sum(x.value * y.value), 6) AS k FROM f x JOIN f y USING (feature) WHERE x.series_id <= y.series_id GROUP BY 1, 2"),
    "join11_linear_kernel_normalised": _with(
        _FEATURES,
        "SELECT x.series_id AS a, y.series_id AS b, round(sum(x.value * y.value / n), 6) AS k FROM f x JOIN f y USING (feature) JOIN (SELECT feature, sum(value * value) AS n FROM f GROUP BY 1) USING (feature) "
        "WHERE x.series_id <= y.series_id GROUP BY 1, 2",
    ),
    "join13_lagged_correlation": sql(
        "SELECT a.series_id, a.channel AS i, b.channel AS j, (b.t - a.t)::INT AS lag, round(corr(a.value, b.value), 6) AS r FROM o a JOIN o b ON a.series_id = b.series_id AND a.segment_id = b.segment_id "
        "AND b.t - a.t BETWEEN 0 AND 2 GROUP BY 1, 2, 3, 4"
    ),
    "stat15_gaussian_kernel": _with(_DIST, "SELECT a, b, round(exp(-d / 0.5), 6) AS k FROM dist"),
    "stat16_median_distance": _with(_DIST, "SELECT round(median(d), 6) AS sigma FROM dist"),
    "stat32_sign_score": _with(_EDGES, "SELECT round(avg(c), 6) AS score FROM (SELECT corr(a.r, b.r) AS c FROM edges a JOIN edges b USING (i, j) WHERE a.series_id < b.series_id GROUP BY a.series_id, b.series_id)"),
    "stat33_apply_signs": _with(_EDGES, "SELECT series_id, i, j, round(r * (1 - 2 * ((series_id + i) % 2)) * (1 - 2 * ((series_id + j) % 2)), 6) AS r FROM edges"),
    "spec10_bands": _with(
        _SPEC, "SELECT state, i, j, band::INT AS band, round(sum(value), 6) AS value FROM sp JOIN (VALUES (1, 0, 2), (2, 2, 5), (3, 4, 9)) b(band, lo, hi) ON f BETWEEN lo AND hi GROUP BY ALL"
    ),
    "spec12_relative_spectra": _with(_SPEC, "SELECT state, f, i, j, round(value - avg(value) OVER (PARTITION BY f, i, j), 6) AS value FROM sp"),
}
