"""Queries over state time-courses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dynamics as d
from tidemark.plans.tables import K, gamma, path, sql


def _r(df, *names):
    """Rounded columns, so that two engines give equal values."""
    return df.withColumns({n: F.round(n, 6) for n in names})


QUERIES = {
    "agg01_fractional_occupancy": lambda s, p: _r(d.fractional_occupancy(gamma(s, p)), "fo"),
    "agg01_occupancy_over_time": lambda s, p: _r(d.occupancy_over_time(gamma(s, p)), "fo"),
    "agg01_occupancy_to_finish": lambda s, p: _r(d.occupancy_over_time(gamma(s, p), "finish"), "fo"),
    "agg02_max_occupancy": lambda s, p: _r(d.max_occupancy(gamma(s, p)), "max_fo"),
    "agg03_switching_rate": lambda s, p: _r(d.switching_rate(d.one_hot(path(s, p), K)), "rate"),
    "agg03_switching_rate_soft": lambda s, p: _r(d.switching_rate(gamma(s, p)), "rate"),
    "agg04_transitions": lambda s, p: _r(d.transitions(path(s, p)), "p"),
    "agg04_transitions_without_diagonal": lambda s, p: _r(d.without_diagonal(d.transitions(path(s, p))), "p"),
    "agg07_approximate_pairs": lambda s, p: _r(d.approximate_pairs(gamma(s, p)).groupBy("series_id", "i", "j").agg(F.sum("p").alias("p")), "p"),
    "agg12_active_states": lambda s, p: _r(d.active_states(gamma(s, p), 20.0), "p"),
    "agg13_redundant_pairs": lambda s, p: _r(d.redundant_pairs(gamma(s, p), 0.2), "distance"),
    "agg15_state_order": lambda s, p: _r(d.state_order(gamma(s, p)), "centre"),
    "agg16_clear_transitions": lambda s, p: _r(d.clear_transitions(d.transitions(path(s, p)), K), "p"),
    "agg17_gamma_check": lambda s, p: d.gamma_check(gamma(s, p), K),
    "agg19_synchronicity": lambda s, p: _r(d.synchronicity(gamma(s, p)), "synchronicity"),
    "win01_life_times": lambda s, p: d.life_times(path(s, p)),
    "win02_life_times_threshold": lambda s, p: d.life_times(path(s, p), 2),
    "win03_interval_times": lambda s, p: d.interval_times(path(s, p)),
    "win04_interval_times_threshold": lambda s, p: d.interval_times(path(s, p), 3),
    "win05_onsets": lambda s, p: _r(d.onsets(path(s, p), 4.0), "onset"),
    "win06_start_finish": lambda s, p: d.start_finish(path(s, p)),
    "pre36_pad_gamma": lambda s, p: _r(
        d.pad(gamma(s, p).filter("t > 2"), path(s, p).groupBy("series_id", "segment_id").agg(F.count("*").alias("n"))), "p"
    ),
    "pre38_one_hot": lambda s, p: d.one_hot(path(s, p), K),
    "eval04_gamma_entropy": lambda s, p: _r(d.entropy(gamma(s, p)), "entropy"),
    "viz03_raster": lambda s, p: d.raster(gamma(s, p)),
}

ORACLES = {
    "agg01_fractional_occupancy": sql("SELECT series_id, state, round(sum(p) / sum(sum(p)) OVER (PARTITION BY series_id), 6) AS fo FROM g GROUP BY series_id, state"),
    "agg01_occupancy_over_time": sql("SELECT t, state, round(fo, 6) AS fo, n_segments FROM course"),
    "agg01_occupancy_to_finish": sql(
        "SELECT (t - m)::INT AS t, state, round(avg(p), 6) AS fo, count(*) AS n_segments FROM "
        "(SELECT *, max(t) OVER (PARTITION BY series_id, segment_id) AS m FROM g) GROUP BY 1, 2"
    ),
    "agg02_max_occupancy": sql("SELECT series_id, round(max(fo), 6) AS max_fo FROM (SELECT series_id, state, avg(p) AS fo FROM g GROUP BY 1, 2) GROUP BY 1"),
    "agg03_switching_rate": sql("SELECT series_id, round(avg((i <> j)::INT), 6) AS rate FROM steps GROUP BY 1"),
    "agg03_switching_rate_soft": sql(
        "SELECT series_id, round(sum(abs(c)) / 2 / (count(*) / 5), 6) AS rate FROM (SELECT series_id, p - lag(p) OVER "
        "(PARTITION BY series_id, segment_id, state ORDER BY t) AS c FROM g) WHERE c IS NOT NULL GROUP BY 1"
    ),
    "agg04_transitions": sql("SELECT i, j, n, round(p, 6) AS p FROM trans"),
    "agg04_transitions_without_diagonal": sql("SELECT i, j, round(n / sum(n) OVER (PARTITION BY i), 6) AS p FROM trans WHERE i <> j"),
    "agg07_approximate_pairs": sql(
        "SELECT a.series_id, a.state AS i, b.state AS j, round(sum(a.p * b.p), 6) AS p FROM g a JOIN g b ON a.series_id = b.series_id "
        "AND a.segment_id = b.segment_id AND b.t = a.t + 1 GROUP BY 1, 2, 3"
    ),
    "agg12_active_states": sql(
        "SELECT series_id, segment_id, t, state, round(p / sum(p) OVER (PARTITION BY series_id, segment_id, t), 6) AS p FROM g "
        "WHERE state IN (SELECT state FROM g GROUP BY state HAVING sum(p) > 20)"
    ),
    "agg13_redundant_pairs": sql(
        "SELECT a.state AS i, b.state AS j, round(avg(abs(a.p - b.p)), 6) AS distance, avg(abs(a.p - b.p)) < 0.2 AS redundant FROM g a JOIN g b "
        "USING (series_id, segment_id, t) WHERE a.state < b.state GROUP BY 1, 2"
    ),
    "agg15_state_order": sql(
        "SELECT state, round(c, 6) AS centre, (row_number() OVER (ORDER BY share < 0.01, c, state))::INT AS rank FROM "
        "(SELECT state, sum(t * fo ** 5) / sum(fo ** 5) AS c, avg(fo) AS share FROM course GROUP BY state)"
    ),
    "agg16_clear_transitions": sql(
        "SELECT a::INT AS i, b::INT AS j, round(CASE WHEN a = b THEN d ELSE (1 - d) / 4 END, 6) AS p FROM (SELECT sum(p) / 5 AS d FROM trans WHERE i = j), range(1, 6) x(a), range(1, 6) y(b)"
    ),
    "agg17_gamma_check": sql(
        "SELECT series_id, bool_or(nan) AS has_nan, bool_and(hi < 0.6 AND lo > 0.1) AS flat FROM (SELECT series_id, state, max(p) AS hi, min(p) AS lo, "
        "bool_or(isnan(p)) AS nan FROM g GROUP BY 1, 2) GROUP BY 1"
    ),
    "agg19_synchronicity": sql("SELECT t, round(max(fo), 6) AS synchronicity FROM course GROUP BY t"),
    "win01_life_times": sql("SELECT series_id, segment_id, state, start_t, length AS life_time FROM runs WHERE n > 1"),
    "win02_life_times_threshold": sql(
        "SELECT series_id, segment_id, state, start_t, length AS life_time FROM runs WHERE n > 1 AND CASE WHEN is_last THEN length > 2 ELSE length >= 2 END"
    ),
    "win03_interval_times": sql(
        'SELECT * FROM (SELECT series_id, segment_id, state, start_t, (start_t - lag(end_t) OVER (PARTITION BY series_id, segment_id, state ORDER BY start_t) - 1)::INT AS "interval" FROM runs) '
        'WHERE "interval" IS NOT NULL'
    ),
    "win04_interval_times_threshold": sql(
        'SELECT * FROM (SELECT series_id, segment_id, state, start_t, (start_t - lag(end_t) OVER (PARTITION BY series_id, segment_id, state ORDER BY start_t) - 1)::INT AS "interval" FROM runs) '
        'WHERE "interval" >= 3'
    ),
    "win05_onsets": sql("SELECT series_id, segment_id, state, round(start_t / 4.0, 6) AS onset FROM runs"),
    "win06_start_finish": sql("SELECT series_id, segment_id, state, start_t, end_t FROM runs"),
    "pre36_pad_gamma": sql(
        "SELECT g.series_id, g.segment_id, g.t, g.state, round(CASE WHEN g.t > 2 THEN g.p ELSE m.p END, 6) AS p FROM g JOIN "
        "(SELECT series_id, segment_id, state, avg(p) AS p FROM g WHERE t > 2 GROUP BY 1, 2, 3) m USING (series_id, segment_id, state)"
    ),
    "pre38_one_hot": sql("SELECT series_id, segment_id, t, k::INT AS state, (state = k)::INT::DOUBLE AS p FROM s, range(1, 6) r(k)"),
    "eval04_gamma_entropy": sql(
        "SELECT series_id, round(f + coalesce(l, 0), 6) AS entropy FROM (SELECT series_id, sum(-p * ln(p)) AS f FROM g WHERE t = 1 GROUP BY 1) LEFT JOIN "
        "(SELECT a.series_id, sum(-a.p * b.p * ln(b.p)) AS l FROM g a JOIN g b ON a.series_id = b.series_id AND a.segment_id = b.segment_id AND b.t = a.t + 1 GROUP BY 1) USING (series_id)"
    ),
    "viz03_raster": sql("SELECT series_id, segment_id, t, arg_max(state, p * 1000 - state * 1e-9)::INT AS state FROM g GROUP BY 1, 2, 3"),
}
