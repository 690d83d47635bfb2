"""Further queries: labels, padding, chains, mixtures of predictions, projections of spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import decode_task as dec
from tidemark.operators import dynamics as d
from tidemark.operators import flips
from tidemark.operators import moments as m
from tidemark.operators import pairs as j
from tidemark.operators import preprocess as p
from tidemark.plans.dynamics import _r
from tidemark.plans.tables import K, SQL, gamma, long, observations, path, samples, sql
from tidemark.session import table
from tidemark.sources import series

COEF = ((1.0, 0.2), (0.5, 0.4), (2.0, -0.1), (1.5, 0.3), (0.8, 0.5))
LOADING = ((1, 1, 0.8), (1, 2, 0.6), (2, 1, -0.6), (2, 2, 0.8))


def _codes(s, f) -> DataFrame:
    return p.pairwise_classes(table(s, f, "embeddings").select("vec_id", F.col("label").cast("int").alias("label")), list(range(10))).drop("label")


def _predicted(s, f) -> DataFrame:
    """One-step predictions of x2: states' lines on the sample before, mixed by their probabilities."""
    before = samples(s, f).withColumn("x", F.lag("x2").over(Window.partitionBy("series_id", "segment_id").orderBy("t"))).filter("x IS NOT NULL")
    coef = s.createDataFrame([(k, a, b) for k, (a, b) in enumerate(COEF, 1)], "state int, a double, b double")
    mixed = gamma(s, f).join(F.broadcast(coef), "state").join(before.select("series_id", "segment_id", "t", "x", "x2"), ["series_id", "segment_id", "t"])
    return mixed.groupBy("series_id", "segment_id", "t").agg(F.first("x2").alias("y"), F.sum(F.col("p") * (F.col("a") + F.col("b") * F.col("x"))).alias("yhat"))


def _projected(s, f) -> DataFrame:
    """Power of two components in value bins, carried to channels by squared loadings and summed in bands."""
    power = samples(s, f).select(F.floor(F.col("x1") / 10).cast("double").alias("f"), F.inline(F.array(*(F.struct(F.lit(i).alias("pc"), F.col(c).alias("v")) for i, c in ((1, "x2"), (2, "x3"))))))
    power = power.groupBy("f", "pc").agg(F.avg("v").alias("v"))
    loading = s.createDataFrame(LOADING, "channel int, pc int, a double")
    spectra = power.join(F.broadcast(loading), "pc").groupBy("f", "channel").agg(F.sum(F.col("v") * F.col("a") * F.col("a")).alias("value"))
    return spectra.groupBy("channel", F.when(F.col("f") < 3, 1).otherwise(2).alias("band")).agg(F.sum("value").alias("value"))


def _segments(s, f) -> DataFrame:
    return path(s, f).groupBy("series_id", "segment_id").agg(F.count("*").alias("n"))


def _label_courses(s, f) -> DataFrame:
    labels = samples(s, f).groupBy("series_id", "segment_id").agg((F.avg("x1") > 20).cast("int").alias("label"))
    return d.label_resets(gamma(s, f), labels)


QUERIES = {
    "src04_length_check": lambda s, f: series.with_lengths(observations(s, f), _segments(s, f).withColumn("n", F.when(F.col("n") > 12, F.col("n") + 1).otherwise(F.col("n")))),
    "src05_trim_labels": lambda s, f: samples(s, f).filter("t > 2").select("series_id", "segment_id", "t", F.when(F.col("state") != 2, F.col("state")).alias("label")),
    "src13_default_fields": lambda s, f: samples(s, f).select("series_id", "segment_id", "t", F.coalesce(F.when(F.col("state") != 2, F.col("x3")), F.lit(0.1)).alias("prior")),
    "pre07_wrapped_phase": lambda s, f: _r(samples(s, f).select("series_id", "segment_id", "t", p.wrap_phase(F.col("x3") - F.col("x2")).alias("d")), "d"),
    "pre25_nearest_class": lambda s, f: p.nearest_class(samples(s, f).select("series_id", "segment_id", "t", (F.col("x2") - 2).alias("yhat"))).drop("yhat"),
    "pre26_binary_columns": lambda s, f: p.binary_columns(_codes(s, f), ["vec_id"]),
    "pre37_pad_path": lambda s, f: p.pad_path(path(s, f).filter("t > 1"), _segments(s, f)),
    "pre39_reconstruct": lambda s, f: _r(p.reconstruct(p.lag_design(long(s, f), [1, 2]), 3), "value"),
    "agg08_chain_pairs": lambda s, f: _r(d.chain_pairs(gamma(s, f)), "on_on", "on_off", "off_on", "off_off"),
    "agg14_prune": lambda s, f: _r(d.active_states(gamma(s, f), 5.0).groupBy("series_id", "state").agg(F.sum("p").alias("mass")), "mass"),
    "agg18_label_resets": lambda s, f: _r(_label_courses(s, f), "r"),
    "win16_labelled_stretches": lambda s, f: p.labelled_stretches(samples(s, f).withColumn("label", F.when(F.col("state") != 2, F.col("state"))), "label"),
    "eval11_mixed_prediction": lambda s, f: _r(m.prediction_error(_predicted(s, f), ["series_id"]), "mse", "fraction", "explained"),
    "dec08_r_squared_by_state": lambda s, f: _r(m.prediction_error(_predicted(s, f).join(path(s, f), ["series_id", "segment_id", "t"]), ["state"]).select("state", "explained"), "explained"),
    "dec10_mixed_precision": lambda s, f: _r(dec.mixed_coefficients(dec.mean_gamma(gamma(s, f)), s.createDataFrame([(k, 1, 1.0 / k) for k in range(1, K + 1)], "state int, term int, beta double")), "beta"),
    "spec19_projected_power": lambda s, f: _r(_projected(s, f), "value"),
    "stat34_sign_matrices": lambda s, f: j.apply_signs(
        samples(s, f).select("series_id").distinct().select("series_id", F.inline(F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.lit(1.0).alias("r")) for a in (1, 2, 3) for b in (1, 2, 3))))),
        samples(s, f).select("series_id").distinct().select("series_id", F.inline(F.array(*(F.struct(F.lit(c).alias("channel"), ((F.col("series_id") + c) % 2).cast("int").alias("flip")) for c in (1, 2, 3))))),
    ),
    "stat27_find_flips": lambda s, f: flips.find_flips(j.lagged_correlation(long(s, f), 1), 3),
    "join05_scatter_divergence": lambda s, f: j.scatter_divergence(samples(s, f), ["x1", "x2", "x3"]),
    "pre24_orthogonalised": lambda s, f: p.orthogonalised(samples(s, f), ["x1", "x2", "x3"]).select("series_id", "segment_id", "t", "orth1", "orth2", "orth3"),
}

_COEF = "coef(state, a, b) AS (VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(COEF, 1)) + ")"
_PRED = (
    f"{_COEF}, lagged AS (SELECT *, lag(x2) OVER (PARTITION BY series_id, segment_id ORDER BY t) AS x FROM s), "
    "pred AS (SELECT series_id, segment_id, t, l.state AS own, any_value(x2) AS y, sum(p * (a + b * x)) AS yhat FROM g JOIN coef USING (state) JOIN lagged l USING (series_id, segment_id, t) WHERE x IS NOT NULL GROUP BY 1, 2, 3, 4)"
)
_LOAD = "loading(channel, pc, a) AS (VALUES " + ", ".join(f"({c}, {i}, {a}::DOUBLE)" for c, i, a in LOADING) + ")"


def _with(extra: str, query: str) -> str:
    return f"WITH {SQL}, {extra} {query}"


ORACLES = {
    "src04_length_check": sql("SELECT series_id, segment_id, count(*) + 1 AS n, count(*) AS found FROM s GROUP BY 1, 2 HAVING count(*) > 12"),
    "src05_trim_labels": sql("SELECT series_id, segment_id, t, CASE WHEN state <> 2 THEN state END AS label FROM s WHERE t > 2"),
    "src13_default_fields": sql("SELECT series_id, segment_id, t, CASE WHEN state <> 2 THEN x3 ELSE 0.1 END::DOUBLE AS prior FROM s"),
    "pre07_wrapped_phase": sql("SELECT series_id, segment_id, t, round(CASE WHEN abs(x3 - x2) > pi() THEN 2 * pi() - abs(x3 - x2) ELSE abs(x3 - x2) END, 6) AS d FROM s"),
    "pre25_nearest_class": sql("SELECT series_id, segment_id, t, CASE WHEN x2 < 2 THEN -1 ELSE 1 END AS label FROM s"),
    "pre26_binary_columns": "SELECT vec_id, k::INT AS class, (label = k)::INT AS member FROM embeddings, range(0, 10) r(k)",
    "pre37_pad_path": sql("SELECT series_id, segment_id, t, CASE WHEN t > 1 THEN state END AS state FROM s"),
    "pre39_reconstruct": sql(
        "SELECT series_id, segment_id, t, channel, round(value, 6) AS value FROM (SELECT *, max(t) OVER (PARTITION BY series_id, segment_id) AS n FROM o) WHERE t BETWEEN 2 AND n - 1"
    ),
    "agg08_chain_pairs": sql(
        "SELECT series_id, state, round(sum(p * q), 6) AS on_on, round(sum(p * (1 - q)), 6) AS on_off, round(sum((1 - p) * q), 6) AS off_on, round(sum((1 - p) * (1 - q)), 6) AS off_off FROM "
        "(SELECT *, lead(p) OVER (PARTITION BY series_id, segment_id, state ORDER BY t) AS q FROM g) WHERE q IS NOT NULL GROUP BY 1, 2"
    ),
    "agg14_prune": sql(
        "SELECT series_id, state, round(sum(p), 6) AS mass FROM (SELECT series_id, state, p / sum(p) OVER (PARTITION BY series_id, segment_id, t) AS p FROM g WHERE state IN (SELECT state FROM g GROUP BY state HAVING sum(p) > 5)) GROUP BY 1, 2"
    ),
    "agg18_label_resets": _with(
        "lab AS (SELECT series_id, segment_id, (avg(x1) > 20)::INT AS label FROM s GROUP BY 1, 2), own AS (SELECT label, t, state, avg(p) AS p FROM g JOIN lab USING (series_id, segment_id) GROUP BY 1, 2, 3)",
        "SELECT label, own.state, round(corr(own.p, course.fo), 6) AS r FROM own JOIN course USING (t, state) GROUP BY 1, 2",
    ),
    "win16_labelled_stretches": sql(
        "SELECT series_id, segment_id, sum(c)::BIGINT AS stretches FROM (SELECT *, CASE WHEN lag(state = 2) OVER (PARTITION BY series_id, segment_id ORDER BY t) = (state = 2) THEN 0 ELSE 1 END AS c FROM s) GROUP BY 1, 2"
    ),
    "eval11_mixed_prediction": _with(
        _PRED,
        "SELECT series_id, round(avg((y - yhat) ** 2), 6) AS mse, round(avg((y - yhat) ** 2) / var_pop(y), 6) AS fraction, round(1 - avg((y - yhat) ** 2) / var_pop(y), 6) AS explained FROM pred GROUP BY 1",
    ),
    "dec08_r_squared_by_state": _with(_PRED, "SELECT own AS state, round(1 - avg((y - yhat) ** 2) / var_pop(y), 6) AS explained FROM pred GROUP BY 1"),
    "dec10_mixed_precision": sql("SELECT t, 1 AS term, round(sum(m / state), 6) AS beta FROM (SELECT t, state, avg(p) AS m FROM g GROUP BY 1, 2) GROUP BY 1"),
    "spec19_projected_power": _with(
        f"{_LOAD}, power AS (SELECT floor(x1 / 10) AS f, unnest([1, 2]) AS pc, unnest([x2, x3]) AS v FROM s), mean AS (SELECT f, pc, avg(v) AS v FROM power GROUP BY 1, 2)",
        "SELECT channel, CASE WHEN f < 3 THEN 1 ELSE 2 END AS band, round(sum(v * a * a), 6) AS value FROM mean JOIN loading USING (pc) GROUP BY 1, 2",
    ),
    "stat34_sign_matrices": sql(
        "SELECT series_id, i::INT AS i, j::INT AS j, ((1 - 2 * ((series_id + i) % 2)) * (1 - 2 * ((series_id + j) % 2)))::DOUBLE AS r FROM (SELECT DISTINCT series_id FROM s), range(1, 4) a(i), range(1, 4) b(j)"
    ),
}
