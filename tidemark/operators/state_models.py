"""What is read from, or drawn with, models of states: means, regressions and connectivities of each
state, logistic bounds, projections, life times, seeded draws.

Sums over samples are one aggregate each; matrices of a few channels are solved where their sums are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import bound_slope, log_sigmoid, uniform
from tidemark.functions.special import mean_life_time
from tidemark.operators import moments

KEY = ("series_id", "segment_id")


def gamma_square(gamma: DataFrame) -> DataFrame:
    """Expected square of a binary state: p² + p (1 - p)."""
    return gamma.withColumn("p", F.col("p") * F.col("p") + F.col("p") * (1 - F.col("p")))


def row_products(rows: DataFrame) -> DataFrame:
    """Adds ``c``: the row vector ``a`` times the matrix ``b`` (array of rows), times ``g``."""
    products = "transform(sequence(0, size(b[0]) - 1), k -> g * aggregate(zip_with(a, b, (x, r) -> x * r[k]), 0D, (s, v) -> s + v))"
    return rows.withColumn("c", F.expr(products))


def state_means(wide: DataFrame, names: Sequence[str], weight: Column) -> DataFrame:
    """(state, mean array): weighted means of columns by state."""
    return wide.groupBy("state").agg(F.array(*(F.sum(weight * F.col(n)) / F.sum(weight) for n in names)).alias("mean"))


def projected_means(means: DataFrame, loadings) -> DataFrame:
    """(state, channel, mean): means of components carried back to channels by loadings (channels, components)."""
    cells = [F.struct(F.lit(r).alias("channel"), sum((F.col("mean")[k] * float(a) for k, a in enumerate(row)), F.lit(0.0)).alias("mean")) for r, row in enumerate(loadings, 1)]
    return means.select("state", F.inline(F.array(*cells)))


def projected_coefficients(spark: SparkSession, weights, loadings) -> DataFrame:
    """(to, from, w): coefficients of one lag among components, carried to channels: A W A'."""
    a = np.asarray(loadings, float)
    full = a @ np.asarray(weights, float) @ a.T
    return spark.createDataFrame([(r + 1, k + 1, float(x)) for (r, k), x in np.ndenumerate(full)], "to int, from int, w double")


def regression_by_state(wide: DataFrame, predictors: Sequence[str], target: str, weight: Column, by: Sequence[str] = ("state",), ridge: float = 0.0) -> DataFrame:
    """(by…, term, beta): weighted least squares with intercept (term 0) in each group; groups whose normal
    equations can't be solved are left out."""
    k = len(predictors)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        sums = moments.matrix(rows[["i", "j", "s"]].itertuples(index=False), k + 1)
        x = sums[: k + 1, : k + 1] + ridge * np.eye(k + 1)
        if np.linalg.matrix_rank(x) <= k:
            return pd.DataFrame(columns=[*by, "term", "beta"])
        return pd.DataFrame({b: rows[b].iloc[0] for b in by} | {"term": np.arange(k + 1, dtype=np.int32), "beta": np.linalg.solve(x, sums[: k + 1, k + 1])})

    sums = moments.products(wide, [*predictors, target], weight, by)
    schema = ", ".join(f"{b} {wide.schema[b].dataType.simpleString()}" for b in by) + ", term int, beta double"
    return sums.groupBy(*by).applyInPandas(solve, schema)


def stability(coefficients: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by…, stable) of one-channel autoregressions (by…, term, beta), term the lag: all roots of the
    companion matrix lie inside the unit circle."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        beta = rows.sort_values("term")["beta"].to_numpy()
        companion = np.vstack([beta, np.eye(len(beta) - 1, len(beta))])
        return pd.DataFrame({b: [rows[b].iloc[0]] for b in by} | {"stable": [bool(np.abs(np.linalg.eigvals(companion)).max() < 1)]})

    schema = ", ".join(f"{b} {coefficients.schema[b].dataType.simpleString()}" for b in by) + ", stable boolean"
    return coefficients.groupBy(*by).applyInPandas(run, schema)


def connectivity(covariances: DataFrame, d: int) -> DataFrame:
    """(state, i, j, cov) for i <= j → (state, i, j, r, partial) for i < j: correlations, and correlations
    given all other channels."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros((d, d))
        for i, j, v in rows[["i", "j", "cov"]].itertuples(index=False):
            c[i - 1, j - 1] = c[j - 1, i - 1] = v
        inverse = np.linalg.inv(c)
        i, j = np.triu_indices(d, 1)
        scale = lambda m: m[i, j] / np.sqrt(m[i, i] * m[j, j])
        return pd.DataFrame({"state": rows["state"].iloc[0], "i": (i + 1).astype(np.int32), "j": (j + 1).astype(np.int32), "r": scale(c), "partial": -scale(inverse)})

    return covariances.groupBy("state").applyInPandas(run, "state int, i int, j int, r double, partial double")


def logistic_points(rows: DataFrame) -> DataFrame:
    """Adds ``psi`` and ``likelihood`` to rows of a design ``x``, a class ``y`` of -1 or 1 (0 is none), the
    mean of the weights and their second moments ``second`` (row order): the point at which the bound of
    the sigmoid is tightest, and the bound there. A row without a class has null for both."""
    dot = "aggregate(zip_with(x, mean, (a, b) -> a * b), 0D, (s, v) -> s + v)"
    quadratic = "aggregate(transform(x, (a, i) -> aggregate(zip_with(x, slice(second, i * size(x) + 1, size(x)), (b, c) -> a * b * c), 0D, (s, v) -> s + v)), 0D, (s, v) -> s + v)"
    found = rows.withColumn("square", F.expr(quadratic)).withColumn("psi", F.when(F.col("y") != 0, F.sqrt("square"))).withColumn("logit", F.expr(dot))
    bound = log_sigmoid(F.col("psi")) + (F.col("y") * F.col("logit") - F.col("psi")) / 2 - bound_slope(F.col("psi")) * (F.col("square") - F.col("psi") * F.col("psi"))
    return found.withColumn("likelihood", bound).drop("square", "logit")


def quadratic_by_code(rows: DataFrame, matrix) -> DataFrame:
    """(…, trace): x' M x of each row, computed once for each distinct ``x`` and joined back. The codes of
    a design of classes are few; where they aren't both sides of the join are shuffled."""
    m = [[float(v) for v in row] for row in matrix]
    value = sum((F.col("x")[i] * F.col("x")[j] * m[i][j] for i in range(len(m)) for j in range(len(m))), F.lit(0.0))
    codes = rows.select("x").distinct().withColumn("trace", value)
    return rows.join(codes, "x").drop("x")


def autocovariances(long: DataFrame, max_lag: int) -> DataFrame:
    """(i, j, lag, c): covariance of x_i(t - lag) with x_j(t) over all segments."""
    w = Window.partitionBy(*KEY, "channel").orderBy("t")
    shifted = F.array(*(F.struct(F.lit(k).alias("lag"), F.lag("value", k).over(w).alias("x")) for k in range(max_lag + 1)))
    past = long.select(*KEY, "t", F.col("channel").alias("i"), shifted.alias("s")).select(*KEY, "t", "i", F.inline("s")).filter("x IS NOT NULL")
    now = long.select(*KEY, "t", F.col("channel").alias("j"), F.col("value").alias("y"))
    return past.join(now, [*KEY, "t"]).groupBy("i", "j", "lag").agg(F.covar_pop("x", "y").alias("c"))


def spectrum_of_autocovariances(covariances: DataFrame, freqs: Sequence[float]) -> DataFrame:
    """(i, f, psd) of autocovariances (i, lag, c), lag from 0: c0 + 2 sum of c cos(2 pi f lag)."""
    f = F.explode(F.array(*(F.lit(float(x)) for x in freqs))).alias("f")
    term = F.col("c") * F.when(F.col("lag") == 0, 1.0).otherwise(2 * F.cos(2 * math.pi * F.col("f") * F.col("lag")))
    return covariances.select("i", "lag", "c", f).groupBy("i", "f").agg(F.sum(term).alias("psd"))


def life_time_of(diagonal: float, k: int) -> float:
    """Expected life time, in samples, under Dirichlet counts of ``diagonal`` on the diagonal and one elsewhere."""
    return mean_life_time(diagonal / (diagonal + k - 1))


def life_time_column(diagonal: Column, k: int) -> Column:
    p = diagonal / (diagonal + k - 1)
    return 1 - (p - 1) / (F.log(p) * F.log(p))


def diagonal_for(life_time: float, k: int) -> float:
    """The diagonal count that gives an expected life time, by bisection; 1 where the shortest is longer."""
    if k == 1 or life_time <= life_time_of(1.0, k):
        return 1.0
    low, high = 1e-7, 1 - 1e-12
    for _ in range(200):
        p = (low + high) / 2
        low, high = (p, high) if mean_life_time(p) < life_time else (low, p)
    return (k - 1) * low / (1 - low)


def simulated_life_times(spark: SparkSession, diagonal: float, k: int, segments: int, length: int, seed: int = 0) -> DataFrame:
    """(state, life_time): mean lengths of the visits of simulated paths, those cut by an end left out."""
    from tidemark.operators.dynamics import visits
    from tidemark.operators.simulate import paths, segment_grid

    stay = diagonal / (diagonal + k - 1)
    transition = np.full((k, k), (1 - stay) / max(1, k - 1)) + np.eye(k) * (stay - (1 - stay) / max(1, k - 1))
    runs = visits(paths(segment_grid(spark, segments, 1, length), transition, np.full(k, 1 / k), seed))
    return runs.filter("start_t > 1 AND NOT is_last").groupBy("state").agg(F.avg("length").alias("life_time"))


def multinomial(units: DataFrame, keys: Sequence[str], shares: Sequence[float], draws: int, seed: int = 0) -> DataFrame:
    """(keys…, k, n): how often each class comes up in ``draws`` draws of a unit; the last class takes what
    the shares leave."""
    u = units.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    x, k = uniform(*map(F.col, keys), F.col("draw"), seed=seed), F.lit(len(shares))
    for n, top in reversed(list(enumerate(np.cumsum(shares)[:-1], 1))):
        k = F.when(F.col("u") < float(top), n).otherwise(k)
    drawn = u.withColumn("u", x).withColumn("c", k)
    counts = [F.struct(F.lit(n).alias("k"), F.count_if(F.col("c") == n).alias("n")) for n in range(1, len(shares) + 1)]
    return drawn.groupBy(*keys).agg(F.array(*counts).alias("n")).select(*keys, F.inline("n"))


#: Ranges of the draws that units are counted in before they are ranked.
RANGES = 4096


def random_groups(units: DataFrame, unit: str, groups: int, seed: int = 0) -> DataFrame:
    """Adds ``part`` 1 … ``groups``: a random partition into parts of floor(n / groups), the last of which
    takes the rest. Units are ranked within ranges of their draws, whose counts (``RANGES`` numbers) are
    added up on the driver, so no task sorts all of them."""
    drawn = units.withColumn("u", uniform(F.col(unit), seed=seed)).withColumn("range", F.floor(F.col("u") * RANGES).cast("int"))
    counts = np.zeros(RANGES + 1, np.int64)
    for r, n in drawn.groupBy("range").count().collect():
        counts[r + 1] = n
    before = np.cumsum(counts)
    each = max(1, int(before[-1]) // groups)
    starts = F.broadcast(units.sparkSession.createDataFrame([(r, int(b)) for r, b in enumerate(before[:-1])], "range int, before bigint"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("u", unit)) - 1 + F.col("before")
    return drawn.join(starts, "range").withColumn("part", (F.least(F.floor(place / each), F.lit(groups - 1)) + 1).cast("int")).drop("u", "range", "before")


def gaussian_noise(gamma: DataFrame, means: Sequence[float], sds: Sequence[float], seed: int = 0) -> DataFrame:
    """(series_id, segment_id, t, x): one channel of states' normal draws, weighted by their probabilities.
    Draws are Box and Muller's of two uniforms that follow from the keys."""
    keys = [F.col(c) for c in (*KEY, "t", "state")]
    z = F.sqrt(-2 * F.log(1 - uniform(*keys, F.lit(1), seed=seed))) * F.cos(2 * math.pi * uniform(*keys, F.lit(2), seed=seed))
    pick = lambda values: F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.col("state"))
    return gamma.groupBy(*KEY, "t").agg(F.sum(F.col("p") * (pick(means) + pick(sds) * z)).alias("x"))
