"""Seeded generators: state paths, Gaussian and autoregressive series of given models.

A segment is generated where its row is, from a seed that depends on its keys, so any executor
gives the same series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import uniform


def segment_grid(spark: SparkSession, n_series: int, n_segments: int, length: int) -> DataFrame:
    """(series_id, segment_id, n)."""
    ids = spark.range(n_series * n_segments)
    return ids.select((F.floor(F.col("id") / n_segments) + 1).alias("series_id"), (F.col("id") % n_segments + 1).alias("segment_id"), F.lit(length).alias("n"))


def _generator(seed: int, series: int, segment: int) -> np.random.Generator:
    return np.random.default_rng([seed, int(series), int(segment)])


def state_path(rng: np.random.Generator, n: int, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """States 1 … K of a Markov chain."""
    u, out = rng.random(n), np.empty(n, np.int32)
    rows, state = np.cumsum(transition, 1), int(np.searchsorted(np.cumsum(start), u[0], side="right")) if n else 0
    for t in range(n):
        state = min(state, len(start) - 1) if t == 0 else min(int(np.searchsorted(rows[state], u[t], side="right")), len(start) - 1)
        out[t] = state + 1
    return out


def _simulated(segments: DataFrame, make, schema: str) -> DataFrame:
    def run(batches):
        for rows in batches:
            for series, segment, n in rows[["series_id", "segment_id", "n"]].itertuples(index=False):
                yield pd.DataFrame({"series_id": series, "segment_id": segment, "t": np.arange(1, n + 1, dtype=np.int32)} | make(series, segment, n))

    return segments.mapInPandas(run, f"series_id bigint, segment_id bigint, t int, {schema}")


def paths(segments: DataFrame, transition, start, seed: int = 0) -> DataFrame:
    """(series_id, segment_id, t, state) for each row of ``segments``."""
    p, pi = np.asarray(transition, float), np.asarray(start, float)
    return _simulated(segments, lambda a, b, n: {"state": state_path(_generator(seed, a, b), n, p, pi)}, "state int")


def gaussian_series(segments: DataFrame, transition, start, means, covariances, seed: int = 0) -> DataFrame:
    """(…, t, state, x): samples of the state's normal distribution."""
    p, pi, mu = (np.asarray(v, float) for v in (transition, start, means))
    roots = np.stack([np.linalg.cholesky(np.atleast_2d(c)) for c in covariances])

    def make(a, b, n):
        rng = _generator(seed, a, b)
        s = state_path(rng, n, p, pi) - 1
        x = mu[s] + np.einsum("nij,nj->ni", roots[s], rng.standard_normal((n, mu.shape[1])))
        return {"state": s + 1, "x": list(x)}

    return _simulated(segments, make, "state int, x array<double>")


def autoregressive_series(segments: DataFrame, coef, cov, orders, burn: int = 200, seed: int = 0) -> DataFrame:
    """(…, t, x) of a vector autoregression with zero mean; ``coef`` is (lags, to, from)."""
    a, root, top = np.asarray(coef, float), np.linalg.cholesky(np.atleast_2d(cov)), max(orders)

    def make(series, segment, n):
        rng = _generator(seed, series, segment)
        x = rng.standard_normal((n + burn, len(root))) @ root.T
        for t in range(top, n + burn):
            x[t] += sum(a[i] @ x[t - o] for i, o in enumerate(orders))
        return {"x": list(x[burn:])}

    return _simulated(segments, make, "x array<double>")


def like_observed(observations: DataFrame, names, order: int, segments: DataFrame, seed: int = 0) -> DataFrame:
    """(…, t, x) of an autoregression fitted to columns ``names`` of ``observations``, means added; order 0
    draws from one normal."""
    from tidemark.operators import moments

    if order == 0:
        sums = moments.matrix(moments.products(observations, names).collect(), len(names))
        mean = sums[0, 1:] / sums[0, 0]
        return gaussian_series(segments, [[1.0]], [1.0], [mean], [moments.covariance_from(sums)], seed).drop("state")
    orders = list(range(1, order + 1))
    found = moments.fit_mar(observations, names, orders)
    body = found["coef"][1:].reshape(order, len(names), len(names)).transpose(0, 2, 1)
    mean = np.linalg.solve(np.eye(len(names)) - body.sum(0), found["coef"][0])
    plain = autoregressive_series(segments, body, found["cov"], orders, seed=seed)
    return plain.withColumn("x", F.expr(f"transform(x, (v, i) -> v + array({', '.join(f'{m!r}D' for m in map(float, mean))})[i])"))


def delay_series(segments: DataFrame, covariance, channels: int, burn: int = 200, seed: int = 0) -> DataFrame:
    """(…, t, x) whose windows of M samples have a given covariance: rows and columns run over lags from the
    oldest to the newest, channels within. Each sample is drawn given the M - 1 before it; ``burn`` samples at
    the start are dropped."""
    s = np.asarray(covariance, float)
    past = len(s) - channels
    gain = np.linalg.solve(s[:past, :past], s[:past, past:]) if past else np.zeros((0, channels))
    root = np.linalg.cholesky(s[past:, past:] - s[past:, :past] @ gain)

    def make(series, segment, n):
        x = _generator(seed, series, segment).standard_normal((n + burn, channels)) @ root.T
        lags = past // channels
        for t in range(lags, n + burn):
            x[t] += x[t - lags : t].ravel() @ gain
        return {"x": list(x[burn:])}

    return _simulated(segments, make, "x array<double>")


def surrogate_path(visits: DataFrame, occupancy: list[float], seed: int = 0) -> DataFrame:
    """Keeps the visits' limits and draws each one's state anew from the occupancies."""
    u = uniform(F.col("series_id"), F.col("segment_id"), F.col("start_t"), seed=seed)
    state = F.lit(len(occupancy))
    for k, share in reversed(list(enumerate(np.cumsum(occupancy)[:-1], 1))):
        state = F.when(u < float(share), F.lit(k)).otherwise(state)
    return visits.withColumn("state", state)
