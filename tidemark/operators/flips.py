"""Polarity of channels: flips that make the series' lagged correlations agree.

Each round takes the mean of all signed correlation tensors (channels squared by lags numbers, one
aggregate) and lets every series, where it is, choose the flips that agree best with it; rounds end
when nothing changes. Of flips that agree equally well the one with fewer flipped channels is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

KEY = ("series_id", "segment_id")


def best_flips(tensor: np.ndarray, target: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Signs of one series (lags, d, d) by flipping channels one at a time while the agreement grows."""
    signs = start.copy()
    product = (tensor * target).sum(0)
    product = product + product.T
    np.fill_diagonal(product, 0)
    while True:
        gain = -2 * signs * (product @ signs)
        k = int(gain.argmax())
        if gain[k] <= 1e-12:
            break
        signs[k] *= -1
    return -signs if (signs < 0).sum() > len(signs) / 2 else signs


def _best_signs(product: np.ndarray, start: np.ndarray, exact: int = 10) -> np.ndarray:
    """Signs of the largest s' P s: all of them tried for few channels, else single flips from ``start`` and from
    it with each channel flipped."""
    d = len(product)
    if d <= exact:
        every = 1 - 2 * ((np.arange(1 << (d - 1))[:, None] >> np.arange(d)) & 1)
        best = every[np.einsum("ni,ij,nj->n", every, product, every).argmax()].astype(float)
    else:
        tried = []
        for first in range(-1, d):
            s = start.copy()
            s[first] *= -1 if first >= 0 else 1
            while (gain := -2 * s * (product @ s)).max() > 1e-12:
                s[int(gain.argmax())] *= -1
            tried.append(s)
        best = max(tried, key=lambda s: s @ product @ s)
    return -best if (best < 0).sum() > d / 2 else best


def _settled(tensor: np.ndarray, target: np.ndarray, p: np.ndarray, weight: float, rounds: int = 50) -> np.ndarray:
    """Probabilities of unflipped channels of one series, channel by channel given the others, until they settle."""
    product = weight * (tensor * target).sum(0)
    product = product + product.T
    np.fill_diagonal(product, 0)
    signs = _best_signs(product, np.where(p < 0.5, -1.0, 1.0))
    if signs @ product @ signs > (2 * p - 1) @ product @ (2 * p - 1) + 1e-9:
        p = np.where(signs < 0, 0.1, 0.9)
    for _ in range(rounds):
        before = p.copy()
        for c in range(len(p)):
            p[c] = 1 / (1 + np.exp(-np.clip(product[c] @ (2 * p - 1), -500, 500)))
        if np.abs(p - before).max() < 1e-6:
            break
    return p


def flip_posteriors(correlations: DataFrame, channels: int, rounds: int = 1000) -> DataFrame:
    """(series_id, channel, p_unflipped, flip): probabilities under a template that all series share. The series
    of the strongest correlations starts the template; each round is one aggregate for the template, to which
    series add their expected signs, and one pass in which they take theirs from it. Rounds end when no flip
    changes. A channel that most series would flip is taken the other way round for all."""
    lags = correlations.agg(F.max("lag")).first()[0] + 1
    shape = (lags, channels, channels)
    cells = F.array_sort(F.collect_list(F.struct("lag", "i", "j", "r")))
    rows = correlations.groupBy("series_id").agg(cells.alias("c"), F.sum(F.when(F.col("i") != F.col("j"), F.abs("r")).otherwise(0.0)).alias("strength")).select("series_id", F.col("c.r").alias("r"), "strength")
    current = stage(rows, "flips")
    n = current.count()
    if not n:
        return current.select("series_id", F.lit(0).alias("channel"), F.lit(0.0).alias("p_unflipped"), F.lit(0).alias("flip"))
    first = current.orderBy(F.desc("strength"), "series_id").limit(1).collect()[0]
    target = np.nan_to_num(np.array(first["r"], float).reshape(shape))
    current = current.select("series_id", "r", F.array_repeat(F.lit(0.9), channels).alias("p"))
    schema = "series_id bigint, r array<double>, p array<double>, changed boolean"

    def step(target: np.ndarray, weight: float):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out, changed = [], []
                for r, p in b[["r", "p"]].itertuples(index=False):
                    old = np.array(p, float)
                    new = _settled(np.nan_to_num(np.array(r, float).reshape(shape)), target, old.copy(), weight)
                    out.append(new.tolist())
                    changed.append(bool(((new < 0.5) != (old < 0.5)).any()))
                yield pd.DataFrame({"series_id": b["series_id"], "r": b["r"], "p": out, "changed": changed})

        return run

    sign = lambda index: F.expr(f"2 * p[int({index})] - 1")
    for turn in range(rounds):
        current = stage(current.select("series_id", "r", "p").mapInPandas(step(target, 10.0), schema), "flips")
        if turn and current.filter("changed").isEmpty():
            break
        place = current.select(F.posexplode("r").alias("k", "v"), "p")
        own = F.expr(f"int((k div {channels}) % {channels}) = int(k % {channels})")
        mean = place.groupBy("k").agg(F.avg(F.col("v") * F.when(own, 1.0).otherwise(sign(f"(k div {channels}) % {channels}") * sign(f"k % {channels}"))).alias("m"))
        target = np.zeros(shape)
        for k, v in mean.collect():
            target.reshape(-1)[k] = v or 0.0
    found = current.select("series_id", F.posexplode("p").alias("c", "p")).select("series_id", (F.col("c") + 1).alias("channel"), F.col("p").alias("p_unflipped"))
    most = found.groupBy("channel").agg((F.avg((F.col("p_unflipped") < 0.5).cast("double")) > 0.5).alias("turned"))
    p = F.when(F.col("turned"), 1 - F.col("p_unflipped")).otherwise(F.col("p_unflipped"))
    return found.join(F.broadcast(most), "channel").select("series_id", "channel", p.alias("p_unflipped"), (p < 0.5).cast("int").alias("flip"))


def align_to_events(observations: DataFrame, events: DataFrame, window: tuple[int, int]) -> DataFrame:
    """(series_id, segment_id, flip): polarity of segments against the mean response of those before. Responses
    around the ``events`` (series_id, segment_id, t) are joined and averaged by segments; then segments come to
    the driver in order of their keys, one at a time, which keeps their running sum only. Events whose window
    leaves the segment don't count; a segment without any isn't flipped."""
    n = observations.groupBy(*KEY).agg(F.max("t").alias("n"))
    inside = events.join(n, list(KEY)).filter((F.col("t") + window[1] <= F.col("n")) & (F.col("t") + window[0] >= 1))
    around = inside.select(*KEY, F.explode(F.sequence(F.lit(window[0]), F.lit(window[1]))).alias("at"), "t").select(*KEY, "at", (F.col("t") + F.col("at")).cast("int").alias("t"))
    values = around.join(observations, [*KEY, "t"]).select(*KEY, "at", F.posexplode("x").alias("c", "v")).groupBy(*KEY, "at", "c").agg(F.avg("v").alias("v"))
    responses = values.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "c", "v"))).alias("r")).select(*KEY, F.col("r.v").alias("v")).orderBy(*KEY)
    total, out = None, []
    for row in stage(responses, "responses").orderBy(*KEY).toLocalIterator():
        y = np.array(row.v)
        flip = total is not None and np.abs(total + y).sum() < np.abs(total - y).sum()
        total = (-y if flip else y) if total is None else total + (-y if flip else y)
        out.append((row.series_id, row.segment_id, int(flip)))
    return observations.sparkSession.createDataFrame(out, "series_id bigint, segment_id bigint, flip int")


def find_flips(correlations: DataFrame, channels: int) -> DataFrame:
    """(series_id, i, j, lag, r) → (series_id, channel, flip). Each change of a flip raises the summed
    agreement with the mean, so the rounds end."""
    lags = correlations.agg(F.max("lag")).first()[0] + 1
    cells = F.array_sort(F.collect_list(F.struct("lag", "i", "j", "r")))
    current = stage(correlations.groupBy("series_id").agg(cells.alias("c")).select("series_id", F.col("c.r").alias("r"), F.array_repeat(F.lit(1), channels).alias("signs")), "flips")
    shape = (lags, channels, channels)
    schema = "series_id bigint, r array<double>, signs array<int>, changed boolean"

    def step(target: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                out, changed = [], []
                for r, signs in rows[["r", "signs"]].itertuples(index=False):
                    old = np.array(signs, float)
                    new = best_flips(np.array(r, float).reshape(shape), target, old)
                    out.append(new.astype(np.int32).tolist())
                    changed.append(bool((new != old).any()))
                yield pd.DataFrame({"series_id": rows["series_id"], "r": rows["r"], "signs": out, "changed": changed})

        return run

    while True:
        target = np.zeros(shape)
        place = current.select(F.posexplode("r").alias("k", "v"), "signs").groupBy("k").agg(
            F.avg(F.col("v") * F.expr(f"signs[int((k div {channels}) % {channels})]") * F.expr(f"signs[int(k % {channels})]")).alias("m")
        )
        for k, v in place.collect():
            target.reshape(-1)[k] = v or 0.0
        current = stage(current.select("series_id", "r", "signs").mapInPandas(step(target), schema), "flips")
        if current.filter("changed").isEmpty():
            break
    return current.select("series_id", F.posexplode("signs").alias("c", "s")).select("series_id", (F.col("c") + 1).alias("channel"), (F.col("s") < 0).cast("int").alias("flip"))
