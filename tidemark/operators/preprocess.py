"""Transforms of series: scaling, trends, lags, designs, cleaning and resampling.

``long`` frames have (series_id, segment_id, t, channel, value). Per-segment statistics are windows
over (series_id, segment_id, channel); lags are window functions, so nothing leaves the JVM except
the recursive filters and Fourier transforms, which run per segment through Arrow.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import small_batches

KEY = ("series_id", "segment_id")
CHANNEL = (*KEY, "channel")


def standardise(long: DataFrame) -> DataFrame:
    """Per-segment z-scores with the n - 1 standard deviation. A channel without variance is an error."""
    w = Window.partitionBy(*CHANNEL)
    scored = long.select("*", F.avg("value").over(w).alias("m"), F.stddev_samp("value").over(w).alias("sd"))
    guard = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.raise_error(F.lit("a channel has no variance")).cast("double"))
    return scored.withColumn("value", (F.col("value") - F.col("m")) / guard).drop("m", "sd")


def flat_channels(long: DataFrame) -> DataFrame:
    """Segments and channels without variance."""
    return long.groupBy(*CHANNEL).agg(F.stddev_samp("value").alias("sd")).filter("sd IS NULL OR sd = 0").select(*CHANNEL)


def clean(long: DataFrame) -> DataFrame:
    """Without the segments in which any channel has no variance."""
    return long.join(flat_channels(long).select(*KEY).distinct(), list(KEY), "left_anti")


def detrend(long: DataFrame) -> DataFrame:
    """Residuals of a straight line over t, per segment and channel."""
    w = Window.partitionBy(*CHANNEL)
    slope = F.coalesce(F.covar_pop("t", "value").over(w) / F.nullif(F.var_pop("t").over(w), F.lit(0.0)), F.lit(0.0))
    line = F.avg("value").over(w) + F.col("slope") * (F.col("t") - F.avg("t").over(w))
    return long.withColumn("slope", slope).withColumn("value", F.col("value") - line).drop("slope")


def embed(long: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Time-delay embedding in long form: (t, channel, lag, value) with value = x(t - lag); samples
    whose lags don't all lie in the segment are dropped. Columns are channel-major."""
    lags = sorted(lags)
    w = Window.partitionBy(*CHANNEL).orderBy("t")
    shifted = [F.struct(F.lit(lag).alias("lag"), F.lag("value", lag).over(w).alias("value")) for lag in lags]
    n = F.count("*").over(Window.partitionBy(*CHANNEL))
    inside = (F.col("t") > max(0, *lags)) & (F.col("t") <= F.col("n") + min(0, *lags))
    rows = long.select(*CHANNEL, "t", n.alias("n"), F.array(*shifted).alias("s")).filter(inside)
    return rows.select(*CHANNEL, "t", F.inline("s"))


def unwrap_embedding(embedded: DataFrame) -> DataFrame:
    """Overlap-add of an embedding: the mean of all copies of each sample."""
    back = embedded.groupBy(*CHANNEL, (F.col("t") - F.col("lag")).alias("t"))
    return back.agg(F.avg("value").alias("value"), F.count("*").alias("n_copies"))


def lag_orders(time_lag: int, order: int, exp_time_lag: float = 1.0, offset: int = 0) -> list[int]:
    """The lags of an autoregression: evenly spaced, or spaced ever wider when ``exp_time_lag`` > 1."""
    if exp_time_lag <= 1:
        return list(range(offset + 1, order + 1, time_lag))
    found, step = [offset + 1], 1.0
    while (lag := found[-1] + math.floor(step + 0.5)) <= order:  # gaps are rounded, halves upwards
        found.append(lag)
        step *= exp_time_lag
    return found


def lag_design(long: DataFrame, orders: Sequence[int], intercept: bool = False) -> DataFrame:
    """Autoregressive design in long form: (t, column, value), lag-major then channel, for samples
    after the largest lag; with an intercept, column 0 is one."""
    w = Window.partitionBy(*CHANNEL).orderBy("t")
    channels = F.max("channel").over(Window.partitionBy(*KEY))
    cells = [F.struct((F.lit(i) * F.col("k") + F.col("channel")).alias("column"), F.lag("value", o).over(w).alias("value")) for i, o in enumerate(orders)]
    rows = long.withColumn("k", channels).select(*KEY, "t", "channel", F.array(*cells).alias("s")).filter(F.col("t") > max(orders))
    out = rows.select(*KEY, "t", F.inline("s"))
    if intercept:
        ones = rows.filter("channel = 1").select(*KEY, "t", F.lit(0).alias("column"), F.lit(1.0).alias("value"))
        out = out.unionByName(ones)
    return out


def aligned_response(long: DataFrame, orders: Sequence[int]) -> DataFrame:
    """The samples that a lag design predicts."""
    return long.filter(F.col("t") > max(orders))


def decimate(long: DataFrame, q: int) -> DataFrame:
    """Every q-th sample, renumbered from 1."""
    return long.filter((F.col("t") - 1) % q == 0).withColumn("t", ((F.col("t") - 1) / q + 1).cast("int"))


def wrap_phase(difference: Column) -> Column:
    """Circular difference of two phases: the absolute difference, folded at pi."""
    d = F.abs(difference)
    return F.when(d > np.pi, 2 * np.pi - d).otherwise(d)


def pairwise_classes(labels: DataFrame, classes: Sequence[int]) -> DataFrame:
    """One-against-one coding: per pair of classes 1 for the first, -1 for the second, 0 for others."""
    pairs = [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]
    coded = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.col("label") == a, 1).when(F.col("label") == b, -1).otherwise(0).alias("code")) for a, b in pairs]
    return labels.select("*", F.inline(F.array(*coded)))


def hard_max(scores: DataFrame) -> DataFrame:
    """``scores`` array → one-hot array of its largest entry."""
    return scores.withColumn("hard", F.expr("transform(scores, x -> int(x = array_max(scores)))"))


def mask_segments(samples: DataFrame) -> DataFrame:
    """Good samples only (boolean ``good``), with a new segment for each unbroken run and t from 1."""
    w = Window.partitionBy(*KEY).orderBy("t")
    broken = F.when(F.lag("good").over(w) == F.col("good"), 0).otherwise(1)
    runs = samples.withColumn("c", broken).withColumn("run", F.sum("c").over(w))
    numbered = runs.filter("good").withColumn("t", F.row_number().over(Window.partitionBy(*KEY, "run").orderBy("t")))
    return numbered.withColumn("run", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("run"))).drop("c", "good")


def per_segment(long: DataFrame, function) -> DataFrame:
    """Applies ``function(values)`` to each segment and channel as a numpy array of equal length."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        return rows.assign(value=function(rows["value"].to_numpy(float)))

    return long.groupBy(*CHANNEL).applyInPandas(run, long.schema)


def many_segments(long: DataFrame, function) -> DataFrame:
    """Applies ``function`` to lists of segments' values, those of an Arrow batch that are of like length at a
    time: for what is a loop over time, taken by all of them together."""
    import pyarrow as pa

    from tidemark.operators.inference import BATCH_SEGMENTS, of_like_length

    rows = F.array_sort(F.collect_list(F.struct("t", "value")))
    held = long.groupBy(*CHANNEL).agg(rows.alias("r")).select(*CHANNEL, F.col("r.t").alias("t"), F.col("r.value").alias("v"))
    small_batches(long.sparkSession, BATCH_SEGMENTS)

    def run(batches):
        for batch in batches:
            for part in of_like_length(batch):
                found = function([np.asarray(v.values, float) for v in part.column("v")])
                columns = {c: part.column(c) for c in (*CHANNEL, "t")}
                yield pa.RecordBatch.from_pydict(columns | {"v": pa.array([x.tolist() for x in found], pa.list_(pa.float64()))})

    kinds = {c: long.schema[c].dataType.simpleString() for c in (*CHANNEL, "t")}
    filtered = held.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in CHANNEL) + f", t array<{kinds['t']}>, v array<double>")
    return filtered.select(*CHANNEL, F.inline(F.arrays_zip("t", "v"))).select(*CHANNEL, "t", F.col("v").alias("value"))


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal by the Fourier transform."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def envelope(long: DataFrame) -> DataFrame:
    """Magnitude of the analytic signal."""
    return per_segment(long, lambda x: np.abs(analytic(x)))


def butterworth(order: int, band: tuple[float, float], fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth filter (numerator, denominator) by the bilinear transform. A band from 0
    is low-pass, one to infinity high-pass, else band-pass."""
    low, high = band
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if low <= 0:
        w = warp(high)
        poles, zeros, gain = poles * w, np.empty(0), w**order
    elif np.isinf(high):
        w = warp(low)
        gain = np.real(1 / np.prod(-poles))
        poles, zeros = w / poles, np.zeros(order)
    else:
        a, b = warp(low), warp(high)
        half, centre = poles * (b - a) / 2, a * b
        poles = np.concatenate([half + np.sqrt(half**2 - centre), half - np.sqrt(half**2 - centre)])
        zeros, gain = np.zeros(order), (b - a) ** order
    k = 2 * fs
    gain = np.real(gain * np.prod(k - zeros) / np.prod(k - poles))
    dz, dp = (k + zeros) / (k - zeros), (k + poles) / (k - poles)
    dz = np.concatenate([dz, -np.ones(len(dp) - len(dz))])
    return np.real(gain * np.poly(dz)), np.real(np.poly(dp))


def recursive_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed, starting from ``state``."""
    out, z = np.empty_like(x), state.copy()
    for i, v in enumerate(x):
        y = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:-1] * v - a[1:-1] * y
        z[-1] = b[-1] * v - a[-1] * y
        out[i] = y
    return out


def recursive_filters(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """``recursive_filter`` of the rows of ``x`` (rows, time) together, from ``state`` (rows, order)."""
    out, z = np.empty_like(x), np.concatenate([state, np.zeros((len(x), 1))], 1)
    for i in range(x.shape[1]):
        v = x[:, i]
        y = b[0] * v + z[:, 0]
        z[:, :-1] = z[:, 1:] + np.outer(v, b[1:]) - np.outer(y, a[1:])
        out[:, i] = y
    return out


def zero_phases(b: np.ndarray, a: np.ndarray, rows: list[np.ndarray]) -> list[np.ndarray]:
    """``zero_phase`` of several series together: all are padded to the longest, which what is causal doesn't
    see, and each is turned round by its own length for the way back."""
    n = max(len(a), len(b))
    a, b = np.r_[a, np.zeros(n - len(a))] / a[0], np.r_[b, np.zeros(n - len(b))] / a[0]
    companion = np.zeros((n - 1, n - 1))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(n - 2)
    steady = np.linalg.solve(np.eye(n - 1) - companion, b[1:] - a[1:] * b[0])
    edges = [min(3 * n, len(x) - 1) for x in rows]
    ext = [np.r_[2 * x[0] - x[e:0:-1], x, 2 * x[-1] - x[-2 : -e - 2 : -1]] for x, e in zip(rows, edges, strict=True)]
    lengths = np.array([len(x) for x in ext])
    padded, inside = np.zeros((len(ext), lengths.max())), np.arange(lengths.max()) < lengths[:, None]
    padded[inside] = np.concatenate(ext)
    back = np.where(inside, lengths[:, None] - 1 - np.arange(lengths.max()), 0)
    turned = lambda y: np.where(inside, np.take_along_axis(y, back, 1), 0.0)
    y = turned(recursive_filters(b, a, padded, steady * padded[:, :1]))
    y = turned(recursive_filters(b, a, y, steady * y[:, :1]))
    return [v[e : e + len(x)] for v, e, x in zip(y, edges, rows, strict=True)]


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filters forwards and backwards, with reflected ends and steady initial states."""
    n = max(len(a), len(b))
    a, b = np.r_[a, np.zeros(n - len(a))] / a[0], np.r_[b, np.zeros(n - len(b))] / a[0]
    companion = np.zeros((n - 1, n - 1))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(n - 2)
    steady = np.linalg.solve(np.eye(n - 1) - companion, b[1:] - a[1:] * b[0])
    edge = min(3 * n, len(x) - 1)
    ext = np.r_[2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]]
    y = recursive_filter(b, a, ext, steady * ext[0])
    y = recursive_filter(b, a, y[::-1], steady * y[-1])[::-1]
    return y[edge : edge + len(x)]


def band_filter(long: DataFrame, band: tuple[float, float], fs: float, order: int = 6) -> DataFrame:
    """Zero-phase Butterworth filter per segment; the order falls while the filter is unstable."""
    for n in range(order, 0, -1):
        b, a = butterworth(n, band, fs)
        if np.all(np.abs(np.roots(a)) < 1):
            return many_segments(long, lambda rows: zero_phases(b, a, rows))
    raise ValueError("no stable filter for this band")


def resample(long: DataFrame, up: int, down: int) -> DataFrame:
    """Rational resampling with a windowed-sinc filter; a segment of n samples gets ceil(n up / down)."""
    half = 10 * max(up, down)
    taps = np.sinc(np.arange(-half, half + 1) / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        wide = np.zeros(len(rows) * up)
        wide[::up] = rows["value"].to_numpy(float)
        y = np.convolve(wide, taps)[half : half + len(wide)][::down]
        first = rows.iloc[0]
        return pd.DataFrame({c: first[c] for c in CHANNEL} | {"t": np.arange(1, len(y) + 1, dtype=np.int32), "value": y})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (long.schema[c] for c in CHANNEL)) + ", t int, value double"
    return long.groupBy(*CHANNEL).applyInPandas(run, schema)


def leading_phases(observations: DataFrame) -> DataFrame:
    """Per sample the leading eigenvector of the channels' phase coherences, signed so that most of it is negative."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        x = np.stack(rows["x"].to_numpy()).astype(float)
        phase = np.angle(np.stack([analytic(c) for c in (x - x.mean(0)).T], 1))
        coherence = np.cos(phase[:, :, None] - phase[:, None, :])
        lead = np.linalg.eigh(coherence)[1][:, :, -1]
        flip = (lead > 0).mean(1) > 0.5
        lead[flip] *= -1
        return rows.assign(x=list(lead))

    return observations.groupBy(*KEY).applyInPandas(run, observations.schema)


def nearest_class(predictions: DataFrame, value: str = "yhat") -> DataFrame:
    """Continuous predictions of a target of -1 and 1 → the nearer of the two, zero counting as 1."""
    return predictions.withColumn("label", F.when(F.col(value) < 0, -1).otherwise(1))


def binary_columns(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-against-one codes (keys…, a, b, code) → (keys…, class, member): 1 for the class that wins all of its pairs."""
    sides = pairs.select(*keys, F.inline(F.array(F.struct(F.col("a").alias("class"), F.col("code").alias("c")), F.struct(F.col("b").alias("class"), (-F.col("code")).alias("c")))))
    return sides.groupBy(*keys, "class").agg(F.min((F.col("c") == 1).cast("int")).alias("member"))


def pad_path(path: DataFrame, segments: DataFrame) -> DataFrame:
    """A path on the full grid of ``segments`` (series_id, segment_id, n), null where it has no state."""
    grid = segments.select(*KEY, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("t"))
    return grid.join(path, [*KEY, "t"], "left")


def reconstruct(design: DataFrame, channels: int) -> DataFrame:
    """The series before each designed sample, from the columns of lag one: (t, channel, value)."""
    return design.filter(F.col("column").between(1, channels)).select(*KEY, (F.col("t") - 1).alias("t"), F.col("column").alias("channel"), "value")


def labelled_stretches(samples: DataFrame, label: str) -> DataFrame:
    """Number of unbroken stretches with and without a label per segment."""
    w = Window.partitionBy(*KEY).orderBy("t")
    change = F.when(F.lag(F.col(label).isNull()).over(w) == F.col(label).isNull(), 0).otherwise(1)
    return samples.withColumn("c", change).groupBy(*KEY).agg(F.sum("c").alias("stretches"))


def orthogonalised(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Symmetric orthogonalisation: columns of equal norm that are as close as possible to the given ones."""
    from tidemark.operators import moments

    sums = moments.matrix(moments.products(rows, names).collect(), len(names))[1:, 1:]
    scale = np.sqrt(np.diag(sums))
    values, vectors = np.linalg.eigh(sums / np.outer(scale, scale))
    root = vectors @ np.diag(1 / np.sqrt(values)) @ vectors.T
    return moments.project(rows, names, (root / scale[:, None]), "orth")
