"""Chains whose states are regressions: autoregressive states, and decoders that change over time.

A state predicts a response from a design: past samples of all channels (``lagged_design``), or
stimuli from channels and the like (columns ``x`` and ``y``). Weights are normal, the noise is Wishart or
Gamma, of each state or shared; with relevance each lag and each pair of channels has a precision of its
own. A cycle is one Spark job, as in ``train``: segments return weighted sums of products only, and the
driver updates posteriors of K states.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.special import digamma, kl_dirichlet, kl_gamma, kl_wishart
from tidemark.operators.inference import KEY, forward_backward, viterbi
from tidemark.operators.train import _run_batches
from tidemark.session import discard, stage

COVARIANCES = ("full", "diag", "sharedfull", "shareddiag")


@dataclass(frozen=True)
class Family:
    """What states are: lags (0: the design comes with the data), an intercept, the kind of noise, and
    whether precisions of lags and of channel pairs are learned."""

    orders: tuple[int, ...] = (1,)
    intercept: bool = True
    covariance: str = "full"
    relevance: bool = True

    def __post_init__(self):
        if self.covariance not in COVARIANCES:
            raise ValueError(f"covariance is one of {', '.join(COVARIANCES)}")

    @property
    def diagonal(self) -> bool:
        return self.covariance.endswith("diag")

    @property
    def shared(self) -> bool:
        return self.covariance.startswith("shared")


@dataclass
class RegressionModel:
    """Posteriors: Dirichlet counts of start and transitions; weights ``w`` (k, p, d) with covariance ``s``
    (k, p d, p d), responses outermost; noise of shape ``a`` and rate ``b`` (d, d), or its diagonal; Gamma
    precisions ``alpha`` of lags and ``sigma`` of pairs, each as (shape, rate)."""

    family: Family
    start: np.ndarray
    counts: np.ndarray
    w: np.ndarray
    s: np.ndarray
    a: np.ndarray
    b: np.ndarray
    alpha: tuple[np.ndarray, np.ndarray]
    sigma: tuple[np.ndarray, np.ndarray]
    prior: dict = field(default_factory=dict)
    history: list = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.start)

    def transition(self) -> np.ndarray:
        return self.counts / self.counts.sum(1, keepdims=True)

    def precision(self, s: int) -> np.ndarray:
        """Expected noise precision of a state."""
        if self.family.diagonal:
            return np.diag(self.a[s] / np.diag(self.b[s]))
        return self.a[s] * np.linalg.inv(self.b[s])

    def log_det(self, s: int) -> float:
        """Expected log-determinant of the noise precision."""
        d = self.b.shape[1]
        if self.family.diagonal:
            return float(d * digamma(self.a[s]) - np.log(np.diag(self.b[s])).sum())
        return float(sum(digamma(self.a[s] - i / 2) for i in range(d)) - np.linalg.slogdet(self.b[s])[1])

    def blocks(self, s: int) -> np.ndarray:
        """Covariances of a state's weights as (d, d, p, p)."""
        p, d = self.w.shape[1:]
        return self.s[s].reshape(d, p, d, p).transpose(0, 2, 1, 3)

    def log_likelihood(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Expected log density of responses (n, d) given designs (n, p), by state."""
        d, out = y.shape[1], np.empty((len(y), self.k))
        for s in range(self.k):
            omega, e = self.precision(s), y - x @ self.w[s]
            spread = np.einsum("mn,mnij->ij", omega, self.blocks(s))
            quad = np.einsum("ni,ij,nj->n", e, omega, e) + np.einsum("ni,ij,nj->n", x, spread, x)
            out[:, s] = 0.5 * (self.log_det(s) - d * math.log(2 * math.pi) - quad)
        return out

    def log_chain(self) -> tuple[np.ndarray, np.ndarray]:
        """exp of the expected logs of transitions and start."""
        rows = np.asarray(digamma(self.counts.ravel())).reshape(self.counts.shape) - np.reshape(digamma(self.counts.sum(1)), (-1, 1))
        return np.exp(rows), np.exp(np.reshape(digamma(self.start), -1) - digamma(self.start.sum()))

    def rows(self) -> list[tuple[int, str, int, int, float]]:
        """(state, param, i, j, value), for a table of models."""
        out = [(0, "start", i + 1, 0, float(v)) for i, v in enumerate(self.start)]
        out += [(i + 1, "counts", i + 1, j + 1, float(v)) for (i, j), v in np.ndenumerate(self.counts)]
        out += [(s + 1, "weight", i, j + 1, float(v)) for (s, i, j), v in np.ndenumerate(self.w)]
        out += [(s + 1, "rate", i + 1, j + 1, float(v)) for (s, i, j), v in np.ndenumerate(self.b)]
        return out + [(s + 1, "shape", 0, 0, float(v)) for s, v in enumerate(self.a)]


def segments(data: DataFrame) -> DataFrame:
    """(series_id, segment_id, t, x array[, y array]) → a row per segment with samples in order."""
    names = [n for n in ("x", "y") if n in data.columns]
    rows = F.array_sort(F.collect_list(F.struct("t", *names))).alias("rows")
    return data.groupBy(*KEY).agg(rows).select(*KEY, F.col("rows.t").alias("t"), *(F.flatten(f"rows.{n}").alias(n) for n in names))


def lagged_design(x: np.ndarray, orders, intercept: bool) -> np.ndarray:
    """Rows after the largest lag: a one, then the channels of each lag."""
    top = max(orders)
    parts = [x[top - o : len(x) - o] for o in orders]
    return np.concatenate([np.ones((max(0, len(x) - top), 1))] * intercept + parts, 1) if len(x) > top else np.empty((0, intercept + len(orders) * x.shape[1]))


def _designs(batch: pa.RecordBatch, family: Family) -> list[tuple[np.ndarray, np.ndarray]]:
    """(design, response) of each segment of a batch."""
    out = []
    for i, t in enumerate(batch.column("t")):
        x = np.asarray(batch.column("x")[i].values, float).reshape(len(t), -1)
        if family.orders:
            out.append((lagged_design(x, family.orders, family.intercept), x[max(family.orders) :]))
        else:
            x = np.concatenate([np.ones((len(x), 1)), x], 1) if family.intercept else x
            out.append((x, np.asarray(batch.column("y")[i].values, float).reshape(len(t), -1)))
    return out


def _inferred(batch: pa.RecordBatch, model: RegressionModel):
    """Designs and responses of the segments that have any, which these are, and padded likelihoods with
    posteriors, evidence and pair sums."""
    parts = _designs(batch, model.family)
    used = [i for i, (x, _) in enumerate(parts) if len(x)]
    lengths = np.array([len(parts[i][0]) for i in used], int)
    ll = np.zeros((len(used), lengths.max(initial=0), model.k))
    for n, i in enumerate(used):
        ll[n, : lengths[n]] = model.log_likelihood(*parts[i])
    found = forward_backward(ll, lengths, *model.log_chain()) if used else None
    return parts, used, lengths, ll, found


def _weighted(x, y, g):
    """Sums of a segment under weights g (n, k)."""
    return [np.einsum("nk,ni,nj->kij", g, x, x), np.einsum("nk,ni,nj->kij", g, x, y), np.einsum("nk,ni,nj->kij", g, y, y)]


def _summed(grouped: DataFrame, make_sums, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    def make(batch):
        flat = make_sums(batch)
        return pa.RecordBatch.from_pydict({"i": np.arange(len(flat), dtype=np.int32), "v": flat})

    summed = dict(_run_batches(grouped, make, "i int, v double").groupBy("i").agg(F.sum("v")).collect())
    flat, out, at = np.array([summed[i] for i in range(len(summed))]), {}, 0
    for name, shape in shapes.items():
        n = int(np.prod(shape))
        out[name], at = flat[at : at + n].reshape(shape), at + n
    return out


def _shapes(k: int, p: int, d: int) -> dict[str, tuple[int, ...]]:
    return {"mass": (k,), "xx": (k, p, p), "xy": (k, p, d), "yy": (k, d, d), "start": (k,), "pairs": (k, k), "tail": (2,)}


def statistics(grouped: DataFrame, model: RegressionModel) -> dict[str, np.ndarray]:
    """Weighted sums over all segments under the model's posteriors."""
    (k, p, d) = model.w.shape

    def sums(batch):
        parts, used, lengths, _, found = _inferred(batch, model)
        total = [np.zeros(s) for s in _shapes(k, p, d).values()]
        if used:
            gamma, evidence, xi = found
            for n, i in enumerate(used):
                g = gamma[n, : lengths[n]]
                total[0] += g.sum(0)
                for slot, part in zip(total[1:4], _weighted(*parts[i], g), strict=True):
                    slot += part
            total[4:] = [gamma[:, 0].sum(0), xi.sum(0), np.array([evidence.sum(), float(lengths.sum())])]
        return np.concatenate([np.ravel(v) for v in total])

    return _summed(grouped, sums, _shapes(k, p, d))


def dealt_statistics(grouped: DataFrame, family: Family, k: int, p: int, d: int, seed: int, run: int = 20) -> dict[str, np.ndarray]:
    """The same sums under a start in which stretches of ``run`` samples are dealt to random states."""

    def sums(batch):
        total = [np.zeros(s) for s in _shapes(k, p, d).values()]
        keys = zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)
        for key, (x, y) in zip(keys, _designs(batch, family), strict=True):
            if not len(x):
                continue
            rng = np.random.default_rng([seed, *(abs(int(v or 0)) for v in key)])
            states = np.repeat(rng.integers(0, k, -(-len(x) // run)), run)[: len(x)]
            g = 0.9 * np.eye(k)[states] + 0.1 / k
            total[0] += g.sum(0)
            for slot, part in zip(total[1:4], _weighted(x, y, g), strict=True):
                slot += part
            total[4] += g[0]
            total[5] += g[:-1].T @ g[1:]
            total[6] += [0.0, float(len(x))]
        return np.concatenate([np.ravel(v) for v in total])

    return _summed(grouped, sums, _shapes(k, p, d))


def initial_model(grouped: DataFrame, family: Family, k: int, seed: int, diagonal_prior: float = 10.0) -> RegressionModel:
    """Priors from the spread of the responses; one update from a random start."""
    row = grouped.select("t", *(n for n in ("x", "y") if n in grouped.columns)).filter(F.size("t") > 0).first()
    n = len(row["t"])
    if family.orders:
        d = len(row["x"]) // n
        j, p = d, family.intercept + len(family.orders) * d
    else:
        j, d = len(row["x"]) // n, len(row["y"]) // n
        p = family.intercept + j
    lags = max(1, len(family.orders))
    stats = dealt_statistics(grouped, family, k, p, d, seed)
    every, total = stats["yy"].sum(0), max(1.0, stats["tail"][1])
    spread = np.maximum(np.diag(every) / total, 1e-12)
    shape = 0.5 if family.diagonal else (d + 2) / 2
    prior = {
        "start": np.ones(k),
        "counts": np.ones((k, k)) + (diagonal_prior - 1) * np.eye(k),
        "a": shape,
        "b": np.diag(spread) * shape / k,
        "intercept": 1.0 / (4 * spread.max() * k),
        "gamma": (0.1, 0.1),
        "fixed": 1e-4,
    }
    kept = 1 if family.shared else k
    model = RegressionModel(
        family, np.ones(k), prior["counts"].copy(), np.zeros((k, p, d)), np.zeros((k, p * d, p * d)),
        np.full(kept, shape + total / k / 2).repeat(k // kept), np.stack([np.diag(spread) * (shape + total / k / 2)] * k),
        (np.full((k, lags), 0.1), np.full((k, lags), 0.1)), (np.full((k, j, d), 0.1), np.full((k, j, d), 0.1)), prior,
    )
    return updated(model, stats)


def weight_precision(model: RegressionModel) -> np.ndarray:
    """Expected prior precisions of the weights (k, p, d)."""
    k, p, d = model.w.shape
    first = int(model.family.intercept)
    if model.family.relevance:
        alpha, sigma = model.alpha[0] / model.alpha[1], model.sigma[0] / model.sigma[1]
        body = np.einsum("kl,kjd->kljd", alpha, sigma).reshape(k, p - first, d)
    else:
        body = np.full((k, p - first, d), model.prior["fixed"])
    return np.concatenate([np.full((k, first, d), model.prior["intercept"]), body], 1)


def update_weights(model: RegressionModel, stats: dict[str, np.ndarray]) -> RegressionModel:
    """Normal posteriors of the weights given the noise; channel by channel where the noise is diagonal."""
    k, p, d = model.w.shape
    prior, w, s = weight_precision(model), np.empty_like(model.w), np.zeros_like(model.s)
    for n in range(k):
        omega = model.precision(n)
        precision = np.diag(prior[n].T.ravel()) + np.kron(omega, stats["xx"][n])
        s[n] = np.linalg.inv(precision)
        s[n] = (s[n] + s[n].T) / 2
        w[n] = (s[n] @ (stats["xy"][n] @ omega).T.ravel()).reshape(d, p).T
    return replace(model, w=w, s=s)


def update_noise(model: RegressionModel, stats: dict[str, np.ndarray]) -> RegressionModel:
    """Wishart or Gamma posteriors of the noise: rates grow by half the expected squared residuals."""
    k, _, d = model.w.shape
    b = np.empty_like(model.b)
    for n in range(k):
        cross = model.w[n].T @ stats["xy"][n]
        residual = stats["yy"][n] - cross - cross.T + model.w[n].T @ stats["xx"][n] @ model.w[n]
        b[n] = 0.5 * (residual + np.einsum("mnij,ij->mn", model.blocks(n), stats["xx"][n]))
    mass = stats["mass"].copy()
    if model.family.shared:
        b, mass = np.stack([b.sum(0)] * k), np.full(k, mass.sum())
    b = model.prior["b"] + (b + b.transpose(0, 2, 1)) / 2
    if model.family.diagonal:
        b = b * np.eye(d)
    return replace(model, a=model.prior["a"] + mass / 2, b=b)


def _squares(model: RegressionModel) -> np.ndarray:
    """Expected squares of the weights without the intercept, (k, lags, channels, responses)."""
    k, p, d = model.w.shape
    first, lags = int(model.family.intercept), model.alpha[0].shape[1]
    var = np.stack([np.diag(model.s[n]).reshape(d, p).T for n in range(k)])
    return (model.w**2 + var)[:, first:].reshape(k, lags, -1, d)


def update_sigma(model: RegressionModel) -> RegressionModel:
    """Precisions of channel pairs."""
    a0, b0 = model.prior["gamma"]
    squares, alpha = _squares(model), model.alpha[0] / model.alpha[1]
    shape = np.full(model.sigma[0].shape, a0 + squares.shape[1] / 2)
    return replace(model, sigma=(shape, b0 + 0.5 * np.einsum("kl,kljd->kjd", alpha, squares)))


def update_alpha(model: RegressionModel) -> RegressionModel:
    """Precisions of lags."""
    a0, b0 = model.prior["gamma"]
    squares, sigma = _squares(model), model.sigma[0] / model.sigma[1]
    shape = np.full(model.alpha[0].shape, a0 + squares.shape[2] * squares.shape[3] / 2)
    return replace(model, alpha=(shape, b0 + 0.5 * np.einsum("kjd,kljd->kl", sigma, squares)))


def updated(model: RegressionModel, stats: dict[str, np.ndarray]) -> RegressionModel:
    """One pass: weights, noise, precisions, chain."""
    model = update_noise(update_weights(model, stats), stats)
    if model.family.relevance:
        model = update_alpha(update_sigma(model))
    return replace(model, start=model.prior["start"] + stats["start"], counts=model.prior["counts"] + stats["pairs"])


def divergences(model: RegressionModel) -> dict[str, float]:
    """Divergences of all posteriors from their priors, by kind."""
    k, p, d = model.w.shape
    prior, first = model.prior, int(model.family.intercept)
    out = {"chain": kl_dirichlet(model.start, prior["start"]) + sum(kl_dirichlet(a, b) for a, b in zip(model.counts, prior["counts"], strict=True))}
    mean = weight_precision(model)
    log_mean = np.log(mean)
    if model.family.relevance:
        logs = [np.reshape(digamma(v[0].ravel()), v[0].shape) - np.log(v[1]) for v in (model.alpha, model.sigma)]
        log_mean[:, first:] = (logs[0][:, :, None, None] + logs[1][:, None]).reshape(k, p - first, d)
    out["weights"] = 0.0
    for n in range(k):
        var = np.diag(model.s[n]).reshape(d, p).T
        out["weights"] += 0.5 * float((mean[n] * (model.w[n] ** 2 + var)).sum() - log_mean[n].sum() - np.linalg.slogdet(model.s[n])[1] - p * d)
    out["noise"] = 0.0
    for n in range(1 if model.family.shared else k):
        if model.family.diagonal:
            out["noise"] += sum(kl_gamma(model.a[n], r, prior["a"], q) for r, q in zip(np.diag(model.b[n]), np.diag(prior["b"]), strict=True))
        else:
            out["noise"] += kl_wishart(model.a[n], model.b[n], prior["a"], prior["b"])
    if model.family.relevance:
        out["relevance"] = float(sum(kl_gamma(a, r, *prior["gamma"]) for v in (model.alpha, model.sigma) for a, r in zip(v[0].ravel(), v[1].ravel(), strict=True)))
    return {n: float(v) for n, v in out.items()}


def free_energy(model: RegressionModel, evidence: float) -> float:
    return sum(divergences(model).values()) - evidence


def fit(data: DataFrame, family: Family, k: int, cycles: int = 50, tolerance: float = 1e-5, seed: int = 0, grouped: DataFrame | None = None, model: RegressionModel | None = None) -> RegressionModel:
    """Cycles until the free energy changes by less than ``tolerance`` of itself; its history is kept."""
    held = stage(segments(data), "segments") if grouped is None else grouped
    model = model or initial_model(held, family, k, seed)
    history: list[float] = []
    for _ in range(cycles):
        stats = statistics(held, model)
        history.append(free_energy(model, stats["tail"][0]))
        if len(history) > 1 and abs(history[-2] - history[-1]) < tolerance * abs(history[-1]):
            break
        model = updated(model, stats)
    if grouped is None:
        discard(held)
    return replace(model, history=history)


def fit_best(data: DataFrame, family: Family, k: int, repetitions: int = 3, short: int = 5, cycles: int = 50, seed: int = 0) -> RegressionModel:
    """Short runs from several random starts; the one of least free energy goes on."""
    held = stage(segments(data), "segments")
    runs = [fit(data, family, k, short, 0.0, seed + n, held) for n in range(repetitions)]
    best = min(runs, key=lambda m: m.history[-1])
    rest = fit(data, family, k, cycles, seed=seed, grouped=held, model=best)
    discard(held)
    return replace(rest, history=best.history + rest.history)


def fit_observations(data: DataFrame, model: RegressionModel, passes: int = 1) -> RegressionModel:
    """Updates of the states alone, the chain and so the time-courses of the first pass kept."""
    held = stage(segments(data), "segments")
    stats = statistics(held, model)
    for _ in range(passes):
        fresh = updated(model, stats)
        model = replace(fresh, start=model.start, counts=model.counts)
    discard(held)
    return model


def _keys(batch: pa.RecordBatch, used, parts, copies: int = 1) -> dict:
    """Series, segment and time of the samples that have a design."""
    t = [np.asarray(batch.column("t")[i].values)[-len(parts[i][0]) :] for i in used]
    sizes = [len(v) for v in t]
    out = {c: np.repeat(batch.column(c).take(pa.array(used)).to_numpy(), np.array(sizes) * copies) for c in KEY}
    return out | {"t": np.repeat(np.concatenate(t), copies).astype(np.int32)}


def decode(data: DataFrame, model: RegressionModel, kind: str = "posterior") -> DataFrame:
    """Gamma (…, t, state, p) or, with ``path``, the most likely states (…, t, state), at the samples that
    have a design."""
    schema = "series_id bigint, segment_id bigint, t int, state int" + (", p double" if kind == "posterior" else "")

    def make(batch):
        parts, used, lengths, ll, found = _inferred(batch, model)
        if not used:
            empty = {"series_id": pa.int64(), "segment_id": pa.int64(), "t": pa.int32(), "state": pa.int32()} | ({"p": pa.float64()} if kind == "posterior" else {})
            return pa.RecordBatch.from_pydict({n: pa.array([], v) for n, v in empty.items()})
        inside = np.arange(ll.shape[1]) < lengths[:, None]
        if kind == "posterior":
            states = np.tile(np.arange(1, model.k + 1, dtype=np.int32), int(lengths.sum()))
            return pa.RecordBatch.from_pydict(_keys(batch, used, parts, model.k) | {"state": states, "p": found[0][inside].ravel()})
        return pa.RecordBatch.from_pydict(_keys(batch, used, parts) | {"state": viterbi(ll, lengths, *model.log_chain())[inside].astype(np.int32)})

    return _run_batches(segments(data), make, schema)


def predict(data: DataFrame, model: RegressionModel) -> DataFrame:
    """(…, t, i, y, yhat): responses and the states' predictions mixed by the posteriors."""
    d = model.w.shape[2]

    def make(batch):
        parts, used, lengths, _, found = _inferred(batch, model)
        if not used:
            return pa.RecordBatch.from_pydict({n: pa.array([], v) for n, v in (("series_id", pa.int64()), ("segment_id", pa.int64()), ("t", pa.int32()), ("i", pa.int32()), ("y", pa.float64()), ("yhat", pa.float64()))})
        y = np.concatenate([parts[i][1] for i in used])
        hat = np.concatenate([np.einsum("nk,kpd,np->nd", found[0][n, : lengths[n]], model.w, parts[i][0]) for n, i in enumerate(used)])
        index = np.tile(np.arange(1, d + 1, dtype=np.int32), len(y))
        return pa.RecordBatch.from_pydict(_keys(batch, used, parts, d) | {"i": index, "y": y.ravel(), "yhat": hat.ravel()})

    return _run_batches(segments(data), make, "series_id bigint, segment_id bigint, t int, i int, y double, yhat double")


def cross_validated(data: DataFrame, family: Family, k: int, folds: int, cycles: int = 20, seed: int = 0) -> DataFrame:
    """(t, i, r2) of responses predicted by models fitted without their fold; a fold is a draw of the
    segment. The time-courses of held-out segments are the average of the training ones at each time, as
    a response must not tell its own state."""
    from tidemark.functions.columns import uniform
    from tidemark.operators.moments import prediction_error

    fold = F.floor(uniform(F.col("series_id"), F.col("segment_id"), seed=seed) * folds)
    scored = None
    for f in range(folds):
        model = fit(data.filter(fold != f), family, k, cycles, seed=seed)
        mean = decode(data.filter(fold != f), model).groupBy("t", "state").agg(F.avg("p").alias("p"))
        part = predicted_under(data.filter(fold == f), model, mean)
        scored = part if scored is None else scored.unionAll(part)
    return prediction_error(scored, ["t", "i"]).select("t", "i", F.col("explained").alias("r2"))


def predicted_under(data: DataFrame, model: RegressionModel, course: DataFrame) -> DataFrame:
    """(series_id, segment_id, t, i, y, yhat) for a design of ``x`` and response ``y`` under given shares of
    states (t, state, p), by built-in functions: weights are literals of the plan."""
    k, p, d = model.w.shape
    x = [F.lit(1.0)] * int(model.family.intercept) + [F.col("x")[i] for i in range(p - int(model.family.intercept))]
    cells = F.array(*(F.struct(F.lit(s + 1).alias("state"), F.lit(i + 1).alias("i"), F.col("y")[i].alias("y"), sum((v * float(w) for v, w in zip(x, model.w[s, :, i], strict=True)), F.lit(0.0)).alias("v")) for s in range(k) for i in range(d)))
    wide = data.select(*KEY, "t", F.inline(cells)).join(course, ["t", "state"])
    return wide.groupBy(*KEY, "t", "i").agg(F.first("y").alias("y"), (F.sum(F.col("p") * F.col("v")) / F.sum("p")).alias("yhat"))


def perturbed(model: RegressionModel, epsilon: float = 1.0, seed: int = 0) -> RegressionModel:
    """Weights moved by a draw from their own posterior, its covariance widened by 0.001."""
    rng, (k, p, d) = np.random.default_rng(seed), model.w.shape
    w = model.w.copy()
    for n in range(k):
        root = np.linalg.cholesky(model.s[n] + 1e-3 * np.eye(p * d))
        w[n] += epsilon * (root @ rng.standard_normal(p * d)).reshape(d, p).T
    return replace(model, w=w)


def dropped(model: RegressionModel, keep) -> RegressionModel:
    """The model of the states ``keep`` alone."""
    keep = list(keep)
    prior = model.prior | {"start": model.prior["start"][keep], "counts": model.prior["counts"][np.ix_(keep, keep)]}
    pick = lambda v: v[keep]
    return replace(
        model, start=pick(model.start), counts=model.counts[np.ix_(keep, keep)], w=pick(model.w), s=pick(model.s), a=pick(model.a), b=pick(model.b),
        alpha=tuple(map(pick, model.alpha)), sigma=tuple(map(pick, model.sigma)), prior=prior,
    )


def without_spare_states(data: DataFrame, model: RegressionModel, cycles: int = 5) -> RegressionModel:
    """Backward elimination: while leaving out a state lowers the free energy, the best such model goes on."""
    held = stage(segments(data), "segments")
    best = fit(data, model.family, model.k, cycles, grouped=held, model=model)
    while best.k > 1:
        tried = [fit(data, best.family, best.k - 1, cycles, grouped=held, model=dropped(best, [i for i in range(best.k) if i != s])) for s in range(best.k)]
        least = min(tried, key=lambda m: m.history[-1])
        if least.history[-1] >= best.history[-1]:
            break
        best = least
    discard(held)
    return best


def marginal(model: RegressionModel, response: int) -> RegressionModel:
    """The model of one response (from 1) of several with diagonal noise."""
    if not model.family.diagonal:
        raise ValueError("responses of full noise don't stand alone")
    i, p = response - 1, model.w.shape[1]
    rows = slice(i * p, (i + 1) * p)
    one = lambda v: v[..., i : i + 1]
    prior = model.prior | {"b": model.prior["b"][i : i + 1, i : i + 1]}
    return replace(model, w=one(model.w), s=model.s[:, rows, rows], b=model.b[:, i : i + 1, i : i + 1], sigma=tuple(map(one, model.sigma)), prior=prior)


def with_response(model: RegressionModel, part: RegressionModel, response: int) -> RegressionModel:
    """``model`` with the posteriors of ``part`` for one of its responses: the inverse of ``marginal``."""
    i, p = response - 1, model.w.shape[1]
    w, s, b, sigma = model.w.copy(), model.s.copy(), model.b.copy(), tuple(v.copy() for v in model.sigma)
    w[:, :, i], b[:, i, i] = part.w[:, :, 0], part.b[:, 0, 0]
    s[:, i * p : (i + 1) * p, i * p : (i + 1) * p] = part.s
    for held, fresh in zip(sigma, part.sigma, strict=True):
        held[..., i] = fresh[..., 0]
    return replace(model, w=w, s=s, b=b, sigma=sigma)


def with_chain(model: RegressionModel, other: RegressionModel) -> RegressionModel:
    """``model`` with the chain of another of as many states."""
    return replace(model, start=other.start.copy(), counts=other.counts.copy())


def stable(model: RegressionModel) -> list[bool]:
    """Whether each state's autoregression dies out: all roots of its companion matrix lie inside the unit circle."""
    out, d, top = [], model.w.shape[2], max(model.family.orders)
    for w in model.w:
        body = w[int(model.family.intercept) :].reshape(len(model.family.orders), d, d)
        companion = np.eye(d * top, k=-d)
        for n, o in enumerate(model.family.orders):
            companion[:d, (o - 1) * d : o * d] = body[n].T
        out.append(bool(np.abs(np.linalg.eigvals(companion)).max() < 1))
    return out


def window_start(data: DataFrame, family: Family, window: int, k: int, seed: int = 0) -> DataFrame:
    """(series_id, segment_id, t, state): autoregressions of windows of ``window`` samples, half a window
    apart, in k groups by their weights (k-means); samples take the group of the window they are nearest
    the middle of. Segments shorter than a window are one window."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    step = max(1, window // 2)

    def features(batches):
        for rows in batches:
            out = []
            for series, segment, t, flat in rows[["series_id", "segment_id", "t", "x"]].itertuples(index=False):
                x = np.asarray(flat, float).reshape(len(t), -1)
                for at in range(0, max(1, len(x) - window + 1), step):
                    part = x[at : at + window]
                    design, y = lagged_design(part, family.orders, family.intercept), part[max(family.orders) :]
                    beta = np.linalg.solve(design.T @ design + 1e-3 * np.eye(design.shape[1]), design.T @ y)
                    out.append((series, segment, at + 1, len(x), beta[int(family.intercept) :].ravel().tolist()))
            yield pd.DataFrame(out, columns=["series_id", "segment_id", "first", "n", "f"])

    held = stage(segments(data).mapInPandas(features, "series_id bigint, segment_id bigint, first int, n int, f array<double>"), "windows")
    vectors = held.withColumn("features", array_to_vector("f"))
    found = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="group").fit(vectors).transform(vectors)
    last = F.expr(f"CASE WHEN first + {step} > n - {window} + 1 THEN n ELSE first + {window // 2 + step // 2} - 1 END")
    begin = F.when(F.col("first") == 1, 1).otherwise(F.col("first") + window // 2 - step + step // 2)
    return found.select(*KEY, F.explode(F.sequence(begin, last)).alias("t"), (F.col("group") + 1).alias("state"))
