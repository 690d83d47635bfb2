"""Episodes: several chains of two states, on and off, that add up over a baseline.

A response is predicted from its lags by the baseline's weights and those of every chain that is on. Chains
are inferred one after the other, each given what the others explain; weights of all chains are solved at
once, from products of the designs weighted by pairs of probabilities. Segments keep their probabilities from
cycle to cycle in a stored table, and return sums only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.special import digamma, kl_dirichlet
from tidemark.operators import regression_chain as rc
from tidemark.operators.inference import BATCH_SEGMENTS, KEY, forward_backward
from tidemark.session import discard, small_batches, stage

_STATE = "series_id bigint, segment_id bigint, t array<int>, x array<double>, g array<double>, sums array<double>"


@dataclass
class Episodes:
    """Weights of the baseline (p, d) and of the chains (k, p, d), noise variances (d), Dirichlet counts of each
    chain's steps (k, 2, 2), off first; ``history`` holds the log evidence a cycle."""

    family: rc.Family
    baseline: np.ndarray
    w: np.ndarray
    noise: np.ndarray
    counts: np.ndarray
    prior: np.ndarray
    history: list = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.w)

    def log_chain(self, n: int) -> np.ndarray:
        c = self.counts[n]
        return np.exp(np.reshape(digamma(c.ravel()), c.shape) - np.reshape(digamma(c.sum(1)), (-1, 1)))


def baseline_weights(data: DataFrame, family: rc.Family, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Ridge autoregression of all segments, and its residual variances."""
    held = stage(rc.segments(data), "segments")
    model = rc.initial_model(held, family, 1, 0)
    sums = rc.statistics(held, model)
    discard(held)
    xx, xy, yy = sums["xx"][0], sums["xy"][0], sums["yy"][0]
    w = np.linalg.solve(xx + ridge * np.eye(len(xx)), xy)
    return w, np.diag(yy - 2 * w.T @ xy + w.T @ xx @ w) / sums["tail"][1]


def responses(x: np.ndarray, w: np.ndarray, g: np.ndarray, states) -> np.ndarray:
    """Predicted part (n, d) of a subset of chains, weighted by their probabilities."""
    return sum((g[:, k : k + 1] * (x @ w[k]) for k in states), np.zeros((len(x), w.shape[2])))


def on_likelihood(x: np.ndarray, rest: np.ndarray, w: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Log-likelihood of a chain being on less that of its being off, given what is left to explain."""
    gain = x @ w
    return ((rest - 0.5 * gain) * gain / noise).sum(1)


def infer_segment(x: np.ndarray, y: np.ndarray, g: np.ndarray, model: Episodes) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass over the chains of a segment: probabilities of on, sums of steps, log evidence. Chains start off."""
    g, steps, evidence = g.copy(), np.zeros((model.k, 2, 2)), 0.0
    rest = y - x @ model.baseline
    for k in range(model.k):
        others = [n for n in range(model.k) if n != k]
        ll = np.zeros((1, len(x), 2))
        ll[0, :, 1] = on_likelihood(x, rest - responses(x, model.w, g, others), model.w[k], model.noise)
        start = np.array([1 - 1e-6, 1e-6])
        gamma, found, xi = forward_backward(ll, np.array([len(x)]), model.log_chain(k), start)
        g[:, k], steps[k], evidence = gamma[0, :, 1], xi[0], evidence + float(found[0])
    left = rest - responses(x, model.w, g, range(model.k))
    spread = sum(((g[:, k] * (1 - g[:, k]))[:, None] * (x @ model.w[k]) ** 2 for k in range(model.k)), np.zeros_like(y))
    return g, steps, evidence - 0.5 * float(((left**2 + spread) / model.noise).sum())


def _sums(x: np.ndarray, y: np.ndarray, g: np.ndarray, steps: np.ndarray, evidence: float) -> np.ndarray:
    """Products of the designs of the baseline, which is always on, and the chains, of them with the response,
    its squares, steps, evidence, size."""
    g = np.concatenate([np.ones((len(x), 1)), g], 1)
    both = np.einsum("na,nb->nab", g, g)
    both[:, range(g.shape[1]), range(g.shape[1])] = g
    parts = [np.einsum("nab,ni,nj->aibj", both, x, x), np.einsum("na,ni,nd->aid", g, x, y), (y**2).sum(0), steps, [evidence, len(x)]]
    return np.concatenate([np.ravel(p) for p in parts])


def _pass(held: DataFrame, model: Episodes) -> DataFrame:
    small_batches(held.sparkSession, BATCH_SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: batch.column(n) for n in (*KEY, "t", "x")} | {"g": [], "sums": []}
            for i, t in enumerate(batch.column("t")):
                flat = np.asarray(batch.column("x")[i].values, float).reshape(len(t), -1)
                x, y = rc.lagged_design(flat, model.family.orders, model.family.intercept), flat[max(model.family.orders) :]
                g = np.asarray(batch.column("g")[i].values, float).reshape(-1, model.k)
                if len(x):
                    g, steps, evidence = infer_segment(x, y, g, model)
                    out["sums"].append(_sums(x, y, g, steps, evidence).tolist())
                else:
                    out["sums"].append([])
                out["g"].append(g.ravel().tolist())
            yield pa.RecordBatch.from_pydict(out)

    return held.mapInArrow(run, _STATE)


def standout(weights: np.ndarray, baseline: np.ndarray, k: int) -> list[int]:
    """Of states' weights (m, p, d) the k that are farthest from the baseline and, one after the other, from
    those already taken."""
    taken: list[int] = []
    for _ in range(min(k, len(weights))):
        near = [min(np.linalg.norm(w - v) for v in (baseline, *(weights[i] for i in taken))) if n not in taken else -1.0 for n, w in enumerate(weights)]
        taken.append(int(np.argmax(near)))
    return taken


def initial(data: DataFrame, family: rc.Family, k: int, seed: int = 0, cycles: int = 15, keep_baseline: bool = False) -> tuple[Episodes, DataFrame]:
    """Chains from the states of a short run of a regression chain of k + 2 states that stand out from the
    baseline, and the segments with the probabilities of those states. The baseline is the regression of all
    data, or, if it is to be learned, that of the state which holds most of the time."""
    baseline, noise = baseline_weights(data, family)
    short = rc.fit_best(data, rc.Family(family.orders, family.intercept, "shareddiag"), k + 2, 3, 5, cycles, seed)
    if not keep_baseline:
        baseline = short.w[int(short.counts.sum(1).argmax())]
    taken = standout(short.w, baseline, k)
    prior = np.array([[9.0, 1.0], [1.0, 4.0]])
    model = Episodes(family, baseline, short.w[taken] - baseline, noise, np.stack([prior] * k), prior)
    cells = F.array_sort(F.collect_list(F.struct("t", "state", "p")))
    chosen = rc.decode(data, short).filter(F.col("state").isin([n + 1 for n in taken]))
    place = F.element_at(F.create_map(*(F.lit(v) for i, n in enumerate(taken) for v in (n + 1, i))), F.col("state"))
    found = chosen.withColumn("state", place).groupBy(*KEY).agg(cells.alias("c")).select(*KEY, F.col("c.p").alias("g"))
    held = rc.segments(data).join(found, list(KEY), "left").withColumn("g", F.coalesce("g", F.array().cast("array<double>")))
    return model, stage(held.select(*KEY, F.col("t").cast("array<int>").alias("t"), "x", "g", F.array().cast("array<double>").alias("sums")), "episodes")


def updated(model: Episodes, sums: np.ndarray, ridge: float = 1e-3, keep_baseline: bool = False) -> Episodes:
    """Weights of the baseline (or with that one kept) and all chains at once, noise, and chains' steps."""
    k, p, d = model.w.shape
    n = (k + 1) * p
    xx, at = sums[: n * n].reshape(n, n), n * n
    xy, at = sums[at : at + n * d].reshape(n, d), at + n * d
    yy, at = sums[at : at + d], at + d
    steps, tail = sums[at : at + 4 * k].reshape(k, 2, 2), sums[at + 4 * k :]
    if keep_baseline:
        chains = np.linalg.solve(xx[p:, p:] + ridge * np.eye(k * p), xy[p:] - xx[p:, :p] @ model.baseline)
        w = np.concatenate([model.baseline, chains])
    else:
        w = np.linalg.solve(xx + ridge * np.eye(n), xy)
    left = yy - 2 * np.einsum("nd,nd->d", w, xy) + np.einsum("nd,nm,md->d", w, xx, w)
    return replace(model, baseline=w[:p], w=w[p:].reshape(k, p, d), noise=np.maximum(left / tail[1], 1e-12), counts=model.prior + steps)


def fit(data: DataFrame, family: rc.Family, k: int, cycles: int = 30, tolerance: float = 1e-5, seed: int = 0, keep_baseline: bool = False) -> tuple[Episodes, DataFrame]:
    """(model, gamma): cycles until the evidence changes by less than ``tolerance`` of itself. With
    ``keep_baseline`` the baseline stays the regression of all data. ``gamma`` is
    (series_id, segment_id, t, state, p), p the probability that a chain is on: they don't sum to one."""
    model, held = initial(data, family, k, seed, keep_baseline=keep_baseline)
    history: list[float] = []
    for _ in range(cycles):
        fresh = stage(_pass(held, model), "episodes")
        discard(held)
        held = fresh
        rows = held.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        sums = np.zeros(len(rows))
        for r in rows:
            sums[r.i] = r.v
        # The evidence of the chains and the residuals, with the noise's own constant.
        history.append(float(sums[-2] - 0.5 * sums[-1] * np.log(model.noise).sum()))
        if len(history) > 1 and abs(history[-1] - history[-2]) < tolerance * abs(history[-1]):
            break
        model = updated(model, sums, keep_baseline=keep_baseline)
    top = max(family.orders)
    cells = F.expr(f"transform(g, (p, n) -> struct(t[int(n div {k}) + {top}] AS t, int(n % {k}) + 1 AS state, p AS p))")
    return replace(model, history=history), held.select(*KEY, F.inline(cells))


def chain_divergence(model: Episodes) -> float:
    """Divergence of all chains' steps from their priors."""
    return float(sum(kl_dirichlet(c[i], model.prior[i]) for c in model.counts for i in (0, 1)))


def step_likelihood(model: Episodes, steps: np.ndarray) -> float:
    """Expected log-likelihood of chains' steps (k, 2, 2) under the model's."""
    return float(sum((steps[n] * np.log(model.log_chain(n))).sum() for n in range(model.k)))
