"""Training of hidden-state models: variational Gaussian chains, dual estimates, stochastic steps.

One cycle is one Spark job: segments run their recursions as padded Arrow batches and return only
additive statistics (state mass, weighted sums and products, pair sums, evidence), which Spark adds
up. The driver then updates posteriors of K states; its memory depends on K and the channels, never
on the rows. A model is plain numpy and can be written as a long table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.special import digamma, kl_dirichlet, kl_wishart
from tidemark.operators.inference import BATCH_SEGMENTS, KEY, forward_backward, of_like_length, viterbi
from tidemark.session import discard, small_batches, stage


#: Observations that starting clusters are found in.
SAMPLE = 2000


@dataclass(frozen=True)
class Options:
    """Options of a fit. Unknown names are an error that names the nearest known one."""

    k: int = 3
    cycles: int = 50
    tolerance: float = 1e-5
    diagonal_prior: float = 10.0
    off_diagonal_prior: float = 1.0
    zero_mean: bool = False
    seed: int = 0
    least_mass: float = 5.0
    drop_states: bool = False

    @classmethod
    def of(cls, **given) -> Options:
        for name in given:
            if name not in cls.__dataclass_fields__:
                near = min(cls.__dataclass_fields__, key=lambda n: edit_distance(n, name))
                raise ValueError(f"unknown option {name}; did you mean {near}?")
        return cls(**given)


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions between two strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@dataclass
class Model:
    """Posteriors of a Gaussian chain: Dirichlet counts of start and transitions; per state a normal
    mean (mean, beta) given a Wishart precision of shape ``a`` and rate ``b``."""

    start: np.ndarray
    counts: np.ndarray
    mean: np.ndarray
    beta: np.ndarray
    a: np.ndarray
    b: np.ndarray
    prior: dict = field(default_factory=dict)
    history: list = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.start)

    def transition(self) -> np.ndarray:
        return self.counts / self.counts.sum(1, keepdims=True)

    def initial(self) -> np.ndarray:
        return self.start / self.start.sum()

    def covariance(self) -> np.ndarray:
        """Expected covariance of each state."""
        d = self.mean.shape[1]
        return self.b / (self.a - (d + 1) / 2)[:, None, None]

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        """Expected log density of samples (n, d) in each state."""
        d, out = x.shape[1], np.empty((len(x), self.k))
        for s in range(self.k):
            precision = self.a[s] * np.linalg.inv(self.b[s])
            e = x - self.mean[s]
            log_det = sum(digamma(self.a[s] - i / 2) for i in range(d)) - np.linalg.slogdet(self.b[s])[1]
            out[:, s] = 0.5 * (log_det - d * math.log(2 * math.pi) - d / self.beta[s] - np.einsum("ni,ij,nj->n", e, precision, e))
        return out

    def log_chain(self) -> tuple[np.ndarray, np.ndarray]:
        """exp of the expected logs of transitions and start."""
        rows = np.asarray(digamma(self.counts.ravel())).reshape(self.counts.shape) - np.asarray(digamma(self.counts.sum(1)))[:, None]
        return np.exp(rows), np.exp(np.asarray(digamma(self.start)) - digamma(self.start.sum()))

    def rows(self) -> list[tuple[int, str, int, int, float]]:
        """(state, param, i, j, value), for a table of models."""
        out = [(0, "start", i + 1, 0, float(v)) for i, v in enumerate(self.start)]
        out += [(i + 1, "counts", i + 1, j + 1, float(v)) for (i, j), v in np.ndenumerate(self.counts)]
        out += [(s + 1, "mean", i + 1, 0, float(v)) for (s, i), v in np.ndenumerate(self.mean)]
        out += [(s + 1, "rate", i + 1, j + 1, float(v)) for (s, i, j), v in np.ndenumerate(self.b)]
        return out + [(s + 1, n, 0, 0, float(v)) for n in ("beta", "a") for s, v in enumerate(getattr(self, n))]


def segments(observations: DataFrame) -> DataFrame:
    """(series_id, segment_id, t, x array) → a row per segment with times and flattened samples."""
    rows = F.array_sort(F.collect_list(F.struct("t", "x")))
    return observations.groupBy(*KEY).agg(rows.alias("rows")).select(*KEY, F.col("rows.t").alias("t"), F.flatten("rows.x").alias("x"))


def samples(grouped: DataFrame) -> DataFrame:
    """The observations of ``segments``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(t) for t in batch.column("t")], int)
            t, x = batch.column("t").flatten(), batch.column("x").flatten()
            ends = np.arange(len(t) + 1, dtype=np.int32) * (len(x) // max(1, len(t)))
            keys = {c: np.repeat(batch.column(c), lengths) for c in KEY}
            yield pa.RecordBatch.from_pydict(keys | {"t": t, "x": pa.ListArray.from_arrays(ends, x)})

    return grouped.mapInArrow(run, "series_id bigint, segment_id bigint, t int, x array<double>")


def _run_batches(grouped: DataFrame, make, schema: str) -> DataFrame:
    small_batches(grouped.sparkSession, BATCH_SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(make, of_like_length(batch))

    return grouped.mapInArrow(run, schema)


def _inferred(batch: pa.RecordBatch, model: Model):
    """Samples, their lengths, gamma, evidence and pair sums of a batch of segments."""
    d = model.mean.shape[1]
    lengths = np.array([len(t) for t in batch.column("t")], int)
    x = np.asarray(batch.column("x").flatten(), float).reshape(-1, d)
    ll = np.zeros((len(lengths), lengths.max(), model.k))
    inside = np.arange(ll.shape[1]) < lengths[:, None]
    ll[inside] = model.log_likelihood(x)
    gamma, evidence, xi = forward_backward(ll, lengths, *model.log_chain())
    return x, lengths, inside, ll, gamma, evidence, xi


def statistics(grouped: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """Sums over all segments, of the order of K squared plus K channels squared numbers."""
    k, d = model.k, model.mean.shape[1]

    def make(batch):
        x, _, inside, _, gamma, evidence, xi = _inferred(batch, model)
        g = gamma[inside]
        parts = [g.sum(0), g.T @ x, np.einsum("nk,ni,nj->kij", g, x, x), gamma[:, 0].sum(0), xi.sum(0), [evidence.sum(), float(len(x))]]
        flat = np.concatenate([np.ravel(p) for p in parts])
        return pa.RecordBatch.from_pydict({"i": np.arange(len(flat), dtype=np.int32), "v": flat})

    summed = dict(_run_batches(grouped, make, "i int, v double").groupBy("i").agg(F.sum("v")).collect())
    flat = np.array([summed[i] for i in range(len(summed))])
    shapes = {"mass": (k,), "first": (k, d), "second": (k, d, d), "start": (k,), "pairs": (k, k), "tail": (2,)}
    out, at = {}, 0
    for name, shape in shapes.items():
        n = int(np.prod(shape))
        out[name], at = flat[at : at + n].reshape(shape), at + n
    return out


def initial_model(observations: DataFrame, options: Options) -> Model:
    """Priors from the data's mean and spread; states start at the clusters of a sample of at most
    ``SAMPLE`` observations, those of least hash under the seed."""
    d = len(observations.first()["x"])
    cells = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)] + [F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(d)]
    row = observations.agg(*cells).first()
    mean, var = np.array(row[:d], float), np.maximum(np.array(row[d:], float), 1e-12)
    rng, k = np.random.default_rng(options.seed), options.k
    prior = {
        "mean": np.zeros(d) if options.zero_mean else mean,
        "beta": 1e6 if options.zero_mean else 0.1,
        "a": (d + 2) / 2,
        "b": np.diag(var) * (d + 2) / 2 / k,
        "start": np.ones(k),
        "counts": np.full((k, k), options.off_diagonal_prior) + np.eye(k) * (options.diagonal_prior - options.off_diagonal_prior),
    }
    if options.zero_mean:
        centre, rate = np.zeros((k, d)), np.stack([np.diag(var) * v for v in np.exp(rng.normal(0, 0.7, k))])
    else:
        picked = observations.orderBy(F.xxhash64(*KEY, "t", F.lit(options.seed))).limit(SAMPLE).select("x").collect()
        centre, rate = clusters(np.array([r[0] for r in picked], float), k, rng)
    shape = prior["a"] + 5
    return Model(np.ones(k), prior["counts"].copy(), centre, np.full(k, 10.0), np.full(k, shape), rate * shape, prior)


def clusters(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Centres and diagonal covariances of k groups: spread-out seeds, then means of nearest points."""
    scaled = x / np.maximum(x.std(0), 1e-12)
    seeds = [int(rng.integers(len(x)))]
    for _ in range(k - 1):
        d = ((scaled[:, None] - scaled[seeds][None]) ** 2).sum(2).min(1)
        seeds.append(int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(x))))
    centre = scaled[seeds]
    for _ in range(rounds):
        near = ((scaled[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.stack([scaled[near == s].mean(0) if (near == s).any() else centre[s] for s in range(k)])
    groups = [x[near == s] if (near == s).sum() > 1 else x for s in range(k)]
    return np.stack([g.mean(0) for g in groups]), np.stack([np.diag(np.maximum(g.var(0), 1e-6 * x.var(0) + 1e-12)) for g in groups])


def updated(model: Model, stats: dict[str, np.ndarray], scale: float = 1.0) -> Model:
    """Posteriors given (scaled) statistics."""
    p, n = model.prior, scale * stats["mass"]
    beta = p["beta"] + n
    mean = (p["beta"] * p["mean"] + scale * stats["first"]) / beta[:, None]
    second = scale * stats["second"] + p["beta"] * np.outer(p["mean"], p["mean"]) - beta[:, None, None] * np.einsum("ki,kj->kij", mean, mean)
    b = p["b"] + 0.5 * (second + second.transpose(0, 2, 1)) / 2
    return replace(model, start=p["start"] + scale * stats["start"], counts=p["counts"] + scale * stats["pairs"], mean=mean, beta=beta, a=p["a"] + n / 2, b=b)


def free_energy(model: Model, evidence: float) -> float:
    """Upper bound of minus the log evidence: minus the chain's evidence under expected parameters,
    plus the divergences of the posteriors from their priors."""
    p, d, total = model.prior, model.mean.shape[1], -evidence
    total += kl_dirichlet(model.start, p["start"]) + sum(kl_dirichlet(a, b) for a, b in zip(model.counts, p["counts"], strict=True))
    for s in range(model.k):
        total += kl_wishart(model.a[s], model.b[s], p["a"], p["b"])
        e = model.mean[s] - p["mean"]
        ratio = p["beta"] / model.beta[s]
        total += 0.5 * (d * (ratio - 1 - math.log(ratio)) + p["beta"] * model.a[s] * e @ np.linalg.inv(model.b[s]) @ e)
    return float(total)


def fit(observations: DataFrame, model: Model | None = None, grouped: DataFrame | None = None, **given) -> Model:
    """Cycles until the free energy changes by less than ``tolerance`` of itself. Its history is kept.
    With ``drop_states`` a state of less than ``least_mass`` samples goes. ``grouped`` are the segments
    where they are stored already."""
    options = Options.of(**given)
    grouped = stage(segments(observations), "segments") if grouped is None else grouped  # gathered once, read by every cycle
    model = model or initial_model(observations, options)
    history: list[float] = []
    for _ in range(options.cycles):
        stats = statistics(grouped, model)
        if options.drop_states and model.k > 1 and (stats["mass"] < options.least_mass).any() and (stats["mass"] >= options.least_mass).any():
            model, history = pruned(model, stats, options.least_mass), []
            stats = statistics(grouped, model)
        history.append(free_energy(model, stats["tail"][0]))
        if len(history) > 1 and abs(history[-2] - history[-1]) < options.tolerance * abs(history[-1]):
            break
        model = updated(model, stats)
    return replace(model, history=history)


def fit_stochastic(observations: DataFrame, batch: int, delay: float = 1.0, forget: float = 0.7, base: float = 0.95, **given) -> Model:
    """Cycles over samples of ``batch`` series, drawn without replacement with weights ``base`` to the power of
    how often a series was used; natural parameters blend with a step that shrinks as (cycle + delay)^-forget.
    The model of least estimated free energy is returned, with the history of all estimates. Draws follow
    from the series' ids, the cycle and the seed."""
    from tidemark.functions.columns import uniform

    options = Options.of(**given)
    model = initial_model(observations, options)
    grouped = stage(segments(observations), "segments")
    units = stage(grouped.select("series_id").distinct().withColumn("used", F.lit(0)), "units")
    n, best, history = units.count(), None, []
    for cycle in range(1, options.cycles + 1):
        # The largest of log(u) / weight are a weighted sample without replacement.
        key = F.log(1 - uniform(F.col("series_id"), F.lit(cycle), seed=options.seed)) / F.pow(F.lit(float(base)), F.col("used"))
        picked = stage(units.withColumn("key", key).orderBy(F.desc("key"), "series_id").limit(batch).select("series_id", F.lit(1).alias("now")), "picked", 8)
        fresh = stage(units.join(picked, "series_id", "left").select("series_id", (F.col("used") + F.coalesce("now", F.lit(0))).alias("used")), "units", 8)
        discard(units)
        units = fresh
        stats, share = statistics(grouped.join(picked.select("series_id"), "series_id", "left_semi"), model), min(1.0, batch / max(1, n))
        history.append(free_energy(model, stats["tail"][0] / share))
        if best is None or history[-1] < best[0]:
            best = history[-1], model
        discard(picked)
        model = blended(model, updated(model, stats, 1 / share), (cycle + delay) ** -forget)
    discard(grouped, units)
    return replace(best[1] if best else model, history=history)


def blended(old: Model, new: Model, rho: float) -> Model:
    """(1 - rho) of the old and rho of the new natural parameters."""
    mix = lambda x, y: (1 - rho) * x + rho * y
    beta = mix(old.beta, new.beta)
    weighted = mix(old.beta[:, None] * old.mean, new.beta[:, None] * new.mean)
    return replace(
        old, start=mix(old.start, new.start), counts=mix(old.counts, new.counts), beta=beta, mean=weighted / beta[:, None], a=mix(old.a, new.a), b=mix(old.b, new.b)
    )


def decode(observations: DataFrame, model: Model, kind: str = "posterior") -> DataFrame:
    """Gamma (…, t, state, p) or, with ``path``, the most likely states (…, t, state)."""

    def make(batch):
        _, lengths, inside, ll, gamma, _, _ = _inferred(batch, model)
        copies = model.k if kind == "posterior" else 1
        out = {c: np.repeat(batch.column(c).to_numpy(), lengths * copies) for c in KEY}
        out["t"] = np.repeat(np.asarray(batch.column("t").flatten()), copies).astype(np.int32)
        if kind == "posterior":
            out["state"] = np.tile(np.arange(1, model.k + 1, dtype=np.int32), int(lengths.sum()))
            out["p"] = gamma[inside].ravel()
        else:
            out["state"] = viterbi(ll, lengths, *model.log_chain())[inside].astype(np.int32)
        return pa.RecordBatch.from_pydict(out)

    schema = "series_id bigint, segment_id bigint, t int, state int" + (", p double" if kind == "posterior" else "")
    return _run_batches(segments(observations), make, schema)


def dual_estimates(observations: DataFrame, model: Model, grouped: DataFrame | None = None) -> DataFrame:
    """Each series' own model: one pass of inference under the group's, then one update. Long rows. ``grouped``
    are the segments where they are stored already."""
    k, d = model.k, model.mean.shape[1]

    def make(batch):
        x, lengths, inside, _, gamma, _, xi = _inferred(batch, model)
        starts, g = np.cumsum(lengths) - lengths, gamma[inside]
        first = g[:, :, None] * x[:, None]
        second = np.stack([np.add.reduceat(first * x[:, None, j, None], starts) for j in range(d)], 3)
        parts = [np.add.reduceat(g, starts), np.add.reduceat(first, starts), second, gamma[:, 0], xi]
        flat = np.concatenate([p.reshape(len(lengths), -1) for p in parts], 1)
        ends = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
        return pa.RecordBatch.from_pydict({"series_id": batch.column("series_id"), "v": pa.ListArray.from_arrays(ends, flat.ravel())})

    grouped = segments(observations) if grouped is None else grouped
    # The one shuffle: both sums of a series stay where its segments meet.
    parts = _run_batches(grouped, make, "series_id bigint, v array<double>").repartition("series_id").select("series_id", F.posexplode("v").alias("i", "v"))
    sums = parts.groupBy("series_id", "i").agg(F.sum("v").alias("v"))
    vectors = sums.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select("series_id", F.col("s.v").alias("v"))

    state, param, i, j, _ = zip(*model.rows(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at, stats = batch.num_rows, 0, {}
            v = np.asarray(batch.column("v").flatten(), float).reshape(n, -1)
            # One update for all: it takes the states of each series as further states.
            for name, shape in {"mass": (n * k,), "first": (n * k, d), "second": (n * k, d, d), "start": (n, k), "pairs": (n, k, k)}.items():
                size = int(np.prod(shape)) // n
                stats[name], at = v[:, at : at + size].reshape(shape), at + size
            found = updated(model, stats)
            value = np.concatenate([p.reshape(n, -1) for p in (found.start, found.counts, found.mean, found.b, found.beta, found.a)], 1)
            cells = {"state": np.tile(np.array(state, np.int32), n), "param": param * n, "i": np.tile(np.array(i, np.int32), n), "j": np.tile(np.array(j, np.int32), n)}
            yield pa.RecordBatch.from_pydict({"series_id": np.repeat(batch.column("series_id"), value.shape[1])} | cells | {"value": value.ravel()})

    return vectors.mapInArrow(run, "series_id bigint, state int, param string, i int, j int, value double")


def pruned(model: Model, stats: dict[str, np.ndarray], least: float) -> Model:
    """Without the states of a mass below ``least``."""
    keep = np.flatnonzero(stats["mass"] >= least)
    prior = model.prior | {"start": model.prior["start"][keep], "counts": model.prior["counts"][np.ix_(keep, keep)]}
    return replace(
        model, start=model.start[keep], counts=model.counts[np.ix_(keep, keep)], mean=model.mean[keep], beta=model.beta[keep], a=model.a[keep], b=model.b[keep], prior=prior
    )


def cross_validate(observations: DataFrame, folds: int, **given) -> list[float]:
    """Held-out log evidence per sample of each fold; a fold is a hash of the segment."""
    fold = F.pmod(F.xxhash64("series_id", "segment_id", F.lit(given.get("seed", 0))), F.lit(folds))
    grouped, out = stage(segments(observations), "segments"), []
    for f in range(folds):
        model = fit(observations.filter(fold != f), grouped=grouped.filter(fold != f), **given)
        tail = statistics(grouped.filter(fold == f), model)["tail"]
        out.append(float(tail[0] / tail[1]))
    discard(grouped)
    return out


def symmetric_divergence(p: Model, q: Model) -> float:
    """Mean of both directions' divergences between chains and emissions, states weighted by use."""

    def one(a: Model, b: Model) -> float:
        total = sum(kl_dirichlet(x, y) for x, y in zip(a.counts, b.counts, strict=True)) + kl_dirichlet(a.start, b.start)
        return total + sum(kl_wishart(a.a[s], a.b[s], b.a[s], b.b[s]) for s in range(a.k))

    return 0.5 * (one(p, q) + one(q, p))


def chain_prior(k: int, diagonal: float = 10.0, off: float = 1.0, mask=None, weight: float = 1.0) -> np.ndarray:
    """Dirichlet counts of transitions: ``diagonal`` on the diagonal, ``off`` elsewhere, none where ``mask`` is
    false, all times ``weight``."""
    counts = (np.full((k, k), off) + (diagonal - off) * np.eye(k)) * weight
    return counts if mask is None else np.where(np.asarray(mask, bool), counts, 0.0)


def state_distances(p: Model, q: Model) -> np.ndarray:
    """Symmetric divergences (states of p, states of q) of emissions."""
    out = np.empty((p.k, q.k))
    for i in range(p.k):
        for j in range(q.k):
            apart = p.mean[i] - q.mean[j]
            shift = 0.25 * apart @ (np.linalg.inv(p.covariance()[i]) + np.linalg.inv(q.covariance()[j])) @ apart
            out[i, j] = 0.5 * (kl_wishart(p.a[i], p.b[i], q.a[j], q.b[j]) + kl_wishart(q.a[j], q.b[j], p.a[i], p.b[i])) / max(p.a[i], q.a[j]) + shift
    return out


def reordered(model: Model, order) -> Model:
    """The model with its states in another order."""
    order = list(order)
    prior = model.prior | {"start": model.prior["start"][order], "counts": model.prior["counts"][np.ix_(order, order)]}
    return replace(model, start=model.start[order], counts=model.counts[np.ix_(order, order)], mean=model.mean[order], beta=model.beta[order], a=model.a[order], b=model.b[order], prior=prior)


def start_by_batches(observations: DataFrame, batches: int, **given) -> Model:
    """A start for stochastic training: series are dealt into batches, each batch gets a model of its own, whose
    states are matched with the first one's by least divergence, and the sums under all of them make one
    update. ``given`` are options of the fits."""
    from tidemark.functions.columns import uniform
    from tidemark.operators.pairs import assign

    options = Options.of(**given)
    deal = F.floor(uniform(F.col("series_id"), seed=options.seed) * batches)
    grouped, base = stage(segments(observations), "segments"), initial_model(observations, options)
    first, total = None, None
    for n in range(batches):
        part = grouped.filter(deal == n)
        if part.isEmpty():
            continue
        model = fit(observations.filter(deal == n), base, part, **given)
        if first is None:
            first = model
        else:
            model = reordered(model, [int(i) for i in assign(state_distances(first, model))])
        sums = statistics(part, model)
        total = sums if total is None else {name: total[name] + v for name, v in sums.items()}
    discard(grouped)
    return base if total is None else updated(base, total)


def from_courses(observations: DataFrame, gamma: DataFrame, k: int, **given) -> Model:
    """The model of given time-courses (…, t, state, p): one update from weighted sums, which are one aggregate,
    and the chain's steps from products of neighbouring probabilities."""
    from tidemark.operators.dynamics import approximate_pairs

    options = Options.of(**given | {"k": k})
    base = initial_model(observations, options)
    d = base.mean.shape[1]
    x = [F.col("x")[i] for i in range(d)]
    cells = [F.sum("p").alias("n"), *(F.sum(F.col("p") * v).alias(f"f{i}") for i, v in enumerate(x))]
    cells += [F.sum(F.col("p") * x[i] * x[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(d)]
    rows = {r.state: r for r in gamma.join(observations, [*KEY, "t"]).groupBy("state").agg(*cells).collect()}
    began = {r.state: r.p for r in gamma.filter("t = 1").groupBy("state").agg(F.sum("p").alias("p")).collect()}
    steps = {(r.i, r.j): r.p for r in approximate_pairs(gamma).groupBy("i", "j").agg(F.sum("p").alias("p")).collect()}
    value = lambda s, name: float(rows[s][name]) if s in rows else 0.0
    states = range(1, k + 1)
    return updated(
        base,
        {
            "mass": np.array([value(s, "n") for s in states]),
            "first": np.array([[value(s, f"f{i}") for i in range(d)] for s in states]),
            "second": np.array([[[value(s, f"s{i}_{j}") for j in range(d)] for i in range(d)] for s in states]),
            "start": np.array([began.get(s, 0.0) for s in states]),
            "pairs": np.array([[steps.get((i, j), 0.0) for j in states] for i in states]),
        },
    )


def sequential_start(path_length: int, k: int) -> np.ndarray:
    """States of equal length in order: ceil(k t / n)."""
    t = np.arange(1, path_length + 1)
    return -(-k * t // path_length)


def fit_best(observations: DataFrame, repetitions: int, short: int = 5, **given) -> Model:
    """Several short runs from different seeds; the one of least free energy goes on to the end."""
    seed = given.pop("seed", 0)
    cycles = given.pop("cycles", Options.cycles)
    grouped = stage(segments(observations), "segments")
    runs = [fit(observations, grouped=grouped, cycles=short, seed=seed + n, **given) for n in range(repetitions)]
    best = min(runs, key=lambda m: m.history[-1])
    rest = fit(observations, best, grouped, cycles=cycles, seed=seed, **given)
    discard(grouped)
    return replace(rest, history=best.history + rest.history)


def agreement(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Per series the share of probability that two time-courses of ``k`` states have in common once
    the second's states are aligned with the first's."""
    from tidemark.operators.pairs import align_states, state_overlap

    order = align_states(state_overlap(first, second), k)
    back = F.create_map(*(F.lit(x) for i, j in enumerate(order, 1) for x in (j, i)))
    aligned = second.select(*KEY, "t", back[F.col("state")].alias("state"), F.col("p").alias("q"))
    both = first.join(aligned, [*KEY, "t", "state"])
    return both.groupBy("series_id").agg((F.sum(F.least("p", "q")) / F.sum("p")).alias("agreement"))


def behaviour_association(gamma: DataFrame, behaviour: DataFrame, k: int) -> DataFrame:
    """Share of the variance of ``behaviour`` (series_id, segment_id, y) that the state probabilities
    explain at each time; the last state is left out, as probabilities sum to one."""
    from tidemark.operators.decode_task import predicted_by_time, r_squared, regression_by_time

    columns = [F.sum(F.when(F.col("state") == s, F.col("p"))).alias(f"p{s}") for s in range(1, k)]
    wide = gamma.groupBy(*KEY, "t").agg(*columns).join(behaviour, list(KEY))
    names = [f"p{s}" for s in range(1, k)]
    return r_squared(predicted_by_time(wide, names, regression_by_time(wide, names, "y", 1e-8)))
