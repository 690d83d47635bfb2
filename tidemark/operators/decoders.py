"""Decoders and encoders of events: over states, over time points, by class, and how sure they are.

Everything that is learned comes from sums of products per time, class, state or fold, which are one
aggregate; small systems are solved where their sums are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import uniform
from tidemark.operators import moments
from tidemark.session import stage

KEY = ("series_id", "segment_id")


def encoding_by_time(wide: DataFrame, channels: Sequence[str], target: str, by: Sequence[str] = ("t",)) -> DataFrame:
    """(by…, channel, r2): share of each channel's variance at a time that a line on ``target`` explains;
    null where either doesn't vary."""
    cells = F.array(*(F.struct(F.lit(n).alias("channel"), F.regr_r2(F.col(c), F.col(target)).alias("r2")) for n, c in enumerate(channels, 1)))
    return wide.groupBy(*by).agg(cells.alias("c")).select(*by, F.inline("c"))


def encoding_by_state(wide: DataFrame, channels: Sequence[str], target: str, weight: Column, ridge: float = 1e-6) -> DataFrame:
    """(state, channel, beta, r2): weighted lines of each channel, less its overall mean, on ``target`` in each
    state, and the share of the channel's weighted squares they explain."""
    means = wide.select(*channels, weight.alias("w")).agg(*(F.avg(c) for c in channels)).first()
    x = [F.col(c) - float(m or 0.0) for c, m in zip(channels, means, strict=True)]
    y = F.col(target)
    s = lambda v: F.sum(weight * v)
    sums = [s(F.lit(1.0)).alias("n"), s(y).alias("y"), s(y * y).alias("yy")]
    for n, v in enumerate(x):
        sums += [s(v).alias(f"x{n}"), s(v * y).alias(f"xy{n}"), s(v * v).alias(f"xx{n}")]
    a, b, c = F.col("n") + ridge, F.col("y"), F.col("yy") + ridge
    det = a * c - b * b
    cells = []
    for n in range(len(x)):
        u, v, q = F.col(f"x{n}"), F.col(f"xy{n}"), F.col(f"xx{n}")
        b0, b1 = (c * u - b * v) / det, (a * v - b * u) / det
        rest = q - 2 * (b0 * u + b1 * v) + b0 * b0 * F.col("n") + 2 * b0 * b1 * F.col("y") + b1 * b1 * F.col("yy")
        cells.append(F.struct(F.lit(n + 1).alias("channel"), b1.alias("beta"), (1 - F.try_divide(rest, q)).alias("r2")))
    return wide.groupBy("state").agg(*sums).select("state", F.inline(F.array(*cells)))


def class_moments(wide: DataFrame, channels: Sequence[str], label: str, by: Sequence[str]) -> DataFrame:
    """(by…, class, n, mean array, cross array) of channels by class: what linear discriminants need."""
    cross = [F.sum(F.col(a) * F.col(b)) for a in channels for b in channels]
    return wide.groupBy(*by, F.col(label).alias("class")).agg(F.count("*").alias("n"), F.array(*(F.avg(c) for c in channels)).alias("mean"), F.array(*cross).alias("cross"))


def discriminants(classes: DataFrame, by: Sequence[str], ridge: float = 1e-6) -> DataFrame:
    """(by…, class, bias, weights): linear discriminants under one covariance for all classes, equal priors."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class")
        mean, n = np.stack(rows["mean"].to_numpy()), rows["n"].to_numpy(float)
        d = mean.shape[1]
        cross = np.stack(rows["cross"].to_numpy()).reshape(-1, d, d)
        cov = (cross - n[:, None, None] * np.einsum("ci,cj->cij", mean, mean)).sum(0) / n.sum() + ridge * np.eye(d)
        w = np.linalg.solve(cov, mean.T).T
        return pd.DataFrame({b: rows[b].iloc[0] for b in by} | {"class": rows["class"].to_numpy(), "bias": -0.5 * (w * mean).sum(1), "weights": list(w)})

    types = ", ".join(f"{b} {classes.schema[b].dataType.simpleString()}" for b in by)
    return classes.groupBy(*by).applyInPandas(solve, f"{types}, class {classes.schema['class'].dataType.simpleString()}, bias double, weights array<double>")


def classify(wide: DataFrame, channels: Sequence[str], models: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys…, class, p): softmax of the discriminants' scores of every class of a sample's group."""
    score = F.col("bias") + sum((F.col(c) * F.col("weights")[i] for i, c in enumerate(channels)), F.lit(0.0))
    scored = wide.select(*dict.fromkeys([*keys, *by, *channels])).join(models, list(by)).select(*keys, "class", score.alias("s"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    e = F.exp(F.col("s") - F.max("s").over(w))
    return scored.withColumn("e", e).select(*keys, "class", (F.col("e") / F.sum("e").over(w)).alias("p"))


def predicted_class(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The class of the highest p, the lowest of equals."""
    return scores.groupBy(*keys).agg(F.max_by("class", F.struct("p", -F.col("class"))).alias("predicted"))


def classification_by_time(wide: DataFrame, channels: Sequence[str], label: str, keys: Sequence[str] = (*KEY, "t")) -> DataFrame:
    """(t, accuracy, n): cross-validated linear discriminants at each time; ``wide`` has a column ``fold``.
    The moments of a fold's rest are those of all less its own, so every row is read once. A fold whose
    rest lacks a class is judged among the classes it has; one without any is left out."""
    own = class_moments(wide, channels, label, ["t", "fold"])
    d = len(channels)
    total = lambda c, k: F.array(*(F.sum(F.col(c)[i] * (F.col("n") if k else F.lit(1.0))) for i in range(d if k else d * d)))
    every = own.groupBy("t", "class").agg(F.sum("n").alias("all_n"), total("mean", True).alias("all_sum"), total("cross", False).alias("all_cross"))
    folds = sorted(r.fold for r in wide.select("fold").distinct().collect())  # a handful
    grid = every.withColumn("fold", F.explode(F.array(*(F.lit(f) for f in folds)))) if folds else every.withColumn("fold", F.lit(0))
    rest = grid.join(own, ["t", "class", "fold"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("left", F.col("all_n") - F.col("n")).filter("left > 0")
    mean = F.expr("transform(all_sum, (x, i) -> (x - coalesce(mean[i] * n, 0D)) / left)")
    cross = F.expr("transform(all_cross, (x, i) -> x - coalesce(cross[i], 0D))")
    rest = rest.select("t", "fold", "class", F.col("left").alias("n"), mean.alias("mean"), cross.alias("cross"))
    scores = classify(wide, channels, discriminants(rest, ["t", "fold"]), ["t", "fold"], keys)
    found = predicted_class(scores, keys).join(wide.select(*dict.fromkeys([*keys, "t"]), F.col(label).alias("truth")), list(keys))
    return found.groupBy("t").agg(F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def logistic_by_time(wide: DataFrame, channels: Sequence[str], label: str, rounds: int = 8, ridge: float = 1e-3, by: Sequence[str] = ("t",)) -> DataFrame:
    """(by…, term, beta): ridge logistic regression of a 0 or 1 label with intercept (term 0) in each group,
    by Newton steps; a step is one aggregate over all rows and a small solve for each group."""
    k = len(channels) + 1
    x = [F.lit(1.0), *(F.col(c) for c in channels)]
    types = ", ".join(f"{b} {wide.schema[b].dataType.simpleString()}" for b in by)
    betas = stage(wide.select(*by).distinct().withColumn("beta", F.array(*[F.lit(0.0)] * k)), "logistic")
    for _ in range(rounds):
        logit = sum((v * F.col("beta")[i] for i, v in enumerate(x)), F.lit(0.0))
        p = 1 / (1 + F.exp(-logit))
        joined = wide.join(betas, list(by)).withColumn("p", p)
        weight = F.col("p") * (1 - F.col("p"))
        hessian = F.array(*(F.sum(weight * a * b) for a in x for b in x))
        gradient = F.array(*(F.sum(a * (F.col(label) - F.col("p"))) for a in x))
        sums = joined.groupBy(*by).agg(hessian.alias("h"), gradient.alias("g"), F.first("beta").alias("beta"))

        def solve(batches):
            for rows in batches:
                fresh = []
                for h, g, beta in zip(rows["h"], rows["g"], rows["beta"], strict=True):
                    step = np.linalg.solve(np.reshape(h, (k, k)) + ridge * np.eye(k), np.asarray(g) - ridge * np.asarray(beta))
                    fresh.append((np.asarray(beta) + step).tolist())
                yield pd.DataFrame({b: rows[b] for b in by} | {"beta": fresh})

        betas = stage(sums.mapInPandas(solve, f"{types}, beta array<double>"), "logistic")
    return betas.select(*by, F.posexplode("beta").alias("term", "beta"))


def sparsified(gamma: DataFrame, least: float = 1e-3) -> DataFrame:
    """Gamma of states held to their time: a normal curve is fitted to each state's mean course by its
    moments over time, a state is zero where the curve is below ``least`` of its top, and the rest is
    normalised anew; samples where all are zero keep their probabilities."""
    course = gamma.groupBy("state", "t").agg(F.avg("p").alias("p"))
    fitted = course.groupBy("state").agg((F.sum(F.col("p") * F.col("t")) / F.sum("p")).alias("m"), (F.sum(F.col("p") * F.col("t") * F.col("t")) / F.sum("p")).alias("q"))
    d = F.col("t") - F.col("m")
    inside = F.exp(-0.5 * d * d / F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(1e-12))) >= least
    held = gamma.join(F.broadcast(fitted.select("state", "m", "q")), "state").withColumn("kept", F.when(inside, F.col("p")).otherwise(0.0))
    from pyspark.sql import Window

    total = F.sum("kept").over(Window.partitionBy(*KEY, "t"))
    return held.select(*KEY, "t", "state", F.when(total > 0, F.col("kept") / total).otherwise(F.col("p")).alias("p"))


def behaviour_by_transitions(pairs: DataFrame, behaviour: DataFrame, k: int, folds: int, ridge: float = 1e-4, seed: int = 0) -> DataFrame:
    """(series_id, y, yhat) of a behaviour (series_id, y) predicted, out of fold, by ridge regression on the
    pair shares (series_id, i, j, share) of k states."""
    names = [f"f{i}_{j}" for i in range(1, k + 1) for j in range(1, k + 1)]
    cells = [F.coalesce(F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col("share"))), F.lit(0.0)).alias(f"f{i}_{j}") for i in range(1, k + 1) for j in range(1, k + 1)]
    wide = pairs.groupBy("series_id").agg(*cells).join(behaviour, "series_id").withColumn("fold", F.floor(uniform(F.col("series_id"), seed=seed) * folds).cast("int"))
    return ridge_out_of_fold(stage(wide, "behaviour"), names, "y", [ridge]).select("series_id", "y", "yhat")


def ridge_out_of_fold(wide: DataFrame, names: Sequence[str], target: str, ridges: Sequence[float]) -> DataFrame:
    """``wide`` (a column ``fold`` among others) with ``yhat`` from ridge regressions on the other folds; with
    several ridges each fold takes the one of least error when the folds of its rest predict each other.
    Sums of products by fold (the folds times the square of the columns) are all that reaches the driver."""
    p = len(names)
    sums = moments.products(wide, [*names, target], None, ["fold"]).collect()
    by = {f: moments.matrix([(r.i, r.j, r.s) for r in sums if r.fold == f], p + 1) for f in sorted({r.fold for r in sums})}

    def solve(folds, ridge):
        m = sum(by[f] for f in folds) if folds else np.zeros((p + 2, p + 2))
        n = max(m[0, 0], 1.0)
        mean = m[0, 1 : p + 2] / n
        centred = m[1 : p + 2, 1 : p + 2] - n * np.outer(mean, mean)
        beta = np.linalg.solve(centred[:p, :p] + ridge * np.eye(p), centred[:p, p])
        return np.r_[mean[p] - beta @ mean[:p], beta]

    def error(folds, beta):
        m = sum(by[f] for f in folds)
        full = np.r_[beta, -1.0]
        return float(full @ m @ full)

    cells, value = F.lit(None).cast("double"), None
    for f in by:
        rest = [g for g in by if g != f]
        best = min(ridges, key=lambda r: sum(error([g], solve([h for h in rest if h != g], r)) for g in rest)) if len(ridges) > 1 else ridges[0]
        beta = solve(rest, best)
        value = sum((F.col(n) * float(b) for n, b in zip(names, beta[1:], strict=True)), F.lit(float(beta[0])))
        cells = F.when(F.col("fold") == f, value).otherwise(cells)
    return wide.withColumn("yhat", cells)


def prediction_scores(scored: DataFrame) -> DataFrame:
    """(sse, cod, r) of columns y and yhat."""
    e = F.col("y") - F.col("yhat")
    return scored.agg(F.sum(e * e).alias("sse"), (1 - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count("*"))).alias("cod"), F.corr("y", "yhat").alias("r"))


def cluster_decoding(wide: DataFrame, predictors: Sequence[str], target: str, k: int, method: str = "regression", rounds: int = 50, ridge: float = 1e-5) -> DataFrame:
    """(t, state) of K regressions that take turns over time, the same for all trials. ``sequential`` gives
    each state a stretch of equal length; ``regression`` goes on from there: states are fitted to the times
    they have, and each time takes the state of least error, until nothing changes; ``hierarchical`` joins
    the times, one after the other, whose regressions predict each other best. Sums of products by time are
    collected, a small matrix for each time of a trial."""
    p = len(predictors)
    rows = moments.products(wide, [*predictors, target], None, ["t"]).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.t, []).append((r.i, r.j, r.s))
    times = sorted(by)
    sums = np.stack([moments.matrix(by[t], p + 1) for t in times])

    def fitted(m):
        return np.r_[np.linalg.solve(m[: p + 1, : p + 1] + ridge * np.eye(p + 1), m[: p + 1, p + 1]), -1.0]

    states = -(-k * np.arange(1, len(times) + 1) // len(times)) - 1
    if method == "hierarchical":
        groups = [[i] for i in range(len(times))]
        while len(groups) > k:
            betas, total = [fitted(sums[g].sum(0)) for g in groups], [sums[g].sum(0) for g in groups]
            cost = {(a, b): sum(x @ total[q] @ x / max(total[q][0, 0], 1.0) for x, q in ((betas[a], b), (betas[b], a))) for a in range(len(groups)) for b in range(a)}
            a, b = min(cost, key=cost.get)
            groups[b] += groups.pop(a)
        for s, g in enumerate(sorted(groups, key=min)):
            states[g] = s
    elif method == "regression":
        for _ in range(rounds):
            betas = [fitted(sums[states == s].sum(0)) if (states == s).any() else None for s in range(k)]
            errors = np.stack([np.full(len(times), np.inf) if b is None else np.einsum("i,tij,j->t", b, sums, b) for b in betas], 1)
            fresh = errors.argmin(1)
            if (fresh == states).all():
                break
            states = fresh
    elif method != "sequential":
        raise ValueError("method is sequential, regression or hierarchical")
    return wide.sparkSession.createDataFrame([(int(t), int(s) + 1) for t, s in zip(times, states, strict=True)], "t int, state int")


def is_euclidean(distances: np.ndarray, tolerance: float = 1e-10) -> bool:
    """Whether a square matrix of distances is one of points in space: its centred squares have no negative
    eigenvalue."""
    d = np.asarray(distances, float)
    if d.ndim != 2 or d.shape[0] != d.shape[1] or (d < 0).any() or not np.allclose(d, d.T):
        return False
    p = np.eye(len(d)) - 1 / len(d)
    values = np.linalg.eigvalsh(p @ (-0.5 * d * d) @ p)
    return bool((values >= -tolerance * max(1.0, np.abs(values).max())).all())


def class_targets(data: DataFrame, label: str, classes: Sequence[int], low: float = -1.0) -> DataFrame:
    """Adds ``y``: for each class 1 or ``low``. A decoder of these takes a family without intercept, as with one
    its states would stand for the classes; an encoder, whose design they are, takes ``low`` 0."""
    return data.withColumn("y", F.array(*(F.when(F.col(label) == c, 1.0).otherwise(low) for c in classes)))


def decoded_classes(predictions: DataFrame, classes: Sequence[int]) -> DataFrame:
    """(series_id, segment_id, t, i, y, yhat) of class responses → (series_id, segment_id, t, label, predicted),
    the first of equals."""
    best = lambda c: F.element_at(F.array(*(F.lit(int(x)) for x in classes)), F.max_by("i", F.struct(c, -F.col("i"))))
    return predictions.groupBy(*KEY, "t").agg(best("y").alias("label"), best("yhat").alias("predicted"))


def prepared(data: DataFrame, target: str, keep: int) -> tuple[DataFrame, list[int]]:
    """Data of a decoder made ready: channels of ``x`` less their means at each time, an intercept in front, and
    of the channels the ``keep`` on which a line on ``target`` explains most of the variance; and which these
    are (from 1, ties to the first)."""
    d = len(data.first()["x"])
    wide = data.select("*", *(F.col("x")[i].alias(f"c{i + 1}") for i in range(d)))
    means = wide.groupBy("t").agg(*(F.avg(f"c{i + 1}").alias(f"m{i + 1}") for i in range(d)))
    centred = wide.join(means, "t").withColumns({f"c{i + 1}": F.col(f"c{i + 1}") - F.col(f"m{i + 1}") for i in range(d)})
    row = centred.agg(*(F.coalesce(F.regr_r2(F.col(f"c{i + 1}"), F.col(target)), F.lit(0.0)).alias(f"r{i}") for i in range(d))).first()
    chosen = sorted(sorted(range(d), key=lambda i: (-row[i], i))[:keep])
    return centred.withColumn("x", F.array(F.lit(1.0), *(F.col(f"c{i + 1}") for i in chosen))).select(*data.columns), [i + 1 for i in chosen]


def discriminate_by_states(data: DataFrame, model, course: DataFrame, classes: Sequence[int]) -> DataFrame:
    """(series_id, segment_id, t, class, p): classes by the likelihood of ``x`` under an encoder, a chain of
    regressions of x on class responses with an intercept and one noise for all states, its states mixed by
    ``course`` (t, state, p); a softmax over the classes."""
    from pyspark.sql import Window

    if not model.family.shared:
        raise ValueError("the encoder needs one noise for all states")
    d, omega = model.w.shape[2], model.precision(0)
    means = F.array(*(F.array(*(F.array(*(F.lit(float(model.w[s, 0, i] + model.w[s, c + 1, i])) for i in range(d))) for c in range(len(classes)))) for s in range(model.k)))
    mixed = course.select("t", F.posexplode(F.element_at(means, F.col("state"))).alias("c", "m"), "p").groupBy("t", "c").agg(*((F.sum(F.col("p") * F.col("m")[i]) / F.sum("p")).alias(f"m{i}") for i in range(d)))
    e = [F.col("x")[i] - F.col(f"m{i}") for i in range(d)]
    score = -0.5 * sum((e[i] * e[j] * float(omega[i, j]) for i in range(d) for j in range(d)), F.lit(0.0))
    scored = data.select(*KEY, "t", "x").join(mixed, "t").select(*KEY, "t", F.element_at(F.array(*(F.lit(int(c)) for c in classes)), F.col("c") + 1).alias("class"), score.alias("s"))
    w = Window.partitionBy(*KEY, "t")
    shifted = F.exp(F.col("s") - F.max("s").over(w))
    return scored.withColumn("q", shifted).select(*KEY, "t", "class", (F.col("q") / F.sum("q").over(w)).alias("p"))


def decoding_permutations(wide: DataFrame, predictors: Sequence[str], trials: DataFrame, permutations: int, ridge: float = 1e-4, seed: int = 0) -> DataFrame:
    """(t, observed, p): share of a trait's variance that channels explain at each time, against trials dealt
    anew. ``wide`` has (trial, t, predictors), ``trials`` (trial, y)."""
    from tidemark.operators import stats

    k = len(predictors)
    dealt = stats.permuted(trials, "trial", "y", permutations, seed)
    sums = moments.products(wide.join(dealt, "trial"), [*predictors, "y"], None, ["perm", "t"])

    def explained(rows: pd.DataFrame) -> pd.DataFrame:
        m = moments.matrix(rows[["i", "j", "s"]].itertuples(index=False), k + 1)
        beta = np.r_[np.linalg.solve(m[: k + 1, : k + 1] + ridge * np.eye(k + 1), m[: k + 1, k + 1]), -1.0]
        spread = m[k + 1, k + 1] - m[0, k + 1] ** 2 / m[0, 0]
        return pd.DataFrame({"perm": rows["perm"].iloc[0], "t": rows["t"].iloc[0], "stat": [float(1 - beta @ m @ beta / spread) if spread > 1e-12 else 0.0]})

    found = sums.groupBy("perm", "t").applyInPandas(explained, f"perm int, t {wide.schema['t'].dataType.simpleString()}, stat double")
    return stats.p_values(found, ["t"], "stat")


def chain_permutations(data: DataFrame, family, k: int, folds: int, permutations: int, cycles: int = 5, seed: int = 0) -> DataFrame:
    """(t, i, observed, p): cross-validated explained variance of a time-varying decoder, against responses of
    whole segments dealt anew among segments of one length. Every permutation is a fit of its own."""
    from tidemark.operators import regression_chain as rc
    from tidemark.operators import stats

    whole = data.groupBy(*KEY).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("t", "y"))).alias("ys"))
    units = whole.select(F.concat_ws("/", *KEY).alias("unit"), *KEY, "n", "ys")
    found = None
    for perm in range(permutations + 1):
        if perm:
            from pyspark.sql import Window

            order = F.md5(F.concat_ws(":", "unit", F.lit(str(perm)), F.lit(str(seed))).cast("binary"))
            home = units.select(*KEY, "n", F.row_number().over(Window.partitionBy("n").orderBy("unit")).alias("at"))
            dealt = units.select("n", "ys", F.row_number().over(Window.partitionBy("n").orderBy(order, "unit")).alias("at"))
            ys = home.join(dealt, ["n", "at"]).select(*KEY, F.inline("ys"))
            turned = stage(data.select(*KEY, "t", "x").join(ys, [*KEY, "t"]), "dealt")
        else:
            turned = data
        part = rc.cross_validated(turned, family, k, folds, cycles, seed).select("t", "i", F.coalesce("r2", F.lit(0.0)).alias("stat"), F.lit(perm).alias("perm"))
        part = stage(part, "permutation")
        found = part if found is None else found.unionAll(part)
    return stats.p_values(found, ["t", "i"], "stat")


def phenotype_from_chains(observations: DataFrame, traits: DataFrame, k: int, folds: int, ridges: Sequence[float], seed: int = 0, cycles: int = 10) -> DataFrame:
    """(series_id, y, yhat): a trait (series_id, y) predicted from each series' own model. For each fold the chain
    is trained on the other folds' series, all series get their estimates under it, and a ridge regression on
    these, its strength chosen within the rest, predicts the fold."""
    from tidemark.operators import train

    fold = F.floor(uniform(F.col("series_id"), seed=seed) * folds).cast("int")
    out = None
    for f in range(folds):
        model = train.fit(observations.filter(fold != f), k=k, cycles=cycles, seed=seed)
        rows = train.dual_estimates(observations, model).filter("param IN ('mean', 'counts')")
        name = F.concat_ws("_", "param", F.col("state").cast("string"), F.col("i").cast("string"), F.col("j").cast("string"))
        d = model.mean.shape[1]
        names = [f"mean_{s}_{i}_0" for s in range(1, k + 1) for i in range(1, d + 1)] + [f"counts_{s}_{s}_{j}" for s in range(1, k + 1) for j in range(1, k)]
        share = rows.withColumn("name", name).groupBy("series_id").agg(*(F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in names))
        wide = stage(share.join(traits, "series_id").withColumn("fold", fold), "chains")
        part = ridge_out_of_fold(wide, names, "y", ridges).filter(F.col("fold") == f).select("series_id", "y", "yhat")
        out = part if out is None else out.unionAll(part)
    return out
