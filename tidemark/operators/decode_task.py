"""Decoding of targets from channels: regressions per time point, mixtures of decoders, scores.

Normal equations are sums per time point and fold, so they are one aggregate; each small system is
then solved where its sums are, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import moments


def regression_by_time(wide: DataFrame, predictors: Sequence[str], target: str, ridge: float = 1e-4, by: Sequence[str] = ("t",)) -> DataFrame:
    """(by…, term, beta): ridge regression with intercept (term 0) in each group."""
    k = len(predictors)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        sums = moments.matrix(rows[["i", "j", "s"]].itertuples(index=False), k + 1)
        beta = np.linalg.solve(sums[: k + 1, : k + 1] + ridge * np.eye(k + 1), sums[: k + 1, k + 1])
        return pd.DataFrame({b: rows[b].iloc[0] for b in by} | {"term": np.arange(k + 1, dtype=np.int32), "beta": beta})

    sums = moments.products(wide, [*predictors, target], None, by)
    schema = ", ".join(f"{b} {wide.schema[b].dataType.simpleString()}" for b in by) + ", term int, beta double"
    return sums.groupBy(*by).applyInPandas(solve, schema)


def predicted_by_time(wide: DataFrame, predictors: Sequence[str], betas: DataFrame, by: Sequence[str] = ("t",)) -> DataFrame:
    """Adds ``yhat`` from (by…, term, beta)."""
    vectors = betas.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("term", "beta"))).alias("__betas"))
    value = sum((F.col(n) * F.col("__betas")[i].getField("beta") for i, n in enumerate(predictors, 1)), F.col("__betas")[0].getField("beta"))
    return wide.join(vectors, list(by)).withColumn("yhat", value).drop("__betas")


def r_squared(scored: DataFrame, by: Sequence[str] = ("t",)) -> DataFrame:
    """(by…, r2) of columns y and yhat."""
    return moments.prediction_error(scored, by).select(*by, F.col("explained").alias("r2"))


def scores(scored: DataFrame, by: Sequence[str] = ("t",)) -> DataFrame:
    """(by…, r, accuracy) of columns y and yhat: their correlation, and how often both are on one side of zero."""
    same = ((F.col("y") >= 0) == (F.col("yhat") >= 0)).cast("double")
    return scored.groupBy(*by).agg(F.corr("y", "yhat").alias("r"), F.avg(same).alias("accuracy"))


def generalisation(wide: DataFrame, predictors: Sequence[str], target: str, ridge: float = 1e-4) -> DataFrame:
    """(train_t, test_t, r2): explained variance at each time of the regression learned at each other, null where
    the target doesn't vary. Both sides are sums of products by time, a small matrix for each time of a trial,
    so no row is predicted more than once, or at all."""
    k = len(predictors)
    rows: dict[int, list] = {}
    for r in moments.products(wide, [*predictors, target], None, ["t"]).collect():
        rows.setdefault(r.t, []).append((r.i, r.j, r.s))
    times = sorted(rows)
    sums = np.stack([moments.matrix(rows[t], k + 1) for t in times]) if times else np.zeros((0, k + 2, k + 2))
    betas = [np.r_[np.linalg.solve(m[: k + 1, : k + 1] + ridge * np.eye(k + 1), m[: k + 1, k + 1]), -1.0] for m in sums]
    spread = [m[k + 1, k + 1] - m[0, k + 1] ** 2 / m[0, 0] for m in sums]
    out = [(int(a), int(b), float(1 - beta @ m @ beta / v) if v > 1e-9 else None) for a, beta in zip(times, betas, strict=True) for b, m, v in zip(times, sums, spread, strict=True)]
    return wide.sparkSession.createDataFrame(out, "train_t int, test_t int, r2 double")


def cross_validated(wide: DataFrame, predictors: Sequence[str], target: str, ridge: float = 1e-4) -> DataFrame:
    """R² per time point of predictions for folds (column ``fold``) left out of the fit: sums of all
    less those of a fold are the sums of the rest, so every row is read once. Null where a time has one
    fold only, as nothing is left to learn from, or its target doesn't vary."""
    sums = moments.products(wide, [*predictors, target], None, ["t", "fold"])
    rest = sums.groupBy("t", "i", "j").agg(F.sum("s").alias("all")).join(sums, ["t", "i", "j"]).select("t", "fold", "i", "j", (F.col("all") - F.col("s")).alias("s"))
    k = len(predictors)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        m = moments.matrix(rows[["i", "j", "s"]].itertuples(index=False), k + 1)
        beta = np.linalg.solve(m[: k + 1, : k + 1] + ridge * np.eye(k + 1), m[: k + 1, k + 1])
        return pd.DataFrame({"t": rows["t"].iloc[0], "fold": rows["fold"].iloc[0], "term": np.arange(k + 1, dtype=np.int32), "beta": beta})

    betas = rest.groupBy("t", "fold").applyInPandas(solve, f"t {wide.schema['t'].dataType.simpleString()}, fold int, term int, beta double")
    scored = predicted_by_time(wide.withColumn("y", F.col(target)), predictors, betas, ("t", "fold"))
    folds = scored.groupBy("t").agg((F.min("fold") < F.max("fold")).alias("many"), (F.min("y") < F.max("y")).alias("varies"))
    usable = r_squared(scored.join(folds.filter("many AND varies").select("t"), "t"))
    return folds.select("t").join(usable, "t", "left")


def mean_gamma(gamma: DataFrame) -> DataFrame:
    """Mean probability across segments of each state and time."""
    return gamma.groupBy("t", "state").agg(F.avg("p").alias("p"))


def mixed_coefficients(mean: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Time-resolved coefficients: states' coefficients (state, term, beta) weighted by their mean probability."""
    return mean.join(F.broadcast(coefficients), "state").groupBy("t", "term").agg(F.sum(F.col("p") * F.col("beta")).alias("beta"))


def class_scores(pairwise: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-against-one logits (keys…, a, b, logit) → normalised product of sigmoids per class."""
    sides = pairwise.select(*keys, F.inline(F.array(F.struct(F.col("a").alias("class"), F.col("logit").alias("v")), F.struct(F.col("b").alias("class"), (-F.col("logit")).alias("v")))))
    logs = sides.groupBy(*keys, "class").agg(F.sum(-F.log1p(F.exp(-F.col("v")))).alias("l"))
    w = Window.partitionBy(*keys)
    return logs.withColumn("e", F.exp(F.col("l") - F.max("l").over(w))).select(*keys, "class", (F.col("e") / F.sum("e").over(w)).alias("p"))


def hard_class(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The class of the largest score, the lowest of equals."""
    best = F.max(F.struct("p", (-F.col("class")).alias("c"))).alias("m")
    return scores.groupBy(*keys).agg(best).select(*keys, (-F.col("m.c")).alias("class"))


def auc(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area under the curve of ``score`` for ``label`` 0 or 1, by mean ranks: equal scores count half."""
    w = Window.partitionBy(*by)
    ranks = scored.groupBy(*by, "score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    below = F.sum("n").over(w.orderBy("score")) - F.col("n")
    ranks = ranks.withColumn("rank", below + (F.col("n") + 1) / 2)
    totals = ranks.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return totals.select(*by, ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))).alias("auc"))
