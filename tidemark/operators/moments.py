"""Weighted moments and what is solved from them: covariance, Gram matrices, PCA, autoregressions.

Sums over samples are Spark aggregates; only matrices of a few channels or columns reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("series_id", "segment_id")


def products(wide: DataFrame, names: Sequence[str], weight=None, by: Sequence[str] = ()) -> DataFrame:
    """Weighted sums of products (…, i, j, s) of columns i <= j, and of weights as (0, 0) and first
    moments as (0, j). One pass with partial aggregation; the output is as wide as the model."""
    w = F.lit(1.0) if weight is None else weight
    cells = [(0, 0, F.sum(w))] + [(0, j, F.sum(w * F.col(n))) for j, n in enumerate(names, 1)]
    cells += [(i, j, F.sum(w * F.col(a) * F.col(names[j - 1]))) for i, a in enumerate(names, 1) for j in range(i, len(names) + 1)]
    summed = wide.groupBy(*by).agg(*(c.alias(f"s{n}") for n, (_, _, c) in enumerate(cells)))
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{n}").alias("s")) for n, (i, j, _) in enumerate(cells)))
    return summed.select(*by, F.inline(rows))


def matrix(rows, k: int) -> np.ndarray:
    """Symmetric (k + 1)-square matrix of collected (i, j, s) rows."""
    out = np.zeros((k + 1, k + 1))
    for i, j, s in rows:
        out[i, j] = out[j, i] = s
    return out


def weighted_covariance(wide: DataFrame, names: Sequence[str], weight, by: Sequence[str] = ()) -> DataFrame:
    """Mean-centred covariance per group, divided by the weights' sum: (…, i, j, cov) for i <= j. Columns
    are taken from their overall means first, so that large means cost no digits; then one aggregate."""
    middle = wide.agg(*(F.avg(n) for n in names)).first()
    x = [F.col(n) - float(m or 0.0) for n, m in zip(names, middle, strict=True)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(weight).alias("n"), *(F.sum(weight * c).alias(f"f{i}") for i, c in enumerate(x)), *(F.sum(weight * x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs)]
    cov = lambda i, j: (F.col(f"s{i}_{j}") - F.col(f"f{i}") * F.col(f"f{j}") / F.col("n")) / F.col("n")
    cells = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), cov(i, j).alias("cov")) for i, j in pairs))
    return wide.groupBy(*by).agg(*sums).select(*by, F.inline(cells))


def covariance_from(sums: np.ndarray) -> np.ndarray:
    n, first = sums[0, 0], sums[0, 1:]
    return (sums[1:, 1:] - np.outer(first, first) / n) / (n - 1)


def pca(wide: DataFrame, names: Sequence[str], keep: float | int = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (columns) and cumulative explained variance. ``keep`` below one is a share that has to
    be exceeded, else a number of components. Each loading's largest entry is positive."""
    means = wide.agg(*(F.avg(n) for n in names)).first()
    centred = wide.select(*((F.col(n) - float(m or 0.0)).alias(n) for n, m in zip(names, means, strict=True)))
    sums = matrix(products(centred, names).collect(), len(names))  # large means cost no digits
    values, vectors = np.linalg.eigh(covariance_from(sums))
    values, vectors = values[::-1], vectors[:, ::-1]
    share = np.cumsum(values) / values.sum()
    n = int(np.argmax(share > keep)) + 1 if keep < 1 else int(keep)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    return vectors[:, :n], share


def project(wide: DataFrame, names: Sequence[str], loadings: np.ndarray, prefix: str = "pc") -> DataFrame:
    """Linear combinations of columns as new columns; the loadings are literals of the plan."""
    columns = [sum((F.col(n) * float(v) for n, v in zip(names, column, strict=True)), F.lit(0.0)).alias(f"{prefix}{k}") for k, column in enumerate(loadings.T, 1)]
    return wide.select("*", *columns)


def regress(wide: DataFrame, predictors: Sequence[str], responses: Sequence[str], ridge: float = 0.0, weight=None) -> np.ndarray:
    """Least squares with intercept: rows are the intercept and the predictors."""
    k = len(predictors)
    sums = matrix(products(wide, [*predictors, *responses], weight).collect(), k + len(responses))
    return np.linalg.solve(sums[: k + 1, : k + 1] + ridge * np.eye(k + 1), sums[: k + 1, k + 1 :])


def lagged(wide: DataFrame, names: Sequence[str], orders: Sequence[int]) -> tuple[DataFrame, list[str]]:
    """Adds a column for each lag and channel (lag-major) and drops the samples without all lags."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEY).orderBy("t")
    cells = {f"{n}_{o}": F.lag(n, o).over(w) for o in orders for n in names}
    return wide.withColumns(cells).filter(F.col("t") > max(orders)), list(cells)


def fit_mar(wide: DataFrame, names: Sequence[str], orders: Sequence[int], ridge: float = 0.0, weight=None) -> dict:
    """Multivariate autoregression by normal equations: coefficients, residual covariance and the
    share of variance explained per channel, all from one pass of sums."""
    design, columns = lagged(wide, names, orders)
    k, m = len(columns), len(names)
    sums = matrix(products(design, [*columns, *names], weight).collect(), k + m)
    x, xy, y = sums[: k + 1, : k + 1], sums[: k + 1, k + 1 :], sums[k + 1 :, k + 1 :]
    coef = np.linalg.solve(x + ridge * np.eye(k + 1), xy)
    rss = y - coef.T @ xy - xy.T @ coef + coef.T @ x @ coef
    centred = np.diag(y) - sums[0, k + 1 :] ** 2 / sums[0, 0]
    return {"columns": columns, "coef": coef, "cov": rss / sums[0, 0], "explained": 1 - np.diag(rss) / centred, "n": sums[0, 0]}


def prediction_error(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(…, y, yhat) → mean squared error, its share of the variance of y and explained variance."""
    e = (F.col("y") - F.col("yhat")) * (F.col("y") - F.col("yhat"))
    return scored.groupBy(*by).agg(F.avg(e).alias("mse"), F.try_divide(F.avg(e), F.var_pop("y")).alias("fraction")).withColumn("explained", 1 - F.col("fraction"))
