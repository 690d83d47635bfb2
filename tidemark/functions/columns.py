"""Special functions as columns, by recurrence and asymptotic series, so that they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the recurrence before the series is used; from there its error is below 1e-13.
SHIFT = 8


def _shifted(x: Column) -> Column:
    return x + F.lit(float(SHIFT))


def log_gamma(x: Column) -> Column:
    """Log gamma of positive numbers."""
    y, x = _shifted(x.cast("double")), x.cast("double")
    down = sum((F.log(x + F.lit(float(k))) for k in range(SHIFT)), F.lit(0.0))
    r = F.lit(1.0) / (y * y)
    tail = (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * (F.lit(1 / 1680) - r * F.lit(1 / 1188))))) / y
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + tail - down


def digamma(x: Column) -> Column:
    """Derivative of log gamma for positive numbers."""
    y, x = _shifted(x.cast("double")), x.cast("double")
    down = sum((F.lit(1.0) / (x + F.lit(float(k))) for k in range(SHIFT)), F.lit(0.0))
    r = F.lit(1.0) / (y * y)
    return F.log(y) - F.lit(0.5) / y - r * (F.lit(1 / 12) - r * (F.lit(1 / 120) - r * (F.lit(1 / 252) - r * (F.lit(1 / 240) - r * F.lit(1 / 132))))) - down


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def kl_gamma(shape_q: Column, rate_q: Column, shape_p: Column, rate_p: Column) -> Column:
    """Divergence of Gamma(shape_q, rate_q) from Gamma(shape_p, rate_p)."""
    return (
        (shape_q - shape_p) * digamma(shape_q) - log_gamma(shape_q) + log_gamma(shape_p) + shape_p * (F.log(rate_q) - F.log(rate_p)) + shape_q * (rate_p - rate_q) / rate_q
    )


def kl_beta(a_q: Column, b_q: Column, a_p: Column, b_p: Column) -> Column:
    """Divergence of Beta(a_q, b_q) from Beta(a_p, b_p)."""
    return (
        log_beta(a_p, b_p) - log_beta(a_q, b_q) + (a_q - a_p) * digamma(a_q) + (b_q - b_p) * digamma(b_q) + (a_p - a_q + b_p - b_q) * digamma(a_q + b_q)
    )


def log_sigmoid(x: Column) -> Column:
    """log(1 / (1 + exp(-x))), without overflow on either side."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def bound_slope(xi: Column) -> Column:
    """The curvature (sigmoid(xi) - 1/2) / (2 xi) of the quadratic bound of a sigmoid; 1/8 at zero."""
    s = F.lit(1.0) / (F.lit(1.0) + F.exp(-xi))
    return F.when(F.abs(xi) < 1e-6, F.lit(0.125)).otherwise((s - 0.5) / (2 * xi))


def mean_in_order(order: str, value: str) -> Column:
    """Aggregate: the mean of a group's values, added up in the order of a column. ``avg`` adds in the order of
    partitions, so that equal groups can differ in the last digit; this is for groups that fit into a row."""
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value)))), lambda x: x[value].cast("double"))
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda a, x: a + x), F.size(held))


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that follows from the keys and the seed alone: 48 bits of their MD5."""
    text = F.concat_ws(":", *(k.cast("string") for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
