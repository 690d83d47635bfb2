"""Observation likelihoods of fixed models, as projections in log space.

``emit`` functions return one column expression a state; parameters are literals of the plan, so a
sample's likelihoods are computed where it is read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.special import digamma


def gaussian(x: Sequence[Column], mean: Sequence[float], covariance) -> Column:
    """Log density of a multivariate normal."""
    precision = np.linalg.inv(np.atleast_2d(covariance))
    d = [c - float(m) for c, m in zip(x, mean, strict=True)]
    quad = sum((d[i] * d[j] * float(precision[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    constant = -0.5 * (len(d) * math.log(2 * math.pi) - np.linalg.slogdet(precision)[1])
    return F.lit(float(constant)) - 0.5 * quad


def bernoulli(x: Sequence[Column], a: Sequence[float], b: Sequence[float]) -> Column:
    """Expected log likelihood of binary channels whose rates have Beta(a, b) posteriors."""
    out = F.lit(0.0)
    for c, p, q in zip(x, a, b, strict=True):
        both = digamma(p + q)
        out += c * float(digamma(p) - both) + (1 - c) * float(digamma(q) - both)
    return out


def poisson(x: Sequence[Column], shape: Sequence[float], rate: Sequence[float]) -> Column:
    """Expected log likelihood of counts whose rates have Gamma posteriors. log(x!) is the built-in
    factorial up to 20 and Stirling's series beyond."""
    out = F.lit(0.0)
    for c, s, r in zip(x, shape, rate, strict=True):
        z = c + 1
        stirling = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0)))
        log_factorial = F.when(c <= 20, F.log(F.factorial(c.cast("int")).cast("double"))).otherwise(stirling)
        out += c * float(digamma(s) - math.log(r)) - float(s / r) - log_factorial
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic_bound(logit: Column, y: Column, psi: Column) -> Column:
    """Jaakkola and Jordan's lower bound of log sigmoid at a class y of -1 or 1, tight at psi = |logit|."""
    slope = (sigmoid(psi) - 0.5) / (2 * F.nullif(psi, F.lit(0.0)))
    return F.log(sigmoid(psi)) + (y * logit - psi) / 2 - F.coalesce(slope, F.lit(0.125)) * (logit * logit - psi * psi)


def log_sum_exp(values: Sequence[Column]) -> Column:
    top = F.greatest(*values) if len(values) > 1 else values[0]
    return top + F.log(sum((F.exp(v - top) for v in values), F.lit(0.0)))


def posterior(log_likelihoods: Sequence[Column], weights: Sequence[float]) -> list[Column]:
    """State probabilities of independent samples under a mixture of these weights."""
    joint = [v + math.log(w) for v, w in zip(log_likelihoods, weights, strict=True)]
    total = log_sum_exp(joint)
    return [F.exp(v - total) for v in joint]
