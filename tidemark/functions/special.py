"""Special functions that neither Spark SQL nor numpy has."""

from __future__ import annotations

import math

import numpy as np


def digamma(x):
    """Derivative of log gamma, by recurrence up to 6 and an asymptotic series beyond."""
    x = np.array(x, float, ndmin=1)
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    out += np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))
    return out if out.size > 1 else float(out[0])


def log_gamma(x):
    """Element-wise log gamma."""
    return np.vectorize(math.lgamma, otypes=[float])(x)


def log_sum_exp(a: np.ndarray, axis: int = -1) -> np.ndarray:
    top = np.max(a, axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    return np.squeeze(safe + np.log(np.sum(np.exp(a - safe), axis=axis, keepdims=True)), axis)


def kl_dirichlet(a: np.ndarray, b: np.ndarray) -> float:
    """Divergence of Dirichlet(a) from Dirichlet(b)."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float(
        math.lgamma(a.sum()) - math.lgamma(b.sum()) - (log_gamma(a) - log_gamma(b)).sum() + ((a - b) * (np.asarray(digamma(a)) - digamma(a.sum()))).sum()
    )


def kl_gamma(shape_q: float, rate_q: float, shape_p: float, rate_p: float) -> float:
    """Divergence between Gamma distributions given by shape and rate."""
    return (
        (shape_q - shape_p) * digamma(shape_q)
        - math.lgamma(shape_q)
        + math.lgamma(shape_p)
        + shape_p * (math.log(rate_q) - math.log(rate_p))
        + shape_q * (rate_p - rate_q) / rate_q
    )


def kl_normal(mu_q, cov_q, mu_p, cov_p) -> float:
    """Divergence between multivariate normals."""
    mu_q, mu_p = np.atleast_1d(mu_q), np.atleast_1d(mu_p)
    cov_q, cov_p = np.atleast_2d(cov_q), np.atleast_2d(cov_p)
    inv = np.linalg.inv(cov_p)
    d = mu_p - mu_q
    return 0.5 * float(np.trace(inv @ cov_q) + d @ inv @ d - len(d) + np.linalg.slogdet(cov_p)[1] - np.linalg.slogdet(cov_q)[1])


def wishart_log_norm(shape: float, rate: np.ndarray) -> float:
    """Log of the constant that normalises a Wishart density of this shape and rate."""
    d = rate.shape[0]
    return shape * np.linalg.slogdet(rate)[1] - _multi_log_gamma(shape, d)


def _multi_log_gamma(a: float, d: int) -> float:
    return d * (d - 1) / 4 * math.log(math.pi) + sum(math.lgamma(a - i / 2) for i in range(d))


def kl_wishart(shape_q: float, rate_q: np.ndarray, shape_p: float, rate_p: np.ndarray) -> float:
    """Divergence between Wisharts over precisions with density ~ |L|^(shape - (d+1)/2) exp(-tr(rate L))."""
    d = rate_q.shape[0]
    mean_log = sum(digamma(shape_q - i / 2) for i in range(d)) - np.linalg.slogdet(rate_q)[1]
    mean = shape_q * np.linalg.inv(rate_q)
    return float(wishart_log_norm(shape_q, rate_q) - wishart_log_norm(shape_p, rate_p) + (shape_q - shape_p) * mean_log - np.trace((rate_q - rate_p) @ mean))


def psi(x: np.ndarray) -> np.ndarray:
    """Digamma of an array, in its shape."""
    return np.reshape(digamma(np.ravel(x)), np.shape(x))


def wishart_parts(shape: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n Wisharts: expected log-determinant, expected precision (n, d * d), and log of the constant."""
    n, d = rate.shape[:2]
    halves, log_det = shape[:, None] - np.arange(d) / 2, np.linalg.slogdet(rate)[1]
    log_norm = shape * log_det - d * (d - 1) / 4 * math.log(math.pi) - log_gamma(halves).sum(1)
    return psi(halves).sum(1) - log_det, (shape[:, None, None] * np.linalg.inv(rate)).reshape(n, -1), log_norm


def symmetric_wishart(shape_a: np.ndarray, rate_a: np.ndarray, shape_b: np.ndarray, rate_b: np.ndarray) -> np.ndarray:
    """Means of both directions' divergences of n Wisharts from m others, as a matrix: the constants cancel."""
    d = rate_a.shape[1]
    (log_a, mean_a, _), (log_b, mean_b, _) = wishart_parts(shape_a, rate_a), wishart_parts(shape_b, rate_b)
    traces = mean_a @ rate_b.reshape(len(rate_b), -1).T + rate_a.reshape(len(rate_a), -1) @ mean_b.T
    return 0.5 * ((shape_a[:, None] - shape_b) * (log_a[:, None] - log_b) - d * (shape_a[:, None] + shape_b) + traces)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def student_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def student_quantile(p: float, df: float) -> float:
    """Inverse of ``student_cdf`` by bisection."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def mean_life_time(p: float) -> float:
    """Mean life time, in samples, of a state of self-transition p, over a uniform phase."""
    return 1 - (p - 1) / math.log(p) ** 2
