"""Chains of hidden states: forward-backward, most likely path and one-sided filtering.

A segment's likelihoods are gathered into one row (segments are bounded by the recording, and each
is independent); batches of segments then run together as padded arrays, one vectorised step of the
recursion for all of them, in log space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.special import log_sum_exp
from tidemark.session import small_batches

KEY = ("series_id", "segment_id")
#: Segments of one Arrow batch, and padded samples that run together unless one segment has more.
BATCH_SEGMENTS = 256
PADDED_SAMPLES = 100_000


def by_segment(log_likelihoods: DataFrame) -> DataFrame:
    """(series_id, segment_id, t, ll array) → one row per segment, samples in order."""
    rows = F.array_sort(F.collect_list(F.struct("t", "ll")))
    return log_likelihoods.groupBy(*KEY).agg(rows.alias("rows")).select(*KEY, F.col("rows.t").alias("t"), F.flatten("rows.ll").alias("ll"))


def _padded(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods (segments, time, k), 0 beyond a segment's end, and its lengths."""
    lengths = np.array([len(t) for t in batch.column("t")], int)
    flat = np.asarray(batch.column("ll").flatten(), float).reshape(-1, k)
    out = np.zeros((len(lengths), max(lengths, default=0), k))
    inside = np.arange(out.shape[1]) < lengths[:, None]
    out[inside] = flat
    return out, lengths


def of_like_length(batch: pa.RecordBatch, most: int = PADDED_SAMPLES) -> Iterator[pa.RecordBatch]:
    """The segments (column ``t``) of a batch in groups of like length, none of more than ``most`` samples
    once padded to its longest: one long recording doesn't widen the others."""
    lengths = np.array([len(t) for t in batch.column("t")], int)
    order = np.argsort(lengths, kind="stable")[::-1]
    at = 0
    while at < len(order):
        end = at + max(1, min(len(order) - at, most // max(1, int(lengths[order[at]]))))
        yield batch.take(pa.array(order[at:end]))
        at = end


def forward_backward(ll: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Padded batch → (gamma, log evidence of each segment, pair sums of each segment)."""
    with np.errstate(divide="ignore"):
        log_p, log_start = np.log(transition), np.log(start)
    n, time, k = ll.shape
    alpha, beta = np.zeros_like(ll), np.zeros_like(ll)
    alpha[:, 0] = log_start + ll[:, 0]
    for t in range(1, time):
        alpha[:, t] = log_sum_exp(alpha[:, t - 1, :, None] + log_p[None], 1) + ll[:, t]
    for t in range(time - 2, -1, -1):
        step = log_sum_exp(log_p[None] + (ll[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where((t + 1 < lengths)[:, None], step, 0.0)
    evidence = log_sum_exp(alpha[np.arange(n), lengths - 1], 1)
    inside = np.arange(time) < lengths[:, None]
    gamma = np.where(inside[:, :, None], np.exp(alpha + beta - evidence[:, None, None]), 0.0)
    xi = np.zeros((n, k, k))
    for t in range(time - 1):
        cell = alpha[:, t, :, None] + log_p[None] + (ll[:, t + 1] + beta[:, t + 1])[:, None, :] - evidence[:, None, None]
        xi += np.where((t + 1 < lengths)[:, None, None], np.exp(np.minimum(cell, 0.0)), 0.0)
    return gamma, evidence, xi


def viterbi(ll: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Most likely states (1-based), the lowest of equals; 0 beyond a segment's end."""
    with np.errstate(divide="ignore"):
        log_p, score = np.log(transition), np.log(start) + ll[:, 0]
    n, time, _ = ll.shape
    back = np.zeros(ll.shape, int)
    scores = [score]
    for t in range(1, time):
        options = score[:, :, None] + log_p[None]
        back[:, t] = options.argmax(1)
        score = options.max(1) + ll[:, t]
        scores.append(score)
    path, rows = np.zeros((n, time), int), np.arange(n)
    state = np.zeros(n, int)
    for t in range(time - 1, -1, -1):
        last = t == lengths - 1
        state = np.where(last, scores[t].argmax(1), state)
        path[:, t] = np.where(t < lengths, state + 1, 0)
        state = np.where(t < lengths, back[rows, t, state], state)
    return path


def _over_segments(log_likelihoods: DataFrame, make, schema: str) -> DataFrame:
    small_batches(log_likelihoods.sparkSession, BATCH_SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(make, of_like_length(batch))

    return by_segment(log_likelihoods).mapInArrow(run, schema)


def _keys(batch: pa.RecordBatch, lengths: np.ndarray, copies: int = 1) -> dict:
    out = {c: np.repeat(batch.column(c).to_numpy(), lengths * copies) for c in KEY}
    return out | {"t": np.repeat(np.asarray(batch.column("t").flatten()), copies).astype(np.int32)}


def decode_posterior(log_likelihoods: DataFrame, transition, start) -> DataFrame:
    """Smoothed state probabilities: (series_id, segment_id, t, state, p)."""
    p, pi = np.asarray(transition, float), np.asarray(start, float)
    k = len(pi)

    def make(batch):
        ll, lengths = _padded(batch, k)
        gamma, _, _ = forward_backward(ll, lengths, p, pi)
        inside = np.arange(ll.shape[1]) < lengths[:, None]
        states = np.tile(np.arange(1, k + 1, dtype=np.int32), int(lengths.sum()))
        return pa.RecordBatch.from_pydict(_keys(batch, lengths, k) | {"state": states, "p": gamma[inside].ravel()})

    return _over_segments(log_likelihoods, make, "series_id bigint, segment_id bigint, t int, state int, p double")


def decode_path(log_likelihoods: DataFrame, transition, start) -> DataFrame:
    """The most likely path: (series_id, segment_id, t, state)."""
    p, pi = np.asarray(transition, float), np.asarray(start, float)

    def make(batch):
        ll, lengths = _padded(batch, len(pi))
        path = viterbi(ll, lengths, p, pi)
        inside = np.arange(ll.shape[1]) < lengths[:, None]
        return pa.RecordBatch.from_pydict(_keys(batch, lengths) | {"state": path[inside].astype(np.int32)})

    return _over_segments(log_likelihoods, make, "series_id bigint, segment_id bigint, t int, state int")


def evidence(log_likelihoods: DataFrame, transition, start) -> DataFrame:
    """Log evidence of each segment: (series_id, segment_id, log_evidence)."""
    p, pi = np.asarray(transition, float), np.asarray(start, float)

    def make(batch):
        ll, lengths = _padded(batch, len(pi))
        found = forward_backward(ll, lengths, p, pi)[1]
        return pa.RecordBatch.from_pydict({c: batch.column(c) for c in KEY} | {"log_evidence": found})

    return _over_segments(log_likelihoods, make, "series_id bigint, segment_id bigint, log_evidence double")
