"""State probabilities of a stream: one forward step for each sample as it arrives.

The state of a segment is its last forward vector, a few numbers; samples of a segment must arrive
in order of t within and across micro-batches. ``occupancy`` aggregates event time with a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = ("series_id", "segment_id")


def filter_states(stream: DataFrame, transition, start) -> DataFrame:
    """(series_id, segment_id, t, ll array) → (…, t, p array): probabilities given the samples so far."""
    p, pi = np.asarray(transition, float), np.asarray(start, float)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = np.array(state.get[0]) if state.exists else None
        rows = pd.concat(batches).sort_values("t")
        out = []
        for ll in rows["ll"]:
            ll = np.asarray(ll, float)
            last = (pi if last is None else last @ p) * np.exp(ll - ll.max())
            last /= last.sum()
            out.append(last)
        state.update((last.tolist(),))
        yield pd.DataFrame({"series_id": key[0], "segment_id": key[1], "t": rows["t"].to_numpy(), "p": [v.tolist() for v in out]})

    return stream.groupBy(*KEY).applyInPandasWithState(
        run, "series_id bigint, segment_id bigint, t int, p array<double>", "alpha array<double>", "append", GroupStateTimeout.NoTimeout
    )


def occupancy(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of states (ts, series_id, state) in event-time windows; events later than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "series_id", "state").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), "series_id", "state", "n"
    )
