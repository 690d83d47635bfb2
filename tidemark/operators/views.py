"""Tables behind figures: courses in an order of trials, panels of spectra, edges of graphs, maps of nodes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import input_bytes, stage, tasks_for

KEY = ("series_id", "segment_id")


def trial_order(gamma: DataFrame, behaviour: DataFrame | None = None) -> DataFrame:
    """(series_id, segment_id, place): trials by a behaviour (…, y), or by the mean time of their first state
    and then of the next; ties go by key. Ranks are taken within ranges of the ordering value."""
    if behaviour is None:
        value = gamma.groupBy(*KEY).agg((F.sum(F.col("t") * F.col("p") * F.col("state")) / F.sum(F.col("p") * F.col("state"))).alias("y"))
    else:
        value = behaviour.select(*KEY, "y")
    return _ranked(value)


#: Ranges of values that rows are counted in before they are ranked.
RANGES = 1024


def _ranked(value: DataFrame) -> DataFrame:
    """Adds ``place`` 1 … n by ``y``, nulls last, and the keys; counts of ``RANGES`` quantile ranges are added up on
    the driver. The values are stored first: summed anew they could fall into another range than was counted."""
    value = stage(value, "ranked", tasks_for(input_bytes(value)))
    cuts = sorted({c for c in value.approxQuantile("y", [i / RANGES for i in range(1, RANGES)], 0.001) if math.isfinite(c)})
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("y"))) if cuts else F.lit(0)
    cut = value.withColumn("part", F.when(F.col("y").isNull(), len(cuts) + 1).otherwise(part))
    counts = dict(cut.groupBy("part").count().collect())
    before, rows = 0, []
    for p in sorted(counts):
        rows.append((p, before))
        before += counts[p]
    if not rows:
        return value.select(*KEY, F.lit(0).cast("bigint").alias("place"))
    starts = F.broadcast(value.sparkSession.createDataFrame(rows, "part int, before bigint"))
    return cut.join(starts, "part").select(*KEY, (F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("y"), *KEY)) + F.col("before")).alias("place"))


def course_table(gamma: DataFrame, order: DataFrame) -> DataFrame:
    """(place, t, state, low, high): bands of a stacked plot, states on top of each other."""
    w = Window.partitionBy("place", "t").orderBy("state")
    placed = gamma.join(order, list(KEY))
    return placed.select("place", "t", "state", (F.sum("p").over(w) - F.col("p")).alias("low"), F.sum("p").over(w).alias("high"))


def spectral_panels(spectra: DataFrame) -> DataFrame:
    """(state, f, i, j, kind, value): power on the diagonal, coherence off it, of spectra (state, f, i, j, re, im)."""
    own = spectra.filter("i = j")
    a, b = own.select("state", "f", "i", F.col("re").alias("sii")), own.select("state", "f", "j", F.col("re").alias("sjj"))
    off = spectra.filter("i < j").join(a, ["state", "f", "i"]).join(b, ["state", "f", "j"])
    coh = F.try_divide(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), F.sqrt(F.col("sii") * F.col("sjj")))
    return own.select("state", "f", "i", "j", F.lit("power").alias("kind"), F.col("re").alias("value")).unionByName(off.select("state", "f", "i", "j", F.lit("coherence").alias("kind"), coh.alias("value")))


def strongest_edges(edges: DataFrame, share: float, by: Sequence[str] = ("state",), centre: bool = False) -> DataFrame:
    """Edges (by…, i, j, w) of the largest absolute weights, ``share`` of each group's, ties in; with ``centre``
    the mean weight of an edge over the groups is taken off first."""
    if centre:
        edges = edges.withColumn("w", F.col("w") - F.avg("w").over(Window.partitionBy("i", "j")))
    limit = edges.groupBy(*by).agg(F.percentile(F.abs("w"), F.lit(1 - share)).alias("limit"))
    return edges.join(limit, list(by)).filter(F.abs("w") >= F.col("limit")).drop("limit")


def node_map(edges: DataFrame, d: int, mode: str = "strength") -> DataFrame:
    """(node, value) of edges (i, j, w) for i < j: the sum of a node's positive weights, or ("eigen") the
    leading eigenvector of the weights with ones on the diagonal, its largest entry positive."""
    if mode == "strength":
        sides = edges.select(F.explode(F.array("i", "j")).alias("node"), F.greatest("w", F.lit(0.0)).alias("w"))
        return sides.groupBy("node").agg(F.sum("w").alias("value"))
    m = np.eye(d)
    for i, j, w in edges.select("i", "j", "w").collect():  # the square of a few channels
        m[i - 1, j - 1] = m[j - 1, i - 1] = w
    lead = np.linalg.eigh(m)[1][:, -1]
    lead = lead * np.sign(lead[np.abs(lead).argmax()])
    return edges.sparkSession.createDataFrame([(n + 1, float(x)) for n, x in enumerate(lead)], "node int, value double")


def region_centres(maps: DataFrame, binary: bool = False) -> DataFrame:
    """(region, x, y, z): centres of regions (region, x, y, z, w), points weighted by w, or alike if positive."""
    w = F.when(F.col("w") > 0, 1.0).otherwise(0.0) if binary else F.col("w")
    return maps.groupBy("region").agg(*(F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(c) for c in ("x", "y", "z")))


def projected_map(values: DataFrame, weights: DataFrame) -> DataFrame:
    """(state, point, value): states' values of regions (state, region, v) on points by weights (region, point, w)."""
    return values.join(weights, "region").groupBy("state", "point").agg(F.sum(F.col("v") * F.col("w")).alias("value"))
