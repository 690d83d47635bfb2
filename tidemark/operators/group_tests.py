"""Tests over units: courses of states against a trait, spectra, connectivity of states, clusters in time,
and features of models for kernels.

All null distributions are seeded permutations spread over the cluster; what is solved for each of them
is solved from sums, which are one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import uniform
from tidemark.operators import divergence, stats

KEY = ("series_id", "segment_id")


def epoch_test(gamma: DataFrame, trials: DataFrame, k: int, permutations: int, ridge: float = 1e-5, seed: int = 0) -> DataFrame:
    """(t, observed, p): share of a trait's variance that the state probabilities explain at each time, against
    trials dealt anew. ``gamma`` has (trial, t, state, p), ``trials`` (trial, y). Gram matrices of a time are
    computed once, permutations only change the products with the trait. As the observed order is one of
    the permutations, p is never zero."""
    mean, sd = trials.agg(F.avg("y"), F.stddev_samp("y")).first()
    scaled = trials.select("trial", ((F.col("y") - float(mean or 0.0)) / float(sd or 1.0)).alias("y"))
    dealt = stats.permuted(scaled, "trial", "y", permutations, seed)
    wide = gamma.groupBy("trial", "t").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("state") == s, F.col("p"))), F.lit(0.0)) for s in range(1, k + 1))).alias("g"))
    gram = wide.groupBy("t").agg(F.array(*(F.sum(F.col("g")[i] * F.col("g")[j]) for i in range(k) for j in range(k))).alias("gram"))
    sums = wide.join(dealt, "trial").groupBy("t", "perm").agg(F.array(*(F.sum(F.col("g")[i] * F.col("y")) for i in range(k))).alias("c"), F.sum(F.col("y") * F.col("y")).alias("yy"))

    def explained(batches):
        for rows in batches:
            out = []
            for g, c, yy in zip(rows["gram"], rows["c"], rows["yy"], strict=True):
                m, c = np.reshape(g, (k, k)), np.asarray(c)
                b = np.linalg.solve(m + ridge * np.eye(k), c)
                out.append(float("nan") if not yy else 1 - (yy - 2 * b @ c + b @ m @ b) / yy)
            yield pd.DataFrame({"t": rows["t"], "perm": rows["perm"], "stat": out})

    found = sums.join(gram, "t").mapInPandas(explained, f"t {gamma.schema['t'].dataType.simpleString()}, perm int, stat double")
    return stats.p_values(found, ["t"], "stat")


def spectral_test(spectra: DataFrame, permutations: int, within: str = "state", seed: int = 0) -> DataFrame:
    """(state, channel, f, value, lower, higher, lower_corrected, higher_corrected): whether the power of a
    state and channel is low or high. ``spectra`` has (unit, state, channel, f, value); ``within`` "state"
    deals the channels of each unit's state anew, "channel" the states of each unit's channel. Corrections
    are Benjamini and Hochberg's over all tests of a side."""
    mixed = "channel" if within == "state" else "state"
    many = spectra.select("*", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("perm"))
    order = F.when(F.col("perm") > 0, F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in ("unit", within, mixed, "perm")), F.lit(str(seed))).cast("binary")))
    group = Window.partitionBy("unit", within, "f", "perm")
    placed = many.withColumn("place", F.row_number().over(group.orderBy(order, mixed))).withColumn("home", F.row_number().over(group.orderBy(mixed)))
    keys = ["unit", within, "f", "perm"]
    left = placed.select(*keys, mixed, F.col("home").alias("at"))
    right = placed.select(*keys, "value", F.col("place").alias("at"))
    means = left.join(right, [*keys, "at"]).groupBy("state", "channel", "f", "perm").agg(F.avg("value").alias("m"))
    seen = means.filter("perm = 0").select("state", "channel", "f", F.col("m").alias("value"))
    both = means.join(seen, ["state", "channel", "f"]).groupBy("state", "channel", "f").agg(
        F.first("value").alias("value"), F.avg(stats.at_least(-F.col("m"), -F.col("value")).cast("double")).alias("lower"), F.avg(stats.at_least(F.col("m"), F.col("value")).cast("double")).alias("higher")
    )
    for side in ("lower", "higher"):
        both = stats.benjamini_hochberg(both.withColumnRenamed(side, "p")).withColumnRenamed("p", side).withColumnRenamed("q", f"{side}_corrected")
    return both


def connectivity_test(samples: DataFrame, path: DataFrame, names: Sequence[str], permutations: int, seed: int = 0) -> DataFrame:
    """(i, j, distance, p): Riemannian distance of the covariances of two states, against paths whose visits
    keep their limits and draw their states anew from the occupancies."""
    from tidemark.operators.dynamics import visits

    runs = visits(path)
    counts = dict(path.groupBy("state").count().collect())
    states = sorted(counts)
    shares = np.cumsum([counts[s] for s in states]) / sum(counts.values())
    many = runs.select(*KEY, "state", "start_t", "end_t", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("perm"))
    u = uniform(F.col("series_id"), F.col("segment_id"), F.col("start_t"), F.col("perm"), seed=seed)
    drawn = F.lit(states[-1])
    for s, top in reversed(list(zip(states[:-1], shares[:-1], strict=True))):
        drawn = F.when(F.col("u") < float(top), s).otherwise(drawn)
    dealt = many.withColumn("u", u).withColumn("state", F.when(F.col("perm") == 0, F.col("state")).otherwise(drawn))
    spread = dealt.select(*KEY, "perm", "state", F.explode(F.sequence("start_t", "end_t")).alias("t"))
    covs = divergence.covariances(samples.select(*KEY, "t", *names).join(spread, [*KEY, "t"]), names, ["perm", "state"])
    a, b = (covs.select("perm", F.col("state").alias(x), F.col("cov").alias(f"c{x}"), F.col("n").alias(f"n{x}")) for x in ("i", "j"))
    pairs = a.join(b, "perm").filter(f"i < j AND ni > {len(names)} AND nj > {len(names)}")
    found = divergence.measured(pairs, ["perm", "i", "j"], ["ci", "cj"], divergence.riemannian, "stat")
    return stats.p_values(found, ["i", "j"], "stat").withColumnRenamed("observed", "distance")


def cluster_test(accuracy: DataFrame, dealt: DataFrame, draws: int, level: float = 0.05, seed: int = 0) -> DataFrame:
    """(t, accuracy, chance, cluster, size, p): stretches of times whose accuracy is above chance, and the share
    of null draws with a stretch as long. ``accuracy`` has (t, accuracy), ``dealt`` (unit, perm, t, accuracy) of
    each unit under permuted labels; a draw takes one permutation of each unit and averages over the units;
    chance is the draws' upper ``level`` quantile at a time."""
    perms = dealt.agg(F.max("perm")).first()[0]
    picked = dealt.select("unit").distinct().select("unit", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picked = picked.withColumn("perm", (F.floor(uniform(F.col("unit"), F.col("draw"), seed=seed) * int(perms)) + 1).cast("int"))
    means = picked.join(dealt, ["unit", "perm"]).groupBy("draw", "t").agg(F.avg("accuracy").alias("accuracy"))
    chance = means.groupBy("t").agg(F.percentile("accuracy", F.lit(1 - level)).alias("chance"))

    def islands(df: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("t") if by else Window.orderBy("t")
        return df.withColumn("c", F.when(F.lag("above").over(w) == F.col("above"), 0).otherwise(1)).withColumn("cluster", F.sum("c").over(w)).drop("c")

    null = islands(means.join(chance, "t").withColumn("above", F.col("accuracy") > F.col("chance")), ["draw"])
    sizes = null.filter("above").groupBy("draw", "cluster").agg(F.count("*").alias("size"))
    longest = picked.select("draw").distinct().join(sizes, "draw", "left").groupBy("draw").agg(F.coalesce(F.max("size"), F.lit(0)).alias("longest"))
    seen = islands(accuracy.join(chance, "t").withColumn("above", F.col("accuracy") > F.col("chance")), []).withColumn("size", F.count("*").over(Window.partitionBy("cluster")))
    lengths = longest.agg(F.collect_list("longest").alias("null"))  # one row of as many numbers as draws
    p = F.when(F.col("above"), F.expr("size(filter(`null`, x -> x >= `size`)) / cast(size(`null`) AS double)"))
    return seen.join(F.broadcast(lengths)).withColumn("p", p).select("t", "accuracy", "chance", F.when(F.col("above"), F.col("cluster")).alias("cluster"), F.when(F.col("above"), F.col("size")).alias("size"), "p")


def chain_gradient(starts: DataFrame, pairs: DataFrame, model_start: DataFrame, model_pairs: DataFrame) -> DataFrame:
    """(series_id, feature, value): gradient of each series' log-likelihood at a group's chain. ``starts``
    (series_id, state, n) and ``pairs`` (series_id, i, j, n) are expected counts, ``model_start`` (state, p) and
    ``model_pairs`` (i, j, p) the group's probabilities. Shares of a series' steps over the group's."""
    w = Window.partitionBy("series_id")
    first = starts.withColumn("share", F.col("n") / F.sum("n").over(w)).join(F.broadcast(model_start), "state")
    moved = pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("series_id", "i"))).join(F.broadcast(model_pairs), ["i", "j"])
    name = lambda *c: F.concat_ws("_", *(x if not isinstance(x, str) else F.lit(x) for x in c))
    return first.select("series_id", name("start", F.col("state").cast("string")).alias("feature"), (F.col("share") / F.greatest(F.col("p"), F.lit(1e-300))).alias("value")).unionByName(
        moved.select("series_id", name("step", F.col("i").cast("string"), F.col("j").cast("string")).alias("feature"), (F.col("share") / F.greatest(F.col("p"), F.lit(1e-300))).alias("value"))
    )
