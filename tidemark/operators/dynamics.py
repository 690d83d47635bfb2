"""State time-courses: occupancy, visits, life times, intervals, onsets, switching, transitions.

Inputs are ``path`` (series_id, segment_id, t, state), one hard state per sample, and ``gamma``
(series_id, segment_id, t, state, p), one probability per sample and state, zeros included. ``t`` is
1-based and gap-free within a segment. All plans are windows and aggregates over
(series_id, segment_id), so they scale with the number of segments and shuffle once on that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("series_id", "segment_id")


def one_hot(path: DataFrame, k: int) -> DataFrame:
    """Hard path → gamma with ``k`` rows a sample."""
    states = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("s")
    return path.select(*KEY, "t", "state", states).select(*KEY, "t", F.col("s").alias("state"), (F.col("s") == F.col("state")).cast("double").alias("p"))


def fractional_occupancy(gamma: DataFrame) -> DataFrame:
    """Mean probability of each state per series, over all of its samples."""
    return (
        gamma.groupBy("series_id", "state")
        .agg(F.sum("p").alias("mass"))
        .withColumn("fo", F.col("mass") / F.sum("mass").over(Window.partitionBy("series_id")))
        .select("series_id", "state", "fo")
    )


def occupancy_over_time(gamma: DataFrame, align: str = "start") -> DataFrame:
    """Mean probability across segments at each time from the start or, with ``finish``, to the end."""
    at: Column = F.col("t")
    if align == "finish":
        last = F.max("t").over(Window.partitionBy(*KEY))
        gamma, at = gamma.withColumn("last", last), F.col("t") - F.col("last")
    elif align != "start":
        raise ValueError("align is start or finish")
    return gamma.groupBy(at.alias("t"), "state").agg(F.avg("p").alias("fo"), F.count("*").alias("n_segments"))


def max_occupancy(gamma: DataFrame) -> DataFrame:
    """The largest occupancy of each series."""
    return fractional_occupancy(gamma).groupBy("series_id").agg(F.max("fo").alias("max_fo"))


def switching_rate(gamma: DataFrame) -> DataFrame:
    """Half the summed change of probabilities, per step of segments longer than one sample."""
    w = Window.partitionBy(*KEY, "state").orderBy("t")
    steps = gamma.withColumn("change", F.abs(F.col("p") - F.lag("p").over(w)))
    by = steps.groupBy(*KEY).agg(F.sum("change").alias("change"), (F.max("t") - F.min("t")).alias("n")).filter("n > 0")
    return by.groupBy("series_id").agg((F.sum("change") / 2 / F.sum("n")).alias("rate"))


def transitions(path: DataFrame) -> DataFrame:
    """Counts and row-wise shares of the steps from state i to state j, within segments."""
    w = Window.partitionBy(*KEY).orderBy("t")
    counts = (
        path.select(F.lag("state").over(w).alias("i"), F.col("state").alias("j")).filter("i IS NOT NULL").groupBy("i", "j").agg(F.count("*").alias("n"))
    )
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("i")))


def series_transitions(path: DataFrame) -> DataFrame:
    """Counts of the steps from state i to state j of each series."""
    w = Window.partitionBy(*KEY).orderBy("t")
    steps = path.select("series_id", F.lag("state").over(w).alias("i"), F.col("state").alias("j")).filter("i IS NOT NULL")
    return steps.groupBy("series_id", "i", "j").agg(F.count("*").alias("n"))


def left_to_right(transition: DataFrame) -> DataFrame:
    """(is_chain): whether every step of (i, j, p) stays or goes to the next state."""
    return transition.filter("p > 0").agg(F.coalesce(F.bool_and((F.col("j") == F.col("i")) | (F.col("j") == F.col("i") + 1)), F.lit(True)).alias("is_chain"))


def without_diagonal(transition: DataFrame) -> DataFrame:
    """(i, j, p) with the diagonal dropped and rows normalised anew."""
    left = transition.filter("i <> j")
    return left.select("i", "j", (F.col("p") / F.sum("p").over(Window.partitionBy("i"))).alias("p"))


def clear_transitions(transition: DataFrame, k: int) -> DataFrame:
    """An uninformative matrix of the same mean diagonal d: d on it and (1 - d) / (k - 1) elsewhere."""
    mean = transition.agg((F.sum(F.when(F.col("i") == F.col("j"), F.col("p"))) / k).alias("d"))
    states = transition.sparkSession.range(1, k + 1)
    grid = states.select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j"))
    return grid.join(F.broadcast(mean)).select("i", "j", F.when(F.col("i") == F.col("j"), F.col("d")).otherwise((1 - F.col("d")) / (k - 1)).alias("p"))


def approximate_pairs(gamma: DataFrame) -> DataFrame:
    """Pair probabilities as products of neighbouring samples, normalised per step: (t, i, j, p)."""
    vectors = gamma.groupBy(*KEY, "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "p"))), lambda s: s["p"]).alias("g"))
    after = F.lead("g").over(Window.partitionBy(*KEY).orderBy("t"))
    both = vectors.withColumn("after", after).filter("after IS NOT NULL")
    cells = both.select(*KEY, "t", "g", "after", F.expr("aggregate(g, 0D, (a, x) -> a + x) * aggregate(after, 0D, (a, x) -> a + x)").alias("total"))
    return (
        cells.select(*KEY, "t", "total", "after", F.posexplode("g").alias("i0", "gi"))
        .select(*KEY, "t", "total", "i0", "gi", F.posexplode("after").alias("j0", "gj"))
        .select(*KEY, "t", (F.col("i0") + 1).alias("i"), (F.col("j0") + 1).alias("j"), (F.col("gi") * F.col("gj") / F.col("total")).alias("p"))
    )


def visits(path: DataFrame) -> DataFrame:
    """Runs of one state: (state, start_t, end_t, length), with ``is_last`` for a segment's last run."""
    w = Window.partitionBy(*KEY).orderBy("t")
    change = F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1)
    runs = path.select(*KEY, "t", "state", change.alias("c")).withColumn("run", F.sum("c").over(w))
    found = runs.groupBy(*KEY, "run", "state").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("length"))
    return found.withColumn("is_last", F.col("run") == F.max("run").over(Window.partitionBy(*KEY))).drop("run")


def start_finish(path: DataFrame) -> DataFrame:
    """First and last sample of each visit."""
    return visits(path).select(*KEY, "state", "start_t", "end_t")


def life_times(path: DataFrame, threshold: int = 0) -> DataFrame:
    """Lengths of the visits in segments of two samples or more. Runs inside a segment stay from
    ``threshold`` on, its last run only above it."""
    runs = visits(path).withColumn("n", F.sum("length").over(Window.partitionBy(*KEY)))
    keep = F.when(F.col("is_last"), F.col("length") > threshold).otherwise(F.col("length") >= threshold)
    return runs.filter(keep & (F.col("n") > 1) & F.col("state").isNotNull()).select(*KEY, "state", "start_t", F.col("length").alias("life_time"))


def interval_times(path: DataFrame, threshold: int = 0) -> DataFrame:
    """Samples between one visit of a state and its next; gaps below ``threshold`` are no gaps."""
    runs = visits(path)
    before = F.lag("end_t").over(Window.partitionBy(*KEY, "state").orderBy("start_t"))
    gaps = runs.filter("state IS NOT NULL").select(*KEY, "state", "start_t", (F.col("start_t") - before - 1).alias("interval")).filter("interval IS NOT NULL")
    return gaps.filter(F.col("interval") >= threshold)


def onsets(path: DataFrame, hz: float = 1.0) -> DataFrame:
    """First samples of visits, 1-based, in seconds."""
    return visits(path).select(*KEY, "state", (F.col("start_t") / F.lit(hz)).alias("onset"))


def confident_path(gamma: DataFrame, limit: float = 2 / 3) -> DataFrame:
    """The state of a probability above ``limit`` at each sample, null where none has it; a limit of half
    or more leaves one at most. Life and interval times of a soft time-course are those of this path."""
    return gamma.groupBy(*KEY, "t").agg(F.max(F.when(F.col("p") > limit, F.col("state"))).alias("state"))


def active_states(gamma: DataFrame, least: float) -> DataFrame:
    """Gamma without the states of a total mass of ``least`` or below, normalised anew per sample."""
    mass = gamma.groupBy("state").agg(F.sum("p").alias("mass")).filter(F.col("mass") > least).select("state")
    kept = gamma.join(F.broadcast(mass), "state")
    return kept.select(*KEY, "t", "state", (F.col("p") / F.sum("p").over(Window.partitionBy(*KEY, "t"))).alias("p"))


def redundant_pairs(gamma: DataFrame, limit: float = 0.05) -> DataFrame:
    """State pairs whose probabilities differ by less than ``limit`` on average."""
    other = gamma.select(*KEY, "t", F.col("state").alias("j"), F.col("p").alias("pj"))
    both = gamma.select(*KEY, "t", F.col("state").alias("i"), F.col("p").alias("pi")).join(other, [*KEY, "t"]).filter("i < j")
    return both.groupBy("i", "j").agg(F.avg(F.abs(F.col("pi") - F.col("pj"))).alias("distance")).withColumn("redundant", F.col("distance") < limit)


def state_order(gamma: DataFrame, least: float = 0.01) -> DataFrame:
    """States by the centre of mass over time of their occupancy to the fifth power; those below ``least`` overall come last."""
    course = occupancy_over_time(gamma)
    centre = course.groupBy("state").agg(
        (F.sum(F.col("t") * F.pow("fo", F.lit(5.0))) / F.sum(F.pow("fo", F.lit(5.0)))).alias("centre"), F.avg("fo").alias("share")
    )
    unused = F.col("share") < least
    return centre.select("state", "centre", F.row_number().over(Window.orderBy(unused, "centre", "state")).alias("rank"))


def gamma_check(gamma: DataFrame, k: int) -> DataFrame:
    """Per series, whether it has NaN and whether all its states stay flat (below 0.6 and above 1 / 2k)."""
    bounds = gamma.groupBy("series_id", "state").agg(F.max("p").alias("hi"), F.min("p").alias("lo"), F.max(F.isnan("p").cast("int")).alias("nan"))
    return bounds.groupBy("series_id").agg(
        (F.max("nan") > 0).alias("has_nan"), F.min(((F.col("hi") < 0.6) & (F.col("lo") > 1.0 / (2 * k))).cast("int")).cast("boolean").alias("flat")
    )


def synchronicity(gamma: DataFrame) -> DataFrame:
    """The largest across-segment mean probability at each time."""
    return occupancy_over_time(gamma).groupBy("t").agg(F.max("fo").alias("synchronicity"))


def entropy(gamma: DataFrame) -> DataFrame:
    """Entropy of the first sample's states and of the steps given the state before, per series, from
    approximate pair probabilities."""
    tiny = 2.2250738585072014e-308
    first = gamma.filter("t = 1").groupBy("series_id").agg(F.sum(-F.col("p") * F.log(F.greatest("p", F.lit(tiny)))).alias("first"))
    pairs = approximate_pairs(gamma)
    row = F.sum("p").over(Window.partitionBy(*KEY, "t", "i"))
    steps = pairs.withColumn("given", F.greatest(F.col("p"), F.lit(tiny)) / F.greatest(row, F.lit(tiny)))
    later = steps.groupBy("series_id").agg(F.sum(-F.col("p") * F.log("given")).alias("later"))
    return first.join(later, "series_id", "left").select("series_id", (F.col("first") + F.coalesce("later", F.lit(0.0))).alias("entropy"))


def raster(gamma: DataFrame) -> DataFrame:
    """The likeliest state of each sample, the lowest of equals."""
    best = F.max(F.struct("p", (-F.col("state")).alias("s"))).alias("m")
    return gamma.groupBy(*KEY, "t").agg(best).select(*KEY, "t", (-F.col("m.s")).alias("state"))


def pad(gamma: DataFrame, segments: DataFrame) -> DataFrame:
    """Gamma on the full grid of ``segments`` (series_id, segment_id, n): samples it lacks get the segment's mean."""
    means = gamma.groupBy(*KEY, "state").agg(F.avg("p").alias("mean"))
    grid = segments.select(*KEY, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("t"))
    filled = grid.join(means, list(KEY)).join(gamma, [*KEY, "t", "state"], "left")
    return filled.select(*KEY, "t", "state", F.coalesce("p", "mean").alias("p"))


def chain_pairs(gamma: DataFrame) -> DataFrame:
    """Per state taken as a chain of its own, the approximate pair probabilities of being on or off at
    neighbouring samples, summed over each series: (series_id, state, on_on, on_off, off_on, off_off)."""
    after = F.lead("p").over(Window.partitionBy(*KEY, "state").orderBy("t"))
    both = gamma.withColumn("q", after).filter("q IS NOT NULL")
    p, q = F.col("p"), F.col("q")
    return both.groupBy("series_id", "state").agg(
        F.sum(p * q).alias("on_on"), F.sum(p * (1 - q)).alias("on_off"), F.sum((1 - p) * q).alias("off_on"), F.sum((1 - p) * (1 - q)).alias("off_off")
    )


def label_resets(gamma: DataFrame, labels: DataFrame) -> DataFrame:
    """Correlation over time of each label's mean course (labels: series_id, segment_id, label) with the
    mean of all, per state: those below zero are to be reset."""
    joined = gamma.join(labels, list(KEY))
    own = joined.groupBy("label", "t", "state").agg(F.avg("p").alias("own"))
    every = joined.groupBy("t", "state").agg(F.avg("p").alias("every"))
    return own.join(every, ["t", "state"]).groupBy("label", "state").agg(F.corr("own", "every").alias("r"))
