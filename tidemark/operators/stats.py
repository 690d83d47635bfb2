"""Tests by permutation, corrections, folds, confounds and one-hot coding.

Permutations are orders by a seeded MD5 of unit and permutation, so they are the same wherever, and
in whatever engine, a row is computed; a table of n units and P permutations has n P rows, spread over
the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import uniform
from tidemark.operators import moments


def permuted(units: DataFrame, unit: str, value: str, permutations: int, seed: int = 0, within: Sequence[str] = (), carried: DataFrame | None = None) -> DataFrame:
    """(perm, …, unit, value): permutation 0 is the data, others deal the values anew among the units
    (of one ``within`` group). ``carried`` has a row per unit whose other columns go along; units that it
    lacks are left out after the values are dealt. Joins of the result are by sorting: Catalyst's estimate
    of an explode is that of its input, by which it would send all permutations to every machine."""
    keys = [*within, "place"]
    many = units.select(*within, unit, value, F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("perm"))
    order = F.when(F.col("perm") > 0, F.md5(F.concat_ws(":", F.col(unit).cast("string"), F.col("perm").cast("string"), F.lit(str(seed))).cast("binary")))
    place = many.select("perm", *within, value, F.row_number().over(Window.partitionBy("perm", *within).orderBy(order, unit)).alias("place"))
    home = units.select(*within, unit, F.row_number().over(Window.partitionBy(*(within or [F.lit(0)])).orderBy(unit)).alias("place"))
    more = [c for c in carried.columns if c != unit] if carried is not None else []
    home = home.join(carried, unit) if carried is not None else home
    return place.hint("merge").join(home, keys).select("perm", *within, unit, value, *more).hint("merge")


def _dealt_measures(units: DataFrame, measures: DataFrame, unit: str, value: str, permutations: int, by: Sequence[str], seed: int) -> DataFrame:
    """(perm, value of the unit, by…, "value"): a unit's measures come as one row, so that permutations are joined once."""
    cells = measures.groupBy(unit).agg(F.collect_list(F.struct(*by, "value")).alias("cells"))
    return permuted(units, unit, value, permutations, seed, carried=cells).select("perm", value, F.inline("cells"))


def at_least(a, b):
    """a >= b where what differs by rounding counts as equal: sums in another order must not decide a tie."""
    return a >= b - (F.abs(b) * 1e-9 + 1e-12)


def p_values(statistics: DataFrame, by: Sequence[str], statistic: str) -> DataFrame:
    """(…, p): the share of permutations whose statistic is at least the observed one, which counts."""
    observed = statistics.filter("perm = 0").select(*by, F.col(statistic).alias("observed"))
    joined = statistics.join(observed, list(by)) if by else statistics.join(F.broadcast(observed))
    return joined.groupBy(*by).agg(F.first("observed").alias("observed"), F.avg(at_least(F.col(statistic), F.col("observed")).cast("double")).alias("p"))


def difference_test(units: DataFrame, measures: DataFrame, unit: str, label: str, permutations: int, by: Sequence[str] = (), seed: int = 0, side: int = 0) -> DataFrame:
    """One-sided permutation test of the difference of means between units of label 1 and 0: (by…,
    observed, p, side). ``side`` 1 asks whether the first is the larger, -1 the smaller, 0 takes the side
    of the observed difference; a difference on the other side has p 1, as has none at all."""
    groups = _dealt_measures(units, measures, unit, label, permutations, by, seed).groupBy("perm", *by)
    means = groups.agg(F.avg(F.when(F.col(label) == 1, F.col("value"))).alias("one"), F.avg(F.when(F.col(label) == 0, F.col("value"))).alias("zero"))
    found = means.select("perm", *by, (F.col("one") - F.col("zero")).alias("d"))
    sides = found.filter("perm = 0").select(*by, (F.when(F.col("d") > 0, 1).otherwise(-1) if side == 0 else F.lit(side)).alias("side"))
    sided = found.join(sides, list(by)) if by else found.join(F.broadcast(sides))
    tested = p_values(sided.select("perm", *by, (F.col("d") * F.col("side")).alias("stat")), by, "stat")
    tested = tested.withColumn("p", F.when(F.col("observed") < 0, 1.0).otherwise(F.col("p")))
    return tested.join(sides, list(by)) if by else tested.join(F.broadcast(sides))


def correlation_test(units: DataFrame, measures: DataFrame, unit: str, target: str, permutations: int, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Permutation test of the squared correlation of a measure with a target."""
    dealt = _dealt_measures(units, measures, unit, target, permutations, by, seed)
    r = F.corr("value", target)
    return p_values(dealt.groupBy("perm", *by).agg((r * r).alias("stat")), by, "stat")


def combined(statistics: DataFrame, by: Sequence[str], over: Sequence[str]) -> DataFrame:
    """Non-parametric combination: each permutation's p among all, combined as -2 sum of logs over
    ``over``, then ranked again. ``statistics`` has (perm, by…, over…, stat)."""
    inner = Window.partitionBy(*by, *over)
    p = F.cume_dist().over(inner.orderBy(F.desc("stat")))
    fisher = statistics.withColumn("p", p).groupBy("perm", *by).agg((-2 * F.sum(F.log("p"))).alias("stat"))
    return p_values(fisher, by, "stat")


def family_wise(statistics: DataFrame, by: Sequence[str]) -> DataFrame:
    """p of each statistic against the largest of all in each permutation."""
    top = statistics.groupBy("perm").agg(F.max("stat").alias("top"))
    observed = statistics.filter("perm = 0").select(*by, F.col("stat").alias("observed"))
    bounds = top.agg(F.collect_list("top").alias("tops"))  # one row of as many numbers as permutations
    share = F.expr("size(filter(tops, x -> x >= observed - (abs(observed) * 1e-9 + 1e-12))) / cast(size(tops) AS double)")
    return observed.join(F.broadcast(bounds)).select(*by, share.alias("p"))


def benjamini_hochberg(tests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted p-values: the least of p n / rank over ranks from its own up, at most one."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = tests.withColumn("rank", F.row_number().over(group.orderBy("p"))).withColumn("n", F.count("*").over(group))
    up = group.orderBy(F.desc("rank"))
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col("p") * F.col("n") / F.col("rank")).over(up))).drop("rank", "n")


def significant(tests: DataFrame, alpha: float, column: str = "p") -> DataFrame:
    return tests.withColumn("significant", F.col(column) < alpha)


def folds(units: DataFrame, unit: str, k: int, seed: int = 0, family: str | None = None, stratify: str | None = None) -> DataFrame:
    """Adds ``fold`` 1 … k. A family stays in one fold; within strata folds are dealt evenly."""
    key = family or unit
    if stratify is None:
        return units.withColumn("fold", F.floor(uniform(F.col(key), seed=seed) * k).cast("int") + 1)
    heads = units.groupBy(key).agg(F.min(stratify).alias("stratum"))
    dealt = heads.withColumn("fold", (F.row_number().over(Window.partitionBy("stratum").orderBy(uniform(F.col(key), seed=seed), key)) - 1) % k + 1)
    return units.join(dealt.select(key, "fold"), key)


def deconfound(units: DataFrame, y: str, confounds: Sequence[str], ridge: float = 1e-5) -> tuple[DataFrame, list[float]]:
    """``y`` less its regression on the confounds, and the coefficients to add them back."""
    coef = [float(c) for c in moments.regress(units, confounds, [y], ridge)[:, 0]]
    fit = sum((F.col(n) * c for n, c in zip(confounds, coef[1:], strict=True)), F.lit(coef[0]))
    return units.withColumn(y, F.col(y) - fit), coef


def confound(units: DataFrame, y: str, confounds: Sequence[str], coef: Sequence[float]) -> DataFrame:
    """The inverse of ``deconfound``."""
    fit = sum((F.col(n) * c for n, c in zip(confounds, coef[1:], strict=True)), F.lit(coef[0]))
    return units.withColumn(y, F.col(y) + fit)


def class_columns(labels: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """Label → array of 0 and 1 over ``classes``."""
    return labels.withColumn("onehot", F.array(*((F.col(label) == c).cast("int") for c in classes)))


def class_label(onehot: DataFrame, classes: Sequence) -> DataFrame:
    """Array of scores → the class of the largest, the first of equals."""
    return onehot.withColumn("label", F.element_at(F.array(*map(F.lit, classes)), F.expr("array_position(onehot, array_max(onehot))").cast("int")))
