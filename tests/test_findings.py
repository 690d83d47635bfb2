"""Findings of the reviews: tests that failed before they were settled."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tidemark import catalog
from tidemark.functions.columns import mean_in_order
from tidemark.operators import divergence, pairs, preprocess, recipes, simulate, stats, train, views


def broadcast(df) -> list[str]:
    """The subtrees of a plan that go to every machine."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:+|\-*]*(\(\d+\) )?", x)[0].split("(")[0]) for x in lines]
    out = []
    for n, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((m for m in range(n + 1, len(lines)) if depth[m] <= depth[n]), len(lines))
            out.append("\n".join(lines[n:end]))
    return out


def _unit_tables(spark):
    units = spark.range(40).select(F.col("id").alias("u"), (F.col("id") % 7).cast("double").alias("target"), (F.col("id") % 2).cast("int").alias("label"))
    return units, spark.range(80).select((F.col("id") % 40).alias("u"), (F.col("id") % 2).alias("state"), (F.col("id") % 11).cast("double").alias("value"))


def test_correlation_test_sends_no_permutations_to_every_machine(spark):
    units, measures = _unit_tables(spark)
    assert not [x for x in broadcast(stats.correlation_test(units, measures, "u", "target", 20, ["state"])) if "Generate explode" in x and "perm" in x]


def test_difference_test_sends_no_permutations_to_every_machine(spark):
    units, measures = _unit_tables(spark)
    assert not [x for x in broadcast(stats.difference_test(units, measures, "u", "label", 20, ["state"])) if "Generate explode" in x and "perm" in x]


def _vectors(spark, n, d, seed):
    v = np.random.default_rng(seed).normal(size=(n, d))
    return v, spark.createDataFrame([(i, j, float(v[i, j])) for i in range(n) for j in range(d)], "series_id bigint, feature int, value double")


def test_divergence_matrix_by_cells(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CELL_SERIES", 5)
    rng, k, d = np.random.default_rng(4), 2, 3
    models = []
    for _ in range(23):
        a = rng.normal(size=(k, d, d))
        models.append(train.Model(rng.random(k) + 1, rng.random((k, k)) * 9 + 1, rng.normal(size=(k, d)), rng.random(k) + 1, rng.random(k) * 9 + d + 2, a @ a.transpose(0, 2, 1) + np.eye(d)))
    rows = [(n, *r) for n, m in enumerate(models) for r in m.rows()]
    found = divergence.divergence_matrix(spark.createDataFrame(rows, "series_id bigint, state int, param string, i int, j int, value double"), k, d)
    got = {(r.a, r.b): r.divergence for r in found.collect()}
    want = {(a, b): 0.5 * (divergence.chain_divergence(models[a], models[b]) + divergence.chain_divergence(models[b], models[a])) for a in range(23) for b in range(a + 1, 23)}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], rel=1e-9) for p in want)


def test_scatter_divergence_by_cells(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CELL_SERIES", 5)
    v = np.random.default_rng(5).normal(size=(17, 30, 2)) * np.arange(1, 18)[:, None, None]
    rows = [(s, float(a), float(b)) for s in range(17) for a, b in v[s]]
    got = {(r.a, r.b): r.divergence for r in pairs.scatter_divergence(spark.createDataFrame(rows, "series_id bigint, u double, v double"), ["u", "v"]).collect()}
    rate = [(np.cov(x.T, bias=True) * 30 + 1e-6 * np.eye(2)) / 2 for x in v]
    want = {(a, b): divergence.wishart_symmetric(17, rate[a], 17, rate[b]) for a in range(17) for b in range(a + 1, 17)}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], rel=1e-9) for p in want)


@pytest.mark.parametrize("few", [100_000, 10, 0])
def test_median_of_distances_stores_no_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(pairs, "CELL_SERIES", 7)
    monkeypatch.setattr(pairs, "EXACT_VALUES", few)
    for n, d, seed in ((24, 3, 1), (23, 1, 2), (2, 2, 3)):
        v, features = _vectors(spark, n, d, seed)
        want = np.median([((v[a] - v[b]) ** 2).sum() for a in range(n) for b in range(a + 1, n)])
        assert pairs.median_of_distances(features).first().sigma == pytest.approx(want, rel=1e-12)
    same = spark.createDataFrame([(i, 1, 2.0) for i in range(30)], "series_id bigint, feature int, value double")
    assert pairs.median_of_distances(same).first().sigma == 0
    assert pairs.median_of_distances(same.limit(1)).first().sigma is None


def test_means_in_order_do_not_depend_on_partitions(spark):
    values = np.random.default_rng(6).random(200) * 100
    rows = spark.range(4000).select((F.col("id") % 20).alias("series_id"), F.lit(1).cast("bigint").alias("segment_id"), F.floor(F.col("id") / 20).cast("int").alias("t"))
    rows = rows.withColumn("x", F.element_at(F.array(*map(F.lit, values.tolist())), F.col("t") + 1)).repartition(7, F.col("series_id") * 31 + F.col("t") * 17)
    means = rows.groupBy("series_id", "segment_id").agg(mean_in_order("t", "x").alias("y"))
    total = 0.0
    for v in values.tolist():
        total += v
    assert {r.y for r in means.collect()} == {total / 200}
    assert [r.series_id for r in views.trial_order(None, means).orderBy("place").collect()] == list(range(20))
    nulls = spark.createDataFrame([(1, None), (1, 2.0), (2, None)], "k int, x double").withColumn("t", F.monotonically_increasing_id())
    assert {r.k: r.y for r in nulls.groupBy("k").agg(mean_in_order("t", "x").alias("y")).collect()} == {1: 2.0, 2: None}


def _course(spark):
    import random

    y = F.udf(lambda n: None if n == 5 else random.random(), "double").asNondeterministic()
    order = views.trial_order(None, spark.range(300).select(F.col("id").alias("series_id"), F.lit(1).cast("bigint").alias("segment_id"), y("id").alias("y")))
    gamma = spark.range(600).select((F.col("id") % 300).alias("series_id"), F.lit(1).cast("bigint").alias("segment_id"), F.lit(1).alias("t"), F.when(F.col("id") < 300, 1).otherwise(2).alias("state"), F.lit(0.5).alias("p"))
    return order, views.course_table(gamma, order)


def test_places_come_from_the_values_that_were_counted(spark):
    order, _ = _course(spark)
    places = {r.series_id: r.place for r in order.collect()}
    assert sorted(places.values()) == list(range(1, 301)) and places[5] == 300  # no value: last, as in SQL


def test_courses_have_one_trial_at_each_place(spark):
    _, course = _course(spark)
    assert sorted((r.place, r.state, r.low, r.high) for r in course.collect()) == [(n, s, 0.5 * (s - 1), 0.5 * s) for n in range(1, 301) for s in (1, 2)]


def test_series_distances_by_cells(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CELL_SERIES", 4)
    x = simulate.gaussian_series(simulate.segment_grid(spark, 9, 2, 60), [[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5], [[0, 0], [4, 3]], [np.eye(2)] * 2, seed=2)
    long = x.select("series_id", "segment_id", "t", F.posexplode("x").alias("c", "value")).select("series_id", "segment_id", "t", (F.col("c") + 1).alias("channel"), "value")
    got = {(r.a, r.b): r.divergence for r in recipes.series_distances(long, recipes.Recipe(), 2, cycles=3, seed=1).collect()}
    names = sorted({n for pair in got for n in pair})
    assert len(names) == 9 and got.keys() == {(a, b) for a in names for b in names if a < b}
    duals = {}
    wide = recipes.array_form(long)
    for r in train.dual_estimates(wide, train.fit(wide, k=2, cycles=3, seed=1)).collect():
        duals.setdefault(r.series_id, {})[r.param, r.state, r.i, r.j] = r.value
    models = {n: _model(cells) for n, cells in duals.items()}
    for (a, b), value in got.items():
        assert value == pytest.approx(0.5 * (divergence.chain_divergence(models[a], models[b]) + divergence.chain_divergence(models[b], models[a])), rel=1e-6)


def _model(cells):
    of = lambda param: np.array([v for (p, *_), v in sorted(cells.items(), key=lambda c: c[0][1:]) if p == param])
    return train.Model(of("start"), of("counts").reshape(2, 2), of("mean").reshape(2, 2), of("beta"), of("a"), of("rate").reshape(2, 2, 2))


def test_scored_segments_are_the_clean_standardised_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(s, g, t, [float(rng.normal()), 0.1 if (s, g) == (1, 2) else float(t % 3), float(rng.normal())]) for s in (1, 2) for g in (1, 2, 3) for t in range(1, 2 if (s, g) == (2, 1) else 3 + s + g)]
    x = spark.createDataFrame(rows, "series_id bigint, segment_id bigint, t int, x array<double>")
    got = {(r.series_id, r.segment_id, r.t): r.x for r in train.samples(recipes.scored_segments(x)).collect()}
    want = recipes.array_form(preprocess.standardise(preprocess.clean(recipes.long_form(x)))).collect()
    assert {(r.series_id, r.segment_id) for r in want} == {(1, 1), (1, 3), (2, 2), (2, 3)}
    assert got.keys() == {(r.series_id, r.segment_id, r.t) for r in want}
    assert all(got[r.series_id, r.segment_id, r.t] == pytest.approx(r.x, rel=1e-12, abs=1e-14) for r in want)


def test_series_distances_read_and_deal_samples_once(spark, monkeypatch):
    plans = []
    for module in (recipes, train, pairs):
        monkeypatch.setattr(module, "stage", lambda df, *a, f=module.stage: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, *a))
    catalog.QUERIES["viz20_series_distances"](spark, DATA).collect()
    read = [p for p in plans if "events.parquet" in p]
    assert len(read) == 1 and read[0].count("events.parquet") == read[0].count("Exchange hashpartitioning") == 1 and "Join" not in read[0]
    models = next(p for p in plans if "pythonUDF" in p or "MapInArrow" in p and p is not read[0])
    assert models.count("Exchange ") == 2  # the sums of a segment go to its series, and a series' model to its row


def test_a_block_against_itself_may_come_in_two_orders(spark, monkeypatch):
    side = lambda order: [(n, [float(n)]) for n in order]
    cells = spark.createDataFrame([(0, 0, side([1, 2, 3, 4]), side([3, 1, 4, 2]))], "p int, q int, x array<struct<series_id: bigint, v: array<double>>>, y array<struct<series_id: bigint, v: array<double>>>")
    monkeypatch.setattr(pairs, "block_cells", lambda rows: cells)
    got = pairs.measured_pairs(None, lambda x, y: abs(x - y.T), "apart").collect()
    assert sorted(map(tuple, got)) == [(a, b, float(b - a)) for a in range(1, 5) for b in range(a + 1, 5)]


def test_cells_of_series_write_no_copies_for_other_blocks(spark, monkeypatch):
    """A row of a block for either side, however many blocks it meets, and pairs that blocks of several pieces share."""
    monkeypatch.setattr(pairs, "CELL_SERIES", 5)
    monkeypatch.setattr(pairs, "BLOCKS", 2)
    monkeypatch.setattr(pairs, "MOST_SERIES", 12)
    rows = spark.range(60).select(F.col("id").alias("series_id"), F.array(F.col("id").cast("double")).alias("v"))
    cells = pairs.block_cells(rows)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode" not in plan and "SortMergeJoin" not in plan
    sides = cells.select("p", "q", F.size("x").alias("x"), F.size("y").alias("y")).collect()
    assert sorted((r.p, r.q) for r in sides) == [(p, q) for p in range(5) for q in range(p, 5)] and max(r.x for r in sides) > 5
    got = pairs.measured_pairs(rows, lambda x, y: abs(x - y.T), "apart").collect()
    assert sorted(map(tuple, got)) == [(a, b, float(b - a)) for a in range(60) for b in range(a + 1, 60)]


def test_pieces_of_a_block_are_of_like_size():
    import pyarrow as pa

    side = [{"series_id": n, "v": [float(n)]} for n in range(11)]
    kind = pa.list_(pa.struct([("series_id", pa.int64()), ("v", pa.list_(pa.float64()))]))
    for size, want in ((10, [11]), (5, [6, 5]), (3, [3, 3, 3, 2])):
        batch = pa.RecordBatch.from_pydict({"p": [0], "q": [0], "x": pa.array([side], kind), "y": pa.array([side], kind)})
        found = list(pairs.block_sides(batch, size, lambda v: v))
        assert [len(x) for same, _, x, _, _ in found if same] == want and len(found) == len(want) * (len(want) + 1) // 2
