"""The driver's tables as series, segments and samples, in Spark and as SQL common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import table

K = 5
# The event types in alphabetical order are the states 1 to 5.
STATES = ("click", "error", "purchase", "signup", "view")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → (series_id, segment_id, t, state, x1, x2, x3): a user's calendar weeks are its segments."""
    events = table(spark, sf_dir, "events")
    week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")) / 7).cast("bigint")
    state = F.array_position(F.array(*map(F.lit, STATES)), F.col("event_type")).cast("int")
    w = Window.partitionBy("series_id", "segment_id").orderBy("ts", "event_id")  # by columns, so that a segment stays where it is
    keyed = events.select(
        "ts",
        "event_id",
        F.col("user_id").alias("series_id"),
        week.alias("segment_id"),
        state.alias("state"),
        F.col("value").alias("x1"),
        F.log1p("value").alias("x2"),
        F.get_json_object("props", "$.k").cast("double").alias("x3"),
    )
    return keyed.select("series_id", "segment_id", F.row_number().over(w).alias("t"), "state", "x1", "x2", "x3")


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("series_id", "segment_id", "t", "state")


def gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A soft time-course: the event's own state weighs four more, later states more with the value."""
    v = F.col("x1") / (1 + F.col("x1"))
    k = F.explode(F.sequence(F.lit(1), F.lit(K)))
    wide = samples(spark, sf_dir).select("series_id", "segment_id", "t", v.alias("v"), F.col("state").alias("own"), k.alias("state"))
    weight = 1 + 4 * (F.col("own") == F.col("state")).cast("double") + (F.col("state") - 1) * F.col("v")
    return wide.select("series_id", "segment_id", "t", "state", (weight / (5 + 4 + 10 * F.col("v"))).alias("p"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, segment_id, t, x) with the channels as an array."""
    return samples(spark, sf_dir).select("series_id", "segment_id", "t", F.array("x1", "x2", "x3").alias("x"))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, segment_id, t, channel, value)."""
    return observations(spark, sf_dir).select("series_id", "segment_id", "t", F.posexplode("x").alias("c", "value")).select(
        "series_id", "segment_id", "t", (F.col("c") + 1).alias("channel"), "value"
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem → longer series: (series_id, segment_id, t, x1, x2, x3), one segment for each supplier."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("series_id"),
        F.lit(1).cast("bigint").alias("segment_id"),
        F.row_number().over(w).alias("t"),
        F.col("l_quantity").alias("x1"),
        (F.col("l_extendedprice") / 1000).alias("x2"),
        (F.col("l_discount") * 100).alias("x3"),
    )


SQL = """
s AS (
  SELECT user_id AS series_id, (date_diff('day', DATE '1970-01-01', ts::DATE) // 7)::BIGINT AS segment_id,
         (row_number() OVER (PARTITION BY user_id, date_diff('day', DATE '1970-01-01', ts::DATE) // 7 ORDER BY ts, event_id))::INT AS t,
         list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::INT AS state,
         value AS x1, ln(1 + value) AS x2, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x3
  FROM events
), g AS (
  SELECT series_id, segment_id, t, k::INT AS state, (1 + 4 * (k = state)::INT + (k - 1) * (x1 / (1 + x1))) / (9 + 10 * (x1 / (1 + x1))) AS p
  FROM s, range(1, 6) r(k)
), o AS (
  SELECT series_id, segment_id, t, c::INT AS channel, CASE c WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END AS value FROM s, range(1, 4) r(c)
), runs AS (
  SELECT series_id, segment_id, state, min(t) AS start_t, max(t) AS end_t, count(*) AS length, run,
         run = max(run) OVER (PARTITION BY series_id, segment_id) AS is_last,
         sum(count(*)) OVER (PARTITION BY series_id, segment_id) AS n
  FROM (SELECT *, sum(c) OVER (PARTITION BY series_id, segment_id ORDER BY t) AS run
        FROM (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY series_id, segment_id ORDER BY t) = state THEN 0 ELSE 1 END AS c FROM s))
  GROUP BY series_id, segment_id, state, run
), course AS (
  SELECT t, state, avg(p) AS fo, count(*) AS n_segments FROM g GROUP BY t, state
), steps AS (
  SELECT * FROM (SELECT series_id, segment_id, lag(state) OVER (PARTITION BY series_id, segment_id ORDER BY t) AS i, state AS j FROM s) WHERE i IS NOT NULL
), trans AS (
  SELECT i, j, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY i) AS p FROM steps GROUP BY i, j
), l AS (
  SELECT l_suppkey AS series_id, 1::BIGINT AS segment_id,
         (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber))::INT AS t,
         l_quantity AS x1, l_extendedprice / 1000 AS x2, l_discount * 100 AS x3
  FROM lineitem
)
"""


def sql(query: str) -> str:
    return f"WITH {SQL} {query}"
