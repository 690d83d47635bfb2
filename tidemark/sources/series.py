"""Reading and writing of series, checks on the way in, and models as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.train import Model

KEY = ("series_id", "segment_id")
FORMATS = {"parquet": {}, "csv": {"header": True, "inferSchema": True}, "json": {}, "orc": {}}


def read(spark: SparkSession, paths: str | Sequence[str], kind: str = "parquet") -> DataFrame:
    """Samples from files of one format; several paths are one scan."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; known are {', '.join(FORMATS)}")
    return spark.read.format(kind).options(**FORMATS[kind]).load([paths] if isinstance(paths, str) else list(paths))


def keyed(rows: DataFrame, series: str, order: Sequence[str], channels: Sequence[str], segment: str | None = None) -> DataFrame:
    """(series_id, segment_id, t, x) of plain rows: t numbers each segment's rows in the given order."""
    segment_id = F.col(segment) if segment else F.lit(1).cast("bigint")
    t = F.row_number().over(Window.partitionBy(F.col(series), segment_id).orderBy(*order))
    return rows.select(F.col(series).alias("series_id"), segment_id.alias("segment_id"), t.alias("t"), F.array(*(F.col(c).cast("double") for c in channels)).alias("x"))


def faults(observations: DataFrame, lost: int = 0) -> DataFrame:
    """Segments that break the rules: gaps in t, no more samples than a lag design loses, or values
    that are null, NaN or infinite. Empty where all is well."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    found = observations.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.count_distinct("t").alias("times"), F.max(bad | F.col("x").isNull()).alias("bad_values")
    )
    gaps = (F.col("first") != 1) | (F.col("last") != F.col("n")) | (F.col("times") != F.col("n"))
    return found.select(*KEY, "n", gaps.alias("gaps"), (F.col("n") <= lost).alias("short"), "bad_values").filter("gaps OR short OR bad_values")


def checked(observations: DataFrame, lost: int = 0) -> DataFrame:
    """The observations, or an error that names a segment at fault."""
    wrong = faults(observations, lost).first()
    if wrong:
        raise ValueError(f"series {wrong.series_id}, segment {wrong.segment_id}: " + ", ".join(n for n in ("gaps", "short", "bad_values") if wrong[n]))
    return observations


def with_lengths(observations: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments whose number of samples differs from the stated ``n``."""
    counted = observations.groupBy(*KEY).agg(F.count("*").alias("found"))
    return segments.join(counted, list(KEY), "full").filter("NOT (n <=> found)")


def to_long(observations: DataFrame) -> DataFrame:
    """(series_id, segment_id, t, channel, value)."""
    return observations.select(*KEY, "t", F.posexplode("x").alias("c", "value")).select(*KEY, "t", (F.col("c") + 1).alias("channel"), "value")


def from_long(long: DataFrame) -> DataFrame:
    """The inverse of ``to_long``."""
    cells = F.array_sort(F.collect_list(F.struct("channel", "value")))
    return long.groupBy(*KEY, "t").agg(cells.alias("c")).select(*KEY, "t", F.col("c.value").alias("x"))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", by: Sequence[str] = ()) -> None:
    """Writes once per ``mode``; ``by`` partitions the files, so later scans of some series prune the rest."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; known are {', '.join(FORMATS)}")
    options = {"header": True} if kind == "csv" else {}
    df.write.format(kind).options(**options).mode(mode).partitionBy(*by).save(path)


def model_table(spark: SparkSession, model: Model) -> DataFrame:
    """A model as (state, param, i, j, value)."""
    return spark.createDataFrame(model.rows(), "state int, param string, i int, j int, value double")


def model_from(rows: DataFrame) -> Model:
    """The inverse of ``model_table``; parameters that an older table lacks get their defaults."""
    import numpy as np

    found: dict[str, dict] = {}
    for state, param, i, j, value in rows.select("state", "param", "i", "j", "value").collect():
        found.setdefault(param, {})[state, i, j] = value
    k, d = max(s for s, _, _ in found["mean"]), max(i for _, i, _ in found["mean"])
    start = np.array([found.get("start", {}).get((0, i + 1, 0), 1.0) for i in range(k)])
    counts = np.array([[found.get("counts", {}).get((i + 1, i + 1, j + 1), 1.0) for j in range(k)] for i in range(k)])
    mean = np.array([[found["mean"][s + 1, i + 1, 0] for i in range(d)] for s in range(k)])
    rate = np.array([[[found["rate"][s + 1, i + 1, j + 1] for j in range(d)] for i in range(d)] for s in range(k)])
    plain = lambda n, v: np.array([found.get(n, {}).get((s + 1, 0, 0), v) for s in range(k)])
    return Model(start, counts, mean, plain("beta", 1.0), plain("a", d + 1.0), rate)
