"""Series tables derived from the given tables, in Spark and in SQL.

Values are whole cents held as doubles, so sums are exact in any order and on
any engine.  ``hourly`` and ``daily`` have at most one row per series and step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourcast.operators.resample import resample
from hourcast.operators.windows import lags

KEYS = ["series"]
# Blocks shorter than the default, so that the small tables already span several.
CHUNK = 256
SPLIT_DATE = "2000-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("series"), "ts", cents("value").alias("v")
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and hour."""
    raw = raw_events(spark, sf_dir).select("series", "ts", "v")
    return resample(raw, KEYS, "ts", "v", "hour", "sum").withColumn("v", F.col("v").cast("double"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per priority and day."""
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts"), cents("o_totalprice").alias("v")
    )
    return resample(raw, KEYS, "ts", "v", "day", "sum").withColumn("v", F.col("v").cast("double"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per priority and month."""
    return resample(daily(spark, sf_dir), KEYS, "ts", "v", "month", "sum")


def steady(column: str) -> Column:
    """Two decimals, cut at an odd place.

    Means of whole cents often lie exactly on half a digit, where plain rounding
    would let the last bit of a sum decide.
    """
    return (F.floor(F.col(column) * 100 + F.lit(0.3183)) / 100).alias(column)


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly series with values up to 50.00 set to NULL."""
    return hourly(spark, sf_dir).withColumn("v", F.when(F.col("v") > 5000, F.col("v")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two forecasts per day, in thousands: the previous row (a) and the one seven rows back (b)."""
    lagged = lags(daily(spark, sf_dir), KEYS, "ts", "v", {"a": 1, "b": 7}, step="day", chunk_rows=CHUNK)
    scaled = {c: F.col(c) / 100000 for c in ("v", "a", "b")}
    return lagged.withColumns(scaled).filter(F.col("a").isNotNull())


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as model versions: one model per priority, the stage from the status."""
    stage = (
        F.when(F.col("o_orderstatus") == "O", "Production")
        .when(F.col("o_orderstatus") == "P", "Staging")
        .otherwise("None")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderkey").alias("version"),
        stage.alias("current_stage"),
        F.col("o_orderdate").alias("creation_timestamp"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as experiment runs."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("ts").alias("start_time"),
        F.col("event_type").alias("experiment"),
        F.col("value").alias("mae"),
    )


# The same frames in SQL, as bodies of WITH items.
H = """h AS (SELECT event_type AS series, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS v FROM events GROUP BY 1, 2)"""
N = H + """, n AS (SELECT series, ts, CASE WHEN v > 5000 THEN v END AS v FROM h)"""
D = """d AS (SELECT o_orderpriority AS series, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)"""
MO = D + """, mo AS (SELECT series, CAST(date_trunc('month', ts) AS TIMESTAMP) AS ts, sum(v) AS v
  FROM d GROUP BY 1, 2)"""
P = D + """, p AS (SELECT series, ts, v / 100000 AS v, a / 100000 AS a, b / 100000 AS b FROM (
  SELECT *, lag(v, 1) OVER w AS a, lag(v, 7) OVER w AS b FROM d
  WINDOW w AS (PARTITION BY series ORDER BY ts)) WHERE a IS NOT NULL)"""
V = """ver AS (SELECT o_orderpriority AS name, o_orderkey AS version,
  CASE o_orderstatus WHEN 'O' THEN 'Production' WHEN 'P' THEN 'Staging' ELSE 'None' END AS current_stage,
  o_orderdate AS creation_timestamp FROM orders)"""
R = """r AS (SELECT event_id AS run_id, ts AS start_time, event_type AS experiment, value AS mae FROM events)"""
STEADY = "floor(({0}) * 100 + 0.3183::DOUBLE) / 100"
W = "WINDOW w AS (PARTITION BY series ORDER BY ts)"
