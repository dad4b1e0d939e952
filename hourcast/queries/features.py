"""Feature rows, splits and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hourcast.functions.calendar import CALENDAR
from hourcast.operators.profile import minmax
from hourcast.operators.training import (
    labels_of,
    minmax_inverse,
    minmax_scale,
    shift_months,
    training_set,
    with_split,
)
from hourcast.plans.features import FeatureConfig, build_features, build_future_features
from hourcast.queries.frames import CHUNK, D, H, KEYS, daily, hourly
from hourcast.queries.registry import query
from hourcast.queries.scalars import FLAG_SQL, FLAGS, PRIORITIES

DAILY = FeatureConfig(
    lags={"lag_1": 1, "lag_7": 7, "lag_30": 30},
    moving={"mean_7": (7, "avg", 7), "std_7": (7, "std", 7), "sum_30": (30, "sum", 1)},
    values=PRIORITIES,
    step="day",
    mode="rows",
    id_column="consumption_id",
    chunk_rows=CHUNK,
)
HOURLY = FeatureConfig(
    lags={"lag_24": 24, "lag_168": 168},
    moving={"mean_24": (24, "avg", 24), "std_24": (24, "std", 24), "sum_168": (168, "sum", 1)},
    values=["click", "error", "purchase", "signup", "view"],
    mode="time",
    id_column="consumption_id",
    chunk_rows=CHUNK,
)

_CALENDAR = """CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
  CAST(month(ts) AS INTEGER) AS month, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(year(ts) AS INTEGER) AS year,
  CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(day(ts) AS INTEGER) AS day_of_month,
  CAST(week(ts) AS INTEGER) AS week_of_year, series || '_' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS consumption_id"""
_HOURLY_FLAGS = ", ".join(f"CAST(series = '{s}' AS INTEGER) AS {s}" for s in HOURLY.values)


def _later(columns: list[str]) -> str:
    """Backward fill of columns in SQL."""
    return ", ".join(
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts "
        f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}"
        for c in columns
    )


def _tidy(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Lower-case names, short flag names, standard deviations rounded."""
    names = {c: c.lower() for c in CALENDAR} | flags
    out = df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])
    return out.withColumns({c: F.round(c, 1) for c in out.columns if c.startswith("std_")})


TRAIN_SQL = f"""{D}, w AS (SELECT series, ts, v, lag(v, 1) OVER o AS lag_1, lag(v, 7) OVER o AS lag_7,
    lag(v, 30) OVER o AS lag_30,
    CASE WHEN count(v) OVER k >= 7 THEN avg(v) OVER k END AS mean_7,
    CASE WHEN count(v) OVER k >= 7 THEN stddev_samp(v) OVER k END AS std_7,
    CASE WHEN count(v) OVER l >= 1 THEN sum(v) OVER l END AS sum_30
  FROM d WINDOW o AS (PARTITION BY series ORDER BY ts),
    k AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
    l AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
  b AS (SELECT series, ts, v, sum_30, {_later(["lag_1", "lag_7", "lag_30", "mean_7", "std_7"])} FROM w),
  x AS (SELECT series, ts, v, lag_1, lag_7, lag_30, mean_7, round(std_7, 1) AS std_7, sum_30, {_CALENDAR}, {FLAG_SQL} FROM b)"""


def daily_features(spark, sf_dir):
    return build_features(daily(spark, sf_dir), "series", "ts", "v", DAILY)


@query("features_train", f"WITH {TRAIN_SQL} SELECT * FROM x")
def features_train(spark, sf_dir):
    return _tidy(daily_features(spark, sf_dir), FLAGS)


@query("training_set", f"WITH {TRAIN_SQL} SELECT * EXCLUDE (series, ts, consumption_id) FROM x")
def features_for_labels(spark, sf_dir):
    days = daily(spark, sf_dir)
    labels = labels_of(days, "series", "ts", "v", "consumption_id")
    features = build_features(days, "series", "ts", "v", DAILY).drop("series")
    joined = training_set(labels, features, ["consumption_id"], exclude=["consumption_id", "ts"])
    return _tidy(joined, FLAGS)


@query(
    "features_future",
    f"""WITH {H}, t AS (SELECT CAST(date_trunc('day', max(ts)) AS TIMESTAMP) + INTERVAL 1 DAY AS day FROM h),
      u AS (SELECT series, ts, v FROM h, t WHERE ts < day AND ts >= day - INTERVAL 168 HOUR - INTERVAL 1 DAY
        UNION ALL SELECT series, unnest(generate_series(day, day + INTERVAL 23 HOUR, INTERVAL 1 HOUR)), NULL
          FROM (SELECT DISTINCT series FROM h), t),
      l AS (SELECT u.series, u.ts, a.v AS lag_24, b.v AS lag_168,
        last_value(u.v IGNORE NULLS) OVER (PARTITION BY u.series ORDER BY u.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
        FROM u LEFT JOIN u a ON a.series = u.series AND a.ts = u.ts - INTERVAL 24 HOUR
          LEFT JOIN u b ON b.series = u.series AND b.ts = u.ts - INTERVAL 168 HOUR),
      m AS (SELECT *, avg(v) OVER k AS mean_24, stddev_samp(v) OVER k AS std_24, sum(v) OVER s AS sum_168 FROM l
        WINDOW k AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
          s AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)),
      f AS (SELECT series, ts, mean_24, round(std_24, 1) AS std_24, sum_168, {_later(["lag_24", "lag_168"])} FROM m)
    SELECT series, ts, lag_24, lag_168, mean_24, std_24, sum_168, {_CALENDAR}, {_HOURLY_FLAGS} FROM f, t WHERE ts >= day""",
)
def features_future(spark, sf_dir):
    history = hourly(spark, sf_dir)
    series = history.select("series").distinct()
    newest = history.agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("d")).scalar()
    day = newest + F.expr("interval 1 day")
    return _tidy(build_future_features(history, series, "series", "ts", "v", day, HOURLY), {})


SPLIT = {"train": ("1995-01-01", "1999-12-31"), "test": ("1999-12-31", "2001-01-01")}


@query(
    "time_split",
    f"""WITH {D} SELECT series, ts, v, CASE WHEN ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1999-12-31' THEN 'train'
      WHEN ts >= TIMESTAMP '1999-12-31' AND ts < TIMESTAMP '2001-01-01' THEN 'test' END AS split FROM d""",
)
def split_rows(spark, sf_dir):
    return with_split(daily(spark, sf_dir), "ts", SPLIT)


@query(
    "shift_split",
    f"""WITH {D}, b AS (SELECT series, CAST(min(ts) AS DATE) AS train_start, CAST(max(ts) AS DATE) AS train_end FROM d GROUP BY 1)
    SELECT series, m AS months, CAST(train_start + to_months(m) AS DATE) AS train_start,
      CAST(train_end + to_months(m) AS DATE) AS train_end FROM b, (VALUES (1), (3), (6)) x(m)""",
)
def shifted_bounds(spark, sf_dir):
    bounds = daily(spark, sf_dir).groupBy("series").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    shifted = [
        bounds.select(
            "series",
            F.lit(m).alias("months"),
            shift_months(F.col("lo"), m).alias("train_start"),
            shift_months(F.col("hi"), m).alias("train_end"),
        )
        for m in (1, 3, 6)
    ]
    return shifted[0].union(shifted[1]).union(shifted[2])


@query(
    "minmax_scale_inverse",
    f"""WITH {D}, b AS (SELECT series, min(v) AS lo, max(v) AS hi FROM d GROUP BY 1)
    SELECT series, ts, v, round((v - lo) / (hi - lo), 9) AS scaled, round((v - lo) / (hi - lo) * (hi - lo) + lo, 2) AS restored
    FROM d JOIN b USING (series)""",
)
def scale_and_back(spark, sf_dir):
    days = daily(spark, sf_dir)
    rows = days.join(minmax(days, ["v"], KEYS), KEYS)
    low, high = F.col("min_v"), F.col("max_v")
    scaled = rows.withColumn("scaled", minmax_scale(F.col("v"), low, high))
    return scaled.select(
        "series",
        "ts",
        "v",
        F.round("scaled", 9).alias("scaled"),
        F.round(minmax_inverse(F.col("scaled"), low, high), 2).alias("restored"),
    )
