"""Lags, moving statistics, grids and decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.operators.resample import asfreq_month_end, future_spine, regularize, resample
from hourcast.operators.windows import (
    bfill,
    continuity,
    decompose,
    lags,
    rolling,
    rolling_daily,
    time_step,
)
from hourcast.queries.frames import CHUNK, D, H, KEYS, MO, STEADY, W, daily, hourly, monthly, steady
from hourcast.queries.registry import query

# Decomposition by a period of twelve rows, of a table ``mo`` (series, ts, v).
DECOMPOSE = f"""i AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS i FROM mo),
      t AS (SELECT *, CASE WHEN count(v) OVER f = 13
        THEN (sum(v) OVER f - 0.5::DOUBLE * (lag(v, 6) OVER w + lead(v, 6) OVER w)) / 12 END AS trend
        FROM i WINDOW w AS (PARTITION BY series ORDER BY ts),
          f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
      q AS (SELECT series, i % 12 AS ph, avg(v - trend) AS raw FROM t GROUP BY 1, 2),
      s AS (SELECT series, ph, raw - avg(raw) OVER (PARTITION BY series) AS seasonal FROM q)
    SELECT t.series, t.ts, v, trend, {STEADY.format("seasonal")} AS seasonal,
      {STEADY.format("v - trend - seasonal")} AS residual
    FROM t JOIN s ON s.series = t.series AND s.ph = t.i % 12"""


@query(
    "rolling_stats",
    f"""WITH {H} SELECT series, ts, v,
      CASE WHEN count(v) OVER m >= 24 THEN avg(v) OVER m END AS mean_24,
      round(CASE WHEN count(v) OVER m >= 24 THEN stddev_samp(v) OVER m END, 4) AS std_24,
      CASE WHEN count(v) OVER k >= 1 THEN sum(v) OVER k END AS sum_168
    FROM h WINDOW m AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
      k AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)""",
)
def rolling_stats(spark, sf_dir):
    specs = {"mean_24": (24, "avg", 24), "std_24": (24, "std", 24), "sum_168": (168, "sum", 1)}
    out = rolling(hourly(spark, sf_dir), KEYS, "ts", "v", specs, chunk_rows=CHUNK)
    return out.withColumn("std_24", F.round("std_24", 4))


@query(
    "rolling_before",
    f"""WITH {D} SELECT series, ts, v,
      CASE WHEN count(v) OVER m >= 3 THEN avg(v) OVER m END AS mean_7
    FROM d WINDOW m AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
)
def rolling_before(spark, sf_dir):
    specs = {"mean_7": (7, "avg", 3)}
    return rolling(daily(spark, sf_dir), KEYS, "ts", "v", specs, True, "day", CHUNK)


@query(
    "lags_rows",
    f"""WITH {D} SELECT series, ts, v, lag(v, 1) OVER w AS lag_1, lag(v, 7) OVER w AS lag_7,
      lag(v, 30) OVER w AS lag_30 FROM d {W}""",
)
def lags_rows(spark, sf_dir):
    periods = {"lag_1": 1, "lag_7": 7, "lag_30": 30}
    return lags(daily(spark, sf_dir), KEYS, "ts", "v", periods, step="day", chunk_rows=CHUNK)


@query(
    "lags_time",
    f"""WITH {H} SELECT a.series, a.ts, a.v, b.v AS lag_24, c.v AS lag_168 FROM h a
      LEFT JOIN h b ON b.series = a.series AND b.ts = a.ts - INTERVAL 24 HOUR
      LEFT JOIN h c ON c.series = a.series AND c.ts = a.ts - INTERVAL 168 HOUR""",
)
def lags_time(spark, sf_dir):
    periods = {"lag_24": 24, "lag_168": 168}
    return lags(hourly(spark, sf_dir), KEYS, "ts", "v", periods, "time", chunk_rows=CHUNK)


@query(
    "regularize",
    f"""WITH {H}, b AS (SELECT series, min(ts) AS lo, max(ts) AS hi FROM h GROUP BY 1),
      s AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM b)
    SELECT s.series, s.ts, h.v FROM s LEFT JOIN h ON h.series = s.series AND h.ts = s.ts""",
)
def regular_grid(spark, sf_dir):
    return regularize(hourly(spark, sf_dir), KEYS, "ts", "hour")


@query(
    "month_end_sample",
    f"""WITH {D}, b AS (SELECT series, date_trunc('month', min(ts)) AS lo, date_trunc('month', max(ts)) AS hi
      FROM d GROUP BY 1),
      s AS (SELECT series, CAST(last_day(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
        INTERVAL 1 MONTH))) AS TIMESTAMP) AS ts FROM b)
    SELECT s.series, s.ts, d.v FROM s LEFT JOIN d ON d.series = s.series AND d.ts = s.ts""",
)
def month_end_sample(spark, sf_dir):
    return asfreq_month_end(daily(spark, sf_dir), KEYS, "ts")


@query(
    "time_step",
    f"""WITH {H} SELECT series, ts, v, CAST(epoch(ts) - epoch(lag(ts) OVER w) AS BIGINT) AS time_diff
    FROM h {W}""",
)
def steps(spark, sf_dir):
    return time_step(hourly(spark, sf_dir), KEYS, "ts", chunk_rows=CHUNK)


@query(
    "continuity",
    f"""WITH {H}, g AS (SELECT series, CAST(epoch(ts) - epoch(lag(ts) OVER w) AS BIGINT) AS s FROM h {W})
    SELECT series, bool_and(s = 3600) AS is_continuous, bool_or(s = 3600) AS any_step_ok,
      count(*) FILTER (s > 3600) AS gaps,
      CAST(coalesce(sum(s // 3600 - 1) FILTER (s > 3600), 0) AS BIGINT) AS missing_steps
    FROM g GROUP BY 1""",
)
def continuous(spark, sf_dir):
    return continuity(hourly(spark, sf_dir), KEYS, "ts")


@query(
    "daily_mean",
    f"""WITH {H} SELECT series, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, avg(v) AS v FROM h GROUP BY 1, 2""",
)
def daily_mean(spark, sf_dir):
    return resample(hourly(spark, sf_dir), KEYS, "ts", "v", "day", "avg")


@query(
    "rolling_7d",
    f"""WITH {H}, m AS (SELECT series, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, avg(v) AS v FROM h GROUP BY 1, 2),
      b AS (SELECT series, min(ts) AS lo, max(ts) AS hi FROM m GROUP BY 1),
      s AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM b),
      g AS (SELECT s.series, s.ts, m.v FROM s LEFT JOIN m ON m.series = s.series AND m.ts = s.ts)
    SELECT series, ts, v, round(CASE WHEN count(v) OVER k >= 7 THEN avg(v) OVER k END, 4) AS rolling
    FROM g WINDOW k AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def rolling_7d(spark, sf_dir):
    out = rolling_daily(hourly(spark, sf_dir), KEYS, "ts", "v")
    return out.withColumn("rolling", F.round("rolling", 4))


@query(
    "decompose",
    f"WITH {MO}, {DECOMPOSE}",
)
def decomposed(spark, sf_dir):
    out = decompose(monthly(spark, sf_dir), KEYS, "ts", "v", 12, chunk_rows=16)
    return out.withColumns({c: steady(c) for c in ("seasonal", "residual")})


@query(
    "future_spine",
    f"""WITH {H}, t AS (SELECT CAST(date_trunc('day', max(ts)) AS TIMESTAMP) + INTERVAL 1 DAY AS day FROM h)
    SELECT series, unnest(generate_series(day, day + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS ts
    FROM (SELECT DISTINCT series FROM h), t""",
)
def next_day_spine(spark, sf_dir):
    history = hourly(spark, sf_dir)
    series = history.select("series").distinct()
    newest = history.agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("d")).scalar()
    day = newest + F.expr("interval 1 day")
    return future_spine(series, "ts", day, day + F.expr("interval 23 hours"), "hour")


@query(
    "continuity_monthly",
    f"""WITH {MO}, k AS (SELECT * FROM mo WHERE NOT (series = '5-LOW' AND month(ts) = 2)),
      g AS (SELECT series, datediff('month', lag(ts) OVER (PARTITION BY series ORDER BY ts), ts) AS s FROM k)
    SELECT series, bool_and(s = 1) AS is_continuous, bool_or(s = 1) AS any_step_ok,
      count(*) FILTER (s > 1) AS gaps, CAST(coalesce(sum(s - 1) FILTER (s > 1), 0) AS BIGINT) AS missing_steps
    FROM g GROUP BY 1""",
)
def continuous_months(spark, sf_dir):
    """Steps of a calendar month, one series with a month missing each year."""
    gone = (F.col("series") == "5-LOW") & (F.month("ts") == 2)
    return continuity(monthly(spark, sf_dir).filter(~gone), KEYS, "ts", "month")


@query(
    "lags_time_monthly",
    f"""WITH {MO} SELECT m.series, m.ts, m.v, a.v AS lag_1, b.v AS lag_12 FROM mo m
      LEFT JOIN mo a ON a.series = m.series AND a.ts = m.ts - INTERVAL 1 MONTH
      LEFT JOIN mo b ON b.series = m.series AND b.ts = m.ts - INTERVAL 12 MONTH""",
)
def monthly_lags(spark, sf_dir):
    months = monthly(spark, sf_dir)
    return lags(months, KEYS, "ts", "v", {"lag_1": 1, "lag_12": 12}, mode="time", step="month", chunk_rows=16)


@query(
    "decompose_month_end",
    f"""WITH {D}, b AS (SELECT series, date_trunc('month', min(ts)) AS lo, date_trunc('month', max(ts)) AS hi FROM d GROUP BY 1),
      sp AS (SELECT series, CAST(last_day(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH))) AS TIMESTAMP) AS ts FROM b),
      e AS (SELECT sp.series, sp.ts, d.v FROM sp LEFT JOIN d ON d.series = sp.series AND d.ts = sp.ts),
      mo AS (SELECT series, ts, first_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM e),
      {DECOMPOSE}""",
)
def decomposed_month_ends(spark, sf_dir):
    """The value on each month's last day, gaps filled from the next known one, then decomposed by the year."""
    ends = asfreq_month_end(daily(spark, sf_dir), KEYS, "ts")
    filled = bfill(ends, KEYS, "ts", "v", step="month", chunk_rows=16)
    out = decompose(filled, KEYS, "ts", "v", 12, chunk_rows=16)
    return out.withColumns({c: steady(c) for c in ("seasonal", "residual")})
