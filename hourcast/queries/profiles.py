"""Profiles and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.operators import profile
from hourcast.operators.quality import (
    between,
    in_set,
    mean_between,
    median_between,
    not_null,
    of_type,
    quality_report,
    run_suite,
    schema_check,
    stddev_between,
    suite_from_df,
    suite_to_df,
)
from hourcast.queries.frames import D, H, KEYS, N, daily, holed, hourly, raw_events
from hourcast.queries.registry import query


@query(
    "count_by_part",
    f"""WITH {D} SELECT 'year' AS part, CAST(year(ts) AS INTEGER) AS value, count(*) AS n FROM d GROUP BY 2
      UNION ALL SELECT 'month', CAST(month(ts) AS INTEGER), count(*) FROM d GROUP BY 2
      UNION ALL SELECT 'weekday', CAST(dayofweek(ts) + 1 AS INTEGER), count(*) FROM d GROUP BY 2
      UNION ALL SELECT 'hour', CAST(hour(ts) AS INTEGER), count(*) FROM d GROUP BY 2""",
)
def count_by_part(spark, sf_dir):
    days = daily(spark, sf_dir)
    parts = [
        profile.count_by_part(days, "ts", p).select(F.lit(p).alias("part"), F.col(p).alias("value"), "n")
        for p in ("year", "month", "weekday", "hour")
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("count_by_hour", f"WITH {H} SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM h GROUP BY 1")
def count_by_hour(spark, sf_dir):
    return profile.count_by_part(hourly(spark, sf_dir), "ts", "hour")


@query("count_by_series", "SELECT event_type AS series, count(*) AS n FROM events GROUP BY 1")
def count_by_series(spark, sf_dir):
    return profile.count_by_series(raw_events(spark, sf_dir), KEYS)


@query("mean_by_series", f"WITH {H} SELECT series, avg(v) AS mean FROM h GROUP BY 1")
def mean_by_series(spark, sf_dir):
    return profile.mean_by_series(hourly(spark, sf_dir), KEYS, "v")


@query("mean_of", f"WITH {D} SELECT avg(v * 2 - 1) AS mean FROM d")
def mean_of_expression(spark, sf_dir):
    return profile.mean_of(daily(spark, sf_dir), F.col("v") * 2 - 1)


@query(
    "monthly_sum",
    f"""WITH {D} SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, series, sum(v) AS total
    FROM d GROUP BY 1, 2, 3""",
)
def monthly_sum(spark, sf_dir):
    return profile.monthly_sum(daily(spark, sf_dir), KEYS, "ts", "v")


def _matrix(frame: str, part: str, slots: range) -> str:
    columns = ", ".join(f"avg(v) FILTER ({part}(ts) = {i}) AS {part[0]}{i:02d}" for i in slots)
    return f"SELECT series, {columns} FROM {frame} GROUP BY 1"


@query("hour_heatmap", f"WITH {H} {_matrix('h', 'hour', range(24))}")
def hour_heatmap(spark, sf_dir):
    return profile.hour_heatmap(hourly(spark, sf_dir), "series", "ts", "v")


@query("month_heatmap", f"WITH {D} {_matrix('d', 'month', range(1, 13))}")
def month_heatmap(spark, sf_dir):
    return profile.hour_heatmap(daily(spark, sf_dir), "series", "ts", "v", "month")


@query(
    "null_profile",
    f"""WITH {N} SELECT count(*) AS rows, count(*) FILTER (series IS NULL) AS series_nulls,
      count(*) FILTER (ts IS NULL) AS ts_nulls, count(*) FILTER (v IS NULL) AS v_nulls,
      count(*) FILTER (series IS NULL) + count(*) FILTER (ts IS NULL) + count(*) FILTER (v IS NULL) AS total_nulls,
      (count(*) FILTER (series IS NULL) + count(*) FILTER (ts IS NULL) + count(*) FILTER (v IS NULL)) * 1e2 / count(*) AS null_pct
    FROM n""",
)
def null_profile(spark, sf_dir):
    return profile.null_profile(holed(spark, sf_dir))


@query(
    "duplicate_profile",
    """WITH g AS (SELECT event_type, user_id, date_trunc('day', ts), count(*) AS n FROM events GROUP BY 1, 2, 3)
    SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
      CAST(sum(n - 1) AS BIGINT) * 1e2 / CAST(sum(n) AS BIGINT) AS duplicate_pct FROM g""",
)
def duplicate_profile(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return profile.duplicate_profile(events.select("event_type", "user_id", F.to_date("ts").alias("day")))


@query(
    "invalid_count",
    f"""WITH {H} SELECT count(*) AS rows, count(*) FILTER (v <= 5000) AS invalid,
      count(*) FILTER (v <= 5000) * 1e2 / count(*) AS invalid_pct FROM h""",
)
def invalid_count(spark, sf_dir):
    return profile.invalid_count(hourly(spark, sf_dir), "v", 5000)


@query(
    "quality_report",
    f"""WITH {N}, c AS (SELECT count(*) AS rows FROM n),
      q AS (SELECT quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM n),
      m AS (SELECT 'missing' AS measure, count(*) FILTER (v IS NULL) AS n FROM n
        UNION ALL SELECT 'invalid', count(*) FILTER (v <= 6000) FROM n
        UNION ALL SELECT 'duplicate', (SELECT count(*) FROM n) - (SELECT count(*) FROM (SELECT DISTINCT * FROM n))
        UNION ALL SELECT 'outlier', count(*) FROM n, q WHERE v < q1 - (q3 - q1) * 1.5::DOUBLE OR v > q3 + (q3 - q1) * 1.5::DOUBLE)
    SELECT measure, n, n * 1e2 / rows AS pct FROM m, c""",
)
def sanity_report(spark, sf_dir):
    return quality_report(holed(spark, sf_dir), "v", 6000)


_IQR = """SELECT {key} q1, q3, q1 - (q3 - q1) * 1.5::DOUBLE AS lower, q3 + (q3 - q1) * 1.5::DOUBLE AS upper,
  count(*) FILTER (v < q1 - (q3 - q1) * 1.5::DOUBLE OR v > q3 + (q3 - q1) * 1.5::DOUBLE) AS outliers FROM {frame} GROUP BY ALL"""


@query(
    "iqr_outliers",
    f"""WITH {H}, q AS (SELECT quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM h)
    {_IQR.format(key="", frame="h, q")}""",
)
def iqr_outliers(spark, sf_dir):
    return profile.iqr_outliers(hourly(spark, sf_dir), "v")


@query(
    "iqr_outliers_by_series",
    f"""WITH {D}, q AS (SELECT series, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM d GROUP BY 1)
    {_IQR.format(key="series,", frame="d JOIN q USING (series)")}""",
)
def iqr_outliers_by_series(spark, sf_dir):
    return profile.iqr_outliers(daily(spark, sf_dir), "v", KEYS)


@query(
    "box_stats",
    f"""WITH {H}, q AS (SELECT series, min(v) AS low, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
      quantile_cont(v, 0.75) AS q3, max(v) AS high FROM h GROUP BY 1)
    SELECT series, low, q1, median, q3, high,
      min(v) FILTER (v BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE) AS whisker_low,
      max(v) FILTER (v BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE) AS whisker_high
    FROM h JOIN q USING (series) GROUP BY ALL""",
)
def box_stats(spark, sf_dir):
    return profile.box_stats(hourly(spark, sf_dir), "v", KEYS)


@query(
    "quantiles",
    """WITH e AS (SELECT event_type AS series, CAST(round(value * 100) AS BIGINT) AS v FROM events)
    SELECT series, quantile_disc(v, 0.01) AS p01, quantile_disc(v, 0.25) AS p25, quantile_disc(v, 0.5) AS p50,
      quantile_disc(v, 0.99) AS p99 FROM e GROUP BY 1""",
)
def quantiles(spark, sf_dir):
    probs = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    return profile.quantiles(raw_events(spark, sf_dir), "v", probs, KEYS)


@query(
    "extreme_times",
    f"""WITH {H} SELECT series, arg_min(ts, (v, ts)) AS min_time, min(v) AS min_value,
      arg_min(ts, (-v, ts)) AS max_time, max(v) AS max_value FROM h GROUP BY 1""",
)
def extreme_times(spark, sf_dir):
    return profile.extreme_times(hourly(spark, sf_dir), KEYS, "ts", "v")


@query(
    "summary_stats",
    f"""WITH {N} SELECT 'v' AS "column", count(v) AS count, avg(v) AS mean, round(stddev_samp(v), 4) AS stddev,
      min(v) AS min, max(v) AS max FROM n""",
)
def summary_stats(spark, sf_dir):
    return profile.summary_stats(holed(spark, sf_dir), ["v"]).withColumn("stddev", F.round("stddev", 4))


@query(
    "minmax",
    f"WITH {H} SELECT series, min(ts) AS min_ts, max(ts) AS max_ts, min(v) AS min_v, max(v) AS max_v FROM h GROUP BY 1",
)
def minmax(spark, sf_dir):
    return profile.minmax(hourly(spark, sf_dir), ["ts", "v"], KEYS)


SUITE = [
    not_null("series"),
    not_null("v"),
    of_type("ts", "timestamp_ntz"),
    in_set("series", ["click", "error", "purchase", "view"]),
    between("v", 0),
    between("v", 6000, 90000),
    between("ts", "2024-01-02 00:00:00", "2024-01-30 00:00:00"),
    mean_between("v", 0, 50000),
    median_between("v", 20000),
    stddev_between("v", None, 10),
]


def _suite_sql() -> str:
    row = "SELECT '{0}' AS \"check\", '{1}' AS \"column\", {2} AS observed, '{3}' AS expected, {4} AS passed, {5} AS n_bad, {6} AS pct_bad FROM n"

    def rows_check(kind, column, expected, bad):
        count = f"count(*) FILTER ({bad})"
        return row.format(
            kind, column, f"CAST({count} AS DOUBLE)", expected, f"{count} = 0", count, f"{count} * 1e2 / count(*)"
        )

    def value_check(kind, column, expected, observed, passed):
        return row.format(kind, column, observed, expected, passed, "NULL::BIGINT", "NULL::DOUBLE")

    return " UNION ALL ".join(
        [
            rows_check("not_null", "series", "no nulls", "series IS NULL"),
            rows_check("not_null", "v", "no nulls", "v IS NULL"),
            value_check("of_type", "ts", "timestamp_ntz", "NULL::DOUBLE", "count(*) >= 0"),
            rows_check("in_set", "series", "click,error,purchase,view",
                       "series NOT IN (''click'', ''error'', ''purchase'', ''view'')".replace("''", "'")),
            rows_check("between", "v", "[0, ]", "v < 0"),
            rows_check("between", "v", "[6000, 90000]", "v < 6000 OR v > 90000"),
            rows_check("between", "ts", "[2024-01-02 00:00:00, 2024-01-30 00:00:00]",
                       "ts < TIMESTAMP '2024-01-02' OR ts > TIMESTAMP '2024-01-30'"),
            value_check("mean_between", "v", "[0, 50000]", "avg(v)", "avg(v) BETWEEN 0 AND 50000"),
            value_check("median_between", "v", "[20000, ]", "median(v)", "median(v) >= 20000"),
            value_check("stddev_between", "v", "[, 10]", "round(stddev_samp(v), 4)", "stddev_samp(v) <= 10"),
        ]
    )


@query("expectations", f"WITH {N} SELECT *, 'nightly' AS run_id FROM ({_suite_sql()})")
def expectations(spark, sf_dir):
    checked = run_suite(holed(spark, sf_dir), suite_from_df(suite_to_df(spark, SUITE)), "nightly")
    rounded = F.when(F.col("check") == "stddev_between", F.round("observed", 4)).otherwise(F.col("observed"))
    return checked.withColumn("observed", rounded)


@query(
    "schema_check",
    """SELECT * FROM (VALUES ('series', 'type', 'int', 'string'), ('step', 'missing', 'string', NULL), ('v', 'unexpected', NULL, 'double'))
      t("column", problem, expected, actual) WHERE (SELECT count(*) FROM events) >= 0""",
)
def schema_problems(spark, sf_dir):
    return schema_check(hourly(spark, sf_dir), {"series": "int", "ts": "timestamp_ntz", "step": "string"})
