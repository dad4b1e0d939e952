"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.functions.calendar import calendar_features, with_date_from_parts
from hourcast.functions.keys import (
    distinct_values,
    id_to_series,
    melt_category,
    one_hot,
    one_hot_decode,
    with_row_id,
)
from hourcast.operators.clean import (
    between_ts,
    cast_columns,
    drop_null,
    filter_part,
    only_series,
    with_literals,
)
from hourcast.operators.runs import with_status
from hourcast.operators.upsert import exists_rows
from hourcast.queries.frames import D, KEYS, SPLIT_DATE, daily
from hourcast.queries.landing import L, landing_text
from hourcast.queries.registry import query
from hourcast.sources.landing import union_all

# The order priorities of the given table.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FLAGS = {p: f"p{p[0]}" for p in PRIORITIES}
FLAG_SQL = ", ".join(f"CAST(series = '{p}' AS INTEGER) AS {f}" for p, f in FLAGS.items())


def flagged(spark, sf_dir):
    """The daily series with a short series name and one flag per series."""
    short = F.concat(F.lit("p"), F.left("series", F.lit(1)))
    return one_hot(daily(spark, sf_dir).withColumn("series", short), "series", list(FLAGS.values()))


@query(
    "calendar_parts",
    f"""WITH {D} SELECT series, ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
      CAST(month(ts) AS INTEGER) AS month, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(year(ts) AS INTEGER) AS year,
      CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(day(ts) AS INTEGER) AS day_of_month,
      CAST(week(ts) AS INTEGER) AS week_of_year, CAST(dayofweek(ts) + 1 AS INTEGER) AS sunday_first,
      CAST(ts AS DATE) AS rebuilt FROM d""",
)
def calendar(spark, sf_dir):
    out = with_date_from_parts(calendar_features(daily(spark, sf_dir).drop("v"), "ts"), "rebuilt")
    out = out.withColumn("sunday_first", F.dayofweek("ts"))
    return out.select(*[F.col(c).alias(c.lower()) for c in out.columns])


@query("one_hot", f"WITH {D} SELECT 'p' || series[1] AS series, ts, v, {FLAG_SQL} FROM d")
def one_hot_flags(spark, sf_dir):
    return flagged(spark, sf_dir)


@query("one_hot_decode", f"WITH {D} SELECT ts, v, 'p' || series[1] AS series FROM d")
def decoded(spark, sf_dir):
    flags = list(FLAGS.values())
    return one_hot_decode(flagged(spark, sf_dir).drop("series"), flags, "series").drop(*flags)


@query("melt_category", f"WITH {D} SELECT ts, v, 'p' || series[1] AS series FROM d")
def melted(spark, sf_dir):
    flags = list(FLAGS.values())
    return melt_category(flagged(spark, sf_dir).drop("series"), ["ts", "v"], flags, "series")


@query("distinct_values", f"WITH {D} SELECT DISTINCT series FROM d")
def distinct_series(spark, sf_dir):
    return distinct_values(daily(spark, sf_dir), "series")


@query(
    "row_id",
    f"WITH {D} SELECT series, ts, v, series || '_' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS consumption_id FROM d",
)
def row_ids(spark, sf_dir):
    return with_row_id(daily(spark, sf_dir), "series", "ts", "consumption_id")


@query(
    "id_to_series",
    f"WITH {D} SELECT series || '_' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS consumption_id, series FROM d",
)
def ids_to_series(spark, sf_dir):
    ids = with_row_id(daily(spark, sf_dir), "series", "ts", "consumption_id").select("consumption_id")
    return id_to_series(ids, "consumption_id", "series")


@query(
    "text_scalars",
    f"""WITH {L} SELECT event_id, lpad(split_part(series, 'c', 1), 8, '0') AS padded,
      concat_ws('_', series, split_part(datetime, ' - ', 2)) AS joined,
      split_part(datetime, ' ', 1) AS day, split_part(datetime, ' ', 2) AS clock,
      CASE WHEN series IN ('view', 'click') THEN 1 ELSE 0 END AS passive,
      TRY_CAST(split_part(datetime, '.', 3) AS DOUBLE) AS unreadable, CAST(v AS VARCHAR) AS v_text FROM l""",
)
def text_scalars(spark, sf_dir):
    d = F.col("datetime")
    return landing_text(spark, sf_dir).select(
        "event_id",
        F.lpad(F.split_part("series", F.lit("c"), F.lit(1)), 8, "0").alias("padded"),
        F.concat_ws("_", "series", F.split_part(d, F.lit(" - "), F.lit(2))).alias("joined"),
        F.element_at(F.split(d, " "), 1).alias("day"),
        F.element_at(F.split(d, " "), 2).alias("clock"),
        F.when(F.col("series").isin("view", "click"), 1).otherwise(0).alias("passive"),
        F.split_part(d, F.lit("."), F.lit(3)).try_cast("double").alias("unreadable"),
        F.col("v").cast("string").alias("v_text"),
    )


@query(
    "date_arith",
    f"""WITH {D} SELECT series, ts, CAST(CAST(ts AS DATE) + INTERVAL 3 MONTH AS DATE) AS later,
      CAST(CAST(ts AS DATE) - INTERVAL 1 MONTH AS DATE) AS earlier, CAST(ts AS DATE) + 1 AS tomorrow,
      CAST(ts AS DATE) - 1 AS yesterday, CAST(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS INTEGER) AS days,
      CAST(date_trunc('month', ts) AS TIMESTAMP) AS month_start, CAST(epoch(ts) AS BIGINT) AS seconds,
      strftime(ts, '%d.%m.%Y') AS text, strptime(strftime(ts, '%d.%m.%Y'), '%d.%m.%Y') AS reread FROM d""",
)
def date_arith(spark, sf_dir):
    day = F.to_date("ts")
    text = F.date_format("ts", "dd.MM.yyyy")
    return daily(spark, sf_dir).select(
        "series",
        "ts",
        F.add_months(day, 3).alias("later"),
        F.add_months(day, -1).alias("earlier"),
        F.date_add(day, 1).alias("tomorrow"),
        F.date_sub(day, 1).alias("yesterday"),
        F.datediff(day, F.lit(SPLIT_DATE).cast("date")).alias("days"),
        F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month_start"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"),
        text.alias("text"),
        F.try_to_timestamp(text, F.lit("dd.MM.yyyy")).cast("timestamp_ntz").alias("reread"),
    )


@query(
    "filter_part",
    f"WITH {D} SELECT series, ts, v FROM d WHERE year(ts) = 1996 AND month(ts) = 9 AND week(ts) = 37",
)
def calendar_filter(spark, sf_dir):
    return filter_part(daily(spark, sf_dir), "ts", year=1996, month=9, week=37)


@query(
    "select_filter_union",
    f"""WITH {D}, u AS (
      SELECT ts AS moment, v, series, 'early' AS part, NULL::DOUBLE AS score, 'x' AS extra FROM d WHERE ts < TIMESTAMP '2000-01-01'
      UNION ALL
      SELECT ts, v, series, 'late', v / 4, NULL FROM d WHERE ts >= TIMESTAMP '2000-01-01' AND series IN ('1-URGENT', '5-LOW'))
    SELECT moment, v, series, part, score, extra, CASE WHEN v <= 20000000 THEN 'Test Passed' ELSE 'Test Failed' END AS status
    FROM u WHERE score IS NOT NULL OR part = 'early'""",
)
def select_filter_union(spark, sf_dir):
    days = daily(spark, sf_dir)
    nothing = F.lit(None).cast("double")
    early = between_ts(days, "ts", "1900-01-01", SPLIT_DATE)
    early = with_literals(early, {"part": "early", "score": nothing, "extra": "x"})
    late = only_series(between_ts(days, "ts", SPLIT_DATE, "2100-01-01"), "series", ["1-URGENT", "5-LOW"])
    late = with_literals(late, {"part": "late"}).withColumn("score", F.col("v") / 4)
    both = union_all([early, drop_null(late, ["score"])], allow_missing=True)
    return with_status(both.withColumnRenamed("ts", "moment"), "v", 20000000)


@query(
    "cast_columns",
    f"WITH {D} SELECT series, CAST(ts AS DATE) AS ts, CAST(v AS BIGINT) AS v FROM d",
)
def casts(spark, sf_dir):
    return cast_columns(daily(spark, sf_dir), {"ts": "date", "v": "bigint"})


@query(
    "exists_rows",
    f"""WITH {D} SELECT series, ts, v FROM d WHERE EXISTS (SELECT 1 FROM d e WHERE e.series = d.series
      AND e.ts = d.ts + INTERVAL 1 DAY)""",
)
def rows_with_next_day(spark, sf_dir):
    days = daily(spark, sf_dir)
    before = days.withColumn("ts", F.col("ts") - F.expr("interval 1 day"))
    return exists_rows(days, before, [*KEYS, "ts"])


@query("ordered_top", f"WITH {D} SELECT series, ts, v FROM d ORDER BY v DESC, series, ts LIMIT 10")
def ordered_top(spark, sf_dir):
    return daily(spark, sf_dir).orderBy(F.desc("v"), "series", "ts").limit(10)
