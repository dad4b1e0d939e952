"""Landing text and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.functions.calendar import parse_interval
from hourcast.operators.clean import dedupe, drop_incomplete, invalid_rows, nullify_invalid
from hourcast.operators.windows import bfill, ffill, lags, windowed
from hourcast.queries.frames import CHUNK, H, KEYS, N, hourly, holed, raw_events
from hourcast.queries.registry import query
from hourcast.sources.landing import clean_landing

# Events as landing text ``dd.MM.yyyy HH:mm - dd.MM.yyyy HH:mm``.
L = """l AS (SELECT event_id, event_type AS series, strftime(ts, '%d.%m.%Y %H:%M') || ' - ' ||
  strftime(ts + INTERVAL 1 HOUR, '%d.%m.%Y %H:%M') AS datetime, CAST(round(value * 100) AS BIGINT) AS v FROM events)"""


def landing_text(spark, sf_dir):
    pattern = "dd.MM.yyyy HH:mm"
    until = F.col("ts") + F.expr("interval 1 hour")
    text = F.concat_ws(" - ", F.date_format("ts", pattern), F.date_format(until, pattern))
    return raw_events(spark, sf_dir).select("event_id", "series", text.alias("datetime"), "v")


@query("hourly_sum", f"WITH {H} SELECT series, ts, v FROM h")
def hourly_sum(spark, sf_dir):
    return hourly(spark, sf_dir)


@query(
    "hourly_clean",
    f"""WITH {N}, f AS (SELECT series, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM n)
    SELECT series, ts, v, lag(v, 24) OVER w AS lag_24,
      CASE WHEN count(v) OVER m >= 24 THEN avg(v) OVER m END AS mean_24
    FROM f WINDOW w AS (PARTITION BY series ORDER BY ts),
      m AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
)
def hourly_clean(spark, sf_dir):
    valid = nullify_invalid(hourly(spark, sf_dir), "v", 5000)
    clean = ffill(valid, KEYS, "ts", "v", chunk_rows=CHUNK, keep_chunk=True)
    return windowed(
        clean, KEYS, "ts", "v", {"lag_24": 24}, {"mean_24": (24, "avg", 24)}, chunk_rows=CHUNK
    )


@query(
    "landing_parse",
    f"""WITH {L} SELECT event_id, series, datetime, v,
      strptime(split_part(datetime, ' - ', 1), '%d.%m.%Y %H:%M') AS ts FROM l""",
)
def landing_parse(spark, sf_dir):
    start = parse_interval("datetime").cast("timestamp_ntz")
    return landing_text(spark, sf_dir).withColumn("ts", start)


@query(
    "landing_clean",
    f"""WITH {L}, u AS (SELECT series, strptime(split_part(datetime, ' - ', 1), '%d.%m.%Y %H:%M') AS ts,
      max(CASE WHEN v > 0 THEN v END) AS v FROM l GROUP BY 1, 2)
    SELECT series, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM u""",
)
def landing_clean(spark, sf_dir):
    return clean_landing(landing_text(spark, sf_dir), value="v", step="minute")


@query(
    "dedupe_prefer",
    """SELECT series, ts, event_id, v FROM (SELECT event_type AS series,
      CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, event_id, CAST(round(value * 100) AS BIGINT) AS v,
      row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY value DESC, event_id DESC) AS k
      FROM events) WHERE k = 1""",
)
def dedupe_prefer(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    rows = raw_events(spark, sf_dir).withColumn("ts", hour)
    return dedupe(rows, ["series", "ts"], ["v", "event_id"])


@query(
    "nullify_ffill",
    f"""WITH {N} SELECT series, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM n""",
)
def nullify_ffill(spark, sf_dir):
    return ffill(nullify_invalid(hourly(spark, sf_dir), "v", 5000), KEYS, "ts", "v", chunk_rows=CHUNK)


@query(
    "nullify_bfill",
    f"""WITH {N} SELECT series, ts, first_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM n""",
)
def nullify_bfill(spark, sf_dir):
    return bfill(holed(spark, sf_dir), KEYS, "ts", "v", chunk_rows=CHUNK)


@query("drop_incomplete", f"WITH {N} SELECT series, ts, v FROM n WHERE v IS NOT NULL")
def drop_incomplete_rows(spark, sf_dir):
    return drop_incomplete(holed(spark, sf_dir), ["v"])


@query("invalid_rows", f"WITH {H} SELECT series, ts, v FROM h WHERE v <= 5000")
def invalid(spark, sf_dir):
    return invalid_rows(hourly(spark, sf_dir), "v", 5000)


@query(
    "lags_after_fill",
    f"""WITH {N}, f AS (SELECT series, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM n)
    SELECT series, ts, v, lag(v, 1) OVER w AS lag_1, lag(v, 24) OVER w AS lag_24 FROM f
    WINDOW w AS (PARTITION BY series ORDER BY ts)""",
)
def lags_after_fill(spark, sf_dir):
    filled = ffill(holed(spark, sf_dir), KEYS, "ts", "v", chunk_rows=CHUNK, keep_chunk=True)
    return lags(filled, KEYS, "ts", "v", {"lag_1": 1, "lag_24": 24}, chunk_rows=CHUNK)
