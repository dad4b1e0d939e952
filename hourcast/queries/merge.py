"""Upserts and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourcast.functions.keys import with_row_id
from hourcast.operators.lookup import join_actuals, join_scores, lookup_asof, lookup_equal
from hourcast.operators.upsert import insert_if_absent, source_col, upsert
from hourcast.queries.frames import D, H, KEYS, P, SPLIT_DATE, daily, hourly, predictions, raw_events
from hourcast.queries.registry import query

KEY = [*KEYS, "ts"]
# The daily series in two parts that overlap in 1999; the later one has doubled values.
U = D + """, t AS (SELECT * FROM d WHERE ts < TIMESTAMP '2000-01-01'),
  s AS (SELECT series, ts, v * 2 AS v FROM d WHERE ts >= TIMESTAMP '1999-01-01')"""


def halves(spark, sf_dir):
    days = daily(spark, sf_dir)
    late = days.filter(F.col("ts") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    early = days.filter(F.col("ts") < F.lit(SPLIT_DATE).cast("timestamp_ntz"))
    return early, late.withColumn("v", F.col("v") * 2)


@query(
    "upsert_all",
    f"WITH {U} SELECT * FROM t ANTI JOIN s USING (series, ts) UNION ALL SELECT * FROM s",
)
def upsert_all(spark, sf_dir):
    target, source = halves(spark, sf_dir)
    return upsert(target, source, KEY)


@query(
    "upsert_columns",
    f"""WITH {U} SELECT coalesce(t.series, s.series) AS series, coalesce(t.ts, s.ts) AS ts,
      CASE WHEN s.ts IS NOT NULL THEN s.v ELSE t.v END AS v, CASE WHEN t.ts IS NOT NULL THEN 'target' END AS tag
    FROM t FULL JOIN s ON t.series = s.series AND t.ts = s.ts""",
)
def upsert_columns(spark, sf_dir):
    target, source = halves(spark, sf_dir)
    return upsert(target.withColumn("tag", F.lit("target")), source, KEY)


@query(
    "upsert_update_expr",
    f"""WITH {U} SELECT t.series, t.ts, t.v, s.v AS actual, t.v - s.v AS residual
    FROM t LEFT JOIN s ON s.series = t.series AND s.ts = t.ts""",
)
def upsert_update_expr(spark, sf_dir):
    target, source = halves(spark, sf_dir)
    empty = F.lit(None).cast("double")
    target = target.withColumns({"actual": empty, "residual": empty})
    changes = {"actual": source_col("v"), "residual": F.col("v") - source_col("v")}
    return upsert(target, source, KEY, changes, insert=False)


@query(
    "upsert_insert_only",
    f"WITH {U} SELECT * FROM t UNION ALL SELECT * FROM s ANTI JOIN t USING (series, ts)",
)
def upsert_insert_only(spark, sf_dir):
    target, source = halves(spark, sf_dir)
    return upsert(target, source, KEY, update=None)


@query(
    "insert_if_absent",
    f"""WITH {D}, g AS (SELECT DISTINCT CAST(ts AS DATE) AS execution_date FROM d WHERE ts < TIMESTAMP '2000-01-01'),
      x AS (SELECT CAST(max(ts) AS DATE) AS execution_date FROM d)
    SELECT * FROM g UNION ALL SELECT * FROM x ANTI JOIN g USING (execution_date)""",
)
def run_log(spark, sf_dir):
    days = daily(spark, sf_dir)
    early = days.filter(F.col("ts") < F.lit(SPLIT_DATE).cast("timestamp_ntz"))
    log = early.select(F.to_date("ts").alias("execution_date")).distinct()
    new = days.agg(F.to_date(F.max("ts")).alias("execution_date"))
    return insert_if_absent(log, new, ["execution_date"])


@query(
    "asof_lookup",
    f"""WITH {H} SELECT e.event_id, e.event_type AS series, e.ts, h.v AS hour_sum
    FROM events e ASOF LEFT JOIN (SELECT series, ts + INTERVAL 1 HOUR AS ts, v FROM h) h
      ON e.event_type = h.series AND e.ts >= h.ts""",
)
def asof_lookup(spark, sf_dir):
    closed = hourly(spark, sf_dir).select(
        "series", (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), F.col("v").alias("hour_sum")
    )
    labels = raw_events(spark, sf_dir).drop("v")
    return lookup_asof(labels, closed, KEYS, "ts")


@query(
    "equi_lookup",
    f"""WITH {D} SELECT a.series || '_' || strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS consumption_id, a.v, b.v AS last_week
    FROM d a LEFT JOIN d b ON b.series = a.series AND b.ts = a.ts - INTERVAL 7 DAY""",
)
def equi_lookup(spark, sf_dir):
    days = daily(spark, sf_dir)
    labels = with_row_id(days, "series", "ts", "consumption_id").select("consumption_id", "ts", "v")
    shifted = days.withColumn("ts", F.col("ts") + F.expr("interval 7 days"))
    features = with_row_id(shifted, "series", "ts", "consumption_id").select(
        "consumption_id", "ts", F.col("v").alias("last_week")
    )
    return lookup_equal(labels, features, ["consumption_id"], exclude=["ts"])


@query("model_join", f"WITH {P} SELECT series, ts, v, a, b FROM p WHERE b IS NOT NULL")
def model_join(spark, sf_dir):
    scored = with_row_id(predictions(spark, sf_dir), "series", "ts", "id")
    second = scored.filter(F.col("b").isNotNull()).select("id", "b")
    return join_scores(scored.drop("b"), second, "id", "b").drop("id")


@query(
    "join_actuals",
    f"""WITH {D} SELECT a.series, a.ts, a.v AS predicted, b.v FROM d a JOIN d b ON a.series = b.series
      AND b.ts = a.ts + INTERVAL 1 DAY""",
)
def text_key_join(spark, sf_dir):
    days = daily(spark, sf_dir)
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    forecast = days.select("series", text, F.col("v").alias("predicted"))
    actual = days.withColumn("ts", F.col("ts") - F.expr("interval 1 day"))
    return join_actuals(forecast, actual, KEYS, "ts")
