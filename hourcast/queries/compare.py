"""Forecast errors, runs and model versions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from hourcast.functions.keys import with_row_id
from hourcast.operators import monitor, runs as run_tables
from hourcast.operators.profile import count_by_series
from hourcast.operators.sampling import latest
from hourcast.operators.training import score_to_predictions
from hourcast.queries.frames import (
    H,
    KEYS,
    P,
    R,
    SPLIT_DATE,
    V,
    daily,
    hourly,
    predictions,
    runs,
    versions,
)
from hourcast.queries.registry import query

SMAPE = "avg(abs({p} - v) / nullif((abs({p}) + abs(v)) / 2, 0) * 100)"


def rounded(df, digits=6):
    """Computed ratios rounded, so that the last bits of a sum do not matter."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def with_residual(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("residual", F.col("a") - F.col("v"))


@query(
    "reconcile",
    f"""WITH {P}, k AS (SELECT * FROM d WHERE ts >= TIMESTAMP '1999-01-01')
    SELECT p.series, p.ts, p.a AS predicted, k.v AS actual, round(p.a - k.v, 6) AS residual
    FROM p LEFT JOIN k ON k.series = p.series AND k.ts = p.ts""",
)
def reconciled(spark, sf_dir):
    empty = F.lit(None).cast("double")
    open_rows = predictions(spark, sf_dir).select(
        "series", "ts", F.col("a").alias("predicted"), empty.alias("actual"), empty.alias("residual")
    )
    known = daily(spark, sf_dir).filter(F.col("ts") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    out = monitor.reconcile(open_rows, known, [*KEYS, "ts"], "v", "predicted", "actual", "residual")
    return out.withColumn("residual", F.round("residual", 6))


@query(
    "pct_errors",
    f"""WITH {P} SELECT series, ts, round((a - v) / nullif(abs(v), 0) * 100, 6) AS pct_error,
      round(abs((a - v) / nullif(abs(v), 0) * 100), 6) AS abs_pct_error FROM p""",
)
def pct_errors(spark, sf_dir):
    out = monitor.with_pct_error(with_residual(spark, sf_dir), "residual", "v")
    return rounded(out.select("series", "ts", "pct_error", "abs_pct_error"))


@query(
    "bias_mape",
    f"""WITH {P} SELECT series, round(avg((a - v) / nullif(abs(v), 0) * 100), 6) AS bias_pct,
      round(avg(abs((a - v) / nullif(abs(v), 0) * 100)), 6) AS mape FROM p GROUP BY 1""",
)
def bias_mape(spark, sf_dir):
    return rounded(monitor.bias_mape(with_residual(spark, sf_dir), "residual", "v", KEYS))


METRICS = """round(avg((v - a) * (v - a)), 6) AS mse, round(sqrt(avg((v - a) * (v - a))), 6) AS rmse,
  round(avg(abs(v - a)), 6) AS mae, round(1 - sum((v - a) * (v - a)) / (var_pop(v) * count(v)), 6) AS r2"""


@query("regression_metrics", f"WITH {P} SELECT count(*) AS n, {METRICS} FROM p")
def regression_metrics(spark, sf_dir):
    return rounded(monitor.regression_metrics(predictions(spark, sf_dir), "v", "a"))


@query("regression_metrics_by_series", f"WITH {P} SELECT series, count(*) AS n, {METRICS} FROM p GROUP BY 1")
def regression_metrics_by_series(spark, sf_dir):
    return rounded(monitor.regression_metrics(predictions(spark, sf_dir), "v", "a", KEYS))


@query("label_vs_prediction", f"WITH {P} SELECT v, a FROM p")
def labels_and_predictions(spark, sf_dir):
    return monitor.label_vs_prediction(predictions(spark, sf_dir), "v", "a")


@query("smape", f"WITH {P} SELECT series, round({SMAPE.format(p='a')}, 6) AS smape FROM p GROUP BY 1")
def smape(spark, sf_dir):
    return rounded(monitor.smape(predictions(spark, sf_dir), "a", "v", KEYS))


@query(
    "feedback_insert",
    f"""WITH {P}, k AS (SELECT series, ts, v FROM d WHERE ts < TIMESTAMP '2000-01-01'),
      q AS (SELECT series, ts, a * 100000 AS v FROM p)
    SELECT series, ts, round(v, 2) AS v, 'actual' AS origin FROM k
    UNION ALL SELECT series, ts, round(v, 2), 'predicted' FROM q ANTI JOIN k USING (series, ts)""",
)
def feedback_insert(spark, sf_dir):
    known = daily(spark, sf_dir).filter(F.col("ts") < F.lit(SPLIT_DATE).cast("timestamp_ntz"))
    guesses = predictions(spark, sf_dir).withColumn("a", F.col("a") * 100000)
    out = monitor.feedback(known, guesses, [*KEYS, "ts"], "v", "a", "origin")
    return out.withColumn("v", F.round("v", 2))


@query(
    "best_run_per_day",
    f"""WITH {R} SELECT run_date, mae, start_time, run_id, experiment FROM (SELECT *, CAST(start_time AS DATE) AS run_date,
      row_number() OVER (PARTITION BY CAST(start_time AS DATE) ORDER BY mae, start_time, run_id) AS k FROM r) WHERE k = 1""",
)
def best_run_per_day(spark, sf_dir):
    return run_tables.best_run_per_day(runs(spark, sf_dir), "mae")


@query(
    "best_per_group",
    f"""WITH {R} SELECT experiment, mae, run_id, start_time FROM (SELECT *,
      row_number() OVER (PARTITION BY experiment ORDER BY mae, run_id) AS k FROM r) WHERE k = 1""",
)
def best_per_group(spark, sf_dir):
    return run_tables.best_per_group(runs(spark, sf_dir), ["experiment"], "mae", ["run_id"])


@query(
    "runs_per_day",
    f"""WITH {R} SELECT strftime(start_time, '%Y-%m-%d') AS run_date, count(*) AS n_runs FROM r
    WHERE start_time >= DATE '2024-02-10' - INTERVAL 30 DAY GROUP BY 1""",
)
def runs_per_day(spark, sf_dir):
    return run_tables.runs_per_day(runs(spark, sf_dir), "2024-02-10")


@query(
    "latest_run",
    f"""WITH {R} SELECT run_id, start_time, experiment, mae FROM (SELECT *,
      row_number() OVER (PARTITION BY experiment ORDER BY start_time DESC, run_id DESC) AS k FROM r) WHERE k = 1""",
)
def latest_run(spark, sf_dir):
    return run_tables.latest_run(runs(spark, sf_dir), ["experiment"])


def run_table(spark, sf_dir):
    """Events as rows of the runs table, the metrics in a map."""
    return runs(spark, sf_dir).select(
        "run_id", "start_time", "experiment", F.create_map(F.lit("MAE"), "mae", F.lit("R2"), F.lit(1.0) - F.col("mae") / 1000).alias("metrics")
    )


@query(
    "run_table_best_per_day",
    f"""WITH {R} SELECT run_date, run_id, start_time, experiment, mae FROM (SELECT *, CAST(start_time AS DATE) AS run_date,
      row_number() OVER (PARTITION BY CAST(start_time AS DATE) ORDER BY mae, start_time, run_id) AS k FROM r) WHERE k = 1""",
)
def run_table_best_per_day(spark, sf_dir):
    best = run_tables.best_run_per_day(run_table(spark, sf_dir), "metrics['MAE']")
    return best.withColumn("mae", F.col("metrics")["MAE"]).drop("metrics")


@query(
    "run_table_latest",
    f"""WITH {R} SELECT run_id, start_time, experiment, mae FROM (SELECT *,
      row_number() OVER (PARTITION BY experiment ORDER BY start_time DESC, run_id DESC) AS k FROM r) WHERE k = 1""",
)
def run_table_latest(spark, sf_dir):
    newest = run_tables.latest_run(run_table(spark, sf_dir), ["experiment"])
    return newest.withColumn("mae", F.col("metrics")["MAE"]).drop("metrics")


@query(
    "run_table_gate",
    f"""WITH {R}, l AS (SELECT run_id, 'MAE' AS metric, mae AS value, 200.0::DOUBLE AS threshold, mae <= 200 AS passed FROM r
        UNION ALL SELECT run_id, 'R2', 1.0::DOUBLE - mae / 1000, 0.9::DOUBLE, 1.0::DOUBLE - mae / 1000 >= 0.9 FROM r)
    SELECT run_id, metric, value, threshold, passed, bool_and(passed) OVER (PARTITION BY run_id) AS all_passed,
      CASE WHEN passed THEN 'Test Passed' ELSE 'Test Failed' END AS status FROM l""",
)
def run_table_gate(spark, sf_dir):
    measured = run_tables.run_metrics(run_table(spark, sf_dir), ["MAE", "R2"])
    return run_tables.gate(measured, {"MAE": 200.0, "R2": 0.9}, ["run_id"])


LIMITS = {"MSE": 1_000_000.0, "MAE": 200.0, "RMSE": 400.0, "R2": 0.9}


@query(
    "metric_gate",
    f"""WITH {P}, m AS (SELECT series, {METRICS} FROM p GROUP BY 1),
      l AS (SELECT series, 'MSE' AS metric, mse AS value, 1000000.0::DOUBLE AS threshold, mse <= 1000000 AS passed FROM m
        UNION ALL SELECT series, 'MAE', mae, 200, mae <= 200 FROM m
        UNION ALL SELECT series, 'RMSE', rmse, 400, rmse <= 400 FROM m
        UNION ALL SELECT series, 'R2', r2, 0.9::DOUBLE, r2 >= 0.9 FROM m)
    SELECT series, metric, value, threshold, passed, bool_and(passed) OVER (PARTITION BY series) AS all_passed,
      CASE WHEN passed THEN 'Test Passed' ELSE 'Test Failed' END AS status FROM l""",
)
def metric_gate(spark, sf_dir):
    measured = rounded(monitor.regression_metrics(predictions(spark, sf_dir), "v", "a", KEYS))
    return run_tables.gate(measured, LIMITS, KEYS)


@query(
    "latest_per_stage",
    f"WITH {V} SELECT name, current_stage, max(version) AS version FROM ver GROUP BY 1, 2",
)
def latest_per_stage(spark, sf_dir):
    return run_tables.latest_per_stage(versions(spark, sf_dir))


@query(
    "latest_version",
    f"""WITH {V} SELECT name, version, current_stage, creation_timestamp FROM (SELECT *,
      row_number() OVER (PARTITION BY name ORDER BY creation_timestamp DESC, version DESC) AS k FROM ver) WHERE k = 1""",
)
def latest_version(spark, sf_dir):
    return latest(versions(spark, sf_dir), "creation_timestamp", ["name"], ["version"])


@query(
    "stage_transition",
    f"""WITH {V}, k AS (SELECT * FROM ver WHERE NOT (name = '5-LOW' AND current_stage = 'Staging')),
      c AS (SELECT name, max(version) AS chosen FROM k WHERE current_stage = 'Staging' GROUP BY 1)
    SELECT name, version, creation_timestamp, CASE WHEN version = chosen THEN 'Production'
      WHEN current_stage = 'Production' AND chosen IS NOT NULL THEN 'Archived' ELSE current_stage END AS current_stage
    FROM k LEFT JOIN c USING (name)""",
)
def stage_transition(spark, sf_dir):
    """The newest staged version of each model goes to production; a model without one keeps what it has."""
    staged_low = (F.col("name") == "5-LOW") & (F.col("current_stage") == "Staging")
    all_versions = versions(spark, sf_dir).filter(~staged_low)
    newest = run_tables.latest_per_stage(all_versions).filter(F.col("current_stage") == "Staging")
    chosen = newest.select("name", F.col("version").alias("chosen"))
    marked = all_versions.join(chosen, "name", "left")
    return run_tables.transition(marked, F.col("version") == F.col("chosen"), "Production", True).drop("chosen")


@query(
    "champion",
    f"""WITH {P}, s AS (SELECT series, {SMAPE.format(p='b')} AS staging_smape, {SMAPE.format(p='a')} AS production_smape
      FROM p WHERE b IS NOT NULL GROUP BY 1)
    SELECT series, round(staging_smape, 6) AS staging_smape, round(production_smape, 6) AS production_smape,
      CASE WHEN staging_smape < production_smape THEN 'Staging' ELSE 'Production' END AS champion FROM s""",
)
def champion(spark, sf_dir):
    both = predictions(spark, sf_dir).filter(F.col("b").isNotNull())
    return rounded(run_tables.choose_champion(both, "v", "b", "a", KEYS))


@query(
    "next_version",
    f"""WITH {V} SELECT '1-URGENT' AS name, CAST(coalesce(max(version), 0) + 1 AS INTEGER) AS version, 'None' AS current_stage,
      TIMESTAMP '2024-01-01' AS creation_timestamp, '/models/next' AS path FROM ver WHERE name = '1-URGENT'""",
)
def next_version(spark, sf_dir):
    return run_tables.next_version(versions(spark, sf_dir), "1-URGENT", "/models/next", datetime(2024, 1, 1))


@query(
    "prediction_rows",
    f"""WITH {P} SELECT ts, series, a AS predicted_consumption, NULL::DOUBLE AS actual_consumption,
      NULL::DOUBLE AS residual, 'models:/previous_row/1' AS model_used FROM p""",
)
def prediction_rows(spark, sf_dir):
    scored = with_row_id(predictions(spark, sf_dir), "series", "ts", "id").withColumnRenamed("a", "prediction")
    out = score_to_predictions(scored, "ts", "models:/previous_row/1", "id", "series")
    return out.toDF(*[c.lower() for c in out.columns])


@query("one_day", f"WITH {H} SELECT series, ts, v FROM h WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def one_day(spark, sf_dir):
    return monitor.one_day(hourly(spark, sf_dir), "ts", "2024-01-15")


@query("runs_by_experiment", f"WITH {R} SELECT experiment, count(*) AS n FROM r GROUP BY 1")
def runs_by_experiment(spark, sf_dir):
    return count_by_series(runs(spark, sf_dir), ["experiment"])
