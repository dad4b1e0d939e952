"""Tables of experiment runs and model versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourcast.operators.monitor import smape_of
from hourcast.operators.sampling import latest

RUNS_SCHEMA = (
    "run_id string, experiment string, start_time timestamp_ntz, params map<string,string>, "
    "tags map<string,string>, metrics map<string,double>"
)
VERSIONS_SCHEMA = (
    "name string, version int, current_stage string, creation_timestamp timestamp_ntz, path string"
)

# Acceptance limits of the gate and the metrics where more is better.
THRESHOLDS = {
    "MSE": 1_000_000_000.0,
    "MAE": 30_000.0,
    "RMSE": 40_000.0,
    "R2": 0.9,
    "Training Time(sec)": 3_600.0,
}
HIGHER_IS_BETTER = ("R2",)


def run_row(
    spark: SparkSession,
    run_id: str,
    experiment: str,
    start_time: datetime,
    params: Mapping[str, object],
    tags: Mapping[str, str],
    metrics: Mapping[str, float],
) -> DataFrame:
    """One run as a row to append to the runs table."""
    texts = {k: str(v) for k, v in params.items()}
    numbers = {k: None if v is None else float(v) for k, v in metrics.items()}
    return spark.createDataFrame(
        [(run_id, experiment, start_time, texts, dict(tags), numbers)], RUNS_SCHEMA
    )


def best_per_group(
    df: DataFrame, by: Sequence[str | Column], metric: str, ties: Sequence[str] = ()
) -> DataFrame:
    """The row with the smallest known metric per group, as a map-side combined aggregate.

    ``metric`` is a column or an expression such as ``metrics['MAE']``; ``ties`` decide between equal metrics.
    Only these are compared, so other columns may be of any type.
    """
    named = [F.col(b) if isinstance(b, str) else b for b in by]
    rest = [c for c in df.columns if c not in [b for b in by if isinstance(b, str)]]
    best = F.min_by(F.struct(*rest), F.struct(F.expr(metric).alias("_metric"), *ties)).alias("_best")
    out = df.filter(F.expr(metric).isNotNull()).groupBy(*named).agg(best)
    return out.select(*[c for c in out.columns if c != "_best"], "_best.*")


def best_run_per_day(
    runs: DataFrame, metric: str, ts: str = "start_time", run_id: str = "run_id"
) -> DataFrame:
    """Per calendar day the run with the lowest metric; earlier start, then run id, break ties."""
    return best_per_group(runs, [F.to_date(ts).alias("run_date")], metric, [ts, run_id])


def runs_per_day(runs: DataFrame, today: date | str, days: int = 30, ts: str = "start_time") -> DataFrame:
    """Number of runs per day since ``days`` before ``today``."""
    start = F.date_sub(F.lit(today).cast("date"), days).cast(runs.schema[ts].dataType)
    return (
        runs.filter(F.col(ts) >= start)
        .groupBy(F.date_format(ts, "yyyy-MM-dd").alias("run_date"))
        .agg(F.count(F.lit(1)).alias("n_runs"))
    )


def latest_run(
    runs: DataFrame, by: Sequence[str] = (), ts: str = "start_time", run_id: str = "run_id"
) -> DataFrame:
    return latest(runs, ts, by, [run_id])


def run_metrics(runs: DataFrame, names: Sequence[str], by: Sequence[str] = ("run_id",)) -> DataFrame:
    """The named entries of the metrics map as columns, the layout that ``gate`` reads."""
    return runs.select(*by, *[F.col("metrics")[n].alias(n) for n in names])


def gate(metrics: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    """One row per metric with limit and status; ``all_passed`` repeats the overall verdict.

    ``metrics`` has one column per metric.  A limit is met at equality; a missing
    metric fails.
    """
    def test(name: str, limit: float) -> Column:
        value = F.col(f"`{name}`").cast("double")
        passed = value >= limit if name in HIGHER_IS_BETTER else value <= limit
        return F.struct(
            F.lit(name).alias("metric"),
            value.alias("value"),
            F.lit(float(limit)).alias("threshold"),
            F.coalesce(passed, F.lit(False)).alias("passed"),
        )

    tests = F.array(*[test(n, t) for n, t in thresholds.items()])
    checked = metrics.select(*by, tests.alias("_tests"))
    return checked.select(
        *by, F.forall("_tests", lambda t: t["passed"]).alias("all_passed"), F.inline("_tests")
    ).withColumn("status", F.when(F.col("passed"), "Test Passed").otherwise("Test Failed"))


def with_status(df: DataFrame, value: str, limit: float, higher_is_better: bool = False) -> DataFrame:
    met = F.col(value) >= limit if higher_is_better else F.col(value) <= limit
    return df.withColumn("status", F.when(met, "Test Passed").otherwise("Test Failed"))


def next_version(versions: DataFrame, name: str, path: str, created: datetime, stage: str = "None") -> DataFrame:
    """The row that registers the next version of a model."""
    number = versions.filter(F.col("name") == name).agg(
        (F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("version")
    )
    return number.select(
        F.lit(name).alias("name"),
        "version",
        F.lit(stage).alias("current_stage"),
        F.lit(created).cast("timestamp_ntz").alias("creation_timestamp"),
        F.lit(path).alias("path"),
    )


def latest_per_stage(versions: DataFrame, by: Sequence[str] = ("name", "current_stage")) -> DataFrame:
    """Highest version per model and stage."""
    return versions.groupBy(*by).agg(F.max("version").alias("version"))


def transition(
    versions: DataFrame, chosen: Column, stage: str, archive_existing: bool = False, model: str = "name"
) -> DataFrame:
    """Move the chosen rows to a stage; optionally archive the rows of the same models that held it."""
    current = F.col("current_stage")
    moved = F.when(chosen, F.lit(stage))
    if not archive_existing:
        return versions.withColumn("current_stage", moved.otherwise(current))
    models = versions.filter(chosen).select(F.col(model).alias("_moved")).distinct()
    marked = versions.join(models, F.col(model).eqNullSafe(F.col("_moved")), "left").withColumn("_own", F.col("_moved").isNotNull())
    moved = moved.when(F.col("_own") & (current == stage), F.lit("Archived"))
    return marked.withColumn("current_stage", moved.otherwise(current)).drop("_moved", "_own")


def choose_champion(
    scores: DataFrame, label: str, staging: str, production: str, by: Sequence[str] = ()
) -> DataFrame:
    """SMAPE of both models in one pass; staging wins only if strictly lower."""
    both = scores.groupBy(*by).agg(
        smape_of(staging, label).alias("staging_smape"),
        smape_of(production, label).alias("production_smape"),
    )
    wins = F.col("staging_smape") < F.col("production_smape")
    return both.withColumn("champion", F.when(wins, "Staging").otherwise("Production"))
