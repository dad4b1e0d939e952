"""The three jobs: train, forecast a day, retrain and promote.

Each is a plain function over tables below one folder.  Dates are arguments;
only scalars (dates, metrics, version numbers) and fitted models reach the driver.

A job that died can be started again with the same arguments: every write is one
commit (see ``sources.manifests``), merges renew the same rows, and rows that a
run adds to a table are a step named by its id, which the table takes once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hourcast.functions.calendar import parse_interval
from hourcast.functions.keys import id_to_series
from hourcast.functions.steps import step_seconds, truncate
from hourcast.operators import runs as run_tables
from hourcast.operators.drift import chi2_drift, drift_groups, ks_drift
from hourcast.operators.lookup import join_scores, score
from hourcast.operators.monitor import bias_mape, one_day, reconcile, regression_metrics
from hourcast.operators.quality import Check, row_result, run_suite
from hourcast.operators.resample import resample
from hourcast.operators.training import (
    ASSEMBLED,
    Bounds,
    Fit,
    RegressorConfig,
    feature_importance,
    labels_of,
    load_model,
    make_pipeline,
    save_pipeline,
    score_to_predictions,
    shift_split,
    time_folds,
    time_split,
    timed_fit,
    training_set,
    tune,
    tuning_report,
)
from hourcast.plans.features import FeatureConfig, build_features, build_future_features, feature_columns
from hourcast.sources.landing import clean_landing, unreadable_rows
from hourcast.sources.tables import (
    append,
    append_if_absent,
    exists,
    load,
    merge_into,
    months_between,
    replace_table,
    save,
    settled,
    with_month,
    write_months,
)

# Column names of the series and prediction tables.
KEY, TS, VALUE = "COUNTRY", "DATETIME", "HOURLY_CONSUMPTION_MW"
PREDICTED, ACTUAL, RESIDUAL, MODEL = "PREDICTED_CONSUMPTION", "ACTUAL_CONSUMPTION", "RESIDUAL", "MODEL_USED"
MONTH = "month_key"


@dataclass(frozen=True)
class Project:
    """Where the tables live and what is built.

    ``stop_early`` holds back the last tenth of the training range and stops boosting when it no longer gains there;
    ``grid`` maps parameters of the regressor to values tried on contiguous time folds before the fit.
    """

    root: str
    features: FeatureConfig
    name: str = "load_forecast"
    regressor: RegressorConfig = field(default_factory=RegressorConfig)
    thresholds: Mapping[str, float] = field(default_factory=lambda: dict(run_tables.THRESHOLDS))
    resample_agg: str = "sum"
    stop_early: bool = False
    grid: Mapping[str, Sequence] | None = None

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    @property
    def reach(self) -> timedelta:
        """How far back features look, and one step more."""
        return timedelta(seconds=step_seconds(self.features.step) * (self.features.reach + 1))


def _day(value) -> date:
    return date.fromisoformat(str(value)[:10])


def _months(spark: SparkSession, project: Project, table: str, start, end) -> DataFrame:
    """The months of a table that a range of days touches."""
    return months_between(load(spark, project.path(table)), _day(start), _day(end))


def _actuals(history: DataFrame) -> DataFrame:
    """Training never sees predictions that were fed back as history."""
    return history.filter(F.col("ORIGIN") == "actual").drop("ORIGIN")


def _sets(spark: SparkSession, project: Project, bounds: Bounds) -> dict[str, DataFrame]:
    """Training set per range: labels joined to the stored features by row id."""
    key = project.features.id_column
    sets = {}
    for part, (start, end) in bounds.items():
        rows = time_split(_actuals(_months(spark, project, "history", start, end)), TS, {part: (start, end)})[part]
        features = _months(spark, project, "features", start, end).drop(KEY)
        sets[part] = training_set(labels_of(rows, KEY, TS, VALUE, key), features, [key])
    return sets


def _inputs(project: Project, df: DataFrame) -> list[str]:
    return feature_columns(df, VALUE, [project.features.id_column, TS])


def _evaluate(fit: Fit, test: DataFrame) -> DataFrame:
    metrics = regression_metrics(fit.model.transform(test), VALUE, "prediction")
    return metrics.select(
        F.col("mse").alias("MSE"),
        F.col("mae").alias("MAE"),
        F.col("rmse").alias("RMSE"),
        F.col("r2").alias("R2"),
        F.lit(fit.seconds).alias("Training Time(sec)"),
        F.col("n").alias("rows"),
    )


def _fit_and_log(
    spark: SparkSession, project: Project, bounds: Bounds, run_id: str, kind: str, now: datetime
) -> tuple[Fit, DataFrame]:
    """Fit on 'train', measure on 'test', log the run; returns the gate rows too."""
    sets = _sets(spark, project, bounds)
    columns = _inputs(project, sets["train"])
    train = time_folds(sets["train"], TS, *bounds["train"], folds=10, name="_tenth")
    train = train.withColumn("_held", F.col("_tenth") == 9).select(VALUE, *columns, "_tenth", "_held")
    pipeline = make_pipeline(columns, VALUE, project.regressor)
    if project.grid:
        folds = train.withColumn("_fold", F.floor(F.col("_tenth") * 3 / 10).cast("int"))
        tuned = tune(pipeline, project.grid, VALUE, fold_column="_fold").fit(folds)
        append(tuning_report(spark, tuned).withColumn("run_id", F.lit(run_id)), project.path("tuning"), run_id)
        best = min(range(len(tuned.avgMetrics)), key=tuned.avgMetrics.__getitem__)
        pipeline = pipeline.copy(tuned.getEstimatorParamMaps()[best])
    if project.stop_early:
        pipeline.getStages()[-1].setValidationIndicatorCol("_held")
    fit = timed_fit(pipeline, train)
    row = _evaluate(fit, sets["test"].select(VALUE, *columns)).first().asDict()
    measured = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{name}` double" for name in row if name != "rows") + ", rows long")
    params = {
        "trees": project.regressor.trees,
        "depth": project.regressor.depth,
        "rate": project.regressor.rate,
        "training_range": bounds["train"],
        "testing_range": bounds["test"],
        "training_rows": fit.rows,
        "testing_rows": row.pop("rows"),
    }
    append(
        run_tables.run_row(spark, run_id, project.name, now, params, {"kind": kind}, row),
        project.path("runs"),
        run_id,
    )
    weights = feature_importance(spark, fit.model, columns).withColumn("run_id", F.lit(run_id))
    append(weights, project.path("importances"), run_id)
    return fit, run_tables.gate(measured, project.thresholds)


def _register(
    spark: SparkSession, project: Project, fit: Fit, data: DataFrame, now: datetime, run_id: str
) -> int:
    """Store model and training data of a run, then list them under the next version, staged as 'Staging'.

    Folders carry the name of the run: what a run that died has left there is written over. A run that is listed already keeps its version.
    """
    table, path = project.path("versions"), f"{project.path('models')}/run={run_id}"
    versions = (
        load(spark, table) if exists(spark, table) else spark.createDataFrame([], run_tables.VERSIONS_SCHEMA)
    )
    known = versions.filter((F.col("name") == project.name) & (F.col("path") == path)).agg(F.max("version")).first()[0]
    if known is not None:
        return known
    new = run_tables.next_version(versions, project.name, "", now, "Staging")
    save_pipeline(fit.model, path)
    save(data, f"{project.path('training_data')}/run={run_id}")
    append(new.withColumn("path", F.lit(path)), table, run_id)
    return new.first()["version"]


def _staged_path(spark: SparkSession, project: Project, stage: str) -> tuple[int, str] | None:
    """Version and path of the newest model in a stage."""
    versions = load(spark, project.path("versions")).filter(F.col("name") == project.name)
    row = (
        versions.filter(F.col("current_stage") == stage)
        .agg(F.max(F.struct("version", "path")).alias("m"))
        .first()["m"]
    )
    return (row["version"], row["path"]) if row else None


def _move(spark: SparkSession, project: Project, version: int, stage: str, archive: bool) -> None:
    table = project.path("versions")
    chosen: Column = (F.col("name") == project.name) & (F.col("version") == version)
    replace_table(run_tables.transition(load(spark, table), chosen, stage, archive), table)


def ingest(spark: SparkSession, project: Project, clean: DataFrame) -> date:
    """Merge clean rows into the raw table, renew the history of the steps they touch and its row counts; returns the first day renewed.

    A step may be longer than a month, or span two: all months of the touched steps are read, and only touched steps are renewed.
    """
    merge_into(clean, project.path("raw"), [KEY, TS], TS)
    append_if_absent(clean.select(KEY).distinct(), project.path("series"), [KEY])
    step = project.features.step
    touched = clean.select(truncate(TS, step).alias(TS)).distinct()
    first, last = touched.agg(F.min(TS), F.max(TS)).first()
    raw = _months(spark, project, "raw", first, last + timedelta(seconds=step_seconds(step)))
    hourly = resample(raw, [KEY], TS, VALUE, step, project.resample_agg).join(touched, TS, "left_semi")
    merge_into(
        hourly.withColumns({VALUE: F.col(VALUE).cast("double"), "ORIGIN": F.lit("actual")}),
        project.path("history"),
        [KEY, TS],
        TS,
    )
    counted = project.path("row_counts")
    # A project without counts gets those of its whole history.
    rows = _months(spark, project, "history", first, last) if exists(spark, counted) else load(spark, project.path("history")).drop(MONTH)
    merge_into(_row_counts(rows), counted, [KEY, TS], TS)
    return first.date()


def ingest_landing(spark: SparkSession, project: Project, landing: DataFrame, run_id: str, text: str = "datetime", **options) -> DataFrame:
    """Clean landing rows; rows with unreadable interval text are kept in 'rejected' and counted in 'quality'."""
    append(unreadable_rows(landing, text).withColumn("run_id", F.lit(run_id)), project.path("rejected"), run_id)
    counted = landing.agg(F.count_if(parse_interval(text).isNull()).alias("bad"), F.count(F.lit(1)).alias("rows"))
    append(row_result(counted, "readable_time", text, "interval text").withColumn("run_id", F.lit(run_id)), project.path("quality"), f"{run_id}/landing")
    return clean_landing(landing, "series", text, ts=TS, out_value=VALUE, **options).withColumnRenamed("series", KEY)


def _row_counts(history: DataFrame) -> DataFrame:
    """Actual rows per series and month."""
    month = truncate(TS, "month").alias(TS)
    return _actuals(history).groupBy(KEY, month).agg(F.count(F.lit(1)).alias("n"))


def _renewal(counts: DataFrame, start: date, rows: int) -> tuple[date, list[str]]:
    """The first month whose features depend on rows from ``start`` on, and the earlier months that hold the rows they need.

    A series with at most ``rows`` rows before ``start`` has features there that
    are filled back from later rows, so it is renewed from its first month.  Of
    every series renewed, the last ``rows`` rows before are needed, whatever gaps
    lie between.  Works on one row per series and month; a date and names of
    months reach the driver.
    """

    def instant(day: date) -> Column:
        return F.lit(day).cast("timestamp_ntz")

    spans = counts.groupBy(KEY).agg(
        F.sum(F.when(F.col(TS) < instant(start), F.col("n"))).alias("_before"), F.min(TS).alias("_oldest"), F.max(TS).alias("_newest")
    )
    short = spans.filter((F.col("_newest") >= instant(start)) & (F.col("_before") <= rows)).agg(F.min("_oldest")).first()[0]
    first = min(start, short.date()) if short else start
    renewed = spans.filter(F.col("_newest") >= instant(first)).select(KEY)
    newer = Window.partitionBy(KEY).orderBy(F.col(TS).desc()).rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        counts.join(renewed, KEY, "left_semi")
        .filter(F.col(TS) < instant(first))
        .withColumn("_after", F.coalesce(F.sum("n").over(newer), F.lit(0)))
        .filter(F.col("_after") < rows)
    )
    return first, [r["m"] for r in needed.select(F.date_format(TS, "yyyy-MM").alias("m")).distinct().collect()]


def refresh_features(spark: SparkSession, project: Project, first: date) -> None:
    """Rebuild the features from the month of ``first`` on.

    Earlier months are read as far as lags reach back in time, and those that hold
    the rows which moving statistics and lags by rows count.
    """
    history = load(spark, project.path("history"))
    if exists(spark, project.path("features")):
        table = project.path("row_counts")
        counts = load(spark, table).drop(MONTH) if exists(spark, table) else _row_counts(history)
        start, months = _renewal(counts, first.replace(day=1), project.features.reach)
        key = F.col(MONTH).cast("string")
        actual = _actuals(history.filter(key.isin(months) | (key >= F.lit(f"{start - project.reach:%Y-%m}"))).drop(MONTH))
        built = build_features(actual, KEY, TS, VALUE, project.features).filter(F.col(TS) >= F.lit(start).cast("timestamp_ntz"))
    else:
        built = build_features(_actuals(history.drop(MONTH)), KEY, TS, VALUE, project.features)
    write_months(with_month(built.drop(VALUE), TS, MONTH), project.path("features"), [project.features.id_column], MONTH)


def train_job(
    spark: SparkSession,
    project: Project,
    clean: DataFrame,
    bounds: Bounds,
    suite: Sequence[Check],
    run_id: str,
    now: datetime,
    promote: bool = True,
) -> DataFrame:
    """Ingest, check, build features, fit, gate and stage; returns the gate rows.

    ``promote`` moves the first staged model on to production.
    """
    first = ingest(spark, project, clean)
    actual = _actuals(load(spark, project.path("history")).drop(MONTH))
    if suite:
        append(run_suite(actual, suite, run_id), project.path("quality"), f"{run_id}/suite")
    refresh_features(spark, project, first)
    fit, gate = _fit_and_log(spark, project, bounds, run_id, "training", now)
    if gate.agg(F.bool_and("passed")).first()[0]:
        sets = _sets(spark, project, bounds)
        version = _register(spark, project, fit, sets["train"].unionByName(sets["test"]), now, run_id)
        if promote:
            _move(spark, project, version, "Production", archive=True)
    return gate


def daily_job(spark: SparkSession, project: Project, day: date, actuals: DataFrame | None = None) -> DataFrame:
    """Forecast ``day``, reconcile it with ``actuals`` if given, and feed it back; returns the errors."""
    cfg = project.features
    log = spark.createDataFrame(
        [(day, day - timedelta(days=1))], "execution_date date, execution_yesterdate date"
    )
    append_if_absent(log, project.path("run_log"), log.columns)

    history = _months(spark, project, "history", day - project.reach - timedelta(days=1), day)
    series = load(spark, project.path("series"))
    start = F.lit(day).cast("timestamp_ntz")
    features = build_future_features(history, series, KEY, TS, VALUE, start, cfg)
    merge_into(features, project.path("features"), [cfg.id_column], TS)

    staged = _staged_path(spark, project, "Production")
    if staged is None:
        raise ValueError(f"no production version of {project.name}")
    version, path = staged
    today = one_day(_months(spark, project, "features", day, day).drop(KEY), TS, day)
    scored = load_model(path).transform(today)
    rows = score_to_predictions(scored, TS, f"models:/{project.name}/{version}", cfg.id_column, KEY)
    # A repeated run renews the forecast but keeps an actual that arrived meanwhile.
    merge_into(rows, project.path("predictions"), [KEY, TS], TS, update=[PREDICTED, MODEL])

    predictions = one_day(_months(spark, project, "predictions", day, day), TS, day)
    if actuals is not None:
        known = one_day(actuals.select(KEY, TS, VALUE), TS, day)
        settled = reconcile(predictions, known, [KEY, TS], VALUE, PREDICTED, ACTUAL, RESIDUAL)
        merge_into(settled, project.path("predictions"), [KEY, TS], TS)
        predictions = one_day(_months(spark, project, "predictions", day, day), TS, day)
    fed = predictions.select(
        KEY, TS, F.col(PREDICTED).alias(VALUE), F.lit("predicted").alias("ORIGIN")
    )
    merge_into(fed, project.path("history"), [KEY, TS], TS, update=None)

    settled = predictions.filter(F.col(ACTUAL).isNotNull())
    errors = regression_metrics(settled, ACTUAL, PREDICTED, [KEY])
    return errors.join(bias_mape(settled, RESIDUAL, ACTUAL, [KEY]), KEY, "left")


def drift_report(df: DataFrame, old_end, new_end, cfg: FeatureConfig, seed: int = 123) -> DataFrame:
    """Chi-square on the series flags and distribution distance on the other features."""
    flags = list(cfg.values)
    continuous = ["DAY_OF_WEEK", "QUARTER", "HOUR", *cfg.lags, *cfg.moving]
    groups = drift_groups(df, TS, old_end, new_end, seed, [cfg.id_column])
    chi = chi2_drift(groups, flags, "data_group").select("feature", "statistic", "p_value", "drifted")
    ks = ks_drift(groups, continuous, "data_group").select("feature", "statistic", "p_value", "drifted")
    return chi.withColumn("test", F.lit("chi2")).unionByName(ks.withColumn("test", F.lit("ks")))


def compare_models(
    spark: SparkSession, project: Project, labels: DataFrame, features: DataFrame, paths: Mapping[str, str]
) -> DataFrame:
    """Labels scored by the staging and the production model, joined on the row id, with the series back in KEY."""
    cfg = project.features
    scored = {
        stage: score(load_model(path), labels, features, [cfg.id_column]).withColumnRenamed(
            "prediction", f"{stage}_prediction"
        )
        for stage, path in paths.items()
    }
    left = scored["staging"].drop(ASSEMBLED, "features")
    both = join_scores(left, scored["production"], cfg.id_column, "production_prediction")
    return id_to_series(both, cfg.id_column, KEY)


def retrain_job(
    spark: SparkSession,
    project: Project,
    bounds: Bounds,
    months: int,
    run_id: str,
    now: datetime,
) -> DataFrame:
    """Shift the ranges, test for drift, refit, gate, stage, compare with production, promote the better one."""
    moved = shift_split(spark, bounds, months)
    refresh_features(spark, project, _day(bounds["train"][1]))
    stored = _months(spark, project, "features", bounds["train"][0], moved["train"][1])
    report = drift_report(stored, bounds["train"][1], moved["train"][1], project.features)
    append(report.withColumn("run_id", F.lit(run_id)), project.path("drift"), run_id)

    fit, gate = _fit_and_log(spark, project, moved, run_id, "retraining", now)
    if not gate.agg(F.bool_and("passed")).first()[0]:
        return gate
    sets = _sets(spark, project, moved)
    version = _register(spark, project, fit, sets["train"].unionByName(sets["test"]), now, run_id)
    production = _staged_path(spark, project, "Production")
    if production is None:
        _move(spark, project, version, "Production", archive=True)
        return gate
    staged = _staged_path(spark, project, "Staging")
    actual = _actuals(_months(spark, project, "history", *moved["test"]))
    test = time_split(actual, TS, {"test": moved["test"]})["test"]
    labels = labels_of(test, KEY, TS, VALUE, project.features.id_column)
    features = _months(spark, project, "features", *moved["test"]).drop(KEY)
    with settled(compare_models(spark, project, labels, features, {"staging": staged[1], "production": production[1]})) as both:
        sides = (VALUE, "staging_prediction", "production_prediction")
        by_series = run_tables.choose_champion(both, *sides, [KEY])
        append(by_series.withColumn("run_id", F.lit(run_id)), project.path("comparisons"), run_id)
        choice = run_tables.choose_champion(both, *sides)
        winner = choice.first()["champion"]
    if winner == "Staging":
        _move(spark, project, staged[0], "Production", archive=True)
    return gate
