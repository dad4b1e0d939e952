"""Features, errors, runs, versions, training and the three jobs."""

import math
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from helpers import frame, hour, random_series, rows_of
from pyspark.sql import functions as F

from hourcast.operators import monitor, runs
from hourcast.operators.clean import dedupe
from hourcast.operators.quality import between, not_null
from hourcast.operators.training import (
    RegressorConfig,
    feature_importance,
    forward_scores,
    load_model,
    make_pipeline,
    make_regressor,
    minmax_inverse,
    minmax_scale,
    save_model,
    save_pipeline,
    scaled_by,
    shift_split,
    time_folds,
    timed_fit,
    tune,
    tuning_report,
)
from hourcast.operators.drift import chi2_drift
from hourcast.operators.windows import continuity, lags
from hourcast.plans import jobs
from hourcast.plans.features import FeatureConfig, build_features, build_future_features
from hourcast.queries import drift_model, stored
from hourcast.queries.features import daily_features
from hourcast.queries.frames import SPLIT_DATE
from hourcast.queries.scalars import FLAGS
from hourcast.session import ensure_checkpoint_dir
from hourcast.sources.tables import FILES_PER_MONTH, load, merge_into

SMALL = FeatureConfig(
    lags={"l24": 24, "l48": 48},
    moving={"m": (24, "avg", 24), "s": (24, "std", 24), "t": (48, "sum", 1)},
    values=["a", "b"],
    chunk_rows=40,
)


def full_series(hours, names=("a", "b")):
    return [
        (n, hour(i), 100.0 + 10 * k + 20 * math.sin(i / 24 * 2 * math.pi) + i % 7)
        for k, n in enumerate(names)
        for i in range(hours)
    ]


def test_features_do_not_depend_on_other_series(spark):
    rows = random_series(1, {"a": 120, "b": 30})
    both = build_features(frame(spark, rows), "series", "ts", "v", SMALL)
    alone = build_features(frame(spark, [r for r in rows if r[0] == "a"]), "series", "ts", "v", SMALL)
    assert rows_of(both.filter("series = 'a'")) == rows_of(alone)


def test_short_series_is_not_filled_from_the_next(spark):
    rows = [("a", hour(0), 1.0), ("a", hour(1), 2.0)] + [("b", hour(i), 7.0) for i in range(60)]
    out = build_features(frame(spark, rows), "series", "ts", "v", SMALL).filter("series = 'a'")
    assert rows_of(out, "l24", "m") == [(None, None), (None, None)]


@pytest.mark.parametrize("mode", ["rows", "time"])
def test_future_features_equal_training_features(spark, mode):
    cfg = FeatureConfig(
        lags=SMALL.lags, moving=SMALL.moving, values=SMALL.values, mode=mode, exclude_current=True
    )
    rows = full_series(24 * 6)
    past = [r for r in rows if r[1] < hour(24 * 5)]
    trained = build_features(frame(spark, rows), "series", "ts", "v", cfg)
    series = spark.createDataFrame([("a",), ("b",)], "series string")
    day = F.lit(hour(24 * 5)).cast("timestamp_ntz")
    future = build_future_features(frame(spark, past), series, "series", "ts", "v", day, cfg)
    assert future.count() == 48
    names = ["CONSUMPTION_ID", "l24", "l48", "HOUR", "DAY_OF_WEEK", "WEEK_OF_YEAR", "a", "b"]
    expected = {r[0]: r for r in rows_of(trained.filter(F.col("ts") >= day), *names)}
    assert {r[0]: r for r in rows_of(future, *names)} == expected
    # The first hour sees only known values, so its moving statistics agree as well.
    first = F.col("ts") == day
    for got, want in zip(rows_of(future.filter(first), "m", "s", "t"), rows_of(trained.filter(first), "m", "s", "t")):
        assert got == pytest.approx(want)


@pytest.mark.parametrize("days", [28, 29, 30, 31])
def test_month_lag_is_found_whatever_the_month(spark, days):
    cfg = FeatureConfig(lags={"l720": 720}, moving={}, values=["a"])
    rows = [("a", hour(i), float(i)) for i in range(24 * 40)]
    day = F.lit(hour(24 * (days + 2))).cast("timestamp_ntz")
    out = build_future_features(frame(spark, rows), spark.createDataFrame([("a",)], "series string"), "series", "ts", "v", day, cfg)
    assert out.filter("l720 is null").count() == 0
    assert out.agg(F.min("l720")).first()[0] == 24 * (days + 2) - 720


def test_feature_names_must_differ():
    with pytest.raises(ValueError):
        FeatureConfig(values=[], lags={"month": 720})


def errors(spark):
    rows = [("a", 10.0, 12.0), ("a", 0.0, 1.0), ("b", -4.0, -5.0), ("b", 0.0, 0.0), ("b", None, 3.0)]
    return frame(spark, rows, "series string, y double, p double")


def test_errors(spark):
    df = errors(spark).withColumn("r", F.col("p") - F.col("y"))
    row = monitor.regression_metrics(df, "y", "p").first()
    assert (row["n"], row["mse"], row["mae"]) == (4, 1.5, 1.0) and row["rmse"] == math.sqrt(1.5)
    mean = (10 - 4) / 4
    total = sum((y - mean) ** 2 for y in (10, 0, -4, 0))
    assert row["r2"] == pytest.approx(1 - 6 / total)
    pct = [r["pct_error"] for r in monitor.with_pct_error(df, "r", "y").collect()]
    assert pct == [20.0, None, -25.0, None, None]
    both = monitor.bias_mape(df, "r", "y").first()
    assert (both["bias_pct"], both["mape"]) == (-2.5, 22.5)
    assert monitor.smape(df, "p", "y").first()[0] == pytest.approx((2 / 11 * 100 + 200 + 1 / 4.5 * 100) / 3)
    assert monitor.regression_metrics(df.limit(0), "y", "p").first()["mse"] is None


def test_reconcile_and_feedback(spark):
    schema = "series string, ts timestamp_ntz, p double, y double, r double"
    pred = frame(spark, [("a", hour(0), 5.0, None, None), ("a", hour(1), 6.0, None, None)], schema)
    known = frame(spark, [("a", hour(0), 4.0), ("z", hour(0), 1.0)])
    out = monitor.reconcile(pred, known, ["series", "ts"], "v", "p", "y", "r")
    assert rows_of(out) == [("a", hour(0), 5.0, 4.0, 1.0), ("a", hour(1), 6.0, None, None)]
    fed = monitor.feedback(known, pred, ["series", "ts"], "v", "p", "origin")
    assert rows_of(fed) == [("a", hour(0), 4.0, "actual"), ("a", hour(1), 6.0, "predicted"), ("z", hour(0), 1.0, "actual")]
    assert rows_of(monitor.one_day(known, "ts", "2024-01-01")) == rows_of(known)


def test_runs(spark):
    rows = [("r1", hour(1), 5.0), ("r2", hour(2), 3.0), ("r3", hour(3), 3.0), ("r4", hour(30), None), ("r5", hour(31), 8.0)]
    df = frame(spark, rows, "run_id string, start_time timestamp_ntz, mae double")
    best = runs.best_run_per_day(df, "mae")
    assert rows_of(best, "run_date", "run_id") == [(date(2024, 1, 1), "r2"), (date(2024, 1, 2), "r5")]
    assert rows_of(runs.runs_per_day(df, "2024-02-01")) == [("2024-01-02", 2)]
    assert runs.latest_run(df).first()["run_id"] == "r5"


def test_run_table_with_maps(spark):
    rows = [("r1", 1, 5.0), ("r2", 2, 3.0), ("r3", 3, 3.0), ("r4", 30, None), ("r5", 31, 8.0)]
    table = None
    for name, at, mae in rows:
        row = runs.run_row(spark, name, "e", hour(at), {"trees": 3}, {"kind": "t"}, {"MAE": mae, "R2": None})
        table = row if table is None else table.unionByName(row)
    assert rows_of(runs.best_run_per_day(table, "metrics['MAE']"), "run_id") == [("r2",), ("r5",)]
    assert runs.latest_run(table).first()["run_id"] == "r5"
    assert rows_of(runs.latest_run(table, ["experiment"]), "run_id") == [("r5",)]
    gated = runs.gate(runs.run_metrics(table, ["MAE", "R2"]), {"MAE": 4.0, "R2": 0.5}, ["run_id"])
    assert rows_of(gated.filter("metric = 'MAE' and passed"), "run_id") == [("r2",), ("r3",)]
    kept = dedupe(table, ["experiment"], ["start_time"])
    assert rows_of(kept, "run_id") == [("r5",)] and kept.columns == table.columns


def test_gate(spark):
    values = (1e9, 10.0, 20.0, 0.95, 1.0)
    good = spark.createDataFrame([values], list(runs.THRESHOLDS))
    assert runs.gate(good).filter("passed and all_passed and status = 'Test Passed'").count() == 5
    bad = runs.gate(spark.createDataFrame([(1e9, 10.0, None, 0.5, 1.0)], "MSE double, MAE double, RMSE double, R2 double, `Training Time(sec)` double"))
    assert rows_of(bad.filter("not passed"), "metric") == [("R2",), ("RMSE",)] and bad.filter("all_passed").count() == 0


def versions(spark):
    rows = [("m", 1, "Archived"), ("m", 2, "Production"), ("m", 3, "Staging"), ("m", 4, "None")]
    rows = [(n, v, s, hour(v), f"p{v}") for n, v, s in rows]
    return frame(spark, rows, runs.VERSIONS_SCHEMA)


def test_versions(spark):
    v = versions(spark)
    assert rows_of(runs.latest_per_stage(v), "current_stage", "version") == [("Archived", 1), ("None", 4), ("Production", 2), ("Staging", 3)]
    moved = runs.transition(v, F.col("version") == 3, "Production", archive_existing=True)
    assert rows_of(moved, "version", "current_stage") == [(1, "Archived"), (2, "Archived"), (3, "Production"), (4, "None")]
    other = frame(spark, [("n", 5, "Production", hour(5), "p5")], runs.VERSIONS_SCHEMA)
    both = runs.transition(v.unionByName(other), (F.col("name") == "m") & (F.col("version") == 3), "Production", True)
    assert rows_of(both.filter("current_stage = 'Production'"), "name", "version") == [("m", 3), ("n", 5)]
    assert both.columns == v.columns
    kept = runs.transition(v, F.col("version") == 4, "Staging")
    assert rows_of(kept.filter("current_stage = 'Staging'"), "version") == [(3,), (4,)]
    assert runs.next_version(v, "m", "x", hour(0)).first()["version"] == 5
    assert runs.next_version(v, "other", "x", hour(0)).first()["version"] == 1


@pytest.mark.parametrize("staging,winner", [(1.5, "Staging"), (2.0, "Production"), (3.0, "Production"), (None, "Production")])
def test_champion(spark, staging, winner):
    df = frame(spark, [(1.0, staging, 2.0)], "y double, s double, p double")
    assert runs.choose_champion(df, "y", "s", "p").first()["champion"] == winner


def test_scaling(spark):
    df = frame(spark, [(201.0, 1.0), (324310.0, 3.0), (1000.0, 2.0)], "y double, x double")
    more = df.unionByName(frame(spark, [(None, 5.0)], "y double, x double"))
    assert rows_of(scaled_by(more, df, ["x", "y"]).orderBy("x"), "x", "x_scaled", "y_scaled")[-1] == (5.0, 2.0, None)
    assert sorted(r[0] for r in scaled_by(df, df, ["y"]).select("y_scaled").collect())[::2] == [0.0, 1.0]
    low, high = F.lit(201.0), F.lit(324310.0)
    back = df.select("y", minmax_inverse(minmax_scale(F.col("y"), low, high), low, high).alias("b"))
    assert all(r["b"] == pytest.approx(r["y"]) for r in back.collect())
    assert df.select(minmax_scale(F.lit(5.0), F.lit(5.0), F.lit(5.0))).first()[0] == 0.5


TINY = RegressorConfig(trees=5, depth=3)


def training_rows(spark):
    rows = [(hour(i), float(i % 24), float(i % 7), 50.0 + 3 * (i % 24) + (i % 7)) for i in range(600)]
    return frame(spark, rows, "ts timestamp_ntz, h double, w double, y double")


def test_training(spark, tmp_path):
    df = training_rows(spark)
    pipeline = make_pipeline(["h", "w"], "y", TINY)
    fit = timed_fit(pipeline, df)
    assert fit.rows == 600 and fit.seconds > 0
    scored = fit.model.transform(df)
    metrics = monitor.regression_metrics(scored, "y", "prediction").first()
    assert metrics["rmse"] < df.agg(F.stddev_pop("y")).first()[0] / 2
    assert scored.filter("prediction is null or isnan(prediction)").count() == 0
    again = timed_fit(pipeline, df).model.transform(df)
    assert rows_of(again, "ts", "prediction") == rows_of(scored, "ts", "prediction")
    weights = {r["feature"]: r["importance"] for r in feature_importance(spark, fit.model, ["h", "w"]).collect()}
    assert weights["h"] > weights["w"] and sum(weights.values()) == pytest.approx(1)
    path = save_model(fit.model, str(tmp_path / "models"), 1)
    assert rows_of(load_model(path).transform(df), "ts", "prediction") == rows_of(scored, "ts", "prediction")
    with pytest.raises(Exception):
        save_model(fit.model, str(tmp_path / "models"), 1)
    for _ in range(2):
        save_pipeline(fit.model, str(tmp_path / "pipeline"))


SF = "/root/testdata/sf0.001"
FITS = {"train_score": drift_model.train_score, "train_score_facts": drift_model.train_score_facts}
FITS |= {"score_with_gaps": drift_model.score_with_gaps, "score_by_id": stored.scored_labels}


@pytest.mark.parametrize("name", FITS)
def test_registered_fits_are_whole(spark, monkeypatch, name):
    """Every registered fit asks for the settings that jobs take."""

    class Asked(Exception):
        pass

    def ask(columns, label, cfg):
        raise Asked(cfg)

    for module in (drift_model, stored):
        monkeypatch.setattr(module, "make_pipeline", ask)
    with pytest.raises(Asked) as asked:
        FITS[name](spark, SF)
    assert asked.value.args == (RegressorConfig(),)


def test_early_stopping(spark):
    df = training_rows(spark).withColumn("held_out", F.hour("ts") >= 18)
    assert make_regressor("y", TINY, "held_out").getValidationIndicatorCol() == "held_out"
    noisy = df.withColumn("y", F.pmod(F.xxhash64("ts"), F.lit(97)).cast("double"))
    config = RegressorConfig(trees=30, depth=4, rate=1.0)
    # Nothing can be learned here, so more trees only fit noise and boosting stops; without held-out rows it does not.
    assert make_pipeline(["h", "w"], "y", config, "held_out").fit(noisy).stages[-1].getNumTrees < 30
    assert make_pipeline(["h", "w"], "y", config).fit(noisy).stages[-1].getNumTrees == 30


def test_no_row_is_lost_in_fit_and_score(spark, tmp_path):
    df = training_rows(spark).withColumn("w", F.when(F.col("h") > 3, F.col("w"))).withColumn("none", F.lit(None).cast("double"))
    columns = ["h", "w", "none"]
    fit = timed_fit(make_pipeline(columns, "y", TINY), df)
    scored = fit.model.transform(df)
    assert scored.count() == 600 == scored.filter("prediction is not null and not isnan(prediction)").count()
    assert len(feature_importance(spark, fit.model, columns).collect()) == 3
    again = load_model(save_model(fit.model, str(tmp_path), 1)).transform(df)
    assert rows_of(again, "ts", "prediction") == rows_of(scored, "ts", "prediction")


def test_tuning(spark):
    df = time_folds(training_rows(spark), "ts", hour(0), hour(600), 3)
    assert rows_of(df.groupBy("fold").count()) == [(0, 200), (1, 200), (2, 200)]
    pipeline = make_pipeline(["h", "w"], "y", RegressorConfig(trees=2, depth=2))
    fitted = tune(pipeline, {"maxDepth": [1, 4]}, "y", fold_column="fold").fit(df)
    report = tuning_report(spark, fitted).collect()
    assert [r["best"] for r in report] == [False, True]
    assert report[1]["params"]["maxDepth"] == "4"
    scores = forward_scores(pipeline.fit, df, "fold", 3, "y")
    assert len(scores) == 2 and all(s > 0 for s in scores)


def test_shift_split(spark):
    bounds = {"train": ("2015-01-01", "2021-12-31"), "test": ("2022-01-01", "2023-01-01")}
    assert shift_split(spark, bounds, 3) == {
        "train": (date(2015, 4, 1), date(2022, 3, 31)), "test": (date(2022, 4, 1), date(2023, 4, 1)),
    }


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    return jobs.Project(
        str(tmp_path_factory.mktemp("project")),
        features=FeatureConfig(lags={"l24": 24}, moving={"m": (24, "avg", 24)}, values=["a", "b"], chunk_rows=100),
        regressor=TINY,
        thresholds={"MSE": 1e6, "MAE": 1e3, "RMSE": 1e3, "R2": -10.0, "Training Time(sec)": 3600.0},
    )


def renamed(df):
    return df.toDF("COUNTRY", "DATETIME", "HOURLY_CONSUMPTION_MW")


def test_jobs(spark, project):
    hours = 24 * 70
    clean = renamed(frame(spark, full_series(hours)))
    bounds = {"train": (date(2024, 1, 1), date(2024, 1, 25)), "test": (date(2024, 1, 25), date(2024, 2, 5))}
    now = datetime(2024, 3, 12)
    suite = [not_null("HOURLY_CONSUMPTION_MW"), between("HOURLY_CONSUMPTION_MW", 0)]
    gate = jobs.train_job(spark, project, clean, bounds, suite, "run-1", now)
    assert gate.filter("not passed").count() == 0
    table = lambda name: load(spark, project.path(name))
    assert table("history").count() == 2 * hours == table("features").count()
    assert table("quality").filter("passed").count() == 2
    assert rows_of(table("versions"), "version", "current_stage") == [(1, "Production")]
    run = table("runs").first()
    assert run["run_id"] == "run-1" and run["metrics"]["RMSE"] > 0 and run["params"]["trees"] == "5"

    day = date(2024, 3, 11)
    truth = renamed(frame(spark, full_series(hours + 24)))
    result = jobs.daily_job(spark, project, day, truth)
    assert rows_of(result, "COUNTRY", "n") == [("a", 24), ("b", 24)]
    assert result.filter("mape > 50").count() == 0
    assert table("history").groupBy("ORIGIN").count().count() == 2
    jobs.daily_job(spark, project, day)
    predictions = table("predictions")
    assert predictions.count() == 48 and predictions.filter("ACTUAL_CONSUMPTION is null").count() == 0
    assert table("run_log").count() == 1
    assert table("history").count() == 2 * hours + 48

    gate = jobs.retrain_job(spark, project, bounds, 1, "run-2", now + timedelta(days=1))
    assert gate.count() == 5
    stages = rows_of(table("versions"), "version", "current_stage")
    assert stages in ([(1, "Archived"), (2, "Production")], [(1, "Production"), (2, "Staging")])
    assert table("drift").filter("test = 'ks'").count() == 5
    assert table("runs").count() == 2
    assert rows_of(table("comparisons"), "COUNTRY") == [("a",), ("b",)]


def test_jobs_read_only_the_months_they_need(spark, project):
    """Runs after test_jobs, on its tables."""
    day = date(2024, 3, 11)
    for name in ("history", "features", "predictions"):
        plan = jobs._months(spark, project, name, day, day)._jdf.queryExecution().executedPlan().toString()
        assert "month_key" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = load(spark, project.path("history")).select("month_key", F.input_file_name().alias("f")).distinct().groupBy("month_key").count()
    assert files.agg(F.max("count")).first()[0] <= FILES_PER_MONTH


def test_checkpoints_are_removed(spark, tmp_path):
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.glob("settled-*")}
    for shift in (0.0, 1.0):
        merge_into(frame(spark, [("a", hour(0), shift), ("b", hour(900), shift)]), str(tmp_path / "t"), ["series", "ts"], "ts")
    assert {p.name for p in folder.glob("settled-*")} == before


def test_merge_refuses_unknown_times(spark, tmp_path):
    rows = [("a", hour(0), 1.0), ("a", None, 2.0)]
    with pytest.raises(ValueError, match="NULL"):
        merge_into(frame(spark, rows), str(tmp_path / "t"), ["series", "ts"], "ts")


def test_ingest_renews_whole_steps(spark, tmp_path):
    weekly = jobs.Project(str(tmp_path), features=FeatureConfig(values=["a"], step="week"))
    first = [("a", datetime(2024, 1, 30), 1.0), ("a", datetime(2024, 1, 31), 10.0), ("a", datetime(2024, 1, 22), 5.0)]
    jobs.ingest(spark, weekly, renamed(frame(spark, first)))
    jobs.ingest(spark, weekly, renamed(frame(spark, [("a", datetime(2024, 2, 1), 100.0)])))
    history = load(spark, weekly.path("history"))
    assert rows_of(history, "DATETIME", "HOURLY_CONSUMPTION_MW") == [(datetime(2024, 1, 22), 5.0), (datetime(2024, 1, 29), 111.0)]


@pytest.mark.parametrize("mode", ["time", "rows"])
def test_refreshed_features_equal_a_full_build(spark, tmp_path, mode):
    """A gap of weeks, a series that starts shortly before it, one that ends before it, and a batch that changes old rows."""
    config = FeatureConfig(lags={"l24": 24}, moving={"m": (24, "avg", 24)}, values=["a", "b", "old"], chunk_rows=100, mode=mode)
    project = jobs.Project(str(tmp_path), features=config)
    at = lambda month, i: datetime(2024, month, 1) + timedelta(hours=i)
    batches = [
        [("a", at(1, i), float(i)) for i in range(19 * 24)] + [("old", at(1, i), 1.0 + i) for i in range(60)],
        [("b", at(2, i), 7.0 * i) for i in range(10)],
        [(s, at(3, i), 1000.0 + i * k) for k, s in enumerate("ab") for i in range(4 * 24)],
        [("a", at(3, 5), -5.0), ("b", at(3, 0), -6.0)],
    ]
    for n, batch in enumerate(batches):
        first = jobs.ingest(spark, project, renamed(frame(spark, batch)))
        jobs.refresh_features(spark, project, first)
        if n < 2:
            continue
        history = load(spark, project.path("history")).drop("ORIGIN", "month_key")
        whole = build_features(history, "COUNTRY", "DATETIME", "HOURLY_CONSUMPTION_MW", config).drop("HOURLY_CONSUMPTION_MW")
        stored = load(spark, project.path("features")).select(*whole.columns)
        assert rows_of(stored) == rows_of(whole)
    # Of the months before March, February holds too few rows of 'b'; nobody alive needs more than January of 'a'.
    counts = load(spark, project.path("row_counts"))
    assert set(rows_of(counts, "COUNTRY", "n")) == {("a", 96), ("a", 456), ("b", 10), ("b", 96), ("old", 60)}
    start, months = jobs._renewal(counts, date(2024, 3, 1), 24)
    assert start == date(2024, 2, 1) and months == ["2024-01"]
    start, months = jobs._renewal(counts, date(2024, 3, 1), 5)
    assert start == date(2024, 3, 1) and sorted(months) == ["2024-01", "2024-02"]


def test_unreadable_landing_rows_are_kept(spark, tmp_path):
    project = jobs.Project(str(tmp_path), features=FeatureConfig(values=["a"]))
    rows = [("a", "01.01.2024 00:00 - 01.01.2024 01:00", 5.0), ("a", "soon", 6.0), ("a", None, 7.0)]
    clean = jobs.ingest_landing(spark, project, frame(spark, rows, "series string, datetime string, Actual_MW double"), "run-1")
    assert clean.count() == 1 and clean.columns == ["COUNTRY", "DATETIME", "HOURLY_CONSUMPTION_MW"]
    assert load(spark, project.path("rejected")).count() == 2
    counted = load(spark, project.path("quality")).first()
    assert (counted["n_bad"], counted["passed"], round(counted["pct_bad"])) == (2, False, 67)


def test_training_with_early_stopping_and_grid(spark, tmp_path):
    project = jobs.Project(
        str(tmp_path),
        features=FeatureConfig(lags={"l24": 24}, moving={"m": (24, "avg", 24)}, values=["a", "b"], chunk_rows=100),
        regressor=RegressorConfig(trees=4, depth=2),
        thresholds={"MSE": 1e9},
        stop_early=True,
        grid={"maxDepth": [1, 3]},
    )
    bounds = {"train": (date(2024, 1, 1), date(2024, 1, 25)), "test": (date(2024, 1, 25), date(2024, 2, 5))}
    jobs.train_job(spark, project, renamed(frame(spark, full_series(24 * 40))), bounds, [], "run-1", datetime(2024, 3, 1))
    tried = load(spark, project.path("tuning")).collect()
    assert sorted(r["params"]["maxDepth"] for r in tried) == ["1", "3"] and sum(r["best"] for r in tried) == 1


def test_empty_test_range_fails_the_gate(spark, tmp_path):
    project = jobs.Project(
        str(tmp_path), features=FeatureConfig(lags={"l24": 24}, moving={}, values=["a", "b"], chunk_rows=100), regressor=TINY, thresholds={"MSE": 1e9}
    )
    bounds = {"train": (date(2024, 1, 1), date(2024, 1, 9)), "test": (date(2025, 1, 1), date(2025, 1, 2))}
    gate = jobs.train_job(spark, project, renamed(frame(spark, full_series(24 * 9))), bounds, [], "run-1", datetime(2024, 3, 1))
    assert [r["passed"] for r in gate.collect()] == [False]


def test_calendar_steps(spark):
    months = [("a", datetime(2024, m, 1), float(m)) for m in range(1, 9)] + [("b", datetime(2024, m, 1), float(m)) for m in (1, 2, 5)]
    df = frame(spark, months)
    found = rows_of(continuity(df, ["series"], "ts", "month"))
    assert found == [("a", True, True, 0, 0), ("b", False, True, 1, 2)]
    lagged = lags(df, ["series"], "ts", "v", {"l": 1}, mode="time", step="month", chunk_rows=2)
    assert [r["l"] for r in lagged.orderBy("series", "ts").collect()] == [None, 1, 2, 3, 4, 5, 6, 7, None, 1, None]
    ends = frame(spark, [("a", datetime(2024, 1, 31), 1.0), ("a", datetime(2024, 2, 29), 1.0), ("a", datetime(2024, 3, 31), 1.0)])
    assert rows_of(continuity(ends, ["series"], "ts", "month"), "is_continuous") == [(True,)]


def test_drift_of_text_categories(spark):
    rows = [(k, g) for k, g, n in [("x", "old", 30), ("y", "old", 10), ("z", "old", 5), ("x", "new", 10), ("y", "new", 30), ("z", "new", 5)] for _ in range(n)]
    found = chi2_drift(frame(spark, rows, "k string, g string"), ["k"], "g").first()
    assert found["dof"] == 2 and found["p_value"] == pytest.approx(math.exp(-found["statistic"] / 2)) and found["drifted"]
