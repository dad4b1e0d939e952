"""Commits that cannot be torn, and jobs that can be started again."""

from datetime import datetime
from pathlib import Path

import pytest
from helpers import frame, hour, rows_of
from pyspark.sql import functions as F

from hourcast.operators.quality import not_null
from hourcast.operators.training import RegressorConfig
from hourcast.plans import jobs
from hourcast.plans.features import FeatureConfig
from hourcast.sources import manifests, tables

KEY = ["series"]


def rows(spark, data):
    return spark.createDataFrame([(s, datetime(2024, m, 1), v) for s, m, v in data], "series string, ts timestamp_ntz, v double")


def merge(spark, path, data):
    tables.merge_into(rows(spark, data), path, ["series", "ts"], "ts")


def seen(spark, path):
    return [(r["series"], r["ts"].month, r["v"]) for r in tables.load(spark, path).orderBy("ts", "series").collect()]


OLD = [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0)]


class Crash(Exception):
    pass


def crash(*_, **__):
    raise Crash


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    merge(spark, path, OLD)
    with monkeypatch.context() as m:
        real = getattr(manifests, step)
        m.setattr(manifests, step, (lambda *a, **k: (real(*a, **k), crash())) if step == "write" else crash)
        for write in (
            lambda: merge(spark, path, [("a", 2, 20.0), ("b", 4, 4.0)]),
            lambda: tables.write_months(tables.with_month(rows(spark, [("z", 2, 0.0)]), "ts"), path, KEY),
            lambda: tables.replace_table(tables.load(spark, path).limit(0), path),
            lambda: tables.append(tables.load(spark, path), path),
        ):
            with pytest.raises(Crash):
                write()
            assert seen(spark, path) == OLD
    merge(spark, path, [("a", 2, 20.0), ("b", 4, 4.0)])
    assert seen(spark, path) == [("a", 1, 1.0), ("a", 2, 20.0), ("a", 3, 3.0), ("b", 4, 4.0)]


def test_a_first_write_that_dies_leaves_no_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with monkeypatch.context() as m:
        m.setattr(manifests, "commit", crash)
        with pytest.raises(Crash):
            merge(spark, path, OLD)
    assert not tables.exists(spark, path)
    merge(spark, path, OLD)
    assert seen(spark, path) == OLD


def test_a_reader_keeps_the_state_it_started_from(spark, tmp_path):
    path = str(tmp_path / "t")
    merge(spark, path, OLD)
    before = tables.load(spark, path)
    merge(spark, path, [("a", 1, 9.0)])
    assert before.agg(F.sum("v")).first()[0] == 6.0
    assert tables.load(spark, path).agg(F.sum("v")).first()[0] == 14.0


def test_the_second_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    merge(spark, path, OLD)
    real = manifests.write

    def late(*a, **k):
        monkeypatch.setattr(manifests, "write", real)
        merge(spark, path, [("a", 2, 5.0)])  # another writer is faster
        return real(*a, **k)

    monkeypatch.setattr(manifests, "write", late)
    with pytest.raises(manifests.ConcurrentWrite):
        merge(spark, path, [("a", 2, 7.0)])
    assert seen(spark, path) == [("a", 1, 1.0), ("a", 2, 5.0), ("a", 3, 3.0)]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2  # the loser's rows are gone


def test_old_states_can_be_read_and_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in (1.0, 2.0, 3.0):
        merge(spark, path, [("a", 1, v), ("a", 2, v)] if v < 3 else [("a", 2, v)])
    old = manifests.current(spark, path, 2)
    assert rows_of(manifests.read(spark, path, old).select("v")) == [(2.0,), (2.0,)]
    assert manifests.remove_old(spark, path, keep=1) == 2 and manifests.versions(spark, path) == [3]
    assert seen(spark, path) == [("a", 1, 2.0), ("a", 2, 3.0)]
    months = sorted(p.name for p in Path(path, "data").glob("*/*") if p.is_dir())
    assert months == ["month_key=2024-01", "month_key=2024-02"]
    with pytest.raises(ValueError):
        manifests.remove_old(spark, path, keep=0)


def test_a_step_is_added_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for step in ("one", "one", "two", "one", None):
        tables.append(spark.createDataFrame([(step or "none",)], "s string"), path, step)
    assert rows_of(tables.load(spark, path)) == [("none",), ("one",), ("two",)]
    with pytest.raises(ValueError, match="columns"):
        tables.append(spark.createDataFrame([(1,)], "other int"), path)
    tables.replace_table(tables.load(spark, path).filter("s <> 'none'"), path)
    tables.append(spark.createDataFrame([("two",)], "s string"), path, "two")
    assert rows_of(tables.load(spark, path)) == [("one",), ("two",)]
    tables.replace_table(tables.load(spark, path).limit(0), path)
    assert tables.load(spark, path).count() == 0 and tables.exists(spark, path)
    with pytest.raises(ValueError, match="manifests"):
        tables.save(spark.createDataFrame([("x",)], "s string"), path)


def project(root) -> jobs.Project:
    return jobs.Project(
        str(root), features=FeatureConfig(values=["a", "b"], lags={"l24": 24}, moving={"m": (24, "avg", 24)}, chunk_rows=100),
        regressor=RegressorConfig(trees=3, depth=2), thresholds={"RMSE": 1e9},
    )


def tables_of(spark, p):
    """All tables of a project, without times and the folder of the project."""
    out = {}
    for name in ("raw", "series", "history", "features", "runs", "importances", "quality", "versions"):
        table = tables.load(spark, p.path(name))
        if name == "runs":
            table = table.select("run_id", F.map_filter("metrics", lambda k, _: ~k.contains("Time")).alias("m")).select("run_id", F.sort_array(F.map_entries("m")).cast("string"))
        if name == "versions":
            table = table.select("name", "version", "current_stage", F.element_at(F.split("path", "/"), -1))
        out[name] = rows_of(table)
    return out


def start(spark, p, clean):
    bounds = {"train": ("2024-01-01", "2024-01-15"), "test": ("2024-01-15", "2024-01-21")}
    return jobs.train_job(spark, p, clean, bounds, [not_null("HOURLY_CONSUMPTION_MW")], "run-1", datetime(2024, 2, 1))


def test_a_training_job_can_be_started_again(spark, tmp_path, monkeypatch):
    """The job dies at one table after the other, before the commit or after it; at last it leaves the tables of an undisturbed run."""
    series = [(n, hour(i), 100.0 + 10 * k + i % 24 + i % 7) for k, n in enumerate("ab") for i in range(20 * 24)]
    clean = frame(spark, series).toDF("COUNTRY", "DATETIME", "HOURLY_CONSUMPTION_MW").persist()
    start(spark, whole := project(tmp_path / "whole"), clean)
    p, real = project(tmp_path / "again"), manifests.commit
    for name, after in (("history", True), ("quality", True), ("runs", True), ("importances", False), ("versions", True), ("versions", False)):

        def dies(session, path, state, name=name, after=after):
            if not path.endswith(f"/{name}") or after:
                real(session, path, state)
            if path.endswith(f"/{name}"):
                raise Crash

        monkeypatch.setattr(manifests, "commit", dies)
        with pytest.raises(Crash):
            start(spark, p, clean)
    monkeypatch.setattr(manifests, "commit", real)
    start(spark, p, clean)
    assert tables_of(spark, p) == tables_of(spark, whole)
