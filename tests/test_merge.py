"""Upserts, lookups, sources and sinks."""

import random
from datetime import date, datetime

import pytest
from helpers import SCHEMA, frame, hour, rows_of
from pyspark.sql import functions as F

from hourcast.operators.lookup import join_actuals, join_scores, lookup_asof, lookup_equal
from hourcast.operators.upsert import assert_unique, exists_rows, insert_if_absent, source_col, upsert
from hourcast.sources import tables
from hourcast.sources.landing import (
    clean_landing,
    load_landing_files,
    load_landing_tables,
    union_all,
    unreadable_rows,
)

KEY = ["series", "ts"]
TARGET = [("a", hour(0), 1.0), ("a", hour(1), 2.0)]
SOURCE = [("a", hour(1), None), ("b", hour(0), 9.0)]


def test_upsert_all(spark):
    t, s = frame(spark, TARGET), frame(spark, SOURCE)
    once = upsert(t, s, KEY)
    assert rows_of(once) == [("a", hour(0), 1.0), ("a", hour(1), None), ("b", hour(0), 9.0)]
    assert rows_of(upsert(once, s, KEY)) == rows_of(once)
    assert rows_of(upsert(t, s, KEY, insert=False)) == [("a", hour(0), 1.0), ("a", hour(1), None)]


def test_upsert_keeps_columns_the_source_lacks(spark):
    t = frame(spark, TARGET).withColumn("tag", F.lit("x"))
    out = upsert(t, frame(spark, SOURCE), KEY)
    assert rows_of(out) == [("a", hour(0), 1.0, "x"), ("a", hour(1), None, "x"), ("b", hour(0), 9.0, None)]


def test_upsert_expression_list_and_insert_only(spark):
    t, s = frame(spark, TARGET), frame(spark, [("a", hour(1), 5.0), ("c", hour(0), 6.0)])
    out = upsert(t, s, KEY, {"v": F.col("v") - source_col("v")}, insert=False)
    assert rows_of(out) == [("a", hour(0), 1.0), ("a", hour(1), -3.0)]
    assert rows_of(upsert(t, s, KEY, ["v"])) == [("a", hour(0), 1.0), ("a", hour(1), 5.0), ("c", hour(0), 6.0)]
    assert rows_of(insert_if_absent(t, s, KEY)) == [*TARGET, ("c", hour(0), 6.0)]
    assert rows_of(exists_rows(s, t, KEY)) == [("a", hour(1), 5.0)]


def test_upsert_empty_sides(spark):
    t, none = frame(spark, TARGET), frame(spark, [], SCHEMA)
    assert rows_of(upsert(t, none, KEY)) == TARGET
    assert rows_of(upsert(none, t, KEY)) == TARGET


def test_duplicate_source(spark):
    with pytest.raises(ValueError, match="more than once"):
        assert_unique(frame(spark, [TARGET[0], TARGET[0]]), KEY)


def test_asof_cases(spark):
    features = frame(spark, [("a", hour(1), 1.0), ("a", hour(3), 3.0), ("a", hour(200), 9.0)], "series string, ts timestamp_ntz, f double")
    labels = frame(spark, [("a", hour(t), float(t)) for t in (0, 1, 2, 3, 150, 200)] + [("z", hour(5), 5.0), (None, hour(5), 6.0)])
    out = {r["v"]: r["f"] for r in lookup_asof(labels, features, ["series"], "ts").collect()}
    assert out == {0.0: None, 1.0: 1.0, 2.0: 1.0, 3.0: 3.0, 150.0: 3.0, 200.0: 9.0, 5.0: None, 6.0: None}
    assert lookup_asof(labels, features, ["series"], "ts", exclude=["ts", "series"]).columns == ["v", "f"]


@pytest.mark.parametrize("bucket", ["hour", "day", "week"])
def test_asof_matches_brute_force(spark, bucket):
    rng = random.Random(3)
    feats = {(rng.choice("ab"), hour(rng.random() * 400)): float(i) for i in range(60)}
    labels = [(rng.choice("abc"), hour(rng.random() * 400), float(i)) for i in range(120)]
    labels += labels[:30]
    df = frame(spark, [(k, t, f) for (k, t), f in feats.items()], "series string, ts timestamp_ntz, f double")
    out = lookup_asof(frame(spark, labels), df, ["series"], "ts", bucket=bucket)

    def brute(k, t):
        earlier = [(ft, f) for (fk, ft), f in feats.items() if fk == k and ft <= t]
        return max(earlier)[1] if earlier else None

    assert rows_of(out) == sorted([(k, t, v, brute(k, t)) for k, t, v in labels], key=repr)


def test_asof_without_key_or_time(spark):
    features = frame(spark, [("a", hour(1), 1.0), ("a", None, 2.0), (None, hour(1), 3.0), ("b", hour(2), None)], "series string, ts timestamp_ntz, f double")
    labels = frame(spark, [("a", None, 0.0), (None, hour(5), 1.0), (None, None, 2.0), ("b", hour(9), 3.0), ("a", hour(1), 4.0)])
    out = {r["v"]: r["f"] for r in lookup_asof(labels, features, ["series"], "ts").collect()}
    assert out == {0.0: None, 1.0: None, 2.0: None, 3.0: None, 4.0: 1.0}
    assert lookup_asof(labels, features.limit(0), ["series"], "ts").count() == 5
    assert lookup_asof(labels.limit(0), features, ["series"], "ts").count() == 0
    assert lookup_asof(labels, features.drop("f"), ["series"], "ts").columns == ["series", "ts", "v"]


def test_asof_takes_the_newest_row_even_if_it_is_unknown(spark):
    features = frame(spark, [("a", hour(1), 1.0), ("a", hour(30), None)], "series string, ts timestamp_ntz, f double")
    labels = frame(spark, [("a", hour(t), float(t)) for t in (2, 31, 90)])
    out = {r["v"]: r["f"] for r in lookup_asof(labels, features, ["series"], "ts").collect()}
    assert out == {2.0: 1.0, 31.0: None, 90.0: None}


def test_asof_reads_each_side_once_and_spreads_a_hot_key(spark, tmp_path):
    hours = range(24 * 60)
    frame(spark, [("hot", hour(i), float(i)) for i in hours], "series string, ts timestamp_ntz, f double").write.parquet(str(tmp_path / "f"))
    frame(spark, [("hot", hour(i + 0.5), float(i)) for i in hours]).write.parquet(str(tmp_path / "l"))
    labels, features = spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "f"))
    out = lookup_asof(labels, features, ["series"], "ts")
    assert out.filter("f = v").count() == len(hours)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = lookup_asof(labels, features, ["series"], "ts").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < len(hours) / 2


def test_equal_lookup_and_joins(spark):
    labels = frame(spark, [("x", 1.0), ("y", 2.0)], "id string, v double")
    features = frame(spark, [("x", 5.0, 0.0)], "id string, f double, v double")
    assert rows_of(lookup_equal(labels, features, ["id"])) == [("x", 1.0, 5.0), ("y", 2.0, None)]
    assert rows_of(join_scores(labels, features, "id", "f")) == [("x", 1.0, 5.0)]
    pred = frame(spark, [("a", "2024-01-01 01:00:00", 4.0)], "series string, ts string, p double")
    assert rows_of(join_actuals(pred, frame(spark, TARGET), ["series"], "ts")) == [("a", hour(1), 4.0, 2.0)]


LANDING = [
    ("01.01.2024 01:00 - 01.01.2024 02:00", 5.0),
    ("01.01.2024 02:00 - 01.01.2024 03:00", 0.0),
    ("01.01.2024 03:00 - 01.01.2024 04:00", None),
    ("01.01.2024 04:00 - 01.01.2024 05:00", 7.0),
    ("01.01.2024 04:00 - 01.01.2024 05:00", 6.0),
    ("rubbish", 1.0),
]


def landing(spark):
    return spark.createDataFrame(LANDING, "datetime string, Actual_MW double")


def test_landing_files(spark, tmp_path):
    for name in ("greece_2020", "spain_2020"):
        landing(spark).write.parquet(str(tmp_path / name))
    df = load_landing_files(spark, str(tmp_path / "*"))
    assert rows_of(df.groupBy("series").count()) == [("greece", 6), ("spain", 6)]
    clean = clean_landing(df).filter("series = 'spain'").orderBy("ts")
    assert [(r["ts"], r["v"]) for r in clean.collect()] == [
        (hour(1), 5.0), (hour(2), 5.0), (hour(3), 5.0), (hour(4), 7.0),
    ]
    assert clean_landing(df, drop_unknown=True).count() == 4
    assert unreadable_rows(df).count() == 2


def test_landing_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS landing")
    for name in ("greece_load", "spain_load"):
        landing(spark).write.mode("overwrite").saveAsTable(f"landing.{name}")
    df = load_landing_tables(spark, "landing")
    assert rows_of(df.groupBy("series").count()) == [("greece", 6), ("spain", 6)]
    with pytest.raises(ValueError):
        load_landing_tables(spark, "landing", "nothing*")


def test_union(spark):
    a, b = frame(spark, TARGET), frame(spark, [("c", hour(0))], "series string, ts timestamp_ntz")
    assert rows_of(union_all([a, b], allow_missing=True)) == [*TARGET, ("c", hour(0), None)]
    assert union_all([a, a, a]).count() == 6


def test_tables(spark, tmp_path):
    df = frame(spark, TARGET)
    tables.save(df, "hourly", ["series"])
    assert rows_of(tables.load(spark, "hourly").select("series", "ts", "v")) == TARGET
    tables.create_if_absent(frame(spark, SOURCE), "hourly")
    assert tables.load(spark, "hourly").count() == 2
    tables.create_feature_table(df, "features", KEY)
    assert tables.exists(spark, "features")
    tables.drop_table(spark, "features")
    assert not tables.exists(spark, "features")
    for bad in ([TARGET[0], TARGET[0]], [(None, hour(0), 1.0)]):
        with pytest.raises(ValueError):
            tables.create_feature_table(frame(spark, bad), "features", KEY)
    path = tables.snapshot(df, str(tmp_path / "data"), 1)
    assert rows_of(tables.load(spark, path)) == TARGET
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.snapshot(df, str(tmp_path / "data"), 1)
    tables.save(spark.createDataFrame([(date(2015, 1, 1), 3)], "train_start date, months int"), str(tmp_path / "config"))
    assert tables.read_config(spark, str(tmp_path / "config")) == {"train_start": date(2015, 1, 1), "months": 3}
    assert tables.rows_to_df(spark, [("MSE", 1.0)], "Metric string, Value double").count() == 1


def test_append_if_absent(spark, tmp_path):
    path = str(tmp_path / "log")
    row = spark.createDataFrame([(date(2024, 1, 2),)], "execution_date date")
    for _ in range(2):
        tables.append_if_absent(row, path, ["execution_date"])
    assert rows_of(tables.load(spark, path)) == [(date(2024, 1, 2),)]


def test_merge_into_rewrites_only_touched_months(spark, tmp_path):
    path = str(tmp_path / "history")
    old = [("a", datetime(2024, m, 1), float(m)) for m in (1, 2, 3)]
    tables.merge_into(frame(spark, old), path, KEY, "ts")
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "history").rglob("month_key=*/*.parquet")}
    tables.merge_into(frame(spark, [("a", datetime(2024, 2, 1), 20.0), ("b", datetime(2024, 2, 1), 5.0)]), path, KEY, "ts")
    out = rows_of(tables.load(spark, path), "series", "ts", "v")
    assert out == [("a", datetime(2024, 1, 1), 1.0), ("a", datetime(2024, 2, 1), 20.0), ("a", datetime(2024, 3, 1), 3.0), ("b", datetime(2024, 2, 1), 5.0)]
    for f, stamp in before.items():
        if "month_key=2024-02" not in str(f):
            assert f.stat().st_mtime_ns == stamp
    with pytest.raises(ValueError):
        tables.merge_into(frame(spark, [TARGET[0], TARGET[0]]), path, KEY, "ts")


def test_replace_table_reads_itself(spark, tmp_path):
    path = str(tmp_path / "versions")
    tables.save(spark.createDataFrame([(1,), (2,)], "n int"), path)
    tables.replace_table(tables.load(spark, path).withColumn("n", F.col("n") + 1), path)
    assert rows_of(tables.load(spark, path)) == [(2,), (3,)]
