"""Resampling, grids, cleaning, keys and calendar parts."""

from datetime import date, datetime

import pytest
from helpers import SCHEMA, frame, hour, pandas_of, random_series, rows_of
from pyspark.sql import functions as F

from hourcast.functions.calendar import calendar_features, parse_interval, with_date_from_parts
from hourcast.functions.keys import (
    id_to_series,
    melt_category,
    one_hot,
    one_hot_decode,
    with_row_id,
)
from hourcast.functions.steps import split_step, step_seconds
from hourcast.operators.clean import (
    between_ts,
    cast_columns,
    dedupe,
    drop_incomplete,
    filter_part,
    nullify_invalid,
)
from hourcast.operators.resample import (
    asfreq_month_end,
    day_spine,
    regularize,
    resample,
    time_grid,
)
from hourcast.operators.training import shift_months, time_split, with_split

KEYS = ["series"]


def test_resample_sum_and_mean(spark):
    quarter = [("a", datetime(2024, 1, 1, 0, m), float(m)) for m in (0, 15, 30, 45)]
    df = frame(spark, quarter)
    assert rows_of(resample(df, KEYS, "ts", "v", "hour", "sum")) == [("a", hour(0), 90.0)]
    assert rows_of(resample(df, KEYS, "ts", "v", "hour", "avg")) == [("a", hour(0), 22.5)]


def test_resample_to_quarter_hours(spark):
    rows = [("a", datetime(1969, 12, 31, 23, 50), 1.0), ("a", datetime(2024, 1, 1, 0, 29, 59), 2.0), ("a", datetime(2024, 1, 1, 0, 15), 3.0)]
    out = resample(frame(spark, rows), KEYS, "ts", "v", "15 minutes", "max")
    assert rows_of(out) == [("a", datetime(1969, 12, 31, 23, 45), 1.0), ("a", datetime(2024, 1, 1, 0, 15), 3.0)]
    with pytest.raises(ValueError):
        resample(frame(spark, rows), KEYS, "ts", "v", "2 months", "sum")


def test_resample_fills_gaps_on_request(spark):
    df = frame(spark, [("a", hour(0), 1.0), ("a", hour(48), 2.0)])
    assert resample(df, KEYS, "ts", "v", "day", "avg").count() == 2
    assert [r["v"] for r in resample(df, KEYS, "ts", "v", "day", "avg", True).orderBy("ts").collect()] == [
        1.0, None, 2.0,
    ]


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_time_grid_in_pieces(spark, rows):
    bounds = spark.createDataFrame([("a", hour(0), hour(10)), ("b", hour(5), hour(5))], "series string, lo timestamp_ntz, hi timestamp_ntz")
    grid = time_grid(bounds, "ts", "lo", "hi", "hour", rows)
    assert rows_of(grid) == sorted([("a", hour(i)) for i in range(11)] + [("b", hour(5))], key=repr)


def test_regularize_matches_pandas(spark):
    rows = random_series(1, {"a": 50, "b": 9})
    expected = []
    for name, part in pandas_of(rows).groupby("series"):
        grid = part.set_index("ts")["v"].asfreq("h")
        expected += [(name, t.to_pydatetime(), None if v != v else v) for t, v in grid.items()]
    assert rows_of(regularize(frame(spark, rows), KEYS, "ts", "hour")) == sorted(expected, key=repr)


def test_month_end_takes_the_value_at_midnight(spark):
    rows = [("a", datetime(2024, 1, 31), 1.0), ("a", datetime(2024, 1, 31, 5), 9.0), ("a", datetime(2024, 2, 28), 2.0), ("a", datetime(2024, 3, 31), 3.0)]
    out = asfreq_month_end(frame(spark, rows), KEYS, "ts").orderBy("ts").collect()
    assert [(r["ts"], r["v"]) for r in out] == [
        (datetime(2024, 1, 31), 1.0), (datetime(2024, 2, 29), None), (datetime(2024, 3, 31), 3.0),
    ]


def test_day_spine(spark):
    series = spark.createDataFrame([("a",), ("b",)], "series string")
    out = day_spine(series, "ts", F.lit(hour(24)).cast("timestamp_ntz"))
    assert out.count() == 48
    assert rows_of(out.agg(F.min("ts"), F.max("ts"))) == [(hour(24), hour(47))]


def test_nullify_and_drop(spark):
    rows = [("a", hour(0), 0.0), ("a", hour(1), -1.0), ("a", hour(2), 2.0), ("a", hour(3), None)]
    df = nullify_invalid(frame(spark, rows), "v")
    assert [r["v"] for r in df.orderBy("ts").collect()] == [None, None, 2.0, None]
    assert drop_incomplete(df, ["v"]).count() == 1
    assert drop_incomplete(df).count() == 1


def test_dedupe_prefers_and_is_stable(spark):
    rows = [("a", hour(0), 1.0), ("a", hour(0), 3.0), ("a", hour(0), None), ("b", hour(0), 2.0)]
    df = frame(spark, rows)
    assert rows_of(dedupe(df, ["series", "ts"], ["v"])) == [("a", hour(0), 3.0), ("b", hour(0), 2.0)]
    assert rows_of(dedupe(df.repartition(3), ["series", "ts"], ["v"])) == rows_of(dedupe(df, ["series", "ts"], ["v"]))


def test_interval_text(spark):
    texts = ["01.02.2020 03:00 - 01.02.2020 04:00", "31.02.2020 03:00 - x", "01.02.2020 03:00", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "datetime string")
    out = [r[0] for r in df.select(parse_interval("datetime").cast("timestamp_ntz")).collect()]
    assert out == [datetime(2020, 2, 1, 3), None, datetime(2020, 2, 1, 3), None, None]


def test_calendar(spark):
    df = frame(spark, [("a", datetime(2021, 1, 1, 13), 1.0)])
    row = calendar_features(df, "ts").first()
    assert [row[c] for c in ("HOUR", "DAY_OF_WEEK", "MONTH", "QUARTER", "YEAR", "DAY_OF_YEAR", "DAY_OF_MONTH", "WEEK_OF_YEAR")] == [13, 4, 1, 1, 2021, 1, 1, 53]
    assert with_date_from_parts(calendar_features(df, "ts")).first()["date"] == date(2021, 1, 1)


def test_flags_round_trip(spark):
    df = frame(spark, [("a", hour(0), 1.0), ("b.c", hour(1), 2.0), (None, hour(2), 3.0)])
    names = ["a", "b.c"]
    wide = one_hot(df, "series", names)
    assert [tuple(r) for r in wide.orderBy("ts").select("a", "`b.c`").collect()] == [(1, 0), (0, 1), (0, 0)]
    assert rows_of(one_hot_decode(wide.drop("series"), names, "series"), "v", "series") == [(1.0, "a"), (2.0, "b.c"), (3.0, "")]
    assert rows_of(melt_category(wide.drop("series"), ["ts", "v"], names, "series"), "v", "series") == [(1.0, "a"), (2.0, "b.c")]


def test_row_id(spark):
    df = with_row_id(frame(spark, [("north_west", hour(5), 1.0)]), "series", "ts", "id")
    assert df.first()["id"] == "north_west_2024-01-01 05:00:00"
    assert id_to_series(df, "id", "s").first()["s"] == "north_west"


def test_ranges(spark):
    df = frame(spark, [("a", hour(i), float(i)) for i in range(4)])
    assert between_ts(df, "ts", str(hour(1)), str(hour(3))).count() == 2
    assert between_ts(df, "ts", hour(1), hour(3), "both").count() == 3
    assert between_ts(df, "ts", hour(1), hour(3), "right").count() == 2


def test_split_is_disjoint_and_complete(spark):
    df = frame(spark, [("a", hour(i), 1.0) for i in range(48)])
    bounds = {"train": (hour(0), hour(30)), "test": (hour(30), hour(48))}
    parts = time_split(df, "ts", bounds)
    assert parts["train"].count() == 30 and parts["test"].count() == 18
    assert parts["train"].join(parts["test"], "ts").count() == 0
    labels = with_split(df, "ts", bounds).groupBy("split").count()
    assert rows_of(labels) == [("test", 18), ("train", 30)]


def test_month_ends(spark):
    days = [date(2024, 1, 31), date(2023, 11, 30), date(2023, 12, 31), date(2024, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert [r[0] for r in df.select(shift_months(F.col("d"), 3)).collect()] == [
        date(2024, 4, 30), date(2024, 2, 29), date(2024, 3, 31), date(2024, 5, 29),
    ]


def test_filter_part_and_casts(spark):
    df = frame(spark, [("a", datetime(2022, 4, 4), 1.5), ("a", datetime(2022, 4, 20), 2.5)])
    assert filter_part(df, "ts", 2022, 4, 14).count() == 1
    assert cast_columns(df, {"v": "int"}).schema["v"].dataType.simpleString() == "int"
    text = spark.createDataFrame([("x",)], "t string")
    assert cast_columns(text, {"t": "int"}, strict=False).first()["t"] is None


def test_steps():
    assert split_step("15 minutes") == (15, "minute") and step_seconds("15 minutes") == 900
    assert step_seconds("day") == 86400
    with pytest.raises(ValueError):
        split_step("fortnight")


def test_empty(spark):
    empty = frame(spark, [], SCHEMA)
    assert regularize(empty, KEYS, "ts", "hour").count() == 0
    assert asfreq_month_end(empty, KEYS, "ts").count() == 0
    assert dedupe(empty, ["series"], ["ts"]).count() == 0
