"""Fills, lags, moving statistics and decomposition against pandas and by hand."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import SCHEMA, frame, hour, pandas_of, random_series, rows_of, same, sorted_pandas

from hourcast.operators.chunks import with_row_index
from hourcast.operators.windows import (
    bfill,
    continuity,
    decompose,
    ffill,
    lags,
    rolling,
    rolling_daily,
    time_step,
    windowed,
)

KEYS = ["series"]
CASES = [(seed, rows) for seed in (1, 2, 3) for rows in (2, 5, 1000)]


def sample(seed):
    return random_series(seed, {"a": 40, "b": 3, "c": 90, "d": 1}, gap=0.3, unknown=0.4)


@pytest.mark.parametrize("seed,chunk", CASES)
def test_fills_match_pandas(spark, seed, chunk):
    rows = sample(seed)
    expected = pandas_of(rows)
    grouped = expected.groupby("series")["v"]
    df = frame(spark, rows)
    assert same(sorted_pandas(ffill(df, KEYS, "ts", "v", chunk_rows=chunk))["v"], grouped.ffill())
    assert same(sorted_pandas(bfill(df, KEYS, "ts", "v", chunk_rows=chunk))["v"], grouped.bfill())


def test_fill_edges(spark):
    rows = [("lead", hour(0), None), ("lead", hour(1), 5.0), ("lead", hour(2), None)]
    rows += [("void", hour(i), None) for i in range(3)]
    df = frame(spark, rows)
    assert rows_of(ffill(df, KEYS, "ts", "v", chunk_rows=1), "series", "v") == sorted(
        [("lead", None), ("lead", 5.0), ("lead", 5.0), ("void", None), ("void", None), ("void", None)], key=repr
    )
    once = ffill(df, KEYS, "ts", "v", chunk_rows=1)
    assert rows_of(ffill(once, KEYS, "ts", "v", chunk_rows=2)) == rows_of(once)


def test_bfill_stays_in_its_series(spark):
    rows = [("a", hour(0), 1.0), ("a", hour(1), None), ("b", hour(0), 7.0)]
    assert ("a", hour(1), None) in rows_of(bfill(frame(spark, rows), KEYS, "ts", "v"))


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_row_index(spark, chunk):
    rows = sample(4)
    out = sorted_pandas(with_row_index(frame(spark, rows), KEYS, "ts", "i", chunk_rows=chunk))
    assert list(out["i"]) == list(pandas_of(rows).groupby("series").cumcount())


@pytest.mark.parametrize("seed,chunk", CASES)
def test_lags_and_moving_match_pandas(spark, seed, chunk):
    rows = sample(seed)
    expected = pandas_of(rows)
    grouped = expected.groupby("series")["v"]
    moving = {"mean": (5, "avg", 3), "std": (5, "std", 2), "sum": (12, "sum", 1)}
    out = sorted_pandas(
        windowed(frame(spark, rows), KEYS, "ts", "v", {"l1": 1, "l7": 7}, moving, chunk_rows=chunk)
    )
    assert same(out["l1"], grouped.shift(1))
    assert same(out["l7"], grouped.shift(7))
    assert same(out["mean"], grouped.rolling(5, min_periods=3).mean())
    assert same(out["std"], grouped.rolling(5, min_periods=2).std())
    assert same(out["sum"], grouped.rolling(12, min_periods=1).sum())


@pytest.mark.parametrize("chunk", [2, 1000])
def test_back_fill_in_blocks_matches_pandas(spark, chunk):
    rows = sample(5)
    expected = pandas_of(rows)
    shifted = expected.groupby("series")["v"].shift(6)
    filled = shifted.groupby(expected["series"]).bfill()
    out = windowed(frame(spark, rows), KEYS, "ts", "v", {"l": 6}, chunk_rows=chunk, back_fill=["l"])
    assert same(sorted_pandas(out)["l"], filled)


@pytest.mark.parametrize("chunk", [2, 7, 1000])
def test_time_lags(spark, chunk):
    rows = sample(6)
    known = {(s, t): v for s, t, v in rows}
    out = lags(frame(spark, rows), KEYS, "ts", "v", {"l5": 5}, "time", chunk_rows=chunk)
    for r in out.collect():
        assert r["l5"] == known.get((r["series"], r["ts"] - timedelta(hours=5)))


def test_time_lags_with_moving(spark):
    rows = sample(7)
    both = windowed(
        frame(spark, rows), KEYS, "ts", "v", {"l": 5}, {"m": (3, "avg", 1)}, mode="time", chunk_rows=3
    )
    expected = pandas_of(rows).groupby("series")["v"].rolling(3, min_periods=1).mean()
    assert same(sorted_pandas(both)["m"], expected)


def test_rows_and_time_lags_differ_on_a_gap(spark):
    df = frame(spark, [("a", hour(0), 1.0), ("a", hour(2), 2.0)])
    assert rows_of(lags(df, KEYS, "ts", "v", {"l": 1}), "l") == [(1.0,), (None,)]
    assert rows_of(lags(df, KEYS, "ts", "v", {"l": 1}, "time"), "l") == [(None,), (None,)]


def test_moving_without_current_row(spark):
    rows = sample(8)
    out = rolling(frame(spark, rows), KEYS, "ts", "v", {"m": (4, "avg", 2)}, True, chunk_rows=3)
    grouped = pandas_of(rows).groupby("series")["v"]
    expected = grouped.transform(lambda s: s.shift(1).rolling(4, min_periods=2).mean())
    assert same(sorted_pandas(out)["m"], expected)


@pytest.mark.parametrize("exclude", [False, True])
@pytest.mark.parametrize("width,chunk", [(48, 10), (60, 1000), (53, 7)])
def test_long_moving_sums(spark, width, chunk, exclude):
    rows = random_series(9, {"a": 200, "b": 20}, gap=0.2, unknown=0.4)
    specs = {"s": (width, "sum", 5), "m": (width, "avg", 20)}
    out = sorted_pandas(rolling(frame(spark, rows), KEYS, "ts", "v", specs, exclude, chunk_rows=chunk))
    grouped = pandas_of(rows).groupby("series")["v"]
    moved = grouped.shift(1).groupby(pandas_of(rows)["series"]) if exclude else grouped
    assert same(out["s"], moved.rolling(width, min_periods=5).sum())
    assert same(out["m"], moved.rolling(width, min_periods=20).mean())


def test_moving_of_one_row(spark):
    out = rolling(frame(spark, [("a", hour(0), 3.0)]), KEYS, "ts", "v", {"s": (24, "std", 1), "t": (24, "sum", 1)})
    assert rows_of(out, "s", "t") == [(None, 3.0)]


def test_rolling_daily_counts_empty_days(spark):
    rows = [("a", hour(24 * d), float(d)) for d in (0, 1, 3, 4, 5)]
    out = rolling_daily(frame(spark, rows), KEYS, "ts", "v", 2, "m").orderBy("ts").collect()
    assert [r["v"] for r in out] == [0.0, 1.0, None, 3.0, 4.0, 5.0]
    assert [r["m"] for r in out] == [None, 0.5, None, None, 3.5, 4.5]


@pytest.mark.parametrize("chunk", [1, 1000])
def test_steps_and_continuity(spark, chunk):
    rows = [("a", hour(i), 1.0) for i in (0, 1, 3)] + [("b", hour(i), 1.0) for i in range(4)]
    rows += [("c", hour(i), 1.0) for i in (0, 3)] + [("d", hour(0), 1.0)]
    df = frame(spark, rows)
    steps = rows_of(time_step(df, KEYS, "ts", chunk_rows=chunk), "series", "time_diff")
    assert ("a", 7200) in steps and ("c", 10800) in steps and ("d", None) in steps
    out = {r["series"]: r for r in continuity(df, KEYS, "ts").collect()}
    assert (out["a"]["is_continuous"], out["a"]["any_step_ok"], out["a"]["gaps"], out["a"]["missing_steps"]) == (
        False, True, 1, 1,
    )
    assert out["b"]["is_continuous"] is True and out["b"]["gaps"] == 0
    assert (out["c"]["any_step_ok"], out["c"]["missing_steps"]) == (False, 2)
    assert out["d"]["is_continuous"] is None and out["d"]["missing_steps"] == 0


def months(n):
    return [pd.Timestamp(2015, 1, 1) + pd.DateOffset(months=i) for i in range(n)]


@pytest.mark.parametrize("chunk", [8, 1000])
def test_decompose_line_and_pattern(spark, chunk):
    pattern = np.array([5, -3, 2, 0, 1, -4, 6, -2, -1, -5, 3, -2], dtype=float)
    rows = [("a", t.to_pydatetime(), float(10.0 + 2 * i + pattern[i % 12])) for i, t in enumerate(months(48))]
    out = decompose(frame(spark, rows), KEYS, "ts", "v", 12, chunk_rows=chunk).orderBy("ts").toPandas()
    inside = out.iloc[6:-6]
    assert out["trend"].isna().sum() == 12 and out["trend"].iloc[:6].isna().all()
    assert np.allclose(inside["residual"], 0, atol=1e-9)
    assert np.allclose(inside["trend"], [10.0 + 2 * i for i in range(6, 42)])
    assert np.allclose(out["seasonal"], np.tile(pattern - pattern.mean(), 4))


def test_decompose_odd_period(spark):
    rows = [("a", hour(i), float(i) + (i % 3)) for i in range(12)]
    out = decompose(frame(spark, rows), KEYS, "ts", "v", 3, step="hour").orderBy("ts").toPandas()
    assert np.allclose(out["trend"].iloc[1:-1], [i + 1.0 for i in range(1, 11)])
    assert abs(out["seasonal"].iloc[:3].sum()) < 1e-9


def test_empty_input(spark):
    empty = frame(spark, [], SCHEMA)
    assert ffill(empty, KEYS, "ts", "v").count() == 0
    assert bfill(empty, KEYS, "ts", "v").count() == 0
    assert windowed(empty, KEYS, "ts", "v", {"l": 1}, {"m": (2, "avg", 1)}, back_fill=["l"]).count() == 0
    assert lags(empty, KEYS, "ts", "v", {"l": 1}, "time").count() == 0
    assert continuity(empty, KEYS, "ts").count() == 0
    assert decompose(empty, KEYS, "ts", "v", 12).count() == 0
    assert rolling_daily(empty, KEYS, "ts", "v").count() == 0


def test_timestamps_with_zone(spark):
    rows = [("a", datetime(2024, 1, 1, i), float(i) if i % 2 else None) for i in range(6)]
    df = frame(spark, rows, "series string, ts timestamp, v double")
    out = ffill(df, KEYS, "ts", "v", chunk_rows=2).orderBy("ts")
    assert [r["v"] for r in out.collect()] == [None, 1.0, 1.0, 3.0, 3.0, 5.0]
