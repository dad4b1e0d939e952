"""Changing the grain of a series: down-sampling, regular grids, spines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hourcast.functions.steps import is_calendar, step_interval, truncate
from hourcast.operators.chunks import CHUNK_ROWS

AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def _type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def resample(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    step: str,
    agg: str,
    fill_gaps: bool = False,
) -> DataFrame:
    """One row per series and step.  The aggregate combines on the map side.

    ``sum`` of sub-hourly samples is not a mean load: choose ``agg`` by unit.
    ``fill_gaps`` adds the missing steps with a NULL value.
    """
    start = truncate(ts, step, _type_of(df, ts)).alias(ts)
    out = df.groupBy(*keys, start).agg(AGGREGATES[agg](value).alias(value))
    return regularize(out, keys, ts, step) if fill_gaps else out


def time_grid(bounds: DataFrame, ts: str, lo: str, hi: str, step: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per step from ``lo`` to ``hi`` (inclusive) of each row of ``bounds``.

    Long ranges are expanded in two stages so that no row ever holds a whole series.
    """
    if is_calendar(step):
        return bounds.select(
            *[c for c in bounds.columns if c not in (lo, hi)],
            F.explode(F.sequence(lo, hi, step_interval(step))).alias(ts),
        )
    others = [c for c in bounds.columns if c not in (lo, hi)]
    pieces = bounds.select(*others, hi, F.explode(F.sequence(lo, hi, step_interval(step, rows))).alias("_from"))
    last = F.least(F.col(hi), F.col("_from") + step_interval(step, rows - 1))
    return pieces.select(*others, F.explode(F.sequence(F.col("_from"), last, step_interval(step))).alias(ts))


def regularize(df: DataFrame, keys: Sequence[str], ts: str, step: str) -> DataFrame:
    """Every step between the first and last row of each series; new rows are NULL."""
    bounds = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    spine = time_grid(bounds, ts, "_lo", "_hi", step)
    return spine.join(df, [*keys, ts], "left").select(*df.columns)


def asfreq_month_end(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """The row at midnight of each month's last day, NULL where the series has none."""
    kind = _type_of(df, ts)
    bounds = df.groupBy(*keys).agg(
        F.trunc(F.min(ts), "month").alias("_lo"), F.trunc(F.max(ts), "month").alias("_hi")
    )
    months = time_grid(bounds, ts, "_lo", "_hi", "month")
    spine = months.withColumn(ts, F.last_day(ts).cast(kind))
    return spine.join(df, [*keys, ts], "left").select(*df.columns)


def future_spine(series: DataFrame, ts: str, start: Column, end: Column, step: str = "hour") -> DataFrame:
    """Every step from ``start`` to ``end`` (inclusive) for each row of ``series``."""
    return series.select("*", F.explode(F.sequence(start, end, step_interval(step))).alias(ts))


def day_spine(series: DataFrame, ts: str, day: Column, step: str = "hour") -> DataFrame:
    """All steps of one day for each series; ``day`` is a timestamp at midnight."""
    end = day + step_interval("day") - step_interval(step)
    return future_spine(series, ts, day, end, step)
