"""Fills, lags and moving statistics."""

from __future__ import annotations

import math
import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from hourcast.functions.steps import epoch_seconds, is_calendar, place_step, step_interval, step_seconds
from hourcast.operators.chunks import (
    BLOCK,
    CHUNK,
    CHUNK_ROWS,
    OWN,
    POSITION,
    attach,
    block_window,
    carry_rows,
    chunk_window,
    drop_carry,
    last_known,
    overlap_by_rows,
    overlap_by_time,
    own_rows,
    time_chunk,
)
from hourcast.operators.resample import resample

# Moving sums over at least this many rows are put together from shorter ones.
LONG = 48
MOVING = {"avg": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}


def _fill(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    forward: bool,
    step: str,
    chunk_rows: int,
    keep_chunk: bool = False,
) -> DataFrame:
    nearest = F.max_by if forward else F.min_by
    parts = {
        c: (nearest(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))), last_known) for c in columns
    }
    rows = carry_rows(
        df.withColumn(CHUNK, time_chunk(ts, step, chunk_rows)), keys, CHUNK, parts, forward
    )
    running = chunk_window(keys, CHUNK, [F.col(ts).asc() if forward else F.col(ts).desc()])
    filled = drop_carry(rows.withColumns({c: last_known(F.col(c)).over(running) for c in columns}))
    return filled if keep_chunk else filled.drop(CHUNK)


def ffill(df, keys, ts, columns, step="hour", chunk_rows=CHUNK_ROWS, keep_chunk=False) -> DataFrame:
    """Replace a NULL by the last value before it in the same series; leading NULLs stay.

    ``keep_chunk`` leaves the chunk column in place, so that lags or moving
    statistics that follow work on the same partitioning.
    """
    names = [columns] if isinstance(columns, str) else columns
    return _fill(df, keys, ts, names, True, step, chunk_rows, keep_chunk)


def bfill(df, keys, ts, columns, step="hour", chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Replace a NULL by the next value in the same series; trailing NULLs stay."""
    return _fill(df, keys, ts, [columns] if isinstance(columns, str) else columns, False, step, chunk_rows)


def bfill_blocks(blocks: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str]) -> DataFrame:
    """Back-fill rows that still carry their block and position, in the partitioning they have.

    Only one summary row per block moves: the first known values of the later blocks.
    The summary reads the same columns as the rows, so both share one shuffle.
    """
    first = {
        c: (F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))), last_known) for c in columns
    }
    rows = carry_rows(blocks, keys, BLOCK, first, forward=False, spread=True)
    running = chunk_window(keys, BLOCK, [F.col(POSITION).desc()])
    return drop_carry(rows.withColumns({c: last_known(F.col(c)).over(running) for c in columns}))


def lag_value(value: str, n: int, window: WindowSpec, mode: str = "rows", step: str = "hour") -> Column:
    """The value ``n`` rows before, or exactly ``n`` steps of time before (ordered by ``place``)."""
    if mode == "rows":
        return F.lag(value, n).over(window)
    instant = -n * place_step(step)
    return F.first(value).over(window.rangeBetween(instant, instant))


def moving_value(
    value: str, width: int, fn: str, min_periods: int, window: WindowSpec, exclude_current: bool = False
) -> Column:
    """Moving statistic over ``width`` rows that is NULL below ``min_periods`` known values."""
    frame = window.rowsBetween(-width, -1) if exclude_current else window.rowsBetween(1 - width, 0)
    return F.when(F.count(value).over(frame) >= min_periods, MOVING[fn](value).over(frame))


def _inner_width(width: int) -> int:
    """Largest divisor of a width up to its square root."""
    return max(d for d in range(1, math.isqrt(width) + 1) if width % d == 0)


def _in_two_steps(fn: str, width: int) -> bool:
    return fn in ("sum", "avg") and width >= LONG and _inner_width(width) > 1


def _long_moving(
    df: DataFrame,
    value: str,
    specs: Mapping[str, tuple[int, str, int]],
    window: WindowSpec,
    exclude_current: bool,
) -> DataFrame:
    """Moving sums and means over many rows, as sums of shorter moving sums.

    A moving frame is summed anew for every row; 168 rows as 14 sums of 12 cost
    a sixth of that.
    """
    inner = {width: _inner_width(width) for width, _, _ in specs.values()}
    frames = {n: window.rowsBetween(1 - n, 0) for n in inner.values()}
    df = df.withColumns(
        {f"_sum_{n}": F.coalesce(F.sum(value).over(f), F.lit(0)) for n, f in frames.items()}
        | {f"_count_{n}": F.count(value).over(f) for n, f in frames.items()}
    )

    def total(kind: str, width: int) -> Column:
        n, first = inner[width], int(exclude_current)
        parts = [F.lag(f"_{kind}_{n}", i, 0).over(window) for i in range(first, width, n)]
        return reduce(operator.add, parts)

    def moving(width: int, fn: str, least: int) -> Column:
        known, result = total("count", width), total("sum", width)
        return F.when(known >= least, result if fn == "sum" else F.try_divide(result, known))

    out = df.withColumns({name: moving(*spec) for name, spec in specs.items()})
    return out.drop(*[f"_{kind}_{n}" for n in frames for kind in ("sum", "count")])


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    periods: Mapping[str, int] | None = None,
    moving: Mapping[str, tuple[int, str, int]] | None = None,
    mode: str = "rows",
    exclude_current: bool = False,
    step: str = "hour",
    chunk_rows: int = CHUNK_ROWS,
    back_fill: Sequence[str] = (),
) -> DataFrame:
    """Add lags (name to periods) and moving statistics (name to width, function, min_periods).

    Counted in rows, all of them share one set of blocks and one sort.  With
    ``mode='time'`` the lags are exact in time, on blocks of time, and moving
    statistics, which always count rows, follow on blocks of rows.  The columns
    named in ``back_fill`` are back-filled within the same blocks.
    """
    periods, moving = periods or {}, moving or {}
    if mode == "time" and periods and moving:
        df = windowed(df, keys, ts, value, periods, None, mode, False, step, chunk_rows)
        return windowed(
            df, keys, ts, value, None, moving, "rows", exclude_current, step, chunk_rows, back_fill
        )
    reach = max([*periods.values(), *[width for width, _, _ in moving.values()]])
    overlap = overlap_by_time if mode == "time" else overlap_by_rows
    blocks = overlap(df, keys, ts, reach, step=step, chunk_rows=chunk_rows)
    window = block_window(keys)
    lagged = {n: lag_value(value, p, window, mode, step) for n, p in periods.items()}
    long = {n: spec for n, spec in moving.items() if _in_two_steps(spec[1], spec[0])}
    stats = {
        n: moving_value(value, width, fn, least, window, exclude_current)
        for n, (width, fn, least) in moving.items()
        if n not in long
    }
    rows = blocks.withColumns(lagged | stats)
    if long:
        rows = _long_moving(rows, value, long, window, exclude_current)
    if back_fill:
        rows = bfill_blocks(rows.filter(OWN), keys, ts, back_fill)
    return own_rows(rows)


def lags(df, keys, ts, value, periods, mode="rows", step="hour", chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Add the value of earlier periods, counted in rows or in exact time."""
    return windowed(df, keys, ts, value, periods, None, mode, False, step, chunk_rows)


def rolling(df, keys, ts, value, specs, exclude_current=False, step="hour", chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Add moving statistics; ``specs`` maps a name to (width in rows, function, min_periods)."""
    return windowed(df, keys, ts, value, None, specs, "rows", exclude_current, step, chunk_rows)


def rolling_daily(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, days: int = 7, name: str = "rolling"
) -> DataFrame:
    """Daily means on a gap-free day grid and their moving mean over full ``days``."""
    daily = resample(df, keys, ts, value, "day", "avg", fill_gaps=True)
    return rolling(daily, keys, ts, value, {name: (days, "avg", days)}, step="day")


def time_step(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    name: str = "time_diff",
    step: str = "hour",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Seconds since the previous row of the series."""
    second = "_second"
    tagged = df.withColumn(CHUNK, time_chunk(ts, step, chunk_rows)).withColumn(second, epoch_seconds(ts))
    rows = carry_rows(tagged, keys, CHUNK, {second: (F.max(second), last_known)})
    previous = chunk_window(keys, CHUNK, [F.col(ts).asc()]).rowsBetween(-1, -1)
    return drop_carry(
        rows.withColumn(name, F.col(second) - F.first(second).over(previous)), CHUNK, second
    )


def continuity(df: DataFrame, keys: Sequence[str], ts: str, step: str = "hour") -> DataFrame:
    """Per series: are all steps regular, is any, how many gaps and missing steps.

    A calendar step is regular if it ends on the same day of the month, or on the last days of both months.
    """
    diff = F.col("time_diff")
    if is_calendar(step):
        now, size = F.col(ts).cast("timestamp"), place_step(step)
        before = F.timestamp_seconds(epoch_seconds(ts) - diff)
        steps = F.months_between(now, before) / size
        regular, gap, missing = before + step_interval(step) == now, steps > 1, F.floor(steps) - 1
        ends = (F.last_day(now) == now.cast("date")) & (F.last_day(before) == before.cast("date"))
        regular = regular | (ends & (steps == 1))
    else:
        seconds = step_seconds(step)
        regular, gap, missing = diff == seconds, diff > seconds, F.floor(diff / seconds) - 1
    return (
        time_step(df, keys, ts, "time_diff", step)
        .groupBy(*keys)
        .agg(
            F.bool_and(regular).alias("is_continuous"),
            F.bool_or(regular).alias("any_step_ok"),
            F.count_if(gap).alias("gaps"),
            F.coalesce(F.sum(F.when(gap, missing)), F.lit(0)).alias("missing_steps"),
        )
    )


def decompose(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    period: int,
    step: str = "month",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Additive seasonal decomposition: adds ``trend``, ``seasonal`` and ``residual``.

    The trend is the centred moving mean (half weights at both ends for an even
    period), the seasonal part the centred mean of the detrended values per phase.
    """
    half = period // 2
    index = "_index"
    blocks = overlap_by_rows(df, keys, ts, half, half, step, chunk_rows)
    window = block_window(keys)
    frame = window.rowsBetween(-half, half)
    total = F.sum(value).over(frame)
    if period % 2 == 0:
        total = total - 0.5 * (F.lag(value, half).over(window) + F.lead(value, half).over(window))
    trend = F.when(F.count(value).over(frame) == 2 * half + 1, total / period)
    rows = own_rows(blocks.withColumn("trend", trend), POSITION).withColumnRenamed(POSITION, index)
    rows = rows.withColumn("_phase", F.col(index) % period)
    # Reading the time here keeps this aggregate on the same shuffle as the rows.
    detrended = F.when(F.col(ts).isNotNull(), F.col(value) - F.col("trend"))
    phases = (
        rows.groupBy(*keys, "_phase")
        .agg(F.avg(detrended).alias("_raw"))
        .withColumn("seasonal", F.col("_raw") - F.avg("_raw").over(Window.partitionBy(*keys)))
        .drop("_raw")
    )
    return (
        attach(rows, phases, [*keys, "_phase"])
        .withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))
        .drop("_phase", index)
    )
