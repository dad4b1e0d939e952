"""Time steps such as ``hour`` or ``15 minutes``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def split_step(step: str) -> tuple[int, str]:
    """``'15 minutes'`` -> ``(15, 'minute')``; a bare unit counts as one."""
    count, _, unit = step.strip().lower().rpartition(" ")
    unit = unit.removesuffix("s")
    if unit not in UNIT_SECONDS and unit not in MONTHS:
        raise ValueError(f"unknown time step: {step!r}")
    return int(count or 1), unit


def step_seconds(step: str) -> int:
    """Length of a step in seconds; calendar steps count their longest length."""
    count, unit = split_step(step)
    if unit in MONTHS:
        return count * MONTHS[unit] * 31 * UNIT_SECONDS["day"]
    return count * UNIT_SECONDS[unit]


def is_calendar(step: str) -> bool:
    return split_step(step)[1] in MONTHS


def step_interval(step: str, times: int = 1) -> Column:
    """The interval literal that covers ``times`` steps."""
    count, unit = split_step(step)
    if unit == "quarter":
        count, unit = count * 3, "month"
    return F.expr(f"interval {count * times} {unit}")


def epoch_seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp with or without zone."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return column.cast("timestamp").cast("long")


def place(ts: str | Column, step: str) -> Column:
    """A number that grows by ``place_step`` from one step to the next: seconds, or months for calendar steps.

    Calendar steps compare calendar months, so they suit series with one row per step.
    """
    column = F.col(ts) if isinstance(ts, str) else ts
    if is_calendar(step):
        return (F.year(column) * 12 + F.month(column) - 1).cast("long")
    return epoch_seconds(column)


def place_step(step: str) -> int:
    count, unit = split_step(step)
    return count * MONTHS[unit] if unit in MONTHS else step_seconds(step)


def truncate(ts: str | Column, step: str, dtype: str = "timestamp_ntz") -> Column:
    """Start of the step (hour, day, 15 minutes, ...) that holds ``ts``; the week starts on Monday."""
    column = F.col(ts) if isinstance(ts, str) else ts
    count, unit = split_step(step)
    if count == 1:
        return F.date_trunc(unit, column).cast(dtype)
    if is_calendar(step):
        raise ValueError(f"cannot truncate to {step!r}")
    seconds = step_seconds(step)
    return F.timestamp_seconds(F.floor(epoch_seconds(column) / seconds) * seconds).cast(dtype)
