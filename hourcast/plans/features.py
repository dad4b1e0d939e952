"""Feature rows for training and for the next period, from one configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from hourcast.functions.calendar import CALENDAR, calendar_parts
from hourcast.functions.keys import one_hot, row_id
from hourcast.functions.steps import place, step_interval
from hourcast.operators.chunks import last_known
from hourcast.operators.resample import day_spine
from hourcast.operators.windows import lag_value, moving_value, windowed

# Names, widths and lags of the hourly feature set.
HOURLY_LAGS = {
    "PREV_DAY_CONSUMPTION": 24,
    "PREV_WEEK_CONSUMPTION": 168,
    "PREVIOUS_MONTH_CONSUMPTION": 720,
}
HOURLY_MOVING = {
    "ROLLING_MEAN_24H": (24, "avg", 24),
    "ROLLING_STD_24H": (24, "std", 24),
    "ROLLING_SUM_7D": (168, "sum", 1),
}


@dataclass(frozen=True)
class FeatureConfig:
    """What to build; training and serving share it, so their features agree.

    ``values`` are the series that get a flag.  Lags are exact in time, so "a day before" is that also after a
    gap; ``mode='rows'`` counts rows instead.
    ``exclude_current`` keeps the label out of its own moving statistics.
    ``future_min_periods`` lets a series with a short history still be scored.
    """

    values: Sequence[str]
    lags: Mapping[str, int] = field(default_factory=lambda: dict(HOURLY_LAGS))
    moving: Mapping[str, tuple[int, str, int]] = field(default_factory=lambda: dict(HOURLY_MOVING))
    step: str = "hour"
    mode: str = "time"
    exclude_current: bool = False
    back_fill: bool = True
    future_min_periods: int = 1
    id_column: str = "CONSUMPTION_ID"
    chunk_rows: int = 1024

    def __post_init__(self) -> None:
        names = [*self.lags, *self.moving, *CALENDAR, self.id_column, *self.values]
        if len({n.lower() for n in names}) < len(names):
            raise ValueError(f"feature names are not distinct: {names}")

    @property
    def reach(self) -> int:
        return max([0, *self.lags.values(), *[width for width, _, _ in self.moving.values()]])

    @property
    def filled(self) -> list[str]:
        """Columns that are NULL at the start of a series and get back-filled."""
        return [*self.lags, *[n for n, (_, _, least) in self.moving.items() if least > 1]]


def _finish(df: DataFrame, key: str, ts: str, value: str, cfg: FeatureConfig) -> DataFrame:
    """Calendar parts, flags and id: plain projections over the windowed columns."""
    return one_hot(
        df.withColumns(calendar_parts(ts) | {cfg.id_column: row_id(key, ts)}), key, cfg.values
    )


def build_features(
    df: DataFrame, key: str, ts: str, value: str, cfg: FeatureConfig
) -> DataFrame:
    """One feature row per input row, keyed by ``cfg.id_column``; keeps series, time and value.

    Lags, moving statistics and back-fill never cross from one series into the
    next, and run on blocks of a series, so a long series spreads over tasks.
    """
    built = windowed(
        df.select(key, ts, value), [key], ts, value, cfg.lags, cfg.moving,
        cfg.mode, cfg.exclude_current, cfg.step, cfg.chunk_rows,
        cfg.filled if cfg.back_fill else (),
    )
    return _finish(built, key, ts, value, cfg)


def history_window(day: Column, cfg: FeatureConfig) -> Column:
    """First instant of history that features of ``day`` can depend on."""
    return day - step_interval(cfg.step, cfg.reach) - step_interval("day")


def build_future_features(
    history: DataFrame,
    series: DataFrame,
    key: str,
    ts: str,
    value: str,
    day: Column,
    cfg: FeatureConfig,
) -> DataFrame:
    """Feature rows for every step of ``day`` and every row of ``series``.

    Only the history the longest lag reaches is read, so each series has at
    most ``cfg.reach`` steps plus two days here whatever the size of the table,
    and one plain window per series is enough.  The value is carried forward
    over the day for the moving statistics; lags see known values only.
    """
    kind = history.schema[ts].dataType
    start = day.cast(kind)
    recent = history.filter((F.col(ts) < start) & (F.col(ts) >= history_window(start, cfg)))
    spine = day_spine(series.select(key), ts, start, cfg.step)
    rows = recent.select(key, ts, value).unionByName(spine, allowMissingColumns=True)
    if cfg.mode == "time":
        rows = rows.withColumn("_order", place(ts, cfg.step))
    else:
        rows = rows.withColumn("_order", F.col(ts))
    window = Window.partitionBy(key).orderBy("_order")
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = window.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns(
        {n: lag_value(value, p, window, cfg.mode, cfg.step) for n, p in cfg.lags.items()}
        | {value: last_known(F.col(value)).over(so_far)}
    )
    rows = rows.withColumns(
        {
            n: moving_value(value, width, fn, cfg.future_min_periods, window, cfg.exclude_current)
            for n, (width, fn, _) in cfg.moving.items()
        }
    )
    if cfg.back_fill:
        rows = rows.withColumns(
            {n: F.first(n, ignorenulls=True).over(later) for n in cfg.lags}
        )
    target = rows.filter(F.col(ts) >= start).drop(value, "_order")
    return _finish(target, key, ts, value, cfg)


def feature_columns(df: DataFrame, label: str, exclude: Sequence[str] = ()) -> list[str]:
    """All columns but the label and the excluded key and time columns."""
    return [c for c in df.columns if c != label and c not in exclude]
