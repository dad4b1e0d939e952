"""Cleaning: invalid values, incomplete rows, filters, duplicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def invalid_rows(df: DataFrame, value: str, limit: float = 0) -> DataFrame:
    """Rows whose value is at or below ``limit``."""
    return df.filter(F.col(value) <= limit)


def nullify_invalid(df: DataFrame, value: str, limit: float = 0) -> DataFrame:
    """Set values at or below ``limit`` to NULL."""
    return df.withColumn(value, F.when(F.col(value) > limit, F.col(value)))


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in the named columns (all columns by default)."""
    return df.dropna(how="any", subset=list(columns) if columns else None)


def drop_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows whose named columns, e.g. a metric, are NULL."""
    return drop_incomplete(df, columns)


def with_literals(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Constant columns; a value may be a Column such as ``lit(None).cast('double')``."""
    return df.withColumns({c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()})


def cast_columns(df: DataFrame, types: dict[str, str], strict: bool = True) -> DataFrame:
    """Cast columns; with ``strict=False`` unreadable values become NULL."""
    return df.withColumns(
        {c: F.col(c).cast(t) if strict else F.col(c).try_cast(t) for c, t in types.items()}
    )


def between_ts(df: DataFrame, ts: str, start: Any, end: Any, closed: str = "left") -> DataFrame:
    """Rows of a time range, half-open by default; the bare column lets the filter reach the scan."""
    column, kind = F.col(ts), df.schema[ts].dataType
    low, high = F.lit(start).cast(kind), F.lit(end).cast(kind)
    lower = column >= low if closed in ("left", "both") else column > low
    upper = column <= high if closed in ("right", "both") else column < high
    return df.filter(lower & upper)


def only_series(df: DataFrame, key: str, values: str | Iterable[str]) -> DataFrame:
    return df.filter(F.col(key).isin([values] if isinstance(values, str) else list(values)))


def filter_part(
    df: DataFrame, ts: str, year: int | None = None, month: int | None = None, week: int | None = None
) -> DataFrame:
    """Rows of a calendar year, month and/or ISO week."""
    for part, wanted in ((F.year, year), (F.month, month), (F.weekofyear, week)):
        if wanted is not None:
            df = df.filter(part(ts) == wanted)
    return df


def dedupe(df: DataFrame, keys: Sequence[str], prefer: Sequence[str], largest: bool = True) -> DataFrame:
    """One row per key: the one with the largest (or smallest) ``prefer`` columns.

    An aggregate instead of a numbered window, so that copies of one key are
    combined on the map side and never gathered in one task.  Ties are broken by
    the remaining columns that have an order (maps have none), so the result does
    not depend on the partitioning.
    """
    rest = [c for c in df.columns if c not in (*keys, *prefer)]
    ordered = [c for c in rest if "map<" not in df.schema[c].dataType.simpleString()]
    if len(ordered) < len(rest):
        row = F.struct(*prefer, *rest)
        best = (F.max_by if largest else F.min_by)(row, F.struct(*prefer, *ordered))
    else:
        best = (F.max if largest else F.min)(F.struct(*prefer, *rest))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*").select(*df.columns)
