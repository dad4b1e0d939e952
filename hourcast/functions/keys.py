"""Series flags and row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column per named category; a NULL category, and one that is not named, is 0 everywhere."""
    return df.withColumns(
        {v: F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
    )


def one_hot_decode(df: DataFrame, values: Sequence[str], name: str) -> DataFrame:
    """The category whose flag is 1; empty text if there is none."""
    flags = [F.when(F.col(f"`{v}`") == 1, F.lit(v)).otherwise(F.lit("")) for v in values]
    return df.withColumn(name, F.concat(*flags))


def melt_category(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str) -> DataFrame:
    """Wide flags to one row per set flag."""
    flags = [F.col(f"`{v}`") for v in values]
    long = df.unpivot(list(ids), flags, name, "_flag")
    return long.filter(F.col("_flag") == 1).drop("_flag")


def row_id(key: str, ts: str, separator: str = "_") -> Column:
    return F.concat_ws(separator, F.col(key), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def with_row_id(df: DataFrame, key: str, ts: str, name: str = "CONSUMPTION_ID") -> DataFrame:
    """Composite key ``series_yyyy-MM-dd HH:mm:ss`` in a format that no session setting changes."""
    return df.withColumn(name, row_id(key, ts))


def id_to_series(df: DataFrame, id_column: str, name: str) -> DataFrame:
    """The series part of a composite key: all but the separator and the 19 characters of the time."""
    text = F.col(id_column)
    return df.withColumn(name, F.left(text, F.length(text) - 20))
