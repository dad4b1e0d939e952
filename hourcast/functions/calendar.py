"""Calendar parts and date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Names of the calendar features in the order of the model schema.
CALENDAR = [
    "HOUR", "DAY_OF_WEEK", "MONTH", "QUARTER", "YEAR", "DAY_OF_YEAR", "DAY_OF_MONTH", "WEEK_OF_YEAR",
]


def calendar_parts(ts: str) -> dict[str, Column]:
    """Monday is day 0 of the week; the week number is the ISO week."""
    parts = [
        F.hour(ts), F.weekday(ts), F.month(ts), F.quarter(ts),
        F.year(ts), F.dayofyear(ts), F.dayofmonth(ts), F.weekofyear(ts),
    ]
    return dict(zip(CALENDAR, parts, strict=True))


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns(calendar_parts(ts))


def with_date_from_parts(df: DataFrame, name: str = "date") -> DataFrame:
    """The calendar date rebuilt from its feature columns."""
    return df.withColumn(name, F.make_date("YEAR", "MONTH", "DAY_OF_MONTH"))


def parse_interval(text: str | Column, separator: str = " - ", pattern: str = "dd.MM.yyyy HH:mm") -> Column:
    """Start of an interval text such as ``01.02.2020 03:00 - 01.02.2020 04:00``; NULL if unreadable."""
    column = F.col(text) if isinstance(text, str) else text
    start = F.split_part(column, F.lit(separator), F.lit(1))
    return F.try_to_timestamp(start, F.lit(pattern))
