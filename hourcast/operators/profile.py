"""Profiles of a series table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hourcast.operators.chunks import attach, cumulative_counts, measured_side

PARTS = {
    "year": F.year,
    "month": F.month,
    "weekday": F.dayofweek,  # Sunday is 1
    "hour": F.hour,
}


def count_by_part(df: DataFrame, ts: str, part: str, name: str = "n") -> DataFrame:
    """Rows per calendar part."""
    return df.groupBy(PARTS[part](ts).alias(part)).agg(F.count(F.lit(1)).alias(name))


def count_by_series(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def mean_of(df: DataFrame, expr: Column, by: Sequence[str] = (), name: str = "mean") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(expr).alias(name))


def mean_by_series(df: DataFrame, keys: Sequence[str], value: str, name: str = "mean") -> DataFrame:
    return mean_of(df, F.col(value), keys, name)


def monthly_sum(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, name: str = "total"
) -> DataFrame:
    return (
        df.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month"), *keys)
        .agg(F.sum(value).alias(name))
        .orderBy("year", "month", *keys)
    )


def hour_heatmap(df: DataFrame, key: str, ts: str, value: str, part: str = "hour") -> DataFrame:
    """Mean per series and hour of day (or month of year) as a matrix with fixed columns."""
    slots = range(24) if part == "hour" else range(1, 13)
    wide = df.withColumn("_part", PARTS[part](ts)).groupBy(key).pivot("_part", list(slots)).agg(F.avg(value))
    return wide.select(key, *[F.col(f"`{i}`").alias(f"{part[0]}{i:02d}") for i in slots])


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs per column, in total, and as a percentage of the rows, in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
    )
    total = reduce(lambda a, b: a + b, [F.col(f"{c}_nulls") for c in columns])
    return counts.withColumns(
        {"total_nulls": total, "null_pct": F.try_divide(total * F.lit(100.0), F.col("rows"))}
    )


def duplicate_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each set of equal rows; copies combine on the map side."""
    return (
        df.groupBy(*(columns or df.columns))
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
        )
        .withColumn("duplicate_pct", F.try_divide(F.col("duplicates") * F.lit(100.0), F.col("rows")))
    )


def invalid_count(df: DataFrame, value: str, limit: float = 0) -> DataFrame:
    rows = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value) <= limit).alias("invalid")
    )
    return rows.withColumn("invalid_pct", F.try_divide(F.col("invalid") * F.lit(100.0), F.col("rows")))


def summary_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum: one row per column, one pass."""
    def stats(c: str) -> Column:
        return F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(c).cast("double").alias("mean"),
            F.stddev_samp(c).alias("stddev"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        )

    return df.agg(F.array(*[stats(c) for c in columns]).alias("_rows")).select(F.inline("_rows"))


def minmax(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        *[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("min", F.min), ("max", F.max))]
    )


def extreme_times(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """First time of the smallest and of the largest value per series."""
    known = df.filter(F.col(value).isNotNull())
    low = F.min(F.struct(F.col(value).alias("v"), F.col(ts).alias("t")))
    high = F.min(F.struct((-F.col(value)).alias("v"), F.col(ts).alias("t")))
    return known.groupBy(*keys).agg(low.alias("_low"), high.alias("_high")).select(
        *keys,
        F.col("_low.t").alias("min_time"),
        F.col("_low.v").alias("min_value"),
        F.col("_high.t").alias("max_time"),
        (-F.col("_high.v")).alias("max_value"),
    )


def value_cells(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count per group and distinct value: the map side combines copies, the shuffle key is the value."""
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def _ranked(df: DataFrame, cells: DataFrame, by: Sequence[str], value: str, side: int | None) -> DataFrame:
    return cumulative_counts(cells, by, value, ["n"], side or measured_side(df, [value], by))


def _at_rank(value: str, rank: Column) -> Column:
    """Aggregate that picks the value at a one-based rank."""
    hit = (F.col("n_upto") >= rank) & (F.col("n_upto") - F.col("n") < rank)
    return F.max(F.when(hit, F.col(value)))


def _disc(value: str, p: float) -> Column:
    return _at_rank(value, F.greatest(F.ceil(F.col("n_total") * F.lit(p)), F.lit(1)))


def _cont(value: str, p: float) -> Column:
    place = (F.col("n_total") - 1) * F.lit(p)
    low, high = _at_rank(value, F.floor(place) + 1), _at_rank(value, F.ceil(place) + 1)
    share = F.max(place - F.floor(place))
    return low + (high - low) * share


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: Sequence[str] = (),
    interpolate: bool = False,
    side: int | None = None,
) -> DataFrame:
    """Exact quantiles per group: data points by rank, or linearly interpolated.

    Works on value counts in ``side`` squared slots, so neither a hot group nor a
    wide value range is ever sorted or held by one task.  Without ``side`` it is
    set from the measured number of distinct values (one more pass over the column).
    """
    pick = _cont if interpolate else _disc
    ranked = _ranked(df, value_cells(df, value, by), by, value, side)
    return ranked.groupBy(*by).agg(*[pick(value, p).alias(name) for name, p in probs.items()])


def iqr_outliers(
    df: DataFrame, value: str, by: Sequence[str] = (), factor: float = 1.5, side: int | None = None
) -> DataFrame:
    """Rank-based quartiles, fences, and the number of rows strictly outside them."""
    cells = value_cells(df, value, by)
    quartiles = _ranked(df, cells, by, value, side).groupBy(*by).agg(
        _disc(value, 0.25).alias("q1"), _disc(value, 0.75).alias("q3")
    )
    spread = (F.col("q3") - F.col("q1")) * F.lit(factor)
    fences = quartiles.withColumns({"lower": F.col("q1") - spread, "upper": F.col("q3") + spread})
    outside = (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    return attach(cells, fences, by).groupBy(*by).agg(
        *[F.first(c).alias(c) for c in ("q1", "q3", "lower", "upper")],
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outliers"),
    )


def box_stats(
    df: DataFrame, value: str, by: Sequence[str] = (), factor: float = 1.5, side: int | None = None
) -> DataFrame:
    """Minimum, interpolated quartiles, maximum, and whiskers at the outermost points inside the fences."""
    cells = value_cells(df, value, by)
    five = _ranked(df, cells, by, value, side).groupBy(*by).agg(
        F.min(value).alias("low"),
        _cont(value, 0.25).alias("q1"),
        _cont(value, 0.5).alias("median"),
        _cont(value, 0.75).alias("q3"),
        F.max(value).alias("high"),
    )
    names = ("low", "q1", "median", "q3", "high")
    spread = (F.col("q3") - F.col("q1")) * F.lit(factor)
    inside = F.col(value).between(F.col("q1") - spread, F.col("q3") + spread)
    return attach(cells, five, by).groupBy(*by).agg(
        *[F.first(c).alias(c) for c in names],
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
    )
