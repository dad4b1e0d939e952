"""Landing data: one table or folder per series, with the series in its name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from hourcast.functions.calendar import parse_interval
from hourcast.operators.clean import dedupe, nullify_invalid
from hourcast.operators.windows import ffill

# Fixed value: the series is the part of the name before the first underscore.
SERIES_PATTERN = r"([^/_]+)_[^/]*"


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """UNION ALL by column name; with ``allow_missing`` absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def with_series_key(df: DataFrame, pattern: str = SERIES_PATTERN, name: str = "series") -> DataFrame:
    """The series taken from the path each row was read from.

    ``pattern`` must match the last folder or file of the path; its first group is the series.
    """
    # The path may end in a part file, so the match is anchored at the named folder.
    path = F.regexp_replace(F.col("_metadata.file_path"), r"/part-[^/]*$", "")
    return df.withColumn(name, F.regexp_extract(path, rf"{pattern}$", 1))


def load_landing_files(
    spark: SparkSession, glob: str, format: str = "parquet", pattern: str = SERIES_PATTERN, **options: str
) -> DataFrame:
    """All landing folders or files as one scan, whatever their number."""
    return with_series_key(spark.read.options(**options).format(format).load(glob), pattern)


def load_landing_tables(
    spark: SparkSession, database: str | None = None, pattern: str = "*", name: str = "series"
) -> DataFrame:
    """All matching catalog tables with the series from the table name."""
    tables = [t for t in spark.catalog.listTables(database, pattern) if not t.isTemporary]
    if not tables:
        raise ValueError(f"no table matches {pattern!r}")
    frames = []
    for table in sorted(tables, key=lambda t: t.name):
        full = f"`{database}`.`{table.name}`" if database else f"`{table.name}`"
        frames.append(spark.read.table(full).withColumn(name, F.lit(table.name.split("_")[0])))
    return union_all(frames, allow_missing=True)


def clean_landing(
    landing: DataFrame,
    series: str = "series",
    text: str = "datetime",
    value: str = "Actual_MW",
    ts: str = "ts",
    out_value: str = "v",
    drop_unknown: bool = False,
    step: str = "hour",
) -> DataFrame:
    """Landing rows as a clean series table ``(series, ts, value)``.

    Interval text becomes its start time, values at or below zero become NULL,
    NULLs take the last known value (or are dropped with ``drop_unknown``), and
    one row per series and time remains, the larger value of a doubled hour.
    Rows whose text cannot be read have no place in a series; they are not part
    of the result, but of ``unreadable_rows``, which the ingest job counts and keeps.
    """
    rows = landing.select(
        F.col(series), parse_interval(text).cast("timestamp_ntz").alias(ts), F.col(value).alias(out_value)
    ).filter(F.col(ts).isNotNull())
    rows = dedupe(nullify_invalid(rows, out_value), [series, ts], [out_value])
    if drop_unknown:
        return rows.filter(F.col(out_value).isNotNull())
    return ffill(rows, [series], ts, out_value, step=step)


def unreadable_rows(landing: DataFrame, text: str = "datetime") -> DataFrame:
    """Landing rows whose interval text has no readable start."""
    return landing.filter(parse_interval(text).isNull())
