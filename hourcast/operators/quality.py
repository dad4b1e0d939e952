"""Data-quality checks: a sanity report and declarative expectations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourcast.operators.chunks import attach, measured_side
from hourcast.operators.profile import (
    duplicate_profile,
    iqr_outliers,
    quantiles,
)

RESULT = ("check", "column", "observed", "expected", "passed", "n_bad", "pct_bad")


def schema_check(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """One row per missing, unexpected or wrongly typed column; empty if the schema is as expected."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(c, "missing", t, None) for c, t in expected.items() if c not in actual]
    rows += [(c, "unexpected", None, t) for c, t in actual.items() if c not in expected]
    rows += [
        (c, "type", t, actual[c]) for c, t in expected.items() if c in actual and actual[c] != t
    ]
    return df.sparkSession.createDataFrame(
        sorted(rows), "column string, problem string, expected string, actual string"
    )


@dataclass(frozen=True)
class Check:
    """One expectation.  ``low``/``high`` are inclusive; ``None`` leaves a side open."""

    kind: str
    column: str
    low: Any = None
    high: Any = None
    values: tuple = ()
    type: str | None = None

    @property
    def expected(self) -> str:
        if self.kind == "of_type":
            return str(self.type)
        if self.kind == "in_set":
            return ",".join(str(v) for v in self.values)
        if self.kind == "not_null":
            return "no nulls"
        return f"[{'' if self.low is None else self.low}, {'' if self.high is None else self.high}]"


def not_null(column: str) -> Check:
    return Check("not_null", column)


def of_type(column: str, type: str) -> Check:
    return Check("of_type", column, type=type)


def in_set(column: str, values: Iterable[Any]) -> Check:
    return Check("in_set", column, values=tuple(values))


def between(column: str, low: Any = None, high: Any = None) -> Check:
    return Check("between", column, low, high)


def mean_between(column: str, low: float | None = None, high: float | None = None) -> Check:
    return Check("mean_between", column, low, high)


def median_between(column: str, low: float | None = None, high: float | None = None) -> Check:
    return Check("median_between", column, low, high)


def stddev_between(column: str, low: float | None = None, high: float | None = None) -> Check:
    return Check("stddev_between", column, low, high)


ROW_CHECKS = ("not_null", "in_set", "between")
STATISTICS = {"mean_between": F.avg, "stddev_between": F.stddev_samp}


def _bad_row(check: Check) -> Column:
    """True for a row that breaks the check; NULL values only break ``not_null``."""
    column = F.col(check.column)
    if check.kind == "not_null":
        return column.isNull()
    if check.kind == "in_set":
        return ~column.isin(list(check.values))
    bad = F.lit(False)
    if check.low is not None:
        bad = bad | (column < F.lit(check.low))
    if check.high is not None:
        bad = bad | (column > F.lit(check.high))
    return bad


def _inside(observed: Column, check: Check) -> Column:
    passed = observed.isNotNull()
    if check.low is not None:
        passed = passed & (observed >= F.lit(float(check.low)))
    if check.high is not None:
        passed = passed & (observed <= F.lit(float(check.high)))
    return F.coalesce(passed, F.lit(False))


def _medians(df: DataFrame, columns: Mapping[str, str], side: int | None) -> DataFrame:
    """One row with the medians (name to column): every column is a group of one distributed quantile, so rows are read once for all."""
    cells = [F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("v")) for name, c in columns.items()]
    found = quantiles(
        df.select(F.inline(F.array(*cells))),
        "v", {"m": 0.5}, ["name"], interpolate=True, side=side or measured_side(df, list(columns.values())),
    )
    return found.agg(*[F.max(F.when(F.col("name") == name, F.col("m"))).alias(name) for name in columns])


def validate(df: DataFrame, suite: Sequence[Check], side: int | None = None) -> DataFrame:
    """One row per check with the observed figure and whether it passed.

    All row checks, means and standard deviations fold into a single aggregate
    over the table; all medians into one distributed quantile, of ``side`` squared
    slots per column (by default as many as the distinct values ask for).
    """
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, check in enumerate(suite):
        if check.kind in ROW_CHECKS:
            aggregates.append(F.count_if(_bad_row(check)).alias(f"_c{i}"))
        elif check.kind in STATISTICS:
            aggregates.append(STATISTICS[check.kind](check.column).cast("double").alias(f"_c{i}"))
    measured = df.agg(*aggregates)
    medians = {f"_c{i}": check.column for i, check in enumerate(suite) if check.kind == "median_between"}
    if medians:
        measured = attach(measured, _medians(df, medians, side), [])
    types = {f.name: f.dataType for f in df.schema}

    def outcome(i: int, check: Check) -> Column:
        bad, pct = F.lit(None).cast("long"), F.lit(None).cast("double")
        if check.kind == "of_type":
            kind = types.get(check.column)
            observed = F.lit(None).cast("double")
            passed = F.lit(kind is not None and check.type in (kind.simpleString(), type(kind).__name__))
        elif check.kind in ROW_CHECKS:
            bad = F.col(f"_c{i}")
            pct = F.try_divide(bad * F.lit(100.0), F.col("_rows"))
            observed, passed = bad.cast("double"), bad == 0
        else:
            observed = F.col(f"_c{i}")
            passed = _inside(observed, check)
        columns = [
            F.lit(check.kind), F.lit(check.column), observed, F.lit(check.expected), passed, bad, pct,
        ]
        return F.struct(*[c.alias(n) for c, n in zip(columns, RESULT, strict=True)])

    outcomes = F.array(*[outcome(i, c) for i, c in enumerate(suite)])
    return measured.select(F.inline(outcomes))


def row_result(counted: DataFrame, check: str, column: str, expected: str) -> DataFrame:
    """A result row from a frame with the number of ``bad`` rows and of all ``rows``."""
    bad = F.col("bad")
    figures = [F.lit(check), F.lit(column), bad.cast("double"), F.lit(expected), bad == 0, bad, F.try_divide(bad * F.lit(100.0), F.col("rows"))]
    return counted.select(*[c.alias(n) for c, n in zip(figures, RESULT, strict=True)])


SUITE_SCHEMA = (
    "position int, kind string, column string, low string, high string, values array<string>, type string"
)


def suite_to_df(spark: SparkSession, suite: Sequence[Check]) -> DataFrame:
    """A suite as a table of check specs, to be saved like any other table."""
    text = lambda v: None if v is None else str(v)
    rows = [
        (i, c.kind, c.column, text(c.low), text(c.high), [str(v) for v in c.values], c.type)
        for i, c in enumerate(suite)
    ]
    return spark.createDataFrame(rows, SUITE_SCHEMA)


def suite_from_df(table: DataFrame) -> list[Check]:
    """The saved suite; bounds come back as numbers where they are numbers, else as text."""

    def bound(text: str | None) -> Any:
        for kind in (int, float):
            try:
                return None if text is None else kind(text)
            except ValueError:
                continue
        return text

    return [
        Check(r["kind"], r["column"], bound(r["low"]), bound(r["high"]), tuple(r["values"]), r["type"])
        for r in table.orderBy("position").collect()
    ]


def run_suite(df: DataFrame, suite: Sequence[Check], run_id: str, side: int | None = None) -> DataFrame:
    """Validation results stamped with a run id, ready to append to a result table."""
    return validate(df, suite, side).withColumn("run_id", F.lit(run_id))


def quality_report(df: DataFrame, value: str, limit: float = 0, side: int | None = None) -> DataFrame:
    """Missing, invalid, duplicate and outlier rows as (measure, n, pct).

    Missing values count cells but are a percentage of rows, so they may exceed
    100.  One aggregate covers rows, NULLs and invalid values; duplicates and
    outliers need one shuffle each on their own keys.
    """
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    basic = df.agg(
        F.count(F.lit(1)).alias("rows"),
        missing.alias("missing"),
        F.count_if(F.col(value) <= limit).alias("invalid"),
    )
    duplicates = duplicate_profile(df).select(F.col("duplicates")).scalar()
    outliers = iqr_outliers(df, value, side=side).select(F.col("outliers")).scalar()
    counts = {
        "missing": F.col("missing"),
        "invalid": F.col("invalid"),
        "duplicate": duplicates,
        "outlier": outliers,
    }
    measures = [F.struct(F.lit(name).alias("measure"), n.alias("n")) for name, n in counts.items()]
    return basic.select("rows", F.inline(F.array(*measures))).select(
        "measure", "n", F.try_divide(F.col("n") * F.lit(100.0), F.col("rows")).alias("pct")
    )
