"""Distribution drift between an old and a new group of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from hourcast.operators.chunks import cumulative_counts, measured_side
from hourcast.operators.sampling import sample_n

OLD, NEW = "old", "new"
# Significance level and effect-size limit of the drift rules.
ALPHA = 0.05
EFFECT_LIMIT = 0.001


def drift_groups(
    df: DataFrame, ts: str, old_end, new_end, seed: int, ids: Sequence[str], group: str = "data_group"
) -> DataFrame:
    """Rows after ``old_end`` up to ``new_end`` as 'new', and an equally large sample of the earlier rows as 'old'."""
    kind = df.schema[ts].dataType
    old_limit, new_limit = F.lit(old_end).cast(kind), F.lit(new_end).cast(kind)
    new = df.filter((F.col(ts) > old_limit) & (F.col(ts) <= new_limit))
    old = df.filter(F.col(ts) <= old_limit)
    size = new.agg(F.count(F.lit(1)).alias("n")).scalar()
    return sample_n(old, size, seed, ids).withColumn(group, F.lit(OLD)).unionByName(
        new.withColumn(group, F.lit(NEW))
    )


def recent_groups(
    df: DataFrame, date: str, days: int, old_rows: int, seed: int, ids: Sequence[str], group: str = "data_group"
) -> DataFrame:
    """The last ``days`` up to the newest date as 'new', and ``old_rows`` sampled earlier rows as 'old'."""
    start = df.agg(F.date_sub(F.max(date).cast("date"), days).alias("d")).scalar()
    new = df.filter(F.col(date) >= start).withColumn(group, F.lit(NEW))
    old = sample_n(df.filter(F.col(date) < start), old_rows, seed, ids).withColumn(group, F.lit(OLD))
    return new.unionByName(old)


def crosstab(df: DataFrame, feature: str, group: str, values: Sequence[str] = (NEW, OLD)) -> DataFrame:
    """Rows per feature value, one column per group."""
    wide = df.groupBy(feature).pivot(group, list(values)).agg(F.count(F.lit(1)))
    return wide.select(feature, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])


def _cells(df: DataFrame, features: Sequence[str], group: str, values: Sequence[str], kind: str = "double") -> DataFrame:
    """Rows of each group per feature and distinct value, in one shuffle for all features."""
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast(kind).alias("value")) for f in features]
    long = df.select(group, F.inline(F.array(*pairs)))
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(*[F.count(F.when(F.col(group) == v, 1)).alias(v) for v in values])
    )


@F.pandas_udf(DoubleType())
def _chi2_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution; one row per feature."""

    def tail(x: float, k: float) -> float | None:
        if pd.isna(x) or pd.isna(k) or k < 1:
            return None
        half = x / 2
        a, q = (0.5, math.erfc(math.sqrt(half))) if k % 2 else (1.0, math.exp(-half))
        while a < k / 2:
            q += math.exp(a * math.log(half) - half - math.lgamma(a + 1)) if half > 0 else 0.0
            a += 1
        return min(q, 1.0)

    return pd.Series([tail(x, k) for x, k in zip(statistic, dof, strict=True)], dtype="float64")


def chi2_statistics(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Chi-square statistic per categorical feature against the two groups.

    Categories are compared as text, so they may be of any type.  A 2x2 table gets the continuity correction.  A feature with a single value
    has no test: statistic and degrees of freedom are NULL.
    """
    cells = _cells(df, features, group, (OLD, NEW), "string")
    per_feature = Window.partitionBy("feature")
    sums = cells.select(
        "*",
        F.sum(OLD).over(per_feature).alias("_old"),
        F.sum(NEW).over(per_feature).alias("_new"),
        F.count(F.lit(1)).over(per_feature).alias("_values"),
    )
    row_total, total = F.col(OLD) + F.col(NEW), F.col("_old") + F.col("_new")

    def part(observed: str, column_total: str) -> Column:
        expected = row_total * F.col(column_total) / total
        distance = F.abs(F.col(observed) - expected)
        correction = F.when(F.col("_values") == 2, F.least(F.lit(0.5), distance)).otherwise(0.0)
        return F.try_divide(F.pow(distance - correction, F.lit(2.0)), expected)

    testable = (F.col("_values") > 1) & (F.col("_old") > 0) & (F.col("_new") > 0)
    term = F.when(testable, part(OLD, "_old") + part(NEW, "_new"))
    return sums.groupBy("feature").agg(
        F.sum(term).alias("statistic"), F.max(F.when(testable, F.col("_values") - 1)).alias("dof")
    )


def chi2_drift(df: DataFrame, features: Sequence[str], group: str, alpha: float = ALPHA) -> DataFrame:
    """Chi-square test per feature; drift if p is below ``alpha`` over the number of features."""
    limit = F.lit(alpha / len(features))
    tested = chi2_statistics(df, features, group).withColumn("p_value", _chi2_tail("statistic", "dof"))
    return tested.withColumn("drifted", F.coalesce(F.col("p_value") < limit, F.lit(False)))


def _ks_tail(distance: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic p-value of the two-sample distance."""
    scale = distance * distance * n * m / (n + m)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda total, j: total
        + F.when(j % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * j * j * scale),
    )
    # The alternating series converges only away from zero, where p is 1.
    return F.when(scale < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def path_share(steps: int, n: int, m: int) -> float:
    """Share of the orders of ``n`` and ``m`` values in which the two groups are ever ``steps / (n * m)`` apart or more.

    An order of the pooled values is a path on a grid: i values of one group and
    j of the other have passed, and the groups are |i * m - j * n| / (n * m) apart.
    Level by level (i + j = k), a cell holds the share of the paths to it that
    touched the limit: 1 where the cell itself lies beyond, else the mean of the
    two cells before, weighted by how many paths come from each.  Shares neither
    overflow nor cancel, so small results keep all their digits.
    """
    touched = np.array([1.0 if steps <= 0 else 0.0])
    low = 0
    for level in range(1, n + m + 1):
        first, last = max(0, level - m), min(n, level)
        i = np.arange(first, last + 1)
        wide = np.zeros(last - first + 3)
        wide[low - first + 1 : low - first + 1 + len(touched)] = touched
        share = i / level
        touched = share * wide[:-2] + (1.0 - share) * wide[1:-1]
        touched[np.abs(i * m - (level - i) * n) >= steps] = 1.0
        low = first
    return float(touched[0])


@F.pandas_udf(DoubleType())
def _ks_exact(distance: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Exact p-value of the two-sample distance; one row per feature."""

    def p_value(d: float, old: float, new: float) -> float | None:
        if pd.isna(d) or pd.isna(old) or pd.isna(new):
            return None
        return path_share(round(d * old * new), int(old), int(new))

    return pd.Series([p_value(*row) for row in zip(distance, n, m, strict=True)], dtype="float64")


def ecdf_distance(df: DataFrame, features: Sequence[str], group: str, side: int | None = None) -> DataFrame:
    """Largest distance between the empirical distributions of the two groups, per feature.

    Ordered running counts over distinct values in slots, so no task orders a
    whole feature.  Without ``side`` the slots follow from the measured number of
    distinct values.
    """
    side = side or measured_side(df, features)
    ranked = cumulative_counts(_cells(df, features, group, (OLD, NEW)), ["feature"], "value", [OLD, NEW], side)
    share = {g: F.try_divide(F.col(f"{g}_upto"), F.col(f"{g}_total")) for g in (OLD, NEW)}
    return ranked.groupBy("feature").agg(
        F.max(F.abs(share[OLD] - share[NEW])).alias("statistic"),
        F.max(f"{OLD}_total").alias("n_old"),
        F.max(f"{NEW}_total").alias("n_new"),
    )


def ks_drift(
    df: DataFrame, features: Sequence[str], group: str, rule: str = "effect", side: int | None = None, method: str = "asymptotic"
) -> DataFrame:
    """Two-sample distance, its p-value and effect size per feature.

    ``rule='effect'``: drift if distance over the number of old rows exceeds
    0.001, a measure that shrinks with the sample.  ``rule='pvalue'``: drift if
    p is below 0.05.  ``method='asymptotic'`` takes the limit of large samples;
    ``method='exact'`` counts orders of the two samples as if no values were tied,
    with old rows times new rows steps per feature in one task.  The caller
    chooses; the size of the samples does not.
    """
    if method not in ("asymptotic", "exact"):
        raise ValueError(f"unknown method: {method!r}")
    tail = _ks_exact if method == "exact" else _ks_tail
    tested = ecdf_distance(df, features, group, side).withColumns(
        {
            "p_value": tail(F.col("statistic"), F.col("n_old"), F.col("n_new")),
            "effect_size": F.try_divide(F.col("statistic"), F.col("n_old")),
        }
    )
    drifted = F.col("effect_size") > EFFECT_LIMIT if rule == "effect" else F.col("p_value") < ALPHA
    return tested.withColumn("drifted", F.coalesce(drifted, F.lit(False)))
