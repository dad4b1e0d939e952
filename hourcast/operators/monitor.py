"""Forecast errors and the hand-over between predictions and actuals."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from hourcast.functions.steps import step_interval
from hourcast.operators.clean import between_ts
from hourcast.operators.upsert import source_col, upsert


def regression_metrics(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """MSE, RMSE, MAE and R2 over rows where both sides are known, in one aggregate."""
    y, p = F.col(label), F.col(prediction)
    e = F.when(y.isNotNull() & p.isNotNull(), y - p)
    known = F.when(e.isNotNull(), y)
    mse = F.avg(e * e)
    return df.groupBy(*by).agg(
        F.count(e).alias("n"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(known) * F.count(e))).alias("r2"),
    )


def pct_error(residual: Column, actual: Column) -> Column:
    """Residual as a percentage of the actual; NULL where the actual is zero."""
    return F.try_divide(residual, F.abs(actual)) * 100


def with_pct_error(df: DataFrame, residual: str, actual: str) -> DataFrame:
    error = pct_error(F.col(residual), F.col(actual))
    return df.withColumns({"pct_error": error, "abs_pct_error": F.abs(error)})


def bias_mape(df: DataFrame, residual: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean percentage error and mean absolute percentage error."""
    error = pct_error(F.col(residual), F.col(actual))
    return df.groupBy(*by).agg(F.avg(error).alias("bias_pct"), F.avg(F.abs(error)).alias("mape"))


def smape_of(prediction: str, actual: str) -> Column:
    """Aggregate: symmetric mean absolute percentage error."""
    p, y = F.col(prediction), F.col(actual)
    return F.avg(F.try_divide(F.abs(p - y), (F.abs(p) + F.abs(y)) / 2) * 100)


def smape(df: DataFrame, prediction: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(smape_of(prediction, actual).alias("smape"))


def label_vs_prediction(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return scored.select(label, prediction)


def reconcile(
    predictions: DataFrame,
    actuals: DataFrame,
    keys: Sequence[str],
    value: str,
    predicted: str = "PREDICTED_CONSUMPTION",
    actual: str = "ACTUAL_CONSUMPTION",
    residual: str = "RESIDUAL",
) -> DataFrame:
    """Fill in actual and residual of predictions that have an actual; never adds rows."""
    changes = {actual: source_col(value), residual: F.col(predicted) - source_col(value)}
    return upsert(predictions, actuals.select(*keys, value), keys, changes, insert=False)


def one_day(df: DataFrame, ts: str, day: date | datetime | str) -> DataFrame:
    """The rows of one day; two bare comparisons, so the scan can skip files."""
    start = F.lit(day).cast("date").cast(df.schema[ts].dataType)
    return between_ts(df, ts, start, start + step_interval("day"))


def feedback(
    history: DataFrame,
    predictions: DataFrame,
    keys: Sequence[str],
    value: str,
    predicted: str = "PREDICTED_CONSUMPTION",
    origin: str = "ORIGIN",
) -> DataFrame:
    """History extended by predictions where no value exists; ``origin`` tells them apart."""
    known = history if origin in history.columns else history.withColumn(origin, F.lit("actual"))
    extra = predictions.select(
        *keys,
        F.col(predicted).cast(history.schema[value].dataType).alias(value),
        F.lit("predicted").alias(origin),
    )
    return upsert(known, extra, keys, update=None)
