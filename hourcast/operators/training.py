"""Splits, training sets, fitting and scoring with Spark ML."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from hourcast.functions.keys import id_to_series, row_id
from hourcast.operators.boosting import HistogramTrees
from hourcast.operators.chunks import attach
from hourcast.operators.clean import between_ts
from hourcast.operators.lookup import lookup_equal
from hourcast.operators.profile import minmax

Bounds = Mapping[str, tuple[Any, Any]]


def with_split(df: DataFrame, ts: str, bounds: Bounds, name: str = "split", closed: str = "left") -> DataFrame:
    """Label each row with the first range that holds its time; NULL outside all ranges."""
    kind = df.schema[ts].dataType
    label = F.lit(None).cast("string")
    for part, (start, end) in reversed(list(bounds.items())):
        t, low, high = F.col(ts), F.lit(start).cast(kind), F.lit(end).cast(kind)
        lower = t >= low if closed in ("left", "both") else t > low
        upper = t <= high if closed in ("right", "both") else t < high
        label = F.when(lower & upper, F.lit(part)).otherwise(label)
    return df.withColumn(name, label)


def time_split(df: DataFrame, ts: str, bounds: Bounds, closed: str = "left") -> dict[str, DataFrame]:
    """One frame per range, half-open by default so that adjoining ranges neither gap nor overlap."""
    return {part: between_ts(df, ts, start, end, closed) for part, (start, end) in bounds.items()}


def shift_months(column: Column, months: int) -> Column:
    """Later by whole months, clipped to the end of a shorter month."""
    return F.add_months(column.cast("date"), months)


def shift_split(spark, bounds: Bounds, months: int) -> dict[str, tuple[Any, Any]]:
    """The ranges moved by whole months, as dates."""
    ends = [
        shift_months(F.lit(b), months).alias(f"{part}_{i}")
        for part, pair in bounds.items()
        for i, b in enumerate(pair)
    ]
    row = spark.range(1).select(*ends).first()
    return {part: (row[f"{part}_0"], row[f"{part}_1"]) for part in bounds}


def labels_of(df: DataFrame, key: str, ts: str, value: str, id_column: str = "CONSUMPTION_ID") -> DataFrame:
    return df.select(row_id(key, ts).alias(id_column), ts, value)


def training_set(
    labels: DataFrame, features: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()
) -> DataFrame:
    """Labels with their features, without key and time columns."""
    return lookup_equal(labels, features, keys, exclude)


@dataclass(frozen=True)
class RegressorConfig:
    """Boosted-tree settings."""

    # Settings of the trained model, and rounds without gain before early stopping.
    trees: int = 300
    depth: int = 8
    rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42
    max_categories: int = 3
    patience: int = 10


class _KnownParams(Params):
    """Columns that may be NULL; ``x`` gets ``x__filled`` and ``x__known``."""

    columns = Param(Params._dummy(), "columns", "columns to complete", TypeConverters.toListString)

    def outputs(self) -> list[str]:
        names = self.getOrDefault("columns")
        return [f"{c}__filled" for c in names] + [f"{c}__known" for c in names]


class FillUnknown(Estimator, _KnownParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the mean of each column, one aggregate over the rows; a column without any value gets 0.

    No row is lost, in fitting or in scoring: a NULL (or NaN) becomes the mean of the training rows, and a flag tells the regressor that it was one.
    """

    @keyword_only
    def __init__(self, columns: Sequence[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FilledModel:
        names = self.getOrDefault("columns")
        means = dataset.agg(*[F.avg(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))).alias(c) for c in names]).first()
        return FilledModel(columns=names, means=[0.0 if m is None else float(m) for m in means])


class FilledModel(Model, _KnownParams, DefaultParamsReadable, DefaultParamsWritable):
    """The learned means, applied as plain projections."""

    means = Param(Params._dummy(), "means", "value for unknown cells, by column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, columns: Sequence[str] | None = None, means: Sequence[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in self.getOrDefault("columns")}
        filled = {f"{c}__filled": F.coalesce(v, F.lit(m)) for (c, v), m in zip(values.items(), self.getOrDefault("means"), strict=True)}
        return dataset.withColumns(filled | {f"{c}__known": v.isNotNull().cast("double") for c, v in values.items()})


ASSEMBLED = "assembled"


def assemble(columns: Sequence[str], out: str = ASSEMBLED, invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid=invalid)


def index_categories(max_categories: int, column: str = ASSEMBLED, out: str = "features") -> VectorIndexer:
    return VectorIndexer(
        inputCol=column, outputCol=out, maxCategories=max_categories, handleInvalid="keep"
    )


def make_regressor(
    label: str, cfg: RegressorConfig = RegressorConfig(), validation: str | None = None
) -> HistogramTrees:
    """Distributed boosted trees; ``validation`` names a boolean column for early stopping."""
    regressor = HistogramTrees(
        featuresCol="features", labelCol=label, predictionCol="prediction",
        maxIter=cfg.trees, maxDepth=cfg.depth, stepSize=cfg.rate, subsamplingRate=cfg.row_share,
        columnShare=cfg.column_share, seed=cfg.seed, patience=cfg.patience,
    )
    return regressor.setValidationIndicatorCol(validation) if validation else regressor


def make_pipeline(
    columns: Sequence[str], label: str, cfg: RegressorConfig = RegressorConfig(), validation: str | None = None
) -> Pipeline:
    """Completed columns, category index, boosted trees: as many predictions as rows."""
    fill = FillUnknown(columns=list(columns))
    return Pipeline(
        stages=[
            fill,
            assemble(fill.outputs()),
            index_categories(cfg.max_categories),
            make_regressor(label, cfg, validation),
        ]
    )


@dataclass(frozen=True)
class Fit:
    """A fitted pipeline with its wall-clock time and training size."""

    model: PipelineModel
    seconds: float
    rows: int


def timed_fit(pipeline: Pipeline, df: DataFrame) -> Fit:
    """Fit and time (runs jobs); the stages of the pipeline read the rows from the cache."""
    data = df.persist()
    try:
        rows = data.count()
        start = time.monotonic()
        model = pipeline.fit(data)
        return Fit(model, time.monotonic() - start, rows)
    finally:
        data.unpersist()


def tune(
    pipeline: Pipeline,
    grid: Mapping[str, Sequence[Any]],
    label: str,
    folds: int = 3,
    seed: int = 42,
    fold_column: str | None = None,
) -> CrossValidator:
    """Grid search with k folds on RMSE over parameters of the last stage.

    Random folds leak along a series; pass a ``fold_column`` of contiguous time
    blocks (see ``time_folds``) to keep neighbours together.
    """
    stage = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(stage, name), list(values))
    validator = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=builder.build(),
        evaluator=RegressionEvaluator(metricName="rmse", labelCol=label, predictionCol="prediction"),
        numFolds=folds,
        seed=seed,
    )
    return validator.setFoldCol(fold_column) if fold_column else validator


def time_folds(df: DataFrame, ts: str, start: Any, end: Any, folds: int, name: str = "fold") -> DataFrame:
    """Number of the contiguous, equally long time block of each row."""
    second = lambda c: c.cast("timestamp").cast("long")
    kind = df.schema[ts].dataType
    low, high = second(F.lit(start).cast(kind)), second(F.lit(end).cast(kind))
    place = F.floor((second(F.col(ts)) - low) * folds / (high - low))
    return df.withColumn(name, F.greatest(F.lit(0), F.least(F.lit(folds - 1), place)).cast("int"))


def forward_scores(
    fit: Callable[[DataFrame], PipelineModel], df: DataFrame, fold_column: str, folds: int, label: str
) -> list[float]:
    """RMSE per fold of a model trained on all earlier folds (runs jobs)."""
    evaluator = RegressionEvaluator(metricName="rmse", labelCol=label, predictionCol="prediction")
    scores = []
    for fold in range(1, folds):
        model = fit(df.filter(F.col(fold_column) < fold))
        scores.append(evaluator.evaluate(model.transform(df.filter(F.col(fold_column) == fold))))
    return scores


def tuning_report(spark, fitted: CrossValidatorModel) -> DataFrame:
    """Mean fold metric per parameter combination; the smallest is the best."""
    best = min(range(len(fitted.avgMetrics)), key=fitted.avgMetrics.__getitem__)
    rows = [
        (i, {p.name: str(v) for p, v in params.items()}, float(metric), i == best)
        for i, (params, metric) in enumerate(
            zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics, strict=True)
        )
    ]
    return spark.createDataFrame(rows, "point int, params map<string,string>, rmse double, best boolean")


def feature_importance(spark, model: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """Weight of each column: of its value and of the flag that it is known together."""
    weights = model.stages[-1].featureImportances.toArray().reshape(2, len(columns)).sum(axis=0)
    rows = [(c, float(w)) for c, w in zip(columns, weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def minmax_scale(column: Column, low: Column, high: Column) -> Column:
    """Position in the range; a constant column is at 0.5."""
    return F.when(high > low, (column - low) / (high - low)).otherwise(F.when(column.isNotNull(), F.lit(0.5)))


def minmax_inverse(scaled: Column, low: Column, high: Column) -> Column:
    return scaled * (high - low) + low


def scaled_by(df: DataFrame, fitted_on: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Columns in units of the range they have in ``fitted_on`` (0 to 1 there), NULL where they are NULL; all rows stay."""
    bounded = attach(df, minmax(fitted_on, columns), [])
    scaled = {f"{c}{suffix}": minmax_scale(F.col(c), F.col(f"min_{c}"), F.col(f"max_{c}")) for c in columns}
    return bounded.withColumns(scaled).drop(*[f"{end}_{c}" for c in columns for end in ("min", "max")])


def score_to_predictions(
    scored: DataFrame, ts: str, model_tag: str, id_column: str = "CONSUMPTION_ID", series: str = "COUNTRY"
) -> DataFrame:
    """Scored rows in the layout of the prediction table, actual and residual still unknown."""
    unknown = F.lit(None).cast("double")
    return id_to_series(scored, id_column, series).select(
        F.col(ts),
        series,
        F.col("prediction").cast("double").alias("PREDICTED_CONSUMPTION"),
        unknown.alias("ACTUAL_CONSUMPTION"),
        unknown.alias("RESIDUAL"),
        F.lit(model_tag).alias("MODEL_USED"),
    )


def save_model(model: PipelineModel, root: str, version: int) -> str:
    """Store a fitted pipeline under a new version; an existing version is an error."""
    path = f"{root.rstrip('/')}/v={version}"
    model.write().save(path)
    return path


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
