"""Tables that are written, merged and read again, and scores looked up by row id."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hourcast.operators.lookup import score
from hourcast.operators.training import RegressorConfig, labels_of, make_pipeline, time_split, timed_fit
from hourcast.queries.features import DAILY, daily_features
from hourcast.queries.frames import D, SPLIT_DATE, daily
from hourcast.queries.registry import query
from hourcast.queries.scalars import FLAGS
from hourcast.session import ensure_checkpoint_dir
from hourcast.sources.tables import create_feature_table, load, merge_into


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "merge_into_months",
    f"""WITH {D} SELECT series, ts, CASE WHEN ts >= TIMESTAMP '1999-06-01' THEN v * 2 ELSE v END AS v,
      strftime(ts, '%Y-%m') AS month_key FROM d""",
)
def merged_months(spark, sf_dir):
    """The days up to 2000 as a table by month, then a batch that renews half a year and adds the rest."""
    days, path = daily(spark, sf_dir), _folder(spark, "months")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    merge_into(days.filter(F.col("ts") < at(SPLIT_DATE)), path, ["series", "ts"], "ts")
    batch = days.filter(F.col("ts") >= at("1999-06-01")).withColumn("v", F.col("v") * 2)
    merge_into(batch, path, ["series", "ts"], "ts")
    return load(spark, path).withColumn("month_key", F.col("month_key").cast("string"))


@query("feature_table", f"WITH {D} SELECT series, ts, v FROM d")
def feature_table(spark, sf_dir):
    """A keyed table: refused with NULL or repeated keys, then read back."""
    path = _folder(spark, "features")
    create_feature_table(daily(spark, sf_dir), path, ["series", "ts"])
    return load(spark, path)


@query(
    "score_by_id",
    f"""WITH {D} SELECT series || '_' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS consumption_id, ts, v, true AS scored FROM d
      WHERE ts >= TIMESTAMP '2000-01-01'""",
)
def scored_labels(spark, sf_dir):
    """Labels scored with features looked up by row id: each label once, whatever its features lack."""
    features = daily_features(spark, sf_dir).withColumnsRenamed(FLAGS)
    columns = [*FLAGS.values(), *DAILY.lags]
    train = time_split(features, "ts", {"train": ("1995-01-01", SPLIT_DATE)})["train"]
    fit = timed_fit(make_pipeline(columns, "v", RegressorConfig()), train.select("v", *columns))
    labels = labels_of(daily(spark, sf_dir).filter(F.col("ts") >= F.lit(SPLIT_DATE).cast("timestamp_ntz")), "series", "ts", "v", "consumption_id")
    out = score(fit.model, labels, features.drop("series", "ts", "v"), ["consumption_id"])
    return out.select("consumption_id", "ts", "v", F.col("prediction").isNotNull().alias("scored"))
