"""Looking up features for labels, and joining scores and actuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hourcast.operators.chunks import CHUNK, carry_rows, chunk_window, last_known, time_chunk

AT = "_at"
LABEL = "_label"
FOUND = "_found"


def lookup_equal(labels: DataFrame, features: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Left join on a key that already holds the time, such as the composite row id."""
    shared = [c for c in labels.columns if c in features.columns and c not in keys]
    return labels.join(features.drop(*shared), list(keys), "left").drop(*exclude)


def lookup_asof(
    labels: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    ts: str,
    exclude: Sequence[str] = (),
    bucket: str = "day",
) -> DataFrame:
    """For each label the latest feature row at or before it; NULL columns if there is none.

    A merge in the order of time: both sides are put together, moved once by key
    and bucket of time, and a running "last feature row" goes over the rows of a
    bucket, starting from the last one of the buckets before.  Nothing is packed
    or held per key, each side is read once, and a hot key spans as many tasks as
    its time span has buckets.  One feature row per key and bucket is folded.

    ``features`` has at most one row per key and time.  A label with a NULL key
    or time finds nothing.  Times of two types are compared as timestamps.
    """
    payload = [c for c in features.columns if c not in (*keys, ts) and c not in labels.columns]
    if not payload:
        return labels.drop(*exclude)
    others = [c for c in labels.columns if c not in keys]
    # Labels without a time need no common task.
    hashed = [f.name for f in labels.schema if "map<" not in f.dataType.simpleString()]
    nowhere = F.lit(2**62) + F.pmod(F.xxhash64(*hashed), F.lit(1024))
    left = labels.select(*keys, F.col(ts).alias(AT), F.struct(*others).alias(LABEL), nowhere.alias(CHUNK))
    right = features.dropna(subset=[*keys, ts]).select(*keys, F.col(ts).alias(AT), F.struct(*payload).alias(FOUND))
    rows = (
        left.unionByName(right, allowMissingColumns=True)
        .withColumn(CHUNK, F.coalesce(time_chunk(AT, bucket, 1), CHUNK))
        .repartition(*keys, CHUNK)
    )
    # The tag is the label itself, so the summary reads the columns that the rows have and both share one shuffle.
    latest = F.max_by(FOUND, F.when(F.col(LABEL).isNull(), F.col(AT)))
    merged = carry_rows(rows, keys, CHUNK, {FOUND: (latest, last_known)}, spread=True)
    running = chunk_window(keys, CHUNK, [F.col(AT).asc(), F.col(LABEL).isNull().desc()])
    found = merged.withColumn(FOUND, last_known(F.col(FOUND)).over(running)).filter(F.col(LABEL).isNotNull())
    own = [F.col(c).cast(labels.schema[c].dataType).alias(c) if c in keys else F.col(LABEL)[c].alias(c) for c in labels.columns]
    looked_up = [F.when(F.col(AT).isNotNull(), F.col(FOUND)[c]).alias(c) for c in payload]
    return found.select(*own, *looked_up).drop(*exclude)


def join_scores(left: DataFrame, right: DataFrame, id_column: str, score: str) -> DataFrame:
    """Rows scored by both models: all columns of the left, one score of the right."""
    return left.join(right.select(id_column, score), id_column, "inner")


def join_actuals(predictions: DataFrame, actuals: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Predictions with the actual of the same instant; times are compared as timestamps, not as text."""
    kind = actuals.schema[ts].dataType
    return predictions.withColumn(ts, F.col(ts).cast(kind)).join(actuals, [*keys, ts], "inner")


def score(model, labels: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Look up features by row id and apply a fitted pipeline."""
    return model.transform(lookup_equal(labels, features, keys))
