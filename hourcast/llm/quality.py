"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import bytes_of, gram_hashes, saved, word_hashes

BUCKETS = 10_000
SMALL = 50_000


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of a batch, and the document of each."""
    words, begins = word_hashes(*bytes_of(column))
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    pairs = gram_hashes(words, 2)
    same = owner[:-1] == owner[1:] if len(owner) else np.zeros(0, bool)
    found = np.concatenate([words, pairs[same]]) % np.uint64(buckets)
    return found.astype(np.int64), np.concatenate([owner, owner[:-1][same]])


def target_sample(labels: DataFrame, rows: int = 20_000) -> DataFrame:
    """Ids of at most ``rows`` documents labelled good, by the order of a hash of the id: the bounded sample that defines the target."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def log_ratios(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw); the raw model counts all documents, the target model those in ``target``.

    Counts are summed inside a task first: at most ``buckets`` rows leave a task and reach the driver.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in rows:
            found, owner = features(batch.column(1), buckets)
            wanted = np.array(batch.column(0).to_pylist(), bool)
            counts[0] += np.bincount(found, minlength=buckets)
            counts[1] += np.bincount(found[wanted[owner]] if len(owner) else found, minlength=buckets)
        seen = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, counts[0][seen], counts[1][seen])], names=["bucket", "raw", "target"])

    chosen = F.broadcast(target.select(F.col("doc_id").alias("__chosen")))  # at most target_sample's rows
    marked = docs.join(chosen, F.col("doc_id") == F.col("__chosen"), "left").select(F.col("__chosen").isNotNull(), F.col("text").cast("binary"))
    total = marked.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, wanted = np.zeros(buckets), np.zeros(buckets)
    for row in total.collect():
        raw[row["bucket"]], wanted[row["bucket"]] = row["raw"], row["target"]
    if not wanted.sum():
        return np.zeros(buckets)
    return np.log((wanted + smoothing) / (wanted.sum() + smoothing * buckets)) - np.log((raw + smoothing) / (raw.sum() + smoothing * buckets))


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = 0) -> DataFrame:
    """doc_id, n_features, log_weight (sum of the ratios of a text's n-grams), score (its mean per n-gram, as a probability) and gumbel_key."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        for batch in rows:
            found, owner = features(batch.column(1), len(ratios))
            size = np.bincount(owner, minlength=batch.num_rows)
            weight = np.bincount(owner, ratios[found], minlength=batch.num_rows).astype(float)  # of nothing, bincount gives integers
            score = 1 / (1 + np.exp(-weight / np.maximum(size, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (size, weight, score))], names=["doc_id", "n_features", "log_weight", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_features long, log_weight double, score double")
    even = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(even)))


def highest(table: DataFrame, key: str, k: int) -> DataFrame:
    """Column ``selected``: whether a row is among the ``k`` with the highest key, ties to the smaller doc_id. No global sort: the limit is enclosed
    by quantiles until few rows are left in between, and these are ordered."""
    if k <= 0:
        return table.withColumn("selected", F.lit(False))
    low, high, above = float("-inf"), float("inf"), 0
    between = (F.col(key) > F.lit(low)) & (F.col(key) <= F.lit(high))
    while True:
        inside = table.filter(between)
        n = inside.count()
        if above + n <= k:
            return table.withColumn("selected", F.coalesce(F.col(key) > F.lit(low), F.lit(False)))
        cuts = sorted(set(inside.approxQuantile(key, [i / 64 for i in range(1, 64)], 0.001)))
        if n <= SMALL or not cuts or (len(cuts) == 1 and cuts[0] == high):
            break
        counts = {r["cell"]: r["count"] for r in inside.groupBy(_cell(key, cuts).alias("cell")).count().collect()}
        bounds = [low, *cuts, high]
        for cell in range(len(cuts), -1, -1):  # rows with bounds[cell] < key <= bounds[cell + 1]
            if above + counts.get(cell, 0) >= k:
                break
            above += counts.get(cell, 0)
        if (low, high) == (bounds[cell], bounds[cell + 1]):
            break
        low, high = bounds[cell], bounds[cell + 1]
        between = (F.col(key) > F.lit(low)) & (F.col(key) <= F.lit(high))
    last = inside.select(F.col(key).alias("key"), "doc_id").orderBy(F.desc("key"), F.col("doc_id")).limit(k - above)
    edge = last.agg(F.min("key").alias("key")).first()["key"]
    tied = last.filter(F.col("key") == F.lit(edge)).agg(F.max("doc_id").alias("doc_id")).first()["doc_id"]
    tie = (F.col(key) == F.lit(edge)) & ((F.col("doc_id") <= F.lit(tied)) | F.col("doc_id").isNull())
    return table.withColumn("selected", F.coalesce((F.col(key) > F.lit(edge)) | tie, F.lit(False)))


def _cell(key: str, cuts: list[float]):
    """Number of cuts below a key."""
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col(key)))


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.5, buckets: int = BUCKETS, rows: int = 20_000, seed: int = 0) -> DataFrame:
    """Importance resampling of documents (doc_id, text) towards those labelled good (labels: doc_id, quality).

    Every row gets a log importance weight; ``selected`` marks a sample without replacement of ``share`` of the rows that have words (rounded down), by
    the highest sums of weight and Gumbel noise. The noise is a hash of the id and ``seed``, so reruns agree and equal ids are equal.
    NULL and empty texts have weight 0, score 0.5 and are never selected. Without any good label all weights are 0: a uniform sample. Rows that tie at
    the limit with one doc_id are selected together.
    """
    ratios = log_ratios(docs, target_sample(labels, rows), buckets)
    table = saved(weigh(docs, ratios, seed), "weights")
    real = table.filter("n_features > 0")
    chosen = highest(real, "gumbel_key", int(share * real.count()))
    return chosen.unionByName(table.filter("n_features = 0").withColumn("selected", F.lit(False)))
