"""Mixing sources to target weights with a curriculum over the training run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourcast.llm.common import running_total, saved

WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: its size and its target.

    Sources are taken by code point, NULL last, and weigh ``weights`` in turn. ``share`` times all sizes is given out by weight; a target stops at
    ``most`` times its source's size and the rest is shared anew. In the order of (limit / weight) the sources at their limit are a prefix, so one
    running sum over the sources (one row each) finds the level at which all is given out.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = totals.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), F.col("turn") + 1))
    limit = F.col("source_size") * F.lit(float(most))
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    stepped = (
        ranked.withColumn("place", F.row_number().over(by_limit))
        .withColumn("given", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most)))
        .withColumn("left", F.sum("weight").over(onward))
        .withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("all") - F.col("given")) / F.col("left"))
    )
    free = F.when(limit / F.col("weight") > F.col("level"), F.struct("place", "level"))
    level = F.min(free).over(everything)["level"]
    target = F.coalesce(F.least(limit, level * F.col("weight")), limit)
    return stepped.select("source", "source_size", "turn", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    slopes: tuple[float, ...] = (0.5, 0.0, -0.5),
) -> DataFrame:
    """Words taken from every document, and its positions in training (0 to 1).

    A source's documents stand in a fixed shuffled order (MD5 of the id) and are read from the start, again and again, until the source's target is
    reached; the last document is cut. The weight of a source over the run is target * (1 + slope * (2t - 1)); its integral, the source's demand up
    to t, is solved for t at the word where a document begins: that is the document's position. ``position_again`` is that of the second reading.

    NULL text has size 0; NULL source is a source of its own; a document without words takes none and has no position. Equal rows get neighbouring
    places, in any order. Reruns agree, as the order depends on the rows alone.
    """
    return _mixed(docs, [], weights, share, most, slopes)


def _mixed(docs: DataFrame, keep: list[str], weights=(3, 1, 2), share=1.5, most=2.0, slopes=(0.5, 0.0, -0.5)) -> DataFrame:
    """``mix_sources`` with the columns ``keep`` of each row, which settle the order of rows with one id and size."""
    sized = docs.select(
        *keep,
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place"),
    )
    sized = saved(sized.withColumn("cell", F.substring("place", 1, 3)), "sizes")  # texts are read once
    order = [F.col("place"), F.col("doc_id"), F.col("size"), *map(F.col, keep)]
    placed = running_total(sized, "size", "cell", order, ["source"])
    targets = source_targets(sized, weights, share, most).withColumnRenamed("source", "__source")
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    goal = F.floor("target").cast("long")
    zero = F.lit(0).cast("long")

    def part(start):
        return F.greatest(zero, F.least(F.col("size"), goal - start))

    first, again = part(F.col("before")), part(F.col("before") + F.col("source_size"))
    slope = F.element_at(F.array(*(F.lit(float(s)) for s in slopes)), F.col("turn") % len(slopes) + 1)

    def position(start):
        done = start / F.col("target")
        return (F.lit(2.0) * done) / ((F.lit(1.0) - slope) + F.sqrt((F.lit(1.0) - slope) * (F.lit(1.0) - slope) + F.lit(4.0) * slope * done))

    return joined.select(
        *keep,
        "doc_id",
        "size",
        "source_size",
        "target",
        (first + again).alias("taken"),
        F.when(first > 0, position(F.col("before"))).alias("position"),
        F.when(again > 0, position(F.col("before") + F.col("source_size"))).alias("position_again"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in training order: each as often as its words are taken, rounded to whole documents (halves up).

    Columns are those of the input. Every row is counted by itself, whatever its id: rows are numbered in a table of their own first.
    """
    rows = saved(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    taken = _mixed(rows, ["__row"], **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    places = F.slice(F.array("position", F.coalesce("position_again", "position")), F.lit(1), times)
    wanted = taken.withColumn("__times", times).filter("__times > 0").select("__row", places.alias("__places"))
    copies = rows.join(wanted, "__row").withColumn("__place", F.explode("__places"))
    return copies.repartitionByRange("__place", "doc_id").sortWithinPartitions("__place", "doc_id").select(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
turned AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM totals),
weighed AS (SELECT *, CASE turn WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CASE turn WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope FROM turned),
stepped AS (
  SELECT *, row_number() OVER by_limit AS k,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
      - CAST(coalesce(sum(source_size) OVER (by_limit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * 2.0::DOUBLE)
    / CAST(sum(weight) OVER (by_limit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed WINDOW by_limit AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)),
chosen AS (SELECT arg_min(level, k) AS level FROM stepped WHERE CAST(source_size AS DOUBLE) * 2.0::DOUBLE / weight > level),
targets AS (
  SELECT source, source_size, slope,
    coalesce(least(CAST(source_size AS DOUBLE) * 2.0::DOUBLE, chosen.level * weight), CAST(source_size AS DOUBLE) * 2.0::DOUBLE) AS target
  FROM stepped, chosen),
placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM sized),
parts AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, t.slope, p.ahead, p.ahead + t.source_size AS ahead_again,
    greatest(0, least(p.size, CAST(floor(t.target) AS BIGINT) - p.ahead)) AS first_part,
    greatest(0, least(p.size, CAST(floor(t.target) AS BIGINT) - p.ahead - t.source_size)) AS second_part
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(first_part + second_part AS BIGINT) AS taken,
  CASE WHEN first_part > 0 THEN (2.0::DOUBLE * (ahead / target)) / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * (ahead / target))) END AS position,
  CASE WHEN second_part > 0 THEN (2.0::DOUBLE * (ahead_again / target)) / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * (ahead_again / target))) END AS position_again
FROM parts
"""
