"""Ordered work on a series without ever putting a whole series into one task.

A window over ``partitionBy(series)`` sorts one series in one task, so a series
that holds a third of the table stops the job.  Everything ordered in this
library therefore runs on pieces of a series:

* ``carry_rows`` splits a series into chunks and gives each chunk one extra row
  with what the earlier chunks contribute (last known value, count so far, ...).
  A plain running window inside the chunk then yields the exact result.
* ``overlap_by_rows`` and ``overlap_by_time`` split a series into blocks and copy
  the few rows a bounded frame needs from the neighbouring block, so lags and
  moving frames are exact inside the block.

A chunk is a fixed stretch of time, so a table with one row per series and step
has at most ``chunk_rows`` rows in a chunk, and the summary that is folded per
series has one row per chunk: its length depends on the time span, not on the
number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from hourcast.functions.steps import epoch_seconds, place, place_step, step_seconds

CARRY = "_carry"
CHUNK = "_chunk"
BLOCK = "_block"
OWN = "_own"
POSITION = "_pos"
CHUNK_ROWS = 1024
LEAST_SIDE = 8
# Distinct values that one slot of an ordered group should hold.
SLOT_VALUES = 1 << 16

Fold = Callable[[Column], Column]


def last_known(column: Column) -> Column:
    return F.last(column, ignorenulls=True)


def time_chunk(ts: str, step: str, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(step_seconds(step) * chunk_rows))


def carry_rows(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    parts: dict[str, tuple[Column, Fold]],
    forward: bool = True,
    spread: bool = False,
) -> DataFrame:
    """``df`` plus one row per chunk that holds the folded parts of the chunks before it.

    ``parts`` maps a column to the aggregate that summarises a chunk and the
    aggregate that folds the summaries.  With ``forward=False`` a chunk receives
    the parts of the chunks after it.  The extra rows have ``_carry`` true and
    sort first in ``chunk_window``.  The summary is combined on the map side.
    ``spread`` puts the extra rows next to rows that are already partitioned by
    keys and chunk, so that the rows themselves need not move again.
    """
    summary = df.groupBy(*keys, chunk).agg(*[total.alias(name) for name, (total, _) in parts.items()])
    order = F.col(chunk).asc() if forward else F.col(chunk).desc()
    seen = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        chunk,
        *[fold(F.col(name)).over(seen).alias(name) for name, (_, fold) in parts.items()],
        F.lit(True).alias(CARRY),
    )
    if spread:
        carried = carried.repartition(*keys, chunk)
    return df.withColumn(CARRY, F.lit(False)).unionByName(carried, allowMissingColumns=True)


def chunk_window(keys: Sequence[str], chunk: str, order: Sequence[Column]) -> WindowSpec:
    """Running window inside a chunk, starting at its carry row."""
    return (
        Window.partitionBy(*keys, chunk)
        .orderBy(F.col(CARRY).desc(), *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def drop_carry(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(~F.col(CARRY)).drop(CARRY, *columns)


def with_row_index(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    name: str = POSITION,
    step: str = "hour",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Zero-based position of each row in its series, ordered by ``ts``.

    Rows that still carry their chunk are taken to be partitioned by it.
    """
    chunked = CHUNK in df.columns
    tagged = df if chunked else df.withColumn(CHUNK, time_chunk(ts, step, chunk_rows))
    tagged = tagged.withColumn(name, F.lit(1).cast("long"))
    rows = carry_rows(tagged, keys, CHUNK, {name: (F.count(F.lit(1)), F.sum)}, spread=chunked)
    running = chunk_window(keys, CHUNK, [F.col(ts).asc()])
    return drop_carry(rows.withColumn(name, F.sum(name).over(running) - 1), CHUNK)


def _spread(df: DataFrame, size: int, back: int, ahead: int) -> DataFrame:
    """Copy each row into its own block and into the blocks whose frames reach it."""
    home = F.floor(F.col(POSITION) / F.lit(size))
    offset = F.col(POSITION) - home * size
    copies = [home]
    if back:
        copies.append(F.when(offset >= size - back, home + 1))
    if ahead:
        copies.append(F.when(offset < ahead, home - 1))
    return df.withColumn(BLOCK, F.explode(F.array_compact(F.array(*copies)))).withColumn(OWN, F.col(BLOCK) == home)


def overlap_by_rows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    back: int,
    ahead: int = 0,
    step: str = "hour",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Blocks of consecutive rows with ``back`` earlier and ``ahead`` later rows copied in."""
    size = max(chunk_rows, 4 * (back + ahead))
    return _spread(with_row_index(df, keys, ts, POSITION, step, chunk_rows), size, back, ahead)


def overlap_by_time(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    back: int,
    step: str = "hour",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Blocks of time with the rows of ``back`` earlier steps copied in; the position is in seconds, or months."""
    one = place_step(step)
    return _spread(df.withColumn(POSITION, place(ts, step)), one * max(chunk_rows, 4 * back), one * back, 0)


def block_window(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(POSITION)


def own_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Drop the copied rows and the helper columns."""
    return df.filter(OWN).drop(*[c for c in (BLOCK, OWN, POSITION) if c not in keep])


def attach(rows: DataFrame, values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the columns of ``values``, one row per group, to all rows of the group.

    Groups are matched NULL-safely.  That keeps the NULL group, and Spark then
    adds no NOT NULL filter to one side, so both can read the same shuffle.
    """
    if not by:
        one = values.select(F.struct("*").alias("_one")).scalar()
        return rows.withColumn("_one", one).select("*", "_one.*").drop("_one")
    renamed = values.withColumnsRenamed({b: f"_of_{b}" for b in by})
    match = [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]
    return rows.join(renamed, match, "left").drop(*[f"_of_{b}" for b in by])


def _count_below(value: str, places: Sequence[str]) -> str:
    """SQL for how many of the marks at these places lie below the value."""
    return " + ".join(f"if(get(_marks, {place}) < `{value}`, 1, 0)" for place in places)


def _with_slot(rows: DataFrame, value: str, side: int) -> DataFrame:
    """Number of marks below the value, among ``side * side - 1`` sorted marks.

    Every ``side``-th mark first, then the marks in between: two short sums of
    comparisons that compile to plain code.
    """
    upper = _count_below(value, [str(side * i - 1) for i in range(1, side)])
    lower = _count_below(value, [f"_upper * {side} + {j}" for j in range(side - 1)])
    return (
        rows.withColumn("_upper", F.expr(upper))
        .withColumn(CHUNK, F.expr(f"_upper * {side} + {lower}"))
        .drop("_marks", "_upper")
    )


def measured_side(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> int:
    """Side of a square of slots with about ``SLOT_VALUES`` distinct values each, for the group and column with the most.

    One pass over these columns with a cardinality sketch (HyperLogLog, combined on
    the map side); its result does not depend on the order of rows, and only one
    number comes to the driver.  At least ``LEAST_SIDE``, also for an empty table.
    """
    distinct = df.groupBy(*by).agg(F.greatest(F.lit(0), *[F.approx_count_distinct(v) for v in values]).alias("n"))
    most = distinct.agg(F.max("n")).first()[0] or 0
    return max(LEAST_SIDE, math.isqrt(most // SLOT_VALUES) + 1)


def in_slots(cells: DataFrame, by: Sequence[str], value: str, counts: Sequence[str], side: int) -> DataFrame:
    """Cells with the slot of their value (``CHUNK``): up to ``side * side`` slots per group, in the order of the values."""
    slots = side * side
    cuts = ", ".join(str(i / slots) for i in range(1, slots))
    # Reading the counts here keeps this aggregate on the same shuffle as the cells.
    known = f"if({' + '.join(f'`{c}`' for c in counts)} > 0, `{value}`, null)"
    marks = F.expr(f"percentile_approx({known}, array({cuts}), {20 * slots})")
    return _with_slot(attach(cells, cells.groupBy(*by).agg(marks.alias("_marks")), by), value, side)


def cumulative_counts(
    cells: DataFrame,
    by: Sequence[str],
    value: str,
    counts: Sequence[str],
    side: int = LEAST_SIDE,
) -> DataFrame:
    """Running and total counts over the ordered values of each group.

    ``cells`` has one row per group and distinct value with the counts of that
    value.  Adds ``<count>_upto`` (values at or below this one) and
    ``<count>_total``.  The values of a group are cut into about ``side * side``
    equal slots, so no task orders more than that share of a group; ``measured_side``
    finds a side from the number of distinct values.  The cuts come from an
    approximate quantile sketch, but the counts are exact for any cuts.
    """
    slotted = in_slots(cells, by, value, counts, side)
    summary = slotted.groupBy(*by, CHUNK).agg(*[F.sum(c).alias(c) for c in counts])
    whole = Window.partitionBy(*by)
    before = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *by,
        CHUNK,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_upto") for c in counts],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in counts],
        F.lit(True).alias(CARRY),
    )
    rows = slotted.withColumns(
        {CARRY: F.lit(False)} | {f"{c}_upto": F.col(c) for c in counts}
    ).unionByName(carried, allowMissingColumns=True)
    running = chunk_window(by, CHUNK, [F.col(value).asc()])
    return drop_carry(
        rows.withColumns(
            {f"{c}_upto": F.sum(f"{c}_upto").over(running) for c in counts}
            | {f"{c}_total": F.first(f"{c}_total", ignorenulls=True).over(running) for c in counts}
        ),
        CHUNK,
    )
