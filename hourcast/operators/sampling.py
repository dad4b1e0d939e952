"""Exact-size samples without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CELLS = 65_536  # values of the first 16 bits of a hash


def sample_n(df: DataFrame, n: int | Column, seed: int, ids: Sequence[str]) -> DataFrame:
    """``n`` rows chosen by a seeded hash of their id (MD5 of its text): the same rows on every run and engine.

    ``ids`` must identify a row.  ``n`` may be a scalar subquery such as the row count of another table.  The
    hash spreads the rows evenly over cells; whole cells are taken up to the one
    where the sample fills up, and only that cell is ordered.
    """
    limit = F.lit(n) if isinstance(n, int) else n
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids], F.lit(str(seed)))
    # The first 16 bits are the cell, so cells and hashes have one order.
    hashed = df.withColumn("_hash", F.md5(text.cast("binary"))).withColumn(
        "_cell", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int")
    )
    # At most CELLS rows, so this table may be ordered in one task and broadcast.
    sizes = hashed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = sizes.withColumn("_upto", F.sum("_n").over(running)).select(
        "_cell", (limit - F.col("_upto") + F.col("_n")).alias("_room"), "_n"
    )
    # A cell is taken whole, in part, or not at all.
    taken = hashed.join(F.broadcast(room.filter("_room > 0")), "_cell")
    whole = taken.filter("_n <= _room")
    order = Window.partitionBy("_cell").orderBy("_hash", *ids)
    part = (
        taken.filter("_n > _room")
        .withColumn("_place", F.row_number().over(order))
        .filter("_place <= _room")
    )
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def latest(df: DataFrame, ts: str, by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """The newest row overall or per group; an aggregate, so no group is gathered.

    Only the time and ``ties`` are compared, so other columns may be of any type.
    """
    rest = [c for c in df.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.struct(ts, *ties)).alias("_newest")
    return df.groupBy(*by).agg(newest).select(*by, "_newest.*").select(*df.columns)
