"""Merging a batch of rows into a table, on DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

SOURCE = "_source"


def duplicate_keys(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assert_unique(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail if a key occurs twice (runs a job); returns ``source`` for chaining."""
    first = duplicate_keys(source, keys).limit(1).collect()
    if first:
        raise ValueError(f"key {first[0].asDict()} occurs more than once")
    return source


def source_col(name: str) -> Column:
    """A column of the source row inside an update expression."""
    return F.col(f"{SOURCE}.{name}")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: str | Sequence[str] | Mapping[str, Column] | None = "all",
    insert: bool = True,
) -> DataFrame:
    """The target after merging the source into it.

    ``update``: ``'all'`` replaces matched rows by source rows; a list replaces
    only these columns; a mapping computes columns, where ``source_col`` names
    source values; ``None`` leaves matched rows alone.  ``insert`` adds source rows without a
    match.  Columns a source lacks become NULL on insert.  The source must be
    unique on ``keys`` (see ``assert_unique``).

    The small side of each join is the source, so Spark broadcasts it when its
    measured size allows and otherwise shuffles both sides on the full key,
    which is unique and hence not skewed.
    """
    if update == "all" and set(source.columns) != set(target.columns):
        update = [c for c in target.columns if c in source.columns and c not in keys]
    if update == "all":
        kept = target.join(source.select(*keys), list(keys), "left_anti")
        new = source if insert else source.join(target.select(*keys), list(keys), "left_semi")
        return kept.unionByName(new.select(*target.columns))
    if update is None:
        merged = target
    else:
        changes = (
            {c: source_col(c) for c in update} if not isinstance(update, Mapping) else dict(update)
        )
        payload = source.select(*keys, F.struct(*source.columns).alias(SOURCE))
        hit = F.col(SOURCE).isNotNull()
        types = {f.name: f.dataType for f in target.schema}
        merged = target.join(payload, list(keys), "left").select(
            *[
                F.when(hit, changes[c].cast(types[c])).otherwise(F.col(c)).alias(c)
                if c in changes
                else F.col(c)
                for c in target.columns
            ]
        )
    if not insert:
        return merged
    fresh = source.join(target.select(*keys), list(keys), "left_anti")
    fresh = fresh.select(*[c for c in source.columns if c in target.columns])
    return merged.unionByName(fresh, allowMissingColumns=True).select(*target.columns)


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First writer wins: add only rows whose key is not there yet."""
    return upsert(target, rows, keys, update=None, insert=True)


def exists_rows(rows: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is already in the target."""
    return rows.join(target.select(*keys), list(keys), "left_semi")
