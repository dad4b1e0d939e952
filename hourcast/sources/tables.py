"""Tables by catalog name or by path, and safe ways to write them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import date
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hourcast.operators.upsert import assert_unique, upsert
from hourcast.session import ensure_checkpoint_dir
from hourcast.sources import manifests


def is_path(name: str) -> bool:
    return "/" in name


def load(spark: SparkSession, name: str) -> DataFrame:
    """A table by catalog name, or by path: the current state of a table with manifests, or a Parquet folder."""
    if not is_path(name):
        return spark.read.table(name)
    state = manifests.current(spark, name)
    return manifests.read(spark, name, state) if state else spark.read.parquet(name)


def exists(spark: SparkSession, name: str) -> bool:
    if not is_path(name):
        return spark.catalog.tableExists(name)
    if manifests.managed(spark, name):
        return bool(manifests.versions(spark, name))
    try:
        load(spark, name)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def save(
    df: DataFrame, name: str, partition_by: Sequence[str] = (), mode: str = "overwrite", format: str = "parquet"
) -> None:
    """Write a plain table; the plan of ``df`` must not read the same table (see ``merge_into``)."""
    if is_path(name) and manifests.versions(df.sparkSession, name):
        raise ValueError(f"{name} has manifests: use append, replace_table, write_months or merge_into")
    writer = df.write.mode(mode).format(format).partitionBy(*partition_by)
    writer.save(name) if is_path(name) else writer.saveAsTable(name)


def create_if_absent(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """Create the table from ``df`` unless it exists already."""
    save(df, name, partition_by, mode="ignore")


def assert_known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself, or an error if one of the columns holds a NULL (runs a job)."""
    if df.filter(" or ".join(f"`{c}` is null" for c in columns)).limit(1).count():
        raise ValueError(f"NULL in {list(columns)}")
    return df


@contextmanager
def settled(df: DataFrame) -> Iterator[DataFrame]:
    """The rows of ``df``, written to the shared folder for as long as they are needed.

    The copy does not read what the plan of ``df`` reads, also not after a lost executor, and is removed afterwards.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def create_feature_table(df: DataFrame, name: str, primary_key: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Create a keyed table after checking that the key is unique and never NULL (runs jobs)."""
    save(assert_unique(assert_known(df, primary_key), primary_key), name, partition_by, mode="errorifexists")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def snapshot(df: DataFrame, root: str, version: int) -> str:
    """Freeze a data set under a version number; an existing version is an error."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_config(spark: SparkSession, name: str) -> dict[str, Any]:
    """The single row of a configuration table."""
    row = load(spark, name).first()
    if row is None:
        raise ValueError(f"{name} has no row")
    return row.asDict()


def rows_to_df(spark: SparkSession, rows: Sequence[tuple], schema: str | StructType) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def append(df: DataFrame, name: str, step: str | None = None) -> None:
    """Add rows to a table, all or none; creates it. The rows of a named ``step`` are added once, however often it is started.

    A Parquet folder without manifests and a catalog table are appended to as Spark does it; they know no steps.
    """
    spark = df.sparkSession
    if not is_path(name):
        return save(df, name, mode="append")
    state = manifests.current(spark, name)
    if state is None and exists(spark, name):
        return save(df, name, mode="append")
    if state is None or step is None or step not in state.steps:
        manifests.change(manifests.aligned(df, state) if state else df, name, state, step=step)


def append_if_absent(rows: DataFrame, name: str, keys: Sequence[str]) -> None:
    """Append the rows whose key the table does not hold yet; creates the table."""
    spark = rows.sparkSession
    if exists(spark, name):
        rows = rows.join(load(spark, name).select(*keys), list(keys), "left_anti")
    # The list of new rows is fixed before the table it was compared with grows.
    with settled(rows) as fixed:
        if fixed.limit(1).count() or not exists(spark, name):
            append(fixed, name)


# Tasks that write one month, and so the files it gets.
FILES_PER_MONTH = 4


def by_month(df: DataFrame, spread: Sequence[str], month: str = "month_key") -> DataFrame:
    """Rows of a month brought together in FILES_PER_MONTH tasks, so that a write leaves few files per month."""
    return df.repartition(F.col(month), F.pmod(F.xxhash64(*spread), F.lit(FILES_PER_MONTH)))


def _state(spark: SparkSession, path: str) -> manifests.Manifest | None:
    state = manifests.current(spark, path)
    if state is None and exists(spark, path):
        raise ValueError(f"{path} is a plain folder: load it and write it to a new path")
    return state


def write_months(df: DataFrame, path: str, spread: Sequence[str], month: str = "month_key") -> None:
    """Write the months that occur in ``df`` and leave the others as they are, in one commit; ``df`` may read ``path``."""
    state = _state(df.sparkSession, path)
    manifests.change(by_month(manifests.aligned(df, state) if state else df, spread, month), path, state, month)


def replace_table(df: DataFrame, name: str) -> None:
    """Replace a small table, such as the version table, by a frame that may itself read it."""
    if is_path(name):
        state = manifests.current(df.sparkSession, name)
        if state or not exists(df.sparkSession, name):
            manifests.change(df, name, state, keep=False)
            return
    with settled(df) as fixed:
        save(fixed, name)


def with_month(df: DataFrame, ts: str, name: str = "month_key") -> DataFrame:
    """Partition column for tables that are updated by day: the month as text."""
    return df.withColumn(name, F.date_format(ts, "yyyy-MM"))


def merge_into(
    source: DataFrame,
    path: str,
    keys: Sequence[str],
    ts: str,
    update: str | Sequence[str] | Mapping[str, Column] | None = "all",
    insert: bool = True,
    month: str = "month_key",
) -> None:
    """Upsert a batch into a Parquet table partitioned by month; creates the table.

    Only the months of the batch are read and merged, and written anew beside the old ones; one commit puts them in their place, or fails if the table
    has changed since it was read (``ConcurrentWrite``). The batch is cached while its keys are checked and its months are merged. A NULL time or key
    is an error: such a row has no month, and matches nothing.
    """
    spark = source.sparkSession
    batch = with_month(source, ts, month).persist()
    try:
        assert_unique(assert_known(batch, sorted({*keys, ts})), keys)
        state = _state(spark, path)
        if state is None:
            if insert:
                manifests.change(by_month(batch, keys, month), path, None, month)
            return
        touched = months_of(manifests.read(spark, path, state), months_in(batch, month), month)
        merged = manifests.aligned(upsert(touched, batch, keys, update, insert), state)
        manifests.change(by_month(merged, keys, month), path, state, month)
    finally:
        batch.unpersist()


def months_in(df: DataFrame, month: str = "month_key") -> list[str]:
    """The months that occur: one value per calendar month (runs a job)."""
    return [row[0] for row in df.select(month).distinct().collect()]


def months_of(table: DataFrame, months: Sequence[str], month: str = "month_key") -> DataFrame:
    """The partitions of some months."""
    return table.withColumn(month, F.col(month).cast("string")).filter(F.col(month).isin(list(months)))


def months_between(table: DataFrame, start: date, end: date, month: str = "month_key") -> DataFrame:
    """The partitions of all months from ``start`` to ``end`` (both inclusive), without the partition column.

    The bounds are constants, so Spark lists and opens no other month.
    """
    key = F.col(month).cast("string")
    return table.filter((key >= F.lit(f"{start:%Y-%m}")) & (key <= F.lit(f"{end:%Y-%m}"))).drop(month)
