"""Tables whose state is one small file: immutable folders of data, and numbered manifests that list those in use.

A writer puts its rows into a new folder and then adds the next manifest by a rename that does not replace. So a reader sees the state before or after a
write and no mixture, a write that dies leaves the state as it was, and of two writers that started from one state the second is refused.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFESTS, DATA, WRITE = "_manifests", "data", "__write"


class ConcurrentWrite(RuntimeError):
    """Another writer changed the table since its state was read."""


@dataclass(frozen=True)
class Manifest:
    """State of a table: folders below its root by name (a partition, or the write they come from), schema, and the steps whose rows it holds."""

    version: int
    schema: str
    parts: dict[str, str] = field(default_factory=dict)
    steps: tuple[str, ...] = ()


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the states that can be read, oldest first."""
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/{MANIFESTS}") if re.fullmatch(r"\d{20}\.json", n))


def managed(spark: SparkSession, path: str) -> bool:
    """Whether the folder is laid out this way, also if its first write has died before its commit."""
    return bool(versions(spark, path)) or any(n.startswith(f"{WRITE}=") for n in _names(spark, f"{path}/{DATA}"))


def current(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The newest state, or the one of a number; None if there is none."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        return None
    fs, file = _files(spark, f"{path}/{MANIFESTS}/{known[-1] if version is None else version:020d}.json")
    stream = fs.open(file)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(found["version"], found["schema"], found["parts"], tuple(found["steps"]))


def read(spark: SparkSession, path: str, state: Manifest) -> DataFrame:
    """The rows of a state; partitions that a filter leaves out are not opened."""
    schema = StructType.fromJson(json.loads(state.schema))
    if not state.parts:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/{p}" for p in sorted(set(state.parts.values()))]
    return spark.read.schema(schema).option("basePath", f"{path}/{DATA}").parquet(*folders).drop(WRITE)


def write(df: DataFrame, path: str, partition: str | None = None) -> dict[str, str]:
    """Put rows into a new folder that no state lists yet; its parts by name."""
    name = uuid.uuid4().hex
    folder = f"{DATA}/{WRITE}={name}"
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(f"{path}/{folder}")
    if not partition:
        return {name: folder}
    return {n.split("=", 1)[1]: f"{folder}/{n}" for n in _names(df.sparkSession, f"{path}/{folder}") if n.startswith(f"{partition}=")}


def commit(spark: SparkSession, path: str, state: Manifest) -> None:
    """Make a state the current one; its number must be the next. The rename is atomic where the file system's is."""
    fs, folder = _files(spark, f"{path}/{MANIFESTS}")
    fs.mkdirs(folder)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
    stream = fs.create(fresh, False)
    stream.write(bytearray(json.dumps({"version": state.version, "schema": state.schema, "parts": state.parts, "steps": list(state.steps)}).encode()))
    stream.close()
    final = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{state.version:020d}.json")
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark._sc._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fresh, final, options)
    except Exception as error:
        fs.delete(fresh, False)
        if "FileAlreadyExistsException" in str(error):
            raise ConcurrentWrite(f"{path}: state {state.version} was written meanwhile") from None
        raise


def change(df: DataFrame, path: str, old: Manifest | None, partition: str | None = None, keep: bool = True, step: str | None = None) -> Manifest:
    """The state after ``old`` with the rows of ``df``: new parts replace those of the same name, the others stay (``keep``) or go.

    ``df`` may read the table itself. If another writer was first, its state stays and the new rows are removed.
    """
    spark = df.sparkSession
    parts = write(df, path, partition)
    steps = (*(old.steps if old else ()), *([step] if step else []))
    schema = old.schema if old and keep else df.schema.json()
    new = Manifest((old.version if old else 0) + 1, schema, {**(old.parts if old and keep else {}), **parts}, steps)
    try:
        commit(spark, path, new)
    except ConcurrentWrite:
        for folder in {"/".join(p.split("/")[:2]) for p in parts.values()}:
            fs, at = _files(spark, f"{path}/{folder}")
            fs.delete(at, True)
        raise
    return new


def remove_old(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all but the newest ``keep`` states, and the data that none of these lists; returns how many states went.

    Not while a write is going on, whose folder no state lists yet; and a reader of a removed state finds its files gone.
    """
    known = versions(spark, path)
    if keep < 1:
        raise ValueError("at least the current state stays")
    states = [current(spark, path, v) for v in known[-keep:]]
    used = {p for s in states for p in s.parts.values()}
    for v in known[:-keep]:
        fs, file = _files(spark, f"{path}/{MANIFESTS}/{v:020d}.json")
        fs.delete(file, False)
    for name in _names(spark, f"{path}/{DATA}"):
        folder = f"{DATA}/{name}"
        if not name.startswith(f"{WRITE}="):
            continue
        inside = [n for n in _names(spark, f"{path}/{folder}") if "=" in n]
        gone = [folder] if not any(p == folder or p.startswith(f"{folder}/") for p in used) else [f"{folder}/{n}" for n in inside if f"{folder}/{n}" not in used]
        for part in gone:
            fs, at = _files(spark, f"{path}/{part}")
            fs.delete(at, True)
    return len(known[:-keep])


def aligned(df: DataFrame, state: Manifest) -> DataFrame:
    """The columns in the order and types of the table; other columns are an error."""
    schema = StructType.fromJson(json.loads(state.schema))
    if sorted(df.columns) != sorted(schema.names):
        raise ValueError(f"columns {df.columns}, not {schema.names}")
    return df.select(*[df[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in schema])

