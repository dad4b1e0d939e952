"""What the corpus operators share: tables in the shared folder, running totals, components, word hashes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourcast.session import ensure_checkpoint_dir


def tables_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(spark: SparkSession) -> SparkSession:
    """Session settings of all operators: batches for Python are bounded in bytes, and keys are spread by all their columns."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.requireAllClusterKeysForDistribution", "true")
    # Python workers import this package: they look where the driver found it (on a cluster it is installed, or sent with --py-files)
    context, root = spark.sparkContext, str(Path(__file__).resolve().parents[2])
    known = context.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
    return spark


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder that ``spark.checkpoint.dir`` names."""
    _MADE.append(f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def made_so_far() -> int:
    return len(_MADE)


def drop_made(spark: SparkSession, first: int, last: int, unless_read_by: DataFrame) -> None:
    """Delete the scratch tables of a stretch of calls, when their results are written; a frame that still reads one keeps it."""
    read = unless_read_by.inputFiles()
    for path in _MADE[first:last]:
        if not any(path.rsplit("/", 1)[-1] in file for file in read):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()  # shuffle files of finished steps go when the driver notices that nothing refers to them
    return spark.read.schema(df.schema).parquet(path)


def number_rows(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small frame of whole numbers, sent as Arrow: rows sent as Python objects would start a second pool of workers on every executor."""
    return spark.createDataFrame(pa.table([pa.array([row[i] for row in rows], pa.int64()) for i in range(len(columns))], names=columns))


def running_total(df: DataFrame, value: str, cell: str, order: list[Column], within: list[str] = (), out: str = "before") -> DataFrame:
    """Sum of ``value`` over the rows before each row, in the order (cell, order), separately per ``within``.

    ``cell`` is a column that agrees with the order and has many values, so no task holds a whole group: cells are
    summed first (with map-side combine), one row per cell is folded, and rows are ordered inside their cell only.
    """
    keys = [*within, cell]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__cell"))
    ahead = Window.partitionBy(*within).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    folded = totals.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.coalesce(F.sum("__cell").over(ahead), F.lit(0)).alias("__base"))
    match = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = df.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return counted.join(folded, match).withColumn(out, F.col("__base") + F.col("__in")).drop("__in", "__base", *(f"__k_{k}" for k in keys))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of links (a, b): rows (node, component) for linked nodes, component = smallest node.

    Alternating large and small stars; only minima (combined on the map side) and equi-joins, so a node with very
    many links is never gathered in one task. Each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    a, b = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    links = saved(edges.filter("a <> b").select(b, a).distinct(), f"{name}-links")
    seen = None
    for _ in range(60):
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = saved(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}-links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    pairs = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


# --- hashing of words and lines in Arrow batches ---------------------------------------------------------------------

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offsets of its values; NULL is empty."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def classes(separators: str, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Tables over byte values: folded byte, and whether the byte separates."""
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    apart = np.zeros(256, bool)
    apart[list(separators.encode("latin-1"))] = True
    return fold, apart


SPACES = classes(" \t\n\x0b\x0c\r", True)


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a byte string, from running sums: equal bytes have equal hashes wherever they stand."""
    up, down = _powers(len(flat))
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_TABLE[flat] * up[: len(flat)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(flat: np.ndarray, offsets: np.ndarray, table=SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents of a batch, and where each document's words begin in that list."""
    fold, apart = table
    n = len(flat)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    folded = fold[flat]
    inside = ~apart[folded]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes = span_hashes(folded, at, to)
    return hashes, np.searchsorted(at, offsets)


_ODD = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words in a list (runs across documents too; the caller cuts)."""
    n = max(0, len(words) - size + 1)
    total = np.full(n, np.uint64(size * int(_ODD[4]) & MASK), np.uint64)
    for i in range(size):
        total = (total ^ words[i : i + n]) * _ODD[i % 4]
        total ^= total >> np.uint64(29)
    return mixed(total)


def shingles(words: np.ndarray, grams: np.ndarray, at: int, to: int, size: int) -> np.ndarray:
    """Sorted distinct shingles of one document; fewer words than ``size`` make one shingle, none make none."""
    if to - at >= size:
        return np.unique(grams[at : to - size + 1])
    return gram_hashes(words[at:to], to - at) if to > at else np.zeros(0, np.uint64)


def batches(rows: dict[str, list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
