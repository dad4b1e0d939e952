"""Token files: ids in document order, coded by frequency rank in a byte-aligned code with separate control bytes.

A file set is a folder with two Parquet tables.

* ``ranks``: (rank, id, times); rank 0 is the most frequent id, equal counts go to the smaller id.
* ``blocks``: one row per block of whole documents, in ascending order of doc_id over blocks and inside them:
  block, n_docs, n_ids, doc_ids (array), lengths (array), control (binary), data (binary).

A rank takes 1 to 4 little-endian bytes in ``data``; two bits of ``control`` say how many, four ranks to a control byte, the first in the lowest bits.
Ranks by frequency make one byte the usual case, and decoding is a lookup of the control byte in a table of four lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm.common import running_total, saved
from hourcast.llm.tokens import crc, id_and_text, id_kind, token_batches

BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1 << 14
PARTITION_IDS = 1 << 22
_LENGTHS = np.stack([(np.arange(256) >> (2 * i)) & 3 for i in range(4)], axis=1).astype(np.int64) + 1
BLOCKS = "block long, n_docs long, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    whole = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), whole[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Ranks from control bytes and data bytes, by table lookup."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size)
    flat = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)).astype(np.uint32)
    begins = ends - size
    out = flat[begins]
    for i in range(1, 4):
        longer = size > i
        if longer.any():
            out[longer] |= flat[begins[longer] + i] << np.uint32(8 * i)
    return out


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and packed ids (end id included) of every whole text."""
    kind = id_kind(path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in token_batches(rows, path, end_id):
            packed = pa.array([x.astype(kind).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), packed], names=["doc_id", "n_tokens", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """How often each id occurs: counted per task, then summed, so at most a vocabulary per task is shuffled."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in rows:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)
            counts = np.bincount(ids, minlength=len(total))
            counts[: len(total)] += total
            total = counts
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "times"])

    return tokens.select("ids").mapInArrow(run, "id long, times long").groupBy("id").agg(F.sum("times").alias("times"))


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 2) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write the file set.

    NULL text is empty and has the end id alone; NULL doc_id comes first; rows with one doc_id stand next to each other, in the order of a
    hash of their ids.
    """
    spark = docs.sparkSession
    kind = id_kind(path)
    tokens = saved(token_table(docs, path, end_id), "tokens")
    counts = id_counts(tokens, kind).collect()  # at most the vocabulary
    order = sorted(((row["times"], -row["id"]) for row in counts), reverse=True)
    ids = np.array([-i for _, i in order], np.int64)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))
    ranks = [(k, int(-i), int(n)) for k, (n, i) in enumerate(order)]
    spark.createDataFrame(ranks, "rank long, id long, times long").coalesce(1).write.parquet(f"{folder}/ranks")
    shared = spark.sparkContext.broadcast(rank_of)
    total = sum(n for n, _ in order)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = shared.value
        block = TaskContext.get().partitionId() << 32

        def made(names: list, sizes: list, parts: list) -> pa.RecordBatch:
            control, data = pack(rank_of[np.frombuffer(b"".join(parts), kind)])
            columns = [[block], [len(names)], [sum(sizes)], [names], [sizes], [control], [data]]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        names, sizes, parts, held = [], [], [], 0
        for batch in rows:
            for name, size, part in zip(*(c.to_pylist() for c in batch.columns)):
                if names and (held + size > BLOCK_IDS or len(names) >= BLOCK_DOCS):
                    yield made(names, sizes, parts)
                    block += 1
                    names, sizes, parts, held = [], [], [], 0
                names.append(name)
                sizes.append(size)
                parts.append(part)
                held += size
        if names:
            yield made(names, sizes, parts)

    parts = max(1, -(-total // PARTITION_IDS))
    # The hash splits rows that share a doc_id, and keeps the ids themselves out of the sample that finds the ranges.
    ranged = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").drop("tie")
    ranged.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a file set in order: block, place (in the block), doc_id, n_tokens, ids (array of long) and start, the ids of all documents before.

    A whole-block decode; starts come from the block heads, folded over blocks.
    """
    docs = _decoded(spark, folder, "block long, place long, doc_id long, before long, n_tokens long, ids array<long>", lambda ids: ids.tolist())
    return _started(spark, folder, docs)


def document_checks(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    docs = _decoded(spark, folder, "block long, place long, doc_id long, before long, n_tokens long, ids_crc32 long", crc)
    return _started(spark, folder, docs).select("doc_id", "start", "n_tokens", "ids_crc32")


def _decoded(spark: SparkSession, folder: str, schema: str, last) -> DataFrame:
    ids = np.array([row["id"] for row in spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").collect()], np.uint32)
    shared = spark.sparkContext.broadcast(ids)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = shared.value
        names = [c.split()[0] for c in schema.split(", ")]
        tail = pa.list_(pa.int64()) if "array" in schema else pa.int64()
        for batch in rows:
            for block, _, n, doc_ids, lengths, control, data in zip(*(c.to_pylist() for c in batch.columns)):
                found = id_of[unpack(control, data, n)]
                ends = np.cumsum(lengths)
                begins = ends - lengths
                cuts = [last(found[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [[block] * len(cuts), range(len(cuts)), doc_ids, begins, lengths, cuts]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 5 + [tail])], names=names)

    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").mapInArrow(run, schema)


def _started(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    heads = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select("block", "n_ids", F.shiftright("block", 32).alias("cell"))
    starts = running_total(heads, "n_ids", "cell", [F.col("block")]).select("block", F.col("before").alias("__start"))
    return docs.join(starts, "block").withColumn("start", F.col("__start") + F.col("before")).drop("__start", "before")
