"""Line dedup: winnowed line fingerprints, matches extended line by line, later repeated runs deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourcast.llm.common import SPACES, bytes_of, classes, mixed, saved, span_hashes

LINE = classes("\n", False)
HEAD = "doc_id long, text_hash long, lines array<long>, windows array<struct<mark:long,whole:long,first:int,last:int>>"


def lines_of(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and word count of every line of a batch (empty lines too), and where each document's lines begin."""
    n = len(flat)
    stop = np.zeros(n + 1, bool)
    stop[np.flatnonzero(flat == 10)] = True
    breaks = np.flatnonzero(stop)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    kind = np.concatenate([np.zeros(len(offsets) - 1, np.int64), np.ones(len(breaks), np.int64)])
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((kind, starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.append(starts[1:] - 1, n)
    last = np.append(owner[1:] != owner[:-1], True)
    ends[last] = offsets[1:][owner[last]]
    apart = SPACES[1][flat]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = ~apart
    begin[1:] &= apart[:-1] | edge[1:n]
    words = np.zeros(n + 1, np.int64)
    np.cumsum(begin, out=words[1:])
    return span_hashes(flat, starts, ends), words[ends] - words[starts], np.searchsorted(owner, np.arange(len(offsets)))


def winnow(hashes: np.ndarray, words: np.ndarray, guarantee: int) -> list[tuple[int, int, int, int]]:
    """Fingerprints of one document: for every shortest window of lines with at least ``guarantee`` words, the least line hash in it, the hash of the
    whole window, its first and its last line. Any run of that many words contains a window, so two texts that share the run share its fingerprint."""
    total = np.cumsum(words)
    firsts = np.flatnonzero(words > 0)
    lasts = np.searchsorted(total, total[firsts] - words[firsts] + guarantee)
    fit = lasts < len(words)
    out = []
    for a, b in zip(firsts[fit].tolist(), lasts[fit].tolist()):
        if a == b:
            mark = whole = hashes[a]
        else:
            part = hashes[a : b + 1]
            mark = part.min()
            whole = mixed(np.bitwise_xor.reduce(mixed(part + np.arange(1, len(part) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), keepdims=True))[0]
        out.append((mark, whole, a, b))
    return out


def agreeing(left: np.ndarray, right: np.ndarray) -> int:
    """How many elements agree from the start on, looked up in pieces that double."""
    n = min(len(left), len(right))
    done, size = 0, 32
    while done < n:
        apart = np.flatnonzero(left[done : min(done + size, n)] != right[done : min(done + size, n)])
        if len(apart):
            return done + int(apart[0])
        done, size = done + size, size * 2
    return n


def runs(own: np.ndarray, other: np.ndarray, anchors: list[tuple[int, int]]) -> list[int]:
    """Lines of ``own`` in the matches that contain an anchor (first line here, first line there), extended both ways as far as lines agree.

    ``anchors`` ascend. One is skipped only if the match of its own diagonal (here - there) covers it: a line that another match deletes may
    still start a match that goes further.
    """
    ends: dict[int, int] = {}
    marks = np.zeros(len(own) + 1, np.int64)
    for here, there in anchors:
        if here < ends.get(here - there, 0):
            continue
        end = here + agreeing(own[here:], other[there:])
        marks[here - agreeing(own[:here][::-1], other[:there][::-1])] += 1
        marks[end] -= 1
        ends[here - there] = end
    return np.flatnonzero(np.cumsum(marks) > 0).tolist()


def heads(docs: DataFrame, guarantee: int) -> DataFrame:
    """doc_id, a hash of the text, the number of the row among equal rows, uid, line hashes and fingerprint windows of every document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            hashes, words, begins = lines_of(*bytes_of(batch.column(2)))
            signed = hashes.view(np.int64)
            spans = list(zip(begins[:-1].tolist(), begins[1:].tolist()))
            found = [winnow(hashes[a:b], words[a:b], guarantee) for a, b in spans]
            flat = [x for w in found for x in w]
            columns = list(zip(*flat)) if flat else [[]] * 4
            parts = [np.array(columns[0], np.uint64).view(np.int64), np.array(columns[1], np.uint64).view(np.int64), np.array(columns[2], np.int32), np.array(columns[3], np.int32)]
            windows = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *(len(w) for w in found)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(p) for p in parts], names=["mark", "whole", "first", "last"]),
            )
            lines = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(signed))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lines, windows], names=["doc_id", "text_hash", "lines", "windows"])

    found = docs.select(F.col("doc_id").cast("long"), text_hash(), F.col("text").cast("binary")).mapInArrow(run, HEAD)
    return found.withColumn("uid", F.monotonically_increasing_id())


def text_hash():
    return F.xxhash64("text").alias("text_hash")


def repeated_lines(docs: DataFrame, guarantee: int = 8) -> DataFrame:
    """Lines that ``dedup_lines`` deletes: doc_id, text_hash, copy (number among rows with equal id and text), n_lines and deleted (line numbers)."""
    table = saved(heads(docs, guarantee), "lines")
    one = Window.partitionBy("doc_id", "text_hash").orderBy("uid")
    windows = table.select("doc_id", "uid", F.explode("windows").alias("w")).select("doc_id", "uid", "w.*")
    key = ["mark", "whole"]
    first = windows.groupBy(*key).agg(F.min(F.struct("doc_id", "uid", "first")).alias("source"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(first, key).filter((F.col("uid") != F.col("source.uid")) | (F.col("first") != F.col("source.first")))
    anchors = later.groupBy("uid", F.col("source.uid").alias("other")).agg(
        F.sort_array(F.collect_list(F.struct("first", F.col("source.first").alias("there")))).alias("anchors")  # at most one per line
    )
    lines = table.select("uid", F.col("lines").alias("own"))
    met = anchors.join(lines, "uid").join(lines.select(F.col("uid").alias("other"), F.col("own").alias("theirs")), "other")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            uids, all_anchors, own, theirs = batch.columns
            out = []
            for i, found in enumerate(all_anchors.to_pylist()):
                mine, other = own[i].values.to_numpy(zero_copy_only=False), theirs[i].values.to_numpy(zero_copy_only=False)
                out.append(runs(mine, other, [(a["first"], a["there"]) for a in found]))
            yield pa.RecordBatch.from_arrays([uids, pa.array(out, pa.list_(pa.int32()))], names=["uid", "deleted"])

    gone = met.select("uid", "anchors", "own", "theirs").mapInArrow(run, "uid long, deleted array<int>")
    per_row = gone.groupBy("uid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("deleted")))).alias("deleted"))
    numbered = table.select("uid", "doc_id", "text_hash", F.size("lines").alias("n_lines"), F.row_number().over(one).alias("copy"))
    return numbered.join(per_row, "uid").drop("uid")


def dedup_lines(docs: DataFrame, guarantee: int = 8) -> DataFrame:
    """The documents without later repeated runs of lines, with two more columns: ``n_lines`` and ``n_deleted``.

    Rows are ordered by doc_id (NULL first); of equal ids the order is fixed by a table of the run. A window is a shortest run of lines with at least
    ``guarantee`` words; its first occurrence is its source. Where a window occurs again, the match with its source is extended line by line both ways,
    and its lines are deleted. So every repeated run of ``guarantee`` words goes but for its first copy, and the first copy of a line always stays.
    Lines are compared by 64-bit hashes of their bytes; empty lines count as lines without words.

    Columns of the input named like the two new ones are replaced. NULL text stays NULL with 0 lines; a text without words, or with fewer than ``guarantee`` words, stays. Where all lines go, the text is empty.
    """
    key = ["__id", "__none", "__hash"]

    def keyed(df: DataFrame, text) -> DataFrame:
        return df.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__none": F.col("doc_id").isNull(), "__hash": text})

    # Of equal rows, all but the first lose the same lines. One key for join and numbering: the texts are shuffled once.
    plan = keyed(repeated_lines(docs, guarantee), F.col("text_hash")).groupBy(*key).agg(
        F.max(F.when(F.col("copy") == 1, F.col("deleted"))).alias("__first"), F.max(F.when(F.col("copy") > 1, F.col("deleted"))).alias("__later")
    )
    number = F.row_number().over(Window.partitionBy(*key).orderBy("__hash"))
    marked = keyed(docs, F.xxhash64("text")).join(plan, key, "left").withColumn("__deleted", F.when(number == 1, F.col("__first")).otherwise(F.col("__later")))
    lines = F.split("text", "\n", -1)
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__deleted", i)), "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    columns = [F.when(F.col("__deleted").isNull(), F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return marked.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("__deleted"), F.lit(0)).alias("n_deleted"))
