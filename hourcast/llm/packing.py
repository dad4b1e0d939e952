"""Packing documents into training windows by non-negative least squares over shallow length combinations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourcast.llm.common import number_rows, running_total, saved
from hourcast.llm.tokens import crc, id_and_text, id_kind, token_batches

PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
CELL_ROWS = 20_000
STRETCH = 1 << 16


@lru_cache(maxsize=4)
def combinations(bins: int, depth: int) -> np.ndarray:
    """Counts per length of all multisets of at most ``depth`` lengths that fill ``bins`` exactly: one column each."""
    found: list[list[int]] = []

    def add(left: int, most: int, parts: list[int]) -> None:
        if left == 0:
            found.append(parts)
            return
        if len(parts) < depth:
            slots = depth - len(parts)
            for part in range(min(left, most), -(-left // slots) - 1, -1):
                add(left - part, part, [*parts, part])

    add(bins, bins, [])
    out = np.zeros((bins + 1, len(found)), np.int16)
    for k, parts in enumerate(found):
        for part in parts:
            out[part, k] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative x with least |ax - b|, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    inside = np.zeros(a.shape[1], bool)
    for _ in range(rounds or 3 * a.shape[0]):
        pull = a.T @ (b - a @ x)
        pull[inside] = -np.inf
        best = int(np.argmax(pull))
        if pull[best] <= 1e-10 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        inside[best] = True
        while True:
            own = np.flatnonzero(inside)
            trial = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if len(own) == 0 or trial.min() > 0:
                break
            bad = trial <= 0
            now = x[own]
            step = np.min(now[bad] / np.maximum(now[bad] - trial[bad], 1e-300))
            x[own] = now + step * (trial - now)
            gone = own[x[own] <= 1e-12]
            if not len(gone):
                gone = own[bad]
            x[gone] = 0
            inside[gone] = False
        x[:] = 0
        x[own] = np.maximum(trial, 0) if len(own) else 0
    return x


def plan_windows(histogram: np.ndarray, depth: int) -> list[tuple[dict[int, int], int]]:
    """Window templates (count per length) and how often each is used, which use up a histogram of lengths 1 to bins.

    Least squares gives repeat counts of the combinations that fill a window; they are rounded, as far as the documents last, and the documents left
    over are packed greedily: the longest first, each window filled with the longest that still fit.
    """
    bins = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []
    if left.sum():
        table = combinations(bins, depth)
        share = float(left.sum())
        x = nnls(table[1:].astype(float), left[1:] / share) * share
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            used = np.flatnonzero(table[:, k])
            times = min(int(round(x[k])), int((left[used] // table[used, k]).min()))
            if times:
                plan.append(({int(u): int(table[u, k]) for u in used}, times))
                left[used] -= times * table[used, k].astype(np.int64)
    while left.any():
        room, parts = bins, {}
        for length in range(bins, 0, -1):
            fit = min(room // length, int(left[length]))
            if fit:
                parts[length] = fit
                room -= fit * length
        times = min(int(left[length] // count) for length, count in parts.items())
        plan.append((parts, times))
        for length, count in parts.items():
            left[length] -= times * count
    return plan


def slots(plan: list[tuple[dict[int, int], int]], first: int) -> tuple[list[tuple], int]:
    """Where the k-th document of a length goes: rows (bin, rank_from, rank_to, sequence, per_window, slot); and the next free sequence."""
    rows, taken = [], {}
    for parts, times in plan:
        slot = 0
        for length, count in sorted(parts.items(), reverse=True):
            begin = taken.get(length, 0)
            rows.append((length, begin, begin + count * times, first, count, slot))
            taken[length] = begin + count * times
            slot += count
        first += times
    return rows, first


def measured(docs: DataFrame, path: str, end_id: int, window: int, fillers: int, keep_encoder: bool = True) -> DataFrame:
    """uid, doc_id, n_tokens, crcs (of each window-sized cut), filler and, for fillers alone, the packed ids."""
    kind = id_kind(path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in token_batches(rows, path, end_id, keep_encoder):
            chosen = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([[] if f else [crc(x[i : i + window]) for i in range(0, len(x), window)] for f, x in zip(chosen, found)], pa.list_(pa.int64())),
                    batch.column(2),
                    pa.array([x.astype(kind).tobytes() if f else None for f, x in zip(chosen, found)], pa.binary()),
                ],
                names=["doc_id", "n_tokens", "crcs", "filler", "ids"],
            )

    chosen = F.pmod(F.xxhash64(F.lit("filler"), "doc_id"), F.lit(fillers)) == 0
    schema = "doc_id long, n_tokens long, crcs array<long>, filler boolean, ids binary"
    found = id_and_text(docs).withColumn("filler", chosen).mapInArrow(run, schema)
    return found.withColumn("uid", F.monotonically_increasing_id())


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, window: int = 4096, quantum: int = 64, depth: int = 5, fillers: int = 8, keep_encoder: bool = True) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most ``window`` tokens, gapless and nearly without padding.

    Documents are cut at multiples of the window. The rests, rounded up to ``quantum``, are packed whole by ``plan_windows``, which sees a histogram of
    at most window / quantum lengths. One in ``fillers`` documents, chosen by a hash of its id, is a filler: the fillers stand in a row, are poured
    into the gaps that rounding leaves, in order of the sequences, and the rest of them into new windows, the last of which are powers of two.
    Where a filler is cut, its next piece fills the next gap.

    Workers keep their encoder between tasks, unless ``keep_encoder`` is false (for jobs that go on with other work).

    NULL text is empty: a document of the end id alone. Rows that share a doc_id are packed one by one. An empty table has no pieces. Ranks and
    positions come from running totals over many cells, so no length, however common, is ordered in one task.
    """
    spark = docs.sparkSession
    table = saved(measured(docs, path, end_id, window, fillers, keep_encoder), "measured")
    whole = table.filter("not filler")
    rows = table.count()
    cells = max(1, rows // CELL_ROWS)
    cell = F.pmod(F.xxhash64("uid"), F.lit(cells))
    own = whole.select("uid", "doc_id", "n_tokens", "crcs", F.floor(F.col("n_tokens") / window).cast("long").alias("n_full"), cell.alias("cell"))

    full = running_total(own.filter("n_full > 0"), "n_full", "cell", [F.col("uid")], out="first")
    windows = full.select(
        "doc_id", "first", F.col("n_tokens").alias("doc_tokens"), F.posexplode(F.slice("crcs", F.lit(1), F.col("n_full").cast("int"))).alias("k", "ids_crc32")
    ).select(
        "doc_id", (F.col("k") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    n_windows = own.agg(F.coalesce(F.sum("n_full"), F.lit(0))).first()[0]

    rests = own.withColumn("length", F.col("n_tokens") - F.col("n_full") * window).filter("length > 0")
    rests = rests.withColumn("bin", F.ceil(F.col("length") / quantum).cast("long")).withColumn("one", F.lit(1))
    histogram = np.zeros(window // quantum + 1, np.int64)
    for row in rests.groupBy("bin").count().collect():  # at most window / quantum rows
        histogram[row["bin"]] = row["count"]
    places, free = slots(plan_windows(histogram, depth), n_windows)
    plan = number_rows(spark, places, ["__bin", "rank_from", "rank_to", "first", "per", "slot"])
    plan = F.broadcast(plan.coalesce(1))  # templates times their lengths, whatever the input
    ranked = running_total(rests, "one", "cell", [F.col("uid")], ["bin"], out="rank")
    met = ranked.join(plan, (F.col("bin") == F.col("__bin")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    into = F.col("rank") - F.col("rank_from")
    placed = met.withColumn("sequence_id", F.col("first") + F.floor(into / F.col("per"))).withColumn("slot", F.col("slot") + into % F.col("per"))
    in_row = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(
        "doc_id", (F.col("n_full") * window).alias("start"), "length", F.element_at("crcs", -1).alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"),
        "sequence_id", F.coalesce(F.sum("length").over(in_row), F.lit(0)).cast("long").alias("offset"),
    )
    placed = saved(placed, "placed")

    # gaps of the sequences, and the fillers, laid on one axis
    gaps = placed.groupBy("sequence_id").agg(F.sum("length").alias("offset")).select("sequence_id", "offset", (F.lit(window) - F.col("offset")).alias("size"))
    gaps = running_total(gaps.filter("size > 0").withColumn("cell", F.floor(F.col("sequence_id") / CELL_ROWS)), "size", "cell", [F.col("sequence_id")], out="at")
    gaps = saved(gaps.select("sequence_id", "offset", "size", "at"), "gaps")
    n_gap = gaps.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    poured = table.filter("filler").select("uid", "doc_id", "n_tokens", cell.alias("cell"))
    poured = running_total(poured, "n_tokens", "cell", [F.col("uid")], out="from")
    n_poured = poured.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    over = max(0, n_poured - n_gap)
    ends, at = [], n_gap + over // window * window
    for k in range(window.bit_length() - 2, -1, -1):
        if over % window >> k & 1:
            ends.append((free + over // window + len(ends), 0, 1 << k, at))
            at += 1 << k
    new = spark.range(over // window).select((F.col("id") + free).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(window).cast("long").alias("size"), (F.col("id") * window + n_gap).alias("at"))
    gaps = gaps.unionByName(new).unionByName(number_rows(spark, ends, ["sequence_id", "offset", "size", "at"]))

    def stretches(begin: str, size: str):
        return F.explode(F.sequence(F.floor(F.col(begin) / STRETCH), F.floor((F.col(begin) + F.col(size) - 1) / STRETCH)))

    left = gaps.withColumn("stretch", stretches("at", "size"))
    right = poured.select("uid", "doc_id", "n_tokens", "from").withColumn("stretch", stretches("from", "n_tokens"))
    low, high = F.greatest("at", "from"), F.least(F.col("at") + F.col("size"), F.col("from") + F.col("n_tokens"))
    met = left.join(right, "stretch").filter((low < high) & (F.floor(low / STRETCH) == F.col("stretch")))
    cuts = met.select("uid", F.struct((low - F.col("from")).alias("start"), (high - low).alias("length"), "sequence_id", (F.col("offset") + low - F.col("at")).alias("offset")).alias("cut"))
    per_doc = cuts.groupBy("uid").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))  # at most one per token of the document
    filled = per_doc.join(table.filter("filler").select("uid", "doc_id", "ids"), "uid").select("doc_id", "ids", "cuts")
    return windows.unionByName(placed).unionByName(filled.mapInArrow(_cut(id_kind(path)), ", ".join(f"{c} long" for c in PIECES)))


def _cut(kind: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[tuple] = []
            for doc_id, ids, cuts in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, kind)
                for c in cuts:
                    out.append((doc_id, c["start"], c["length"], crc(ids[c["start"] : c["start"] + c["length"]]), len(ids), c["sequence_id"], c["offset"]))
            columns = zip(*out) if out else [[]] * len(PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=PIECES)

    return run
