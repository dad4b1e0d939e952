"""Substring dedup: windows of words that a document with a smaller id also holds, found by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from hourcast.llm.common import classes, gram_hashes, mixed, saved, span_hashes
from hourcast.llm.jaccard import bit_filter

WINDOW, MER = 50, 16
LONGEST = 256
STRETCH = 1 << 18
SHARED_BITS, HOT_BITS = 26, 24
HOT = 4096
SPACES = classes(" \t\n\x0b\x0c\r", False)[1]

PIECES = "mini long, name binary, packed binary, windows int, uid long, doc_id long, start int"
FOUND = "name binary, first int, last int, least long"


class Words:
    """The words of the texts of a stretch: bytes with one space behind every word, where words begin there, and where documents begin in the words."""

    def __init__(self, texts: list[bytes | None]):
        flat = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]), np.uint8)
        inside = ~SPACES[flat]
        ends = np.zeros(len(flat), bool)
        ends[1:] = inside[:-1] & ~inside[1:]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        kept = inside | ends
        place = np.cumsum(kept) - kept
        self.flat = np.where(ends, np.uint8(32), flat)[kept]
        self.at = np.append(place[starts], len(self.flat))  # word i is flat[at[i] : at[i + 1] - 1]
        sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
        self.begins = np.searchsorted(np.flatnonzero(starts), np.concatenate([[0], np.cumsum(sizes)]))

    def __len__(self) -> int:
        return len(self.at) - 1

    def hashes(self) -> np.ndarray:
        return span_hashes(self.flat, self.at[:-1], self.at[1:] - 1)


def stretches(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """Texts of a batch, about a quarter of a megabyte at a time, with the place of the first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(column):
        held.append(text.as_py())
        size += len(held[-1] or b"")
        if size >= STRETCH:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def least_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by doubling."""
    out, reach = hashes, 1
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(words: Words, window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: minimiser, first word, number of windows and document of every run of consecutive windows that share their minimiser.

    The minimiser of a window is the least hash of its runs of ``mer`` words: the same in every text that holds the window. Runs are cut at LONGEST windows.
    """
    n = len(words)
    owner = np.repeat(np.arange(len(words.begins) - 1), np.diff(words.begins))
    whole = np.flatnonzero(np.arange(n) + window <= words.begins[1:][owner]) if n else np.zeros(0, np.int64)
    if not len(whole):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    minis = least_of(gram_hashes(words.hashes(), mer), window - mer + 1)[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (np.diff(whole) != 1) | (owner[whole][1:] != owner[whole][:-1]) | (minis[1:] != minis[:-1])
    begin = np.flatnonzero(new)
    new[(np.arange(len(whole)) - begin[np.cumsum(new) - 1]) % LONGEST == 0] = True
    begin = np.flatnonzero(new)
    return minis[begin], whole[begin], np.diff(np.append(begin, len(whole))), owner[whole[begin]]


def bits_of(minis: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(minis) >> np.uint64(64 - bits)).astype(np.int64)


def passes(filled: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (filled[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def filter_of(minis: DataFrame, bits: int) -> np.ndarray:
    """A filter of fixed size for the minimisers of a frame (column mini); what passes by chance only costs work."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield pa.RecordBatch.from_arrays([pa.array(bits_of(batch.column(0).to_numpy().view(np.uint64), bits))], names=["bit"])

    return bit_filter(minis.select("mini").mapInArrow(run, "bit long"), F.col("bit"), bits)


def shared_minis(docs: DataFrame, window: int, mer: int) -> DataFrame:
    """Minimisers (mini) that stand in documents of at least two ids."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids = batch.column(0).to_numpy()
            for first, texts in stretches(batch.column(1)):
                minis, _, _, owner = runs_of(Words(texts), window, mer)
                pairs = np.unique(np.stack([minis.view(np.int64), ids[first + owner]]), axis=1) if len(minis) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["mini", "doc_id"])

    seen = docs.select("doc_id", "text").mapInArrow(run, "mini long, doc_id long")
    return seen.groupBy("mini").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("mini")


def pieces(docs: DataFrame, filled, window: int, mer: int) -> DataFrame:
    """The super-k-mers whose minimiser passes the filter, packed: words joined by one space, and a 128-bit name of that string."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = filled.value
        for batch in rows:
            uids, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, texts in stretches(batch.column(2)):
                words = Words(texts)
                minis, first, count, owner = runs_of(words, window, mer)
                met = np.flatnonzero(passes(shared, bits_of(minis, SHARED_BITS)))
                minis, first, count, owner = minis[met], first[met], count[met], owner[met]
                raw = words.flat.tobytes()
                packed = [raw[a:b] for a, b in zip(words.at[first].tolist(), (words.at[first + count + window - 1] - 1).tolist())]
                columns = [
                    pa.array(minis.view(np.int64)),
                    pa.array([xxhash.xxh3_128_digest(p) for p in packed], pa.binary()),
                    pa.array(packed, pa.binary()),
                    pa.array(count.astype(np.int32)),
                    pa.array(uids[at + owner]),
                    pa.array(ids[at + owner]),
                    pa.array((first - words.begins[owner]).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select("uid", "doc_id", "text").mapInArrow(run, PIECES)


def windows_of(packed: pa.Array, count: np.ndarray, window: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of packed strings: the bytes, begin and end of each window in them, its string, and its number there."""
    raw = b"".join(p + b" " for p in packed.to_pylist())
    stops = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    begins = np.concatenate([[0], stops[:-1] + 1])
    words = count + window - 1
    owner = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(np.cumsum(words) - words, count) + number
    return raw, begins[first], stops[first + window - 1], owner, number


def least_ids(raw: bytes, begin: np.ndarray, end: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every window the least id among equal windows: sorted by hash, neighbours compared byte by byte."""
    hashes = span_hashes(np.frombuffer(raw, np.uint8), begin, end)
    order = np.argsort(hashes, kind="stable")
    hashes, a, b = hashes[order], begin[order].tolist(), end[order].tolist()
    same = hashes[1:] == hashes[:-1]
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(~same)
    again = np.flatnonzero(same).tolist()
    wrong = [i for i in again if raw[a[i] : b[i]] != raw[a[i + 1] : b[i + 1]]]
    for g in {int(group[i]) for i in wrong}:  # two windows of one hash: groups by their words
        names: dict[bytes, int] = {}
        for i in np.flatnonzero(group == g).tolist():
            group[i] = names.setdefault(raw[a[i] : b[i]], int(group.max()) + 1 if names else g)
    order_of = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order_of], prepend=-1))
    least = np.minimum.reduceat(ids[order][order_of], cuts)
    out = np.empty(len(order), np.int64)
    out[order[order_of]] = np.repeat(least, np.diff(np.append(cuts, len(order))))
    return out


def stretched(name: pa.Array, owner: np.ndarray, number: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    """Rows name, first, last, least: neighbouring windows of a string with one least id are one row."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1] + 1) | (least[1:] != least[:-1])
    begin = np.flatnonzero(new)
    last = number[np.append(begin[1:], len(owner)) - 1] if len(owner) else number
    columns = [name.take(pa.array(owner[begin])), pa.array(number[begin].astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(least[begin])]
    return pa.RecordBatch.from_arrays(columns, names=["name", "first", "last", "least"])


def whole_buckets(rows: Iterator[pa.RecordBatch], size: int = 2 * STRETCH) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut between its values: about ``size`` bytes, but no value in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut).combine_chunks()
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def cut_small(table: pa.Table, size: int = 2 * STRETCH) -> Iterator[pa.Table]:
    """A table sorted by its first column in pieces of about ``size`` bytes, cut between values."""
    keys = table.column(0).to_numpy()
    sizes = np.cumsum(pc.binary_length(table["packed"]).to_numpy())
    first = 0
    while first < table.num_rows:
        base = sizes[first - 1] if first else 0
        last = min(table.num_rows, int(np.searchsorted(sizes, base + size, "right")) + 1)
        last = int(np.searchsorted(keys, keys[last - 1], "right"))
        yield table.slice(first, last - first).combine_chunks()
        first = last


def repeated_ranges(docs: DataFrame, window: int, mer: int, hot: int) -> DataFrame:
    """uid, first and last of the runs of words to remove, from documents (uid, doc_id, text as bytes) with an id."""
    spark = docs.sparkSession
    mer = min(mer, window)
    filled = spark.sparkContext.broadcast(filter_of(shared_minis(docs, window, mer), SHARED_BITS))
    found = saved(pieces(docs, filled, window, mer), "pieces")
    strings = found.groupBy("mini", "name", "packed", "windows").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    strings = saved(strings, "strings")
    crowded = spark.sparkContext.broadcast(filter_of(strings.groupBy("mini").agg(F.count("*").alias("n")).filter(F.col("n") > hot), HOT_BITS))

    def chosen(of_hot: bool):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                yield batch.filter(pa.array(passes(crowded.value, bits_of(batch.column(0).to_numpy().view(np.uint64), HOT_BITS)) == of_hot))

        return strings.mapInArrow(run, strings.schema)

    def buckets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_buckets(rows):
            for table in cut_small(held):
                raw, begin, end, owner, number = windows_of(table["packed"].chunk(0), table["windows"].to_numpy().astype(np.int64), window)
                least = least_ids(raw, begin, end, table["low"].to_numpy()[owner])
                met = least < table["high"].to_numpy()[owner]
                yield stretched(table["name"].chunk(0), owner[met], number[met], least[met])

    def single(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw, begin, end, owner, number = windows_of(part.column(2), part.column(3).to_numpy().astype(np.int64), window)
                keys = pa.array([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist())], pa.binary())
                columns = [keys, part.column(1).take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(part.column(4).to_numpy()[owner]), pa.array(part.column(5).to_numpy()[owner])]
                yield pa.RecordBatch.from_arrays(columns, names=["words", "name", "number", "low", "high"])

    usual = chosen(False).repartition("mini").sortWithinPartitions("mini").mapInArrow(buckets, FOUND)
    windows = saved(chosen(True).mapInArrow(single, "words binary, name binary, number int, low long, high long"), "windows")
    least = windows.groupBy("words").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").drop("most")
    rest = windows.join(least, "words").filter("least < high").select("name", F.col("number").alias("first"), F.col("number").alias("last"), "least")
    earlier = usual.unionByName(rest)
    return (
        found.select("name", "uid", "doc_id", "start").join(earlier, "name").filter("least < doc_id")
        .select("uid", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last") + window - 1).alias("last"))
    )


def without(words: Words, document: int, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """A document without ranges of its words, and how many words went."""
    begin, end = int(words.begins[document]), int(words.begins[document + 1])
    kept, at, gone = [], 0, 0
    for first, last in [*sorted(ranges), (end - begin, end - begin)]:
        if first > at:
            kept.append(words.flat[words.at[begin + at] : words.at[begin + first] - 1].tobytes())
        gone += max(0, min(last + 1, end - begin) - max(first, at))
        at = max(at, last + 1)
    return b" ".join(kept), gone


def dedup_passages(docs: DataFrame, window: int = WINDOW, mer: int = MER, hot: int = HOT) -> DataFrame:
    """The documents without passages that a document with a smaller doc_id holds, with two more columns: ``n_words`` and ``n_removed``.

    Words are runs of characters other than ASCII white space. A window is ``window`` consecutive words of one document; each word goes that a window covers
    whose words also start somewhere in a document with a smaller doc_id. Windows are judged on the input. ``text`` becomes the kept words, joined by one
    space ('' where none is left, and for NULL). Columns of the input named like the two new ones are replaced; others stay as they are.

    A repeat inside one document, or in rows of one doc_id, removes nothing. Rows without doc_id keep all words and remove none.

    Consecutive windows with one minimiser (least hash of ``mer`` words) travel as one packed string to the bucket of the minimiser; equal windows meet there,
    are sorted by hash and compared byte by byte. Minimisers of one document only are left out before (a filter of fixed size; exact, since only what is shared
    can repeat), equal strings are one row with their least id, and buckets of more than ``hot`` different strings are cut into windows of their own, which
    128-bit hashes of their words stand for. Strings are told apart by 128-bit hashes, too, where ids are handed back to the documents.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed")]
    names = [f.name for f in kept]
    uid, id_, body = "uid", f"c{names.index('doc_id')}", f"c{names.index('text')}"
    table = saved(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias(uid)), "passages")
    bare = table.filter(f"{id_} IS NOT NULL AND {body} IS NOT NULL").select(uid, F.col(id_).cast("long").alias("doc_id"), F.col(body).cast("binary").alias("text"))
    gone = repeated_ranges(bare, window, mer, hot).groupBy(uid).agg(F.collect_list(F.struct("first", "last")).alias("gone"))  # bounded by the length of a document

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[tuple[bytes, int, int]] = []
            for at, texts in stretches(batch.column(len(names))):
                words = Words(texts)
                for i, count in enumerate(np.diff(words.begins).tolist()):
                    spans = batch.column(len(names) + 1)[at + i].as_py() or []
                    out.append((*without(words, i, [(s["first"], s["last"]) for s in spans]), count))
            more = [pa.array([x[0] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], names=schema.names)

    # the text travels as bytes only; its own place holds NULL on the way
    carried = [F.lit(None).cast(f.dataType).alias(f"c{i}") if f.name == "text" else F.col(f"c{i}") for i, f in enumerate(kept)]
    joined = table.join(gone, uid, "left").select(*carried, F.col(body).cast("binary").alias("text"), "gone")
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)]).add("text", "binary").add("n_words", "long").add("n_removed", "long")
    done = joined.mapInArrow(run, schema)
    columns = [F.col("text").cast("string").alias(c) if c == "text" else F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return done.select(*columns, "n_words", "n_removed")


SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  x AS (SELECT r, doc_id, i, array_to_string(w[i : i + 49], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
  f AS (SELECT k, min(doc_id) AS m FROM x GROUP BY k HAVING count(*) > 1),
  c AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM x JOIN f USING (k) WHERE m < doc_id),
  s AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
    FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r)"""
