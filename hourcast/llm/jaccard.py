"""N-gram Jaccard join by set relations: skipping in index lists, and skipping pairs whose answer follows from similar sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourcast.llm.common import bytes_of, components, gram_hashes, mixed, saved, shingles, word_hashes

FREQUENT = 64
MOST_FREQUENT = 1 << 18
NEAR = 4
BLOCK = 2048
SIGN_BITS, MOST_SIGN_BITS = 1 << 10, 1 << 16
FILTER_BITS, TOKEN_FILTER = 24, 26
ROWS_PER_RANGE, HELD, STRETCH = 4096, 1 << 20, 1 << 20
SALT = 4


def least_overlap(n, m, percent: int):
    """Smallest intersection with 100 * intersection >= percent * union, for set sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    """So many first elements, in one order for all sets: linked sets have one of them in common."""
    return n - -(-percent * n // 100) + 1


def sets_of(batch_text: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of every text of a batch, a stretch of about a megabyte at a time."""
    flat, offsets = bytes_of(batch_text)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STRETCH, "right")) - 1)
        words, begins = word_hashes(flat[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        grams = gram_hashes(words, size)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
            yield shingles(words, grams, a, b, size)
        first = last


def name_of(elements: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    weights = elements * np.uint64(0x9E3779B97F4A7C15) ^ (elements >> np.uint64(32))
    return np.array([elements.sum(dtype=np.uint64) + np.uint64(len(elements)), weights.sum(dtype=np.uint64)], np.uint64).tobytes()


def signature(elements: np.ndarray) -> bytes:
    """Parity bits, at least twice as many as elements (up to a limit): two sets differ in at least as many elements as their signatures in bits."""
    size = min(MOST_SIGN_BITS, max(SIGN_BITS, 1 << (2 * len(elements)).bit_length()))
    bits = np.bincount((elements >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(signs: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) as they would be with fewer bits."""
    return signs if signs.shape[1] == words else np.bitwise_xor.reduce(signs.reshape(len(signs), -1, words), axis=1)


def apart(first: list[bytes], second: list[bytes]) -> np.ndarray:
    """Bits in which pairs of signatures differ, in the shorter of the two sizes."""
    out = np.zeros(len(first), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(first, second)]).reshape(-1, 2)
    for a, b in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes == (a, b)).all(axis=1))
        x = np.frombuffer(b"".join([first[i] for i in at]), np.uint64).reshape(len(at), -1)
        y = np.frombuffer(b"".join([second[i] for i in at]), np.uint64).reshape(len(at), -1)
        words = min(a, b) // 8
        out[at] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(axis=1, dtype=np.int64)
    return out


def ordered(elements: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set: by hash, but frequent elements last."""
    need = prefix_size(len(elements), percent)
    if not len(frequent):
        return elements[:need]
    place = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
    often = frequent[place] == elements
    return np.concatenate([elements[~often], elements[often]])[:need]


def text_only(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), F.xxhash64("text").alias("text_hash"))


def counted(parts: Iterator[np.ndarray], ranges: int) -> Iterator[pa.RecordBatch]:
    """Counts of hashes inside a task, as one packed row per range of hashes (by their lowest bits)."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, times = np.unique(np.concatenate(held), return_counts=True)
        place = (tokens % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        tokens, times, place = tokens[order], times[order].astype(np.uint32), place[order]
        names, begins = np.unique(place, return_index=True)
        cuts = list(zip(begins.tolist(), [*begins[1:].tolist(), len(place)]))
        columns = [pa.array(names), pa.array([tokens[x:y].tobytes() for x, y in cuts], pa.binary()), pa.array([times[x:y].tobytes() for x, y in cuts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["range", "tokens", "times"])

    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= HELD:
            yield packed(held)
            held = []
    if sum(map(len, held)):
        yield packed(held)


def seen_more(counts: DataFrame, than: int) -> DataFrame:
    """token, times and bit (of the token filter) of the hashes that were seen more often than ``than``, from packed counts."""

    def total(group: pa.Table) -> pa.Table:
        tokens = np.frombuffer(b"".join(group["tokens"].to_pylist()), np.uint64)
        names, place = np.unique(tokens, return_inverse=True)
        times = np.bincount(place, np.frombuffer(b"".join(group["times"].to_pylist()), np.uint32), len(names)).astype(np.int64)
        often = times > than
        names = names[often]
        return pa.table([pa.array(names.view(np.int64)), pa.array(times[often]), pa.array(token_bits(names))], names=["token", "times", "bit"])

    return counts.groupBy("range").applyInArrow(total, "token long, times long, bit long")


COUNTS = "range long, tokens binary, times binary"


def ranges_for(rows: int) -> int:
    return 1 << max(4, (rows // ROWS_PER_RANGE).bit_length())


def frequent_elements(docs: DataFrame, size: int, percent: int) -> np.ndarray:
    """Hashes that stand in many prefixes by plain hash order, sorted: at most MOST_FREQUENT, the most frequent ones.

    Any set of hashes gives a right order; this one keeps passages that many texts share out of the prefixes.
    """
    ranges = ranges_for(docs.count())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = (np.concatenate([s[: prefix_size(len(s), percent) + len(s) // 20] for s in sets_of(b.column(1), size)]) for b in rows if b.num_rows)
        return counted(firsts, ranges)

    often = seen_more(text_only(docs).mapInArrow(run, COUNTS), FREQUENT).orderBy(F.desc("times"), "token").limit(MOST_FREQUENT).select("token").collect()
    return np.sort(np.array([row["token"] for row in often], np.int64).view(np.uint64))


def bit_filter(found: DataFrame, bit, bits: int) -> np.ndarray:
    """A filter of 2 ** ``bits`` bits with those set that ``bit`` names: its size is fixed, whatever the number of rows."""
    buckets = found.groupBy(F.floor(bit / 32768).alias("bucket")).agg(F.bitmap_construct_agg(bit % 32768).alias("bits"))
    filled = np.zeros(((1 << bits) // 32768, 4096), np.uint8)
    for row in buckets.collect():
        filled[row["bucket"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return filled.reshape(-1)


def token_bits(tokens: np.ndarray) -> np.ndarray:
    return (mixed(tokens) >> np.uint64(64 - TOKEN_FILTER)).astype(np.int64)


def profiles(docs: DataFrame, frequent: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n (set size), sid (name of the set), signature and prefix of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in rows:
            found = list(sets_of(batch.column(1), size))
            prefixes = [ordered(s, frequent, percent) if len(s) else s for s in found]
            flat = np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)
            columns = [
                batch.column(0),
                batch.column(2),
                pa.array([len(s) for s in found], pa.int64()),
                pa.array([name_of(s) for s in found], pa.binary()),
                pa.array([signature(s) for s in found], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(flat)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "sid", "signature", "prefix"])

    return text_only(docs).mapInArrow(run, "doc_id long, text_hash long, n long, sid binary, signature binary, prefix array<long>")


def shared_lists(sets: DataFrame) -> DataFrame:
    """Index lists of at least two sets: token, uid, n, place (in the prefix).

    Most elements stand in one prefix alone. Counting them first, packed, sets the bits of a filter for the others; only what passes is shuffled as
    rows, and counted again exactly.
    """
    ranges = ranges_for(sets.count())

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return counted((b.column(0).flatten().to_numpy().view(np.uint64) for b in rows if b.num_rows), ranges)

    several = seen_more(sets.select("prefix").mapInArrow(count, COUNTS), 1)
    shared = sets.sparkSession.sparkContext.broadcast(bit_filter(several, F.col("bit"), TOKEN_FILTER))

    def entries(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in rows:
            tokens = batch.column(2).flatten().to_numpy()
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            bit = token_bits(tokens.view(np.uint64))
            met = np.flatnonzero(filled[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            owner = np.repeat(np.arange(len(sizes)), sizes)[met]
            place = met - (np.cumsum(sizes) - sizes)[owner]
            uid, n = batch.column(0).to_numpy()[owner], batch.column(1).to_numpy()[owner]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tokens[met], uid, n, place)], names=["token", "uid", "n", "place"])

    found = sets.select("uid", "n", "prefix").mapInArrow(entries, "token long, uid long, n long, place long")
    return found.withColumn("m", F.count("*").over(Window.partitionBy("token"))).filter("m > 1").drop("m")


def _lists(rows: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Lists one by one from batches sorted by their first column (a list may reach over batches): its columns as arrays."""
    held: pa.Table | None = None
    for batch in rows:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        keys = held.column(0).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(cuts):
            yield from _cut(held.slice(0, cuts[-1]), cuts[:-1])
            held = held.slice(cuts[-1]).combine_chunks()
    if held is not None:
        yield from _cut(held, np.zeros(0, np.int64))


def _cut(table: pa.Table, cuts: np.ndarray) -> Iterator[list[np.ndarray]]:
    columns = [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy() for c in table.columns]
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), table.num_rows]):
        yield [c[a:b] for c in columns]


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """First candidates: each set of a list with the NEAR sets before it in the order of size, and with the leader of its stretch.

    A linear number, and all pairs of lists of up to NEAR + 1 sets. A stretch ends where the size of its leader could no longer link.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _lists(rows):
            _, uid, n, place = (c.tolist() for c in columns)
            found, leader = set(), 0
            for i in range(1, len(uid)):
                if 100 * n[leader] < percent * n[i]:
                    leader = i
                for j in {leader, *range(max(0, i - NEAR), i)} - {i}:
                    if 100 * n[j] >= percent * n[i] and min(place[i], place[j]) + 1 + min(n[i] - place[i], n[j] - place[j]) - 1 >= least_overlap(n[i], n[j], percent):
                        found.add((min(uid[i], uid[j]), max(uid[i], uid[j])))
            if found:
                yield _pairs(sorted(found))

    sorted_lists = lists.repartition("token").sortWithinPartitions("token", "n", "uid")
    return sorted_lists.mapInArrow(run, "a long, b long").distinct()


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that their signatures allow, with the number of bits that differ."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            bits = apart(batch.column(3).to_pylist(), batch.column(5).to_pylist())
            fit = pa.array(bits <= n + m - 2 * least_overlap(n, m, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits)], names=["a", "b", "apart"]).filter(fit)

    one = sets.select(F.col("uid").alias("a"), F.col("n").alias("n"), F.col("signature").alias("first"))
    two = sets.select(F.col("uid").alias("b"), F.col("n").alias("m"), F.col("signature").alias("second"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n", "first", "m", "second").mapInArrow(run, "a long, b long, apart long")


def closest(pairs: DataFrame) -> DataFrame:
    """Of every set the pair with the fewest bits apart: enough to join most sets that belong together."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "apart")
    return both.groupBy("node").agg(F.min(F.struct("apart", "a", "b")).alias("best")).select("best.a", "best.b").distinct()


def across(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sets are in different classes; a set without class is one of its own."""
    one = classes.select(F.col("node").alias("a"), F.col("component").alias("x"))
    two = classes.select(F.col("node").alias("b"), F.col("component").alias("y"))
    joined = pairs.select("a", "b").join(one, "a", "left").join(two, "b", "left")
    return joined.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _may(n, m, i, j, percent: int):
    """Whether sets of sizes n and m that share elements at places i and j of their prefixes can overlap enough."""
    return np.minimum(i, j) + 1 + np.minimum(n - i - 1, m - j - 1) >= least_overlap(n, m, percent)


def rest_pairs(lists: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All other candidates: pairs of a longer list that no chain of links joins yet, and that size, place and signature allow.

    Sets of one class are skipped: their answers follow from each other's. Lists are sorted by size and cut into blocks; each pair of blocks is a group
    of its own, so a long list is spread over many tasks. Lists with the same main class meet (in SALT places), where a pair that many of them hold is
    given out once.
    """
    known = classes.select(F.col("node").alias("uid"), "component")
    marked = lists.join(known, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    open_lists = marked.groupBy("token").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"), F.mode("component").alias("main"))
    open_lists = open_lists.filter((F.col("m") > NEAR + 1) & (F.col("low") != F.col("high"))).select("token", "m", "main")
    rank = F.row_number().over(Window.partitionBy("token").orderBy("n", "uid")) - 1
    placed = marked.join(open_lists, "token").withColumn("block", F.floor(rank / BLOCK).cast("long")).withColumn("blocks", F.floor((F.col("m") - 1) / BLOCK))
    placed = placed.join(sets.select("uid", "signature"), "uid")
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))).alias("partner")
    pair = [F.least("block", "partner"), F.greatest("block", "partner")]
    home = F.xxhash64("main", F.pmod("token", F.lit(SALT)), *pair).alias("home")
    spread = placed.select("*", partner).select(
        F.xxhash64("token", *pair).alias("group"), "uid", "n", "place", "signature", "component", "block", home
    )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        last = None
        for _, uid, n, place, sign, component, block, home in _lists(rows):
            if home[0] != last:
                seen, last = set(), home[0]
            kinds = np.unique(component, return_inverse=True)[1]
            if kinds.max() == 0:
                continue
            found, two = set(), bool(block[0] != block[-1])
            main = np.bincount(kinds).argmax()
            for i in np.flatnonzero(kinds != main).tolist():
                fit = (kinds != kinds[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & _may(n, n[i], place, place[i], percent)
                if two:
                    fit &= block != block[i]
                at = np.flatnonzero(fit)
                bits = apart([sign[i]] * len(at), [sign[j] for j in at])
                for j in at[bits <= n[at] + n[i] - 2 * least_overlap(n[at], n[i], percent)].tolist():
                    found.add((min(uid[i], uid[j]), max(uid[i], uid[j])))
            if found - seen:
                yield _pairs(sorted(found - seen))
                seen = found if len(seen) > HELD else seen | found  # bounded; what is forgotten is only given out again

    return spread.repartition("home").sortWithinPartitions("home", "group", "block", "uid").mapInArrow(run, "a long, b long").distinct()


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """uid and elements (packed) of the sets in ``wanted`` (uid, sid), made from the texts again.

    A bit filter of fixed size over the names lets only their texts pass; where it is too full for that, more rows are joined, with the same result.
    """
    bit = F.conv(F.hex(F.substring("sid", 1, 3)), 16, 10).cast("long")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, bit, FILTER_BITS))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in rows:
            names, found = [], []
            for elements in sets_of(batch.column(1), size):
                name = name_of(elements)
                bit = int.from_bytes(name[:3], "big")
                if filled[bit >> 3] >> (bit & 7) & 1:
                    names.append(name)
                    found.append(elements.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.binary())], names=["sid", "elements"])

    found = text_only(docs).mapInArrow(run, "sid binary, elements binary").groupBy("sid").agg(F.first("elements").alias("elements"))
    return found.join(wanted, "sid").select("uid", "elements")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets overlap enough."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            left, right, first, second = (c.to_pylist() for c in batch.columns)
            kept = []
            for a, b, x, y in zip(left, right, first, second):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int(np.count_nonzero(y[place] == x))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    kept.append((a, b))
            if kept:
                yield _pairs(kept)

    one = sets.select(F.col("uid").alias("a"), F.col("elements").alias("first"))
    two = sets.select(F.col("uid").alias("b"), F.col("elements").alias("second"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "first", "second").mapInArrow(run, "a long, b long")


def jaccard_groups(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and text_hash of every row of ``docs`` (doc_id, text): groups of texts joined by chains of links.

    Words are split at ASCII white space, A-Z lower-cased; a set has the distinct runs of ``size`` words (fewer words: one run of all). Two sets link
    when 100 * intersection >= percent * union. Shingles are compared by 64-bit hashes, sets by 128-bit names.

    Rows with equal sets are one set from the start. Of every set the first elements of one global order are indexed (frequent ones last): linked sets
    share one of them. Lists of the index give candidates, signatures thin them out, whole sets decide. First every set is compared with the closest of
    its neighbours in the lists; sets that are then in one class need no comparison any more, whatever the length of a list, and all other pairs are
    enumerated, so no link between classes is lost.

    NULL, empty and blank texts have no shingles and link with nothing: their component is their own doc_id. Rows with one doc_id are rows of their
    own; a group of NULL ids alone has a NULL component. So a component_id names a smallest id, and groups may share it: see ``numbered_groups``.
    """
    return numbered_groups(docs, size, percent).drop("group")


def numbered_groups(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """``jaccard_groups`` with the number of the group in ``group``: different groups have different numbers, whatever their ids; NULL without words."""
    frequent = frequent_elements(docs, size, percent)
    table = saved(profiles(docs, frequent, size, percent), "profiles")
    each = table.filter("n > 0").groupBy("sid").agg(
        F.first("n").alias("n"), F.min("doc_id").alias("least"), F.first("signature").alias("signature"), F.first("prefix").alias("prefix")
    )
    sets = saved(each.withColumn("uid", F.monotonically_increasing_id()), "sets")
    lists = saved(shared_lists(sets), "lists")
    near = saved(plausible(near_pairs(lists, percent), sets, percent), "near")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        uids = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
        return saved(linked(pairs, whole_sets(docs, uids.join(sets.select("uid", "sid"), "uid"), size), percent), name)

    def merged(classes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """Classes after the links among some more pairs."""
        pairs = saved(pairs, f"{name}-pairs")
        if not pairs.limit(1).count():
            return classes
        one = classes.select(F.col("node").alias("a"), F.col("component").alias("x"))
        two = classes.select(F.col("node").alias("b"), F.col("component").alias("y"))
        links = checked(pairs, name).join(one, "a", "left").join(two, "b", "left")
        between = links.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        upper = components(between, name).select(F.col("node").alias("component"), F.col("component").alias("top"))
        lower = classes.unionByName(between.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("component"))).distinct()
        moved = lower.join(upper, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        return saved(moved.distinct(), f"{name}-classes")

    classes = saved(components(checked(closest(near), "closest"), "closest"), "classes")
    classes = merged(classes, across(near, classes).distinct(), "across")
    classes = merged(classes, rest_pairs(lists, sets, classes, percent), "rest")
    grouped = sets.select("uid", "sid", "least").join(classes.withColumnRenamed("node", "uid"), "uid", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "uid"))
    lowest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = grouped.join(lowest, "component").select("sid", F.col("component").alias("group"), "component_id")
    rows = table.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "sid").join(answer, "sid", "left")
    component = F.coalesce("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id"))).alias("component_id")
    return rows.select("doc_id", "n_shingles", component, "text_hash", "group")


def one_of_each_group(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """The documents without near copies: of each group of ``jaccard_groups`` the row with the smallest doc_id stays (NULL last; of several, the one
    with the smallest hash of the text; of equal rows, one). Groups of one name, by NULL or repeated ids, keep a row each. Texts without words stay.
    Columns are those of the input."""
    groups = saved(numbered_groups(docs, size, percent), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    chosen = groups.filter("n_shingles > 0").groupBy("group").agg(F.min(order).alias("first"))
    chosen = chosen.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__text")).withColumn("__copy", F.lit(1))
    blank = groups.filter("n_shingles = 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).distinct().withColumn("__copy", F.lit(None).cast("int"))
    number = F.row_number().over(Window.partitionBy(F.col("doc_id").cast("long"), "__hash").orderBy("__hash"))
    marked = docs.withColumn("__hash", F.xxhash64("text")).withColumn("__number", number)
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text"))
    kept = marked.join(chosen.unionByName(blank), match).filter(F.col("__copy").isNull() | (F.col("__number") == 1))
    return kept.select(*docs.columns)
