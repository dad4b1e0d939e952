"""Embedding near-dedup by sorted projection passes."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import components, saved
from hourcast.llm.vectors import matrix, packed_vectors, unit

BITS = 32
ROWS_PER_TASK = 20_000
BLOCK = 2048
MARGIN = 1e-9
SALT = 32
PROBES, MORE_PROBES, LINKED_PROBES = 1024, 4096, 64
MOST_ROUNDS = 16

log = logging.getLogger(__name__)


def planes(dims: int, passes: int, seed: int, turn: int = 0) -> np.ndarray:
    return np.random.default_rng([seed, dims, turn] if turn else [seed, dims]).standard_normal((dims, passes * BITS))


def centres(nodes: DataFrame) -> DataFrame:
    """label, dims and centre (packed) of the labels with at least SALT vectors: the mean of their unit vectors, summed in the tasks first."""

    def sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            label, dims, vector = (c.to_pylist() for c in batch.columns)
            groups: dict[tuple, list] = {}
            for name, d, v in zip(label, dims, vector):
                groups.setdefault((name, d), []).append(v)
            totals = [unit(matrix(v, d)).sum(axis=0).tobytes() for (_, d), v in groups.items()]
            columns = [[x for x, _ in groups], [d for _, d in groups], [len(v) for v in groups.values()], totals]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=["label", "dims", "n", "total"])

    def mean(group: pa.Table) -> pa.Table:
        n = sum(group["n"].to_pylist())
        total = sum(np.frombuffer(x) for x in group["total"].to_pylist())
        centre = np.round(total / n, 6).tobytes()  # sums in another order give the same
        return pa.table({"label": group["label"][:1], "dims": group["dims"][:1], "n": pa.array([n], pa.int64()), "centre": pa.array([centre], pa.binary())})

    parts = nodes.select("label", "dims", "vector").mapInArrow(sums, "label string, dims int, n long, total binary")
    found = parts.groupBy("label", "dims").applyInArrow(mean, "label string, dims int, n long, centre binary")
    return found.filter(F.col("n") >= SALT).drop("n")


def with_centres(nodes: DataFrame, middle: DataFrame) -> DataFrame:
    """Nodes with the centre of their label, NULL in a small one; each centre is joined in SALT places, so no label is one task's work."""
    places = middle.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return nodes.select("node", "label", "dims", "vector", F.pmod("node", F.lit(SALT)).cast("long").alias("salt")).join(places, ["label", "dims", "salt"], "left")


def sort_keys(nodes: DataFrame, passes: int, seed: int, turn: int = 0) -> DataFrame:
    """A row per vector and pass: the signs of BITS random projections, seen from the centre of the label, the first one highest.

    Vectors of one direction have most signs in common; from their centre the signs tell them apart.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in rows:
            node, label, dims, vector, centre = (c.to_pylist() for c in batch.columns)
            for size in sorted(set(dims)):
                at = [i for i, d in enumerate(dims) if d == size]
                middle = np.frombuffer(b"".join(centre[i] or bytes(8 * size) for i in at)).reshape(len(at), size)
                signs = (unit(matrix([vector[i] for i in at], size)) - middle) @ planes(size, passes, seed, turn) > 0
                keys = signs.reshape(len(at), passes, BITS) @ weights
                for p in range(passes):
                    columns = [[p] * len(at), [label[i] for i in at], [size] * len(at), keys[:, p], [node[i] for i in at], [vector[i] for i in at]]
                    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["pass", "label", "dims", "key", "node", "vector"])

    return nodes.select("node", "label", "dims", "vector", "centre").mapInArrow(run, "pass int, label string, dims int, key long, node long, vector binary")


def link_recall(nodes: DataFrame, classes: DataFrame, threshold: float, probes: int = PROBES) -> tuple[int, float | None]:
    """Of ``probes`` vectors of the largest label, compared with all its vectors in blocks: how many have links, and the mean share of a vector's
    links that are inside its group (None if no probe has links). If few have links, MORE_PROBES are asked."""
    largest = nodes.groupBy("label", "dims").count().orderBy(F.desc("count"), "label", "dims").first()
    if largest is None:
        return 0, None
    label, dims = largest["label"], largest["dims"]
    own = nodes.filter((F.col("label") == F.lit(label)) & (F.col("dims") == F.lit(dims))).join(classes, "node", "left")
    own = own.select("node", "vector", F.coalesce("component", "node").alias("component"))
    asked = own.orderBy(F.xxhash64("node"), "node").limit(probes).collect()
    names, groups = (np.array([r[c] for r in asked], np.int64) for c in ("node", "component"))
    shared = nodes.sparkSession.sparkContext.broadcast((names, groups, unit(matrix([bytes(r["vector"]) for r in asked], dims))))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, groups, queries = shared.value
        real, found = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for batch in rows:
            if not batch.num_rows:
                continue
            node, group = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            vectors = unit(matrix(batch.column(1).to_pylist(), dims))
            for k in range(0, len(names), PROBES):
                part = slice(k, k + PROBES)
                near = (queries[part] @ vectors.T >= threshold) & (names[part, None] != node[None, :])
                real[part] += near.sum(axis=1)
                found[part] += (near & (groups[part, None] == group[None, :])).sum(axis=1)
        at = np.flatnonzero(real)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, real[at], found[at])], names=["probe", "real", "found"])

    shares = own.mapInArrow(run, "probe long, real long, found long").groupBy("probe").agg((F.sum("found") / F.sum("real")).alias("share"))
    linked, reached = shares.agg(F.count("*"), F.avg("share")).first()
    if linked < LINKED_PROBES and probes < MORE_PROBES and probes <= len(asked):
        return link_recall(nodes, classes, threshold, MORE_PROBES)
    return linked, reached


def neighbour_links(keyed: DataFrame, parts: int, threshold: float, window: int) -> DataFrame:
    """Links of vectors at most ``window`` places apart in the order of a pass, within a range partition; as few as keep the same groups joined."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        tail: list[tuple] = []
        for batch in rows:
            found = tail + list(zip(*(c.to_pylist() for c in batch.columns)))
            seen, links, begin = len(tail), [], 0
            while begin < len(found):
                group, end = found[begin][:3], begin + 1
                while end < len(found) and found[end][:3] == group:
                    end += 1
                m = unit(matrix([r[5] for r in found[begin:end]], group[2]))
                names = np.array([r[4] for r in found[begin:end]])
                for k in range(1, min(window, len(m) - 1) + 1):
                    near = np.flatnonzero(np.einsum("ij,ij->i", m[:-k], m[k:]) >= threshold)
                    for a, b in zip(names[near].tolist(), names[near + k].tolist()):
                        x, y = top(a), top(b)
                        if x != y:
                            up[max(x, y)] = min(x, y)
                            links.append((a, b))
                begin = end
            tail = found[max(0, len(found) - window) :] if len(found) > seen else tail
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    order = ["pass", "label", "dims", "key", "node"]
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def with_pivots(members: DataFrame) -> DataFrame:
    """Members of groups with their angle to the group's first vector."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            dims, vector, pivot = (batch.column(i).to_pylist() for i in (3, 4, 5))
            cosine = [float((unit(matrix([v], d)) * unit(matrix([p], d))).sum()) for d, v, p in zip(dims, vector, pivot)]
            angle = np.arccos(np.clip(cosine, -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(angle, pa.float64())], names=["component", "node", "copies", "dims", "vector", "angle"])

    pivots = members.filter("node = component").select("component", F.col("vector").alias("pivot"))
    joined = members.join(pivots, "component").select("component", "node", "copies", "dims", "vector", "pivot")
    return joined.mapInArrow(run, "component long, node long, copies long, dims int, vector binary, angle double")


def counted_links(members: DataFrame, threshold: float) -> DataFrame:
    """node and n_links of the members of groups: how many rows of its group a vector links with, itself left out.

    If the angles of a vector and of the group's farthest member to the pivot add up to no more than the limit, it links with all of them. The other
    vectors are compared with their group, block by block; a block of rows and a block of columns are one task's work.
    """
    limit = float(np.arccos(threshold)) - MARGIN
    placed = saved(with_pivots(members), "angles")
    groups = placed.groupBy("component").agg(F.max("angle").alias("widest"), F.sum("copies").alias("all"), F.count("*").alias("m"))
    met = placed.join(groups, "component")
    sure = F.col("angle") + F.col("widest") <= limit
    certain = met.filter(sure).select("node", (F.col("all") - 1).alias("n_links"))
    block = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK))).cast("long")
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK)).cast("long") - 1)
    wide = met.filter(F.col("widest") * 2 > limit).withColumn("block", block)
    part = ["component", "node", "copies", "dims", "vector"]
    asked = wide.filter(~sure).select(*part, F.col("block").alias("i"), F.explode(blocks).alias("j"))
    given = wide.select(*(F.col(c).alias(f"its_{c}") for c in part), F.explode(blocks).alias("its_i"), F.col("block").alias("its_j"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "n": []})
        dims = int(left["dims"].iloc[0])
        x, y = unit(matrix(left["vector"].tolist(), dims)), unit(matrix(right["its_vector"].tolist(), dims))
        near = (x @ y.T >= threshold) | (left["node"].to_numpy()[:, None] == right["its_node"].to_numpy()[None, :])
        return pd.DataFrame({"node": left["node"], "n": near.astype(np.int64) @ right["its_copies"].to_numpy()})

    pairs = asked.groupBy("component", "i", "j").cogroup(given.groupBy("its_component", "its_i", "its_j"))
    found = pairs.applyInPandas(compare, "node long, n long")
    return certain.unionByName(found.groupBy("node").agg((F.sum("n") - 1).alias("n_links")))


def near_duplicates(table: DataFrame, threshold: float = 0.93, passes: int = 16, window: int = 16, seed: int = 7, recall: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``table`` (vec_id, embedding, label).

    Only vectors with equal labels are compared, by cosine in double precision. Equal vectors of a label are one node from the start. In every pass
    the nodes are sorted by label and by BITS random signs, and each is compared with the ``window`` nodes behind it (windows end with a range
    partition); verified pairs of all passes are joined to groups. Inside a group all links are then counted, so a window bounds no vector's links.

    A pair that never comes close in any pass, and no chain of other links joins, is not found; the larger a label, the more bits tell a window's rows
    apart, and the fewer pairs a pass finds. So the share found is measured on probes of the largest label (``link_recall``), and rounds of ``passes``
    more are added until it is ``recall``, at most MOST_ROUNDS; the share reached is logged, as a warning if it is less.

    NULL labels, and vectors that are NULL, zero, or hold NULL or non-finite components, link with nothing; vectors of different length do not link.
    Rows that share a vec_id are vectors of their own. Components are named by their smallest vec_id.
    """
    name = F.md5(F.concat(F.coalesce(F.col("label"), F.lit("")).cast("binary"), F.lit(b"\x00"), F.col("vector")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull()
    rows = saved(packed_vectors(table).withColumn("name", F.when(usable, name)), "vectors")
    real = rows.filter(F.col("name").isNotNull())
    each = real.groupBy("name").agg(
        F.first("label").alias("label"), F.first("dims").alias("dims"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least")
    )
    nodes = saved(each.withColumn("node", F.monotonically_increasing_id()), "nodes")
    parts = max(1, -(-nodes.count() * passes // ROWS_PER_TASK))
    middle = saved(centres(nodes), "centres")
    classes = nodes.sparkSession.createDataFrame([], "node long, component long")
    for turn in range(MOST_ROUNDS):
        links = saved(neighbour_links(sort_keys(with_centres(nodes, middle), passes, seed, turn), parts, threshold, window), "links")
        known = classes.select(F.col("node").alias("a"), F.col("component").alias("b"))
        classes = saved(components(links.unionByName(known), "vectors"), "classes")
        linked, reached = link_recall(nodes, classes, threshold)
        if reached is None or reached >= recall:
            break
    short = reached is not None and reached < recall
    log.log(logging.WARNING if short else logging.INFO, "%d passes; recall %s on %d linked probes of the largest label", passes * (turn + 1), reached, linked)
    members = nodes.join(classes, "node").select("component", "node", "copies", "dims", "vector")
    counts = counted_links(members, threshold)
    whole = nodes.select("node", "name", "copies", "least").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = whole.groupBy("component").agg(F.min("least").alias("lowest"))
    answer = whole.join(lowest, "component").join(counts, "node", "left").select("name", F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), "lowest")
    out = rows.select("vec_id", "name").join(answer, "name", "left")
    component = F.coalesce("lowest", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
