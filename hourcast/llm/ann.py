"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourcast.llm.common import saved
from hourcast.llm.vectors import matrix, packed_vectors

CHUNK = 2048


class Tree:
    """Centres of all nodes but the root, children by node, and the leaf number of nodes without children.

    For the largest inner product, vectors get one more component that gives all of them the length of the longest; queries have 0 there. The nearest
    by distance is then the one with the largest product.
    """

    def __init__(self, sample: np.ndarray, longest: float, rows: int, leaf_rows: int, branching: int, seed: int):
        self.longest = longest
        self.centres: list[np.ndarray] = [np.zeros(sample.shape[1] + 1)]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        self.leaves = 0
        rng = np.random.default_rng(seed)
        lifted = self.lift(sample)
        todo = [(0, np.arange(len(lifted)))]
        while todo:
            node, own = todo.pop()
            expected = rows * len(own) / max(1, len(lifted))
            k = int(min(branching, -(-expected // leaf_rows), len(own) // 4))
            groups = self._split(lifted[own], k, rng) if k > 1 else []
            if len(groups) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for centre, members in groups:
                self.centres.append(centre)
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(len(self.centres) - 1)
                todo.append((len(self.centres) - 1, own[members]))
        self.points = np.array(self.centres)
        self.squares = (self.points**2).sum(axis=1)

    @staticmethod
    def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
            used = np.unique(near)
            centres = np.array([x[near == c].mean(axis=0) for c in used])
        near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        return [(centres[c], np.flatnonzero(near == c)) for c in np.unique(near)]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(axis=1, keepdims=True)))])

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest child at every node."""
        lifted, out = self.lift(x), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            kids = self.children[node]
            if not kids:
                out[own] = self.leaf[node]
            elif len(own):
                near = np.argmin(self.squares[kids] - 2 * lifted[own] @ self.points[kids].T, axis=1)
                todo += [(kid, own[near == i]) for i, kid in enumerate(kids)]
        return out

    def visits(self, x: np.ndarray, most: int) -> list[list[int]]:
        """Leaves of each query, best bin first: a priority queue gives the open node with the nearest centre, a leaf is a visit."""
        zero = np.hstack([x, np.zeros((len(x), 1))])
        away = self.squares - 2 * zero @ self.points.T
        out = []
        for row in away:
            heap, found = [(0.0, 0)], []
            while heap and len(found) < most:
                _, node = heapq.heappop(heap)
                if self.children[node]:
                    for kid in self.children[node]:
                        heapq.heappush(heap, (row[kid], kid))
                else:
                    found.append(self.leaf[node])
            out.append(found)
        return out


HIT = "struct<away:double,least:long,node:long>"
SPARE = 8


def best_of_rows(queries: np.ndarray, rows: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best rows of every query, nearest first, ties to the smaller name, and their products.

    A matrix product finds the few that can be among the best; these are multiplied again, each sum in the same order, so equal vectors have equal
    products.
    """
    rough = queries @ rows.T
    few = min(len(rows), k + SPARE)
    at = np.argpartition(-rough, few - 1, axis=1)[:, :few] if few < len(rows) else np.tile(np.arange(len(rows)), (len(queries), 1))
    exact = (rows[at] * queries[:, None, :]).sum(axis=2)
    order = np.lexsort((names[at], -exact), axis=1)[:, :k]
    at, exact = np.take_along_axis(at, order, 1), np.take_along_axis(exact, order, 1)
    if few < len(rows):
        near = 1e-9 * np.maximum(1.0, np.abs(exact[:, -1]))
        for i in np.flatnonzero((rough >= (exact[:, -1] - near)[:, None]).sum(axis=1) > few):  # more ties at the limit than were taken along
            own = np.flatnonzero(rough[i] >= exact[i, -1] - near[i])
            score = (rows[own] * queries[i]).sum(axis=1)
            top = np.lexsort((names[own], -score))[:k]
            at[i], exact[i] = own[top], score[top]
    return at, exact


def searched(asked: DataFrame, index: DataFrame, k: int, dims: int) -> DataFrame:
    """name (of a query) and its k best of one leaf and chunk, as one array."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["name", "found"]
        kind = pa.list_(pa.struct([("away", pa.float64()), ("least", pa.int64()), ("node", pa.int64())]))
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.string()), pa.array([], kind)], names=names)
        rows, least, node = matrix(right["row"].to_pylist(), dims), right["least"].to_numpy(), right["node"].to_numpy()
        at, score = best_of_rows(matrix(left["vector"].to_pylist(), dims), rows, least, min(k, len(rows)))
        hits = pa.StructArray.from_arrays([pa.array(-score.reshape(-1)), pa.array(least[at].reshape(-1)), pa.array(node[at].reshape(-1))], fields=list(kind.value_type))
        offsets = pa.array(np.arange(len(at) + 1) * at.shape[1], pa.int32())
        return pa.table([left["name"].combine_chunks(), pa.ListArray.from_arrays(offsets, hits)], names=names)

    theirs = index.select("node", "least", F.col("vector").alias("row"), F.col("leaf").alias("its_leaf"), F.col("chunk").alias("its_chunk"))
    pairs = asked.groupBy("leaf", "chunk").cogroup(theirs.groupBy("its_leaf", "its_chunk"))
    return pairs.applyInArrow(scan, f"name string, found array<{HIT}>")


def calibrate(tree: Tree, index: DataFrame, sample: np.ndarray, k: int, recall: float) -> int:
    """Leaf visits at which the sampled queries find the share ``recall`` of their k nearest, by comparing them with all rows in blocks."""
    shared = index.sparkSession.sparkContext.broadcast(sample)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        kept = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
        for batch in rows:
            vectors = matrix(batch.column(1).to_pylist(), queries.shape[1])
            leaf = batch.column(0).to_numpy()
            scores = queries @ vectors.T
            for i in range(len(queries)):
                s, f = np.concatenate([kept[i][0], scores[i]]), np.concatenate([kept[i][1], leaf])
                top = np.argsort(-s, kind="stable")[: k + 1]
                kept[i] = s[top], f[top]
        found = [(i, float(s), int(f)) for i, (scores, leaves) in enumerate(kept) for s, f in zip(scores, leaves)]
        columns = list(zip(*found)) if found else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64()))], names=["query", "score", "leaf"])

    best_first = Window.partitionBy("query").orderBy(F.desc("score"), "leaf")
    top = index.select("leaf", "vector").mapInArrow(run, "query long, score double, leaf long").withColumn("rank", F.row_number().over(best_first))
    truth = top.filter(F.col("rank") <= k + 1).collect()  # queries times k + 1
    order = [{leaf: n + 1 for n, leaf in enumerate(found)} for found in tree.visits(sample, tree.leaves)]
    needed = sorted(order[row["query"]][row["leaf"]] for row in truth)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def nearest(
    table: DataFrame,
    every: int = 20,
    k: int = 20,
    recall: float = 0.97,
    sample: int = 20_000,
    probes: int = 200,
    leaf_rows: int = 1024,
    branching: int = 16,
    most_leaves: int = 1 << 14,
    seed: int = 5,
) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest rows of every row whose vec_id is divisible by ``every``, by inner product.

    The tree is fitted on at most ``sample`` vectors, by a hash of the id; it has about rows / ``leaf_rows`` leaves, at most a quarter of the sample or
    ``most_leaves``. All rows are put into its leaves. ``probes`` queries are compared with all rows, and tell how many leaves have to be visited for
    the wanted ``recall``; every query then visits as many. A leaf is read in chunks, so a full leaf is many tasks' work.

    Equal vectors are one entry with their k + 1 smallest ids (no answer can hold more of them), and equal queries are searched once. Vectors that are
    NULL, zero or hold NULL or non-finite components take no part, nor do vectors that are not of the most common length (the smaller at a tie), nor
    rows without id. Rows that share a vec_id are candidates of their own, but none of a query with that id. Ties go to the smaller vec_id.
    """
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = saved(packed_vectors(table.withColumn("label", F.lit(None).cast("string"))).filter("vec_id is not null and dims is not null").withColumn("name", F.md5("vector")), "rows")
    common = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return empty
    dims = common["dims"]
    rows = rows.filter(F.col("dims") == dims)
    by_id = Window.partitionBy("name").orderBy("vec_id")
    few = rows.select("name", "vec_id").withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k + 1)
    ids = few.groupBy("name").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = rows.groupBy("name").agg(F.first("vector").alias("vector"), F.max(F.when(F.col("vec_id") % every == 0, 1).otherwise(0)).alias("asked"))
    nodes = saved(vectors.join(ids, "name").withColumn("node", F.monotonically_increasing_id()).withColumn("least", F.element_at("ids", 1)), "distinct")
    n = nodes.count()

    chosen = nodes.orderBy(F.xxhash64("least"), "least").limit(sample).select("vector").collect()  # the bounded sample
    fitted = matrix([bytes(r["vector"]) for r in chosen], dims)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column(0).to_pylist(), dims)
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((m * m).sum(axis=1)).max())])], names=["longest"])

    longest = nodes.select("vector").mapInArrow(lengths, "longest double").agg(F.max("longest")).first()[0]
    tree = Tree(fitted, longest, n, max(leaf_rows, -(-n // most_leaves)), branching, seed)
    shared = spark.sparkContext.broadcast(tree)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.place(matrix(batch.column(2).to_pylist(), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["node", "least", "vector", "leaf"])

    index = nodes.select("node", "least", "vector").mapInArrow(put, "node long, least long, vector binary, leaf long")
    index = saved(index, "index")
    queries = nodes.filter("asked = 1").select("name", "vector", "least")
    probe = queries.orderBy(F.xxhash64("least", F.lit(1)), "least").limit(probes).select("vector").collect()
    visits = calibrate(tree, index, matrix([bytes(r["vector"]) for r in probe], dims), k, recall)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.visits(matrix(batch.column(1).to_pylist(), dims), visits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=["name", "vector", "leaves"])

    sizes = index.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunked = index.join(sizes, "leaf").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).drop("chunks")
    asked = queries.select("name", "vector").mapInArrow(walk, "name string, vector binary, leaves array<long>").select("name", "vector", F.explode("leaves").alias("leaf"))
    asked = asked.join(sizes, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    merged = searched(asked, chunked, k + 1, dims).groupBy("name").agg(F.flatten(F.collect_list("found")).alias("found"))  # visits times k + 1 at most
    hits = merged.select("name", F.explode(F.slice(F.array_sort("found"), 1, k + 1)).alias("hit")).select("name", (-F.col("hit.away")).alias("score"), "hit.node")
    answers = hits.join(nodes.select("node", "ids"), "node").select("name", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("name").orderBy(F.desc("score"), "vec_id")
    listed = answers.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= k + 1)
    lists = listed.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("all"))  # k + 1 at most
    own = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "name")
    mine = own.join(lists, "name").select("query_id", F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("all"))
    return mine.select("query_id", F.posexplode("all").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
