"""Boosted regression trees on binned features, grown by the tasks of one barrier stage."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from hourcast.sources.tables import settled

MOST_DEPTH = 14
CELLS_PER_TASK = 1 << 27
LOWEST = -np.finfo(float).max
TREES = "tree int, feature array<int>, cut array<int>, value array<double>, gain array<double>, error double"


# --- bins ------------------------------------------------------------------------------------------------------------


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper bounds of all bins but the last, from the values of a sample: between all distinct values, or at their quantiles where there are too many."""
    known = np.maximum(values[~np.isnan(values)], LOWEST)
    distinct = np.unique(known)
    if len(distinct) < bins:
        low, high = distinct[:-1], distinct[1:]
        middle = low / 2 + high / 2
        return np.where((middle >= low) & (middle < high), middle, low)
    return np.unique(np.quantile(known, np.arange(1, bins - 1) / (bins - 1), method="lower"))


def binned(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin 0 for unknown values, then 1 for values up to the first cut, and so on."""
    return np.where(np.isnan(values), 0, 1 + np.searchsorted(cuts, np.maximum(values, LOWEST), "left")).astype(np.uint8)


# --- one task --------------------------------------------------------------------------------------------------------


@dataclass
class Settings:
    """What all tasks know: sizes of the bins per feature, settings, the scale of whole-number gradients, and the number of rows."""

    sizes: np.ndarray
    depth: int
    rate: float
    row_share: float
    column_share: float
    ridge: float
    seed: int
    base: float
    limit: float
    scale: float
    error_scale: float
    patience: int


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def drawn(keys: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Rows of a tree: by a hash of row and tree, so the same whatever task holds the row."""
    salt = spread(np.array([seed & 0xFFFFFFFF, tree], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return spread(keys ^ salt[0] ^ spread(salt[1:])[0]) < np.uint64(min(share, 1 - 2**-53) * 2.0**64) if share < 1 else np.ones(len(keys), bool)


def weight(number: int, rate: float) -> float:
    """The first tree counts in full, those that correct it by the rate, as in Spark ML's boosted trees."""
    return rate if number else 1.0


class Grower:
    """The rows of one task: bins by feature, labels, predictions so far.

    Gradients are whole numbers, so sums over tasks are exact, every task derives the same tree from them, and the tree does not depend on how rows are dealt out.
    """

    def __init__(self, codes: np.ndarray, labels: np.ndarray, keys: np.ndarray, held: np.ndarray, settings: Settings, total: Callable[[np.ndarray], np.ndarray]):
        self.codes, self.labels, self.keys, self.held, self.settings, self.total = codes, labels, keys, held, settings, total
        self.predicted = np.full(len(labels), settings.base)
        self.used = np.flatnonzero(settings.sizes > 1)

    def follow(self, number: int, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> None:
        """Add a tree that is known already."""
        node = np.zeros(len(self.labels), np.int64)
        for _ in range(self.settings.depth):
            node = self.moved(node, feature, cut)
        self.predicted += weight(number, self.settings.rate) * value[node]

    def moved(self, node: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        rows = np.flatnonzero(feature[node] >= 0)
        at = node[rows]
        out = node.copy()
        out[rows] = 2 * at + 1 + (self.codes[feature[at], rows] > cut[at])
        return out

    def histogram(self, rows: np.ndarray, slot: np.ndarray, count: int, columns: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """Sums of gradients and numbers of rows by (slot, bin of each column), over the rows of all tasks."""
        sums, numbers = [], []
        for f in columns.tolist():
            size = int(self.settings.sizes[f])
            cell = slot * size + self.codes[f, rows]
            sums.append(np.bincount(cell, gradient, count * size).reshape(count, size).astype(np.int64))
            numbers.append(np.bincount(cell, minlength=count * size).reshape(count, size))
        return self.total(np.stack([np.concatenate(sums, axis=1), np.concatenate(numbers, axis=1)]))

    def tree(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Feature, cut (greatest bin that goes left), value and gain by node; node i has the children 2 i + 1 and 2 i + 2, a leaf has feature -1."""
        s = self.settings
        nodes = (1 << s.depth + 1) - 1
        feature, cut = np.full(nodes, -1, np.int32), np.zeros(nodes, np.int32)
        value, gain = np.zeros(nodes), np.zeros(nodes)
        rng = np.random.default_rng([s.seed & 0xFFFFFFFF, number])
        columns = np.sort(rng.choice(self.used, max(1, int(np.ceil(s.column_share * len(self.used)))), replace=False)) if len(self.used) else self.used
        mine = np.flatnonzero(drawn(self.keys, s.seed, number, s.row_share) & ~self.held)
        left_over = np.clip(self.labels[mine] - self.predicted[mine], -s.limit, s.limit)
        gradient = np.rint(left_over * s.scale)

        sizes = s.sizes[columns]
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(columns)), sizes)

        def worth(sums: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return (sums / s.scale) ** 2 / np.maximum(rows + s.ridge, 1e-300)

        node = np.zeros(len(self.labels), np.int64)
        open_ = np.zeros(1, np.int64)
        if len(columns):
            table = self.histogram(mine, np.zeros(len(mine), np.int64), 1, columns, gradient)
            whole = table[:, 0, : sizes[0]].sum(axis=1)
        else:
            table, whole = None, self.total(np.array([int(gradient.sum()), len(mine)], np.int64))
        sums, rows = whole[:1], whole[1:]  # of the nodes of the level
        value[0] = sums[0] / s.scale / max(rows[0] + s.ridge, 1e-300)
        for level in range(s.depth):
            if table is None or not len(open_):
                break
            entry, left = self._sides(table, owner)  # bins with rows, and sums and rows up to them
            of_node, best = np.divmod(entry, len(owner))
            right = np.stack([sums, rows])[:, of_node] - left
            parent = worth(sums, rows)
            gains = worth(left[0], left[1]) + worth(right[0], right[1]) - parent[of_node]
            gains[right[1] == 0] = -np.inf
            begin = np.flatnonzero(np.diff(of_node, prepend=-1))
            most = np.maximum.reduceat(gains, begin)
            top = np.flatnonzero(gains == np.repeat(most, np.diff(np.append(begin, len(gains)))))
            top = top[np.diff(of_node[top], prepend=-1) > 0]  # of equal gains the first feature and cut
            fit = most > 1e-12 * np.maximum(parent[of_node[begin]], 1e-300)
            split, top = of_node[begin][fit], top[fit]
            if not len(split):
                break
            at, best = open_[split], best[top]
            feature[at], cut[at], gain[at] = columns[owner[best]], best - starts[owner[best]], gains[top]
            parts = np.stack([left[:, top], right[:, top]], axis=2).reshape(2, -1)  # children side by side
            children = np.stack([2 * at + 1, 2 * at + 2], axis=1).ravel()
            value[children] = parts[0] / s.scale / np.maximum(parts[1] + s.ridge, 1e-300)
            node = self.moved(node, feature, cut)
            if level + 1 < s.depth:
                # rows are counted for the smaller child only; the other is what is left of the parent
                small = np.where(parts[1][0::2] <= parts[1][1::2], 0, 1)
                slot_of = np.full(nodes, -1, np.int64)
                slot_of[children[0::2] + small] = np.arange(len(split))
                slot = slot_of[node[mine]]
                chosen = np.flatnonzero(slot >= 0)
                fresh = self.histogram(mine[chosen], slot[chosen], len(split), columns, gradient[chosen])
                both = np.empty((2, 2 * len(split), fresh.shape[2]), np.int64)
                both[:, 2 * np.arange(len(split)) + small] = fresh
                both[:, 2 * np.arange(len(split)) + 1 - small] = table[:, split] - fresh
                table = both
            open_, sums, rows = children, parts[0], parts[1]
        self.predicted += weight(number, s.rate) * value[node]
        return feature, cut, value, gain

    def _sides(self, table: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (node, bin) with rows, in order, and sums of gradients and rows of the bins of their feature up to each."""
        entry = np.flatnonzero(table[1])
        own = table.reshape(2, -1)[:, entry]
        run = np.cumsum(own, axis=1)
        of_node, place = np.divmod(entry, len(owner))
        group = of_node * (int(owner[-1]) + 1) + owner[place]
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        return entry, run - np.repeat((run - own)[:, begin], np.diff(np.append(begin, len(entry))), axis=1)

    def error(self) -> float:
        """Mean squared error on the held-out rows of all tasks."""
        apart = (self.labels[self.held] - self.predicted[self.held]) ** 2
        found = self.total(np.array([int(np.rint(np.minimum(apart * self.settings.error_scale, 2.0**52)).sum()), len(apart)], np.int64))
        return float(found[0]) / self.settings.error_scale / max(int(found[1]), 1)


def stopped(errors: list[float], patience: int) -> bool:
    """Whether so many rounds have passed since the best one."""
    return bool(errors) and len(errors) - 1 - int(np.argmin(errors)) >= patience


def grow(settings: Settings, known: list[tuple], first: int, last: int, tasks: int, watch: bool):
    """The function of one task: rows in, trees ``first`` to ``last`` out (of the task that holds partition 0)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        features = len(settings.sizes)
        held = [(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, features), *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))) for b in rows if b.num_rows]
        parts = list(zip(*held)) or [[np.zeros((0, features), np.uint8)], [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]]
        codes, labels, keys, out = (np.concatenate(p) for p in parts)

        def total(numbers: np.ndarray) -> np.ndarray:
            if tasks == 1:
                return numbers
            packed = base64.b64encode(zlib.compress(np.ascontiguousarray(numbers).tobytes(), 1)).decode()
            found = [np.frombuffer(zlib.decompress(base64.b64decode(m)), np.int64) for m in context.allGather(packed)]
            return np.sum(found, axis=0).reshape(numbers.shape)

        grower = Grower(np.ascontiguousarray(codes.T), labels, keys.view(np.uint64), out, settings, total)
        for number, (feature, cut, value, *_) in enumerate(known):
            grower.follow(number, feature, cut, value)
        errors = [k[4] for k in known] if watch else []
        for number in range(first, last):
            if watch and stopped(errors, settings.patience):
                break
            tree = grower.tree(number)
            if watch:
                errors.append(grower.error())
            if context.partitionId() == 0:
                columns = [pa.array([number], pa.int32()), *(pa.array([x.tolist()], t) for x, t in zip(tree, (pa.list_(pa.int32()),) * 2 + (pa.list_(pa.float64()),) * 2)), pa.array([errors[-1] if watch else None], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "feature", "cut", "value", "gain", "error"])

    return run


# --- estimator and model ---------------------------------------------------------------------------------------------


class _TreeParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of the values of all trees but the first that counts", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows per tree", TypeConverters.toFloat)
    columnShare = Param(Params._dummy(), "columnShare", "share of the features per tree", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)
    ridge = Param(Params._dummy(), "ridge", "rows added to a leaf, with gradient 0", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins per feature, the one of unknown values included (at most 256)", TypeConverters.toInt)
    binRows = Param(Params._dummy(), "binRows", "rows whose values set the bins", TypeConverters.toInt)
    validationIndicatorCol = Param(Params._dummy(), "validationIndicatorCol", "true for held-out rows", TypeConverters.toString)
    patience = Param(Params._dummy(), "patience", "rounds without gain on held-out rows before boosting stops", TypeConverters.toInt)
    maxTasks = Param(Params._dummy(), "maxTasks", "tasks of the barrier stage at most", TypeConverters.toInt)
    treesPerStage = Param(Params._dummy(), "treesPerStage", "trees grown by a stage", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="prediction", maxIter=300, maxDepth=8, stepSize=0.1, subsamplingRate=0.8, columnShare=0.8,
            seed=42, ridge=1.0, maxBins=256, binRows=20_000, patience=10, maxTasks=32, treesPerStage=25,
        )

    def getValidationIndicatorCol(self) -> str | None:
        return self.getOrDefault("validationIndicatorCol") if self.isDefined("validationIndicatorCol") else None


class HistogramTrees(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted regression trees for squared error.

    Features are binned once: cuts come from the ``binRows`` rows with the least hashes, so they do not depend on the order of rows; NaN has a bin of its
    own, which goes left. The binned rows (one byte a feature) are written to the shared folder. The tasks of a barrier stage hold them, sum gradients per
    node and bin, exchange the sums by ``allGather``, and all derive the same tree; the larger child of a split is its parent minus the smaller. Gradients
    and errors are whole numbers, rows are drawn by a hash of (row, tree): equal rows in any number of partitions give equal trees.

    A stage grows ``treesPerStage`` trees, starting from those of the stages before; a stage that loses an executor is run again from there. With
    ``validationIndicatorCol`` the held-out error is measured after every tree; ``patience`` trees without gain end the fit, and the model keeps the trees up to the best.

    Rows without label take no part. Equal rows (features and label) are drawn together. Without any row for training the fit is an error.

    A task holds one byte per cell (row and feature) and some 60 bytes per row. Spark looks for the end of an exchange once a second, so a level of a tree
    takes a second at least where there are several tasks: one more is taken per CELLS_PER_TASK cells, which is about a second of work. The exchange carries
    at most 2 ** (depth - 2) nodes times features times bins from each of at most ``maxTasks`` tasks, whatever the number of rows.
    """

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._set(**self._input_kwargs)

    def setValidationIndicatorCol(self, name: str) -> HistogramTrees:
        return self._set(validationIndicatorCol=name)

    def _fit(self, dataset: DataFrame) -> HistogramTreesModel:
        get = self.getOrDefault
        if not 0 <= get("maxDepth") <= MOST_DEPTH or not 3 <= get("maxBins") <= 256:
            raise ValueError(f"maxDepth is at most {MOST_DEPTH}, maxBins 3 to 256")
        spark = dataset.sparkSession
        watched = self.getValidationIndicatorCol()
        held = F.coalesce(F.col(watched).cast("boolean"), F.lit(False)) if watched else F.lit(False)
        label = F.nanvl(F.col(get("labelCol")).cast("double"), F.lit(None).cast("double"))
        rows = dataset.select(vector_to_array(get("featuresCol")).alias("x"), label.alias("y"), held.alias("held")).filter("y IS NOT NULL")
        rows = rows.withColumn("key", F.xxhash64("x", "y"))
        train = rows.filter("NOT held")
        facts = rows.agg(F.count_if(~F.col("held")).alias("n"), F.max(F.abs("y")).alias("most"), F.count_if("held").alias("out"), F.max(F.size("x")).alias("features")).first()
        if not facts["n"]:
            raise ValueError("no row to train on")
        sample = train.orderBy("key").limit(get("binRows")).select("x").toPandas()["x"]
        values = np.array(sample.tolist(), float).reshape(len(sample), facts["features"])
        cuts = [cuts_of(values[:, f], get("maxBins")) for f in range(facts["features"])]
        limit = 8 * facts["most"] or 1.0
        scale = 2.0 ** np.floor(np.log2(2.0**52 / (facts["n"] * limit)))
        summed = train.agg(F.sum(F.rint(F.col("y") * F.lit(float(scale))).cast("decimal(38,0)"))).first()[0]
        sizes = np.array([2 + len(c) for c in cuts], np.int64)
        settings = Settings(
            sizes, get("maxDepth"), get("stepSize"), get("subsamplingRate"), get("columnShare"), get("ridge"), get("seed"), int(summed) / facts["n"] / scale,
            limit, scale, 2.0 ** np.floor(np.log2(2.0**62 / (max(facts["out"], 1) * limit * limit))), get("patience"),
        )

        def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, len(cuts))
                codes = np.stack([binned(x[:, f], c) for f, c in enumerate(cuts)], axis=1) if cuts else np.zeros((batch.num_rows, 0), np.uint8)
                raw = codes.tobytes()
                packed = pa.array([raw[i : i + len(cuts)] for i in range(0, len(raw), len(cuts))], pa.binary())
                yield pa.RecordBatch.from_arrays([packed, *batch.columns[1:]], names=["bins", "y", "key", "held"])

        cells = (facts["n"] + facts["out"]) * max(1, len(cuts))
        tasks = int(max(1, min(get("maxTasks"), spark.sparkContext.defaultParallelism, -(-cells // CELLS_PER_TASK))))
        chosen = rows.select("x", "y", "key", "held").mapInArrow(to_bins, "bins binary, y double, key long, held boolean")
        trees: list[tuple] = []
        with settled(chosen) as table:
            while len(trees) < get("maxIter"):
                first, last = len(trees), min(get("maxIter"), len(trees) + get("treesPerStage"))
                dealt = table.repartition(tasks).mapInArrow(grow(settings, trees, first, last, tasks, bool(watched)), TREES, barrier=True)
                for r in sorted(dealt.collect()):
                    trees.append((np.array(r["feature"], np.int32), np.array(r["cut"], np.int32), np.array(r["value"]), np.array(r["gain"]), r["error"]))
                if watched and stopped([t[4] for t in trees], get("patience")):
                    break
        errors = [t[4] for t in trees] if watched else []
        if errors:
            trees = trees[: int(np.argmin(errors)) + 1]
        nodes = (1 << get("maxDepth") + 1) - 1
        feature = np.array([t[0] for t in trees], np.int32).reshape(-1, nodes)
        cut = np.array([t[1] for t in trees], np.int64).reshape(-1, nodes)
        bounds = np.full(feature.shape, -np.inf)
        for f, c in enumerate(cuts):
            at = (feature == f) & (cut > 0)
            bounds[at] = c[cut[at] - 1]
        model = HistogramTreesModel(
            settings.base, len(cuts), feature, bounds, np.array([t[2] for t in trees]).reshape(-1, nodes), np.array([t[3] for t in trees]).reshape(-1, nodes), errors
        )
        return self._copyValues(model)


class HistogramTreesModel(Model, _TreeParams, MLWritable, MLReadable):
    """Trees as arrays (tree, node): the value goes left if it is unknown or at most ``bound``; node i has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, base=0.0, features=0, feature=None, bound=None, value=None, gain=None, errors=()):
        super().__init__()
        none = np.zeros((0, 1))
        self.base, self.features, self.errors = base, features, list(errors)
        self.feature = none.astype(np.int32) if feature is None else feature
        self.bound, self.value, self.gain = (none if x is None else x for x in (bound, value, gain))

    @property
    def getNumTrees(self) -> int:
        return len(self.feature)

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each feature in the gain of all splits."""
        out = np.zeros(self.features)
        split = self.feature >= 0
        np.add.at(out, self.feature[split], self.gain[split])
        return DenseVector(out / out.sum() if out.sum() > 0 else out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows of features."""
        depth, rate = self.getOrDefault("maxDepth"), self.getOrDefault("stepSize")
        out = np.full(len(x), float(self.base))
        tree = np.arange(self.getNumTrees)
        for at in range(0, len(x) if len(tree) else 0, 512):
            part = np.maximum(x[at : at + 512], LOWEST)
            node = np.zeros((len(part), len(tree)), np.int64)
            row = np.arange(len(part))[:, None]
            for _ in range(depth):
                f = self.feature[tree, node]
                v = part[row, np.maximum(f, 0)] if part.shape[1] else np.zeros(f.shape)
                node = np.where(f < 0, node, 2 * node + 1 + (v > self.bound[tree, node]))
            leaf = self.value[tree, node]
            for t in range(len(tree)):  # in the order of the fit, so that sums round alike
                out[at : at + 512] += weight(t, rate) * leaf[:, t]
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            rows = np.array(x.tolist(), float).reshape(len(x), model.features)
            return pd.Series(model.predict(rows))

        return dataset.withColumn(self.getOrDefault("predictionCol"), predicted(vector_to_array(self.getOrDefault("featuresCol"))))

    def write(self) -> MLWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreesReader(cls)


class _TreesWriter(MLWriter):
    def __init__(self, model: HistogramTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, m = SparkSession.getActiveSession(), self.model
        more = {"base": float(m.base).hex(), "features": m.features, "errors": [float(e).hex() for e in m.errors], "nodes": m.feature.shape[1]}
        DefaultParamsWriter.saveMetadata(m, path, spark.sparkContext, extraMetadata={"trees": more})
        rows = [(t, *(x[t].tolist() for x in (m.feature, m.bound, m.value, m.gain))) for t in range(m.getNumTrees)]
        schema = "tree int, feature array<int>, bound array<double>, value array<double>, gain array<double>"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/data")


class _TreesReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> HistogramTreesModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark.sparkContext)
        more = metadata["trees"]
        rows = spark.read.parquet(f"{path}/data").orderBy("tree").collect()  # as many as trees
        parts = [np.array([r[c] for r in rows], kind).reshape(-1, more["nodes"]) for c, kind in (("feature", np.int32), ("bound", float), ("value", float), ("gain", float))]
        model = self.kind(float.fromhex(more["base"]), more["features"], *parts, [float.fromhex(e) for e in more["errors"]])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
