"""Boosted trees: against a plain trainer, over partitions, with early stopping, saved and loaded."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hourcast.operators.boosting import Grower, HistogramTrees, HistogramTreesModel, Settings, binned, cuts_of, drawn, stopped


def plain_tree(codes, gradient, depth, ridge):
    """Greedy tree by trying every cut of every feature; rows go left up to the cut. Node to (feature, cut, value)."""
    out = {}

    def add(node, rows, level):
        g = gradient[rows]
        best = (0.0, None)
        if level < depth:
            for f in range(len(codes)):
                for c in np.unique(codes[f][rows])[:-1]:
                    left = codes[f][rows] <= c
                    gain = g[left].sum() ** 2 / (left.sum() + ridge) + g[~left].sum() ** 2 / ((~left).sum() + ridge) - g.sum() ** 2 / (len(g) + ridge)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, int(c)))
        value = g.sum() / (len(g) + ridge)
        out[node] = (*(best[1] or (-1, 0)), value)
        if best[1]:
            left = codes[best[1][0]][rows] <= best[1][1]
            add(2 * node + 1, rows[left], level + 1)
            add(2 * node + 2, rows[~left], level + 1)

    add(0, np.arange(len(gradient)), 0)
    return out


def data(n=400, features=5, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, features)), 1)
    x[rng.random((n, features)) < 0.1] = np.nan
    x[:, 3] = np.round(x[:, 3])
    return x, np.round(np.nan_to_num(x[:, 0]) * 3 + np.nan_to_num(x[:, 1]) ** 2 + rng.standard_normal(n), 2)


def test_trees_equal_a_plain_trainer():
    x, y = data()
    cuts = [cuts_of(x[:, f], 256) for f in range(5)]
    codes = np.stack([binned(x[:, f], c) for f, c in enumerate(cuts)])
    settings = Settings(np.array([2 + len(c) for c in cuts]), 4, 0.3, 1.0, 1.0, 1.0, 7, float(y.mean()), 1000.0, 2.0**30, 2.0**20, 10)
    grower = Grower(codes, y, np.arange(400, dtype=np.uint64), np.zeros(400, bool), settings, lambda a: a)
    predicted = np.full(400, y.mean())
    for number in range(6):
        feature, cut, value, gain = grower.tree(number)
        expected = plain_tree(codes, y - predicted, 4, 1.0)
        assert {i for i in range(31) if feature[i] >= 0} == {i for i, e in expected.items() if e[0] >= 0}
        for i, (f, c, v) in expected.items():
            assert (int(feature[i]), int(cut[i])) == (f, c) and value[i] == pytest.approx(v, abs=1e-6)
        for r in range(400):
            node = 0
            while expected[node][0] >= 0:
                node = 2 * node + 1 + int(codes[expected[node][0]][r] > expected[node][1])
            predicted[r] += (0.3 if number else 1.0) * expected[node][2]
    assert np.allclose(grower.predicted, predicted, atol=1e-5)


def frame(spark, x, y, parts=1):
    rows = [(None if np.isnan(v) else float(v), row.tolist(), i % 4 == 3) for i, (row, v) in enumerate(zip(x, y))]
    made = spark.createDataFrame(rows, "y double, x array<double>, held boolean")
    return made.select(array_to_vector("x").alias("features"), F.col("y").alias("label"), "held").repartition(parts)


def arrays(model):
    return [model.feature.tolist(), model.bound.tolist(), model.value.tolist(), model.gain.tolist(), model.base, model.errors]


def test_partitions_and_tasks_do_not_matter(spark, monkeypatch):
    x, y = data(900)
    x, y = np.vstack([x, x[:50]]), np.append(y, y[:50])  # repeated rows, too
    found = []
    for parts, cells, per_stage in ((1, 1 << 20, 25), (8, 1 << 20, 1), (3, 1600, 2), (8, 1200, 25)):  # one task, one task, three, four: a second per exchange
        monkeypatch.setattr("hourcast.operators.boosting.CELLS_PER_TASK", cells)
        trees = HistogramTrees(maxIter=3, maxDepth=3, treesPerStage=per_stage, validationIndicatorCol="held", patience=50)
        found.append(arrays(trees.fit(frame(spark, x, y, parts))))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0][5]) == 3


def test_best_round_is_kept_and_ten_more_are_grown(spark):
    """Held-out labels are those of the first trees' fit: from a known round on every tree makes them worse."""
    x, y = data(300)
    held = np.array([i % 4 == 3 for i in range(300)])
    plain = HistogramTrees(maxIter=30, maxDepth=3, stepSize=0.5, subsamplingRate=1.0, columnShare=1.0)
    whole = plain.fit(frame(spark, x[~held], y[~held]).withColumn("held", F.lit(False)))
    best = 7
    short = HistogramTreesModel(whole.base, whole.features, whole.feature[:best], whole.bound[:best], whole.value[:best], whole.gain[:best])
    whole._copyValues(short)
    y = np.where(held, short.predict(x), y)
    stopping = HistogramTrees(maxIter=30, maxDepth=3, stepSize=0.5, subsamplingRate=1.0, columnShare=1.0, validationIndicatorCol="held", patience=10, treesPerStage=4)
    model = stopping.fit(frame(spark, x, y))
    assert model.getNumTrees == best and len(model.errors) == best + 10
    assert int(np.argmin(model.errors)) == best - 1 and model.errors[best - 1] < 1e-9
    assert model.feature.tolist() == whole.feature[:best].tolist()


def test_stopped():
    assert not stopped([], 2) and not stopped([3.0, 2.0, 2.5], 2) and stopped([3.0, 2.0, 2.5, 2.0], 2)


def test_saved_and_loaded(spark, tmp_path):
    x, y = data(200)
    docs = frame(spark, x, y)
    model = HistogramTrees(maxIter=5, maxDepth=3, predictionCol="p").fit(docs)
    model.write().save(str(tmp_path / "m"))
    again = HistogramTreesModel.load(str(tmp_path / "m"))
    assert arrays(again) == arrays(model) and again.uid == model.uid and again.getOrDefault("predictionCol") == "p"
    rows = [r["p"] for r in model.transform(docs).orderBy("label", "p").collect()]
    assert rows == [r["p"] for r in again.transform(docs).orderBy("label", "p").collect()] and len(rows) == 200
    HistogramTrees(maxIter=9).write().save(str(tmp_path / "e"))
    assert HistogramTrees.load(str(tmp_path / "e")).getOrDefault("maxIter") == 9


def test_awkward_rows(spark):
    """Unknown and endless values, constant features, missing labels, one row, no row."""
    x = np.array([[np.nan, 1.0, np.inf, 5.0], [np.nan, 2.0, -np.inf, 5.0], [np.nan, 3.0, 1e308, 5.0], [np.nan, np.nan, -1e308, 5.0]] * 5)
    y = np.array([1.0, 2.0, 3.0, np.nan] * 5)
    model = HistogramTrees(maxIter=40, maxDepth=2, subsamplingRate=1.0, ridge=0.0).fit(frame(spark, x, y))
    found = model.predict(x)
    assert np.allclose(found[:3], [1, 2, 3], atol=0.1) and np.isfinite(found).all()
    assert model.featureImportances.toArray()[[0, 3]].tolist() == [0.0, 0.0]
    one = HistogramTrees(maxIter=2).fit(frame(spark, x[:1], y[:1]))
    assert one.predict(x).tolist() == [1.0] * 20 and one.featureImportances.toArray().tolist() == [0.0] * 4
    with pytest.raises(ValueError, match="no row"):
        HistogramTrees().fit(frame(spark, x[3:4], y[3:4]))


def test_bins():
    values = np.array([np.nan, 1.0, 2.0, 2.0, 5.0])
    cuts = cuts_of(values, 256)
    assert cuts.tolist() == [1.5, 3.5] and binned(values, cuts).tolist() == [0, 1, 2, 2, 3]
    many = np.random.default_rng(0).standard_normal(5000)
    cuts = cuts_of(many, 256)
    assert len(cuts) <= 254 and np.bincount(binned(many, cuts)).max() < 60 and binned(np.array([np.inf, -np.inf]), cuts).tolist() == [1 + len(cuts), 1]
    share = drawn(np.arange(100_000, dtype=np.uint64), 3, 5, 0.8).mean()
    assert share == pytest.approx(0.8, abs=0.01)
