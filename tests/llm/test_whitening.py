"""Embedding whitening against numpy's eigenvectors, and the spectrum slicing by itself."""

import numpy as np
import pytest

from hourcast.llm import whitening
from hourcast.llm.common import settle
from hourcast.llm.whitening import Factor, Spectrum

SCHEMA = "vec_id long, embedding array<double>, label int, component int, n string, vector long"


def table(spark, data):
    return settle(spark).createDataFrame([(i, v, 1, -1, "x", -2) for i, v in data], SCHEMA)


def plain(vectors, components):
    """n, deviations, whitened (up to the sign of each column), explained."""
    x = np.floor(np.array(vectors, float) * 64) + 1_000_000
    n = len(x)
    centred = x - x.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    whole = x.astype(np.int64)
    deviations = [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, whole.sum(axis=0)))) for row in whole]
    return n, deviations, centred @ directions[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def compared(rows, data, components):
    good = [(i, v) for i, v in data if v is not None and len(v) == len(data[0][1]) and all(c is not None and np.isfinite(c) for c in v)]
    n, deviations, white, explained = plain([v for _, v in good], components)
    assert len(rows) == n * components and {r["n"] for r in rows} == {n}
    got = np.zeros((n, components))
    place = {i: k for k, (i, _) in enumerate(good)}
    for r in rows:
        k = place[r["vec_id"]]
        got[k, r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviations[k]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    for c in range(components):
        assert np.allclose(got[:, c], white[:, c], atol=1e-6) or np.allclose(got[:, c], -white[:, c], atol=1e-6)
    errors = {r["identity_error"] for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitened_like_numpy(spark):
    rng = np.random.default_rng(5)
    mix = rng.standard_normal((40, 40)) * rng.uniform(0.05, 2, 40)
    data = [(i, (rng.standard_normal(40) @ mix + 3).tolist()) for i in range(400)]
    bad = [(1000, None), (1001, [None] + [1.0] * 39), (1002, [float("nan")] * 40), (1003, [float("inf")] + [0.0] * 39), (1004, [1.0] * 7), (1005, []), (1006, [1e300] * 40)]
    rows = whitening.whiten(table(spark, data + bad).repartition(5)).collect()
    assert whitening.whiten(table(spark, data)).schema == spark.createDataFrame([], whitening.OUT).schema
    compared(rows, data, 32)


def test_ids_that_repeat_or_are_null_are_rows_of_their_own(spark):
    rng = np.random.default_rng(6)
    vectors = [rng.standard_normal(3).tolist() for _ in range(20)]
    data = [(None, v) for v in vectors[:5]] + [(7, v) for v in vectors[5:]] + [(7, vectors[5])]
    rows = whitening.whiten(table(spark, data)).collect()
    assert len(rows) == 21 * 3 and {r["n"] for r in rows} == {21}
    assert len([r for r in rows if r["vec_id"] is None]) == 15
    _, deviations, _, _ = plain([v for _, v in data], 3)
    assert sorted(r["deviation"] for r in rows if r["component"] == 1) == sorted(deviations)


def test_no_variance(spark):
    """Components without variance have no whitened entries; the others are whitened all the same."""
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, []), (3, [None])])).count() == 0
    one = whitening.whiten(table(spark, [(1, [0.5, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(c, 1, 0, None, 0.0, 0.0) for c in (1, 2)]
    flat = whitening.whiten(table(spark, [(i, [float(i % 3), float(i % 3), 4.0, 4.0]) for i in range(30)])).collect()
    assert {r["component"] for r in flat if r["whitened"] is not None} == {1}
    assert {r["identity_error"] < 1e-12 for r in flat} == {True}
    assert all(r["explained"] == pytest.approx(1.0) for r in flat if r["component"] == 1)


def test_large_entries_are_exact(spark):
    data = [(i, [float(i) * 1e13, -1e15 + i, 0.25 * (i % 5)]) for i in range(50)]
    rows = whitening.whiten(table(spark, data)).collect()
    x = [[int(np.floor(c * 64)) + 1_000_000 for c in v] for _, v in data]
    sums = [sum(r[d] for r in x) for d in range(3)]
    exact = [sum((50 * r[d] - sums[d]) ** 2 for d in range(3)) for r in x]
    for r in rows:
        assert r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 1 << 63 else None)
    fitted = whitening.fit(table(spark, data).select("embedding"), 3)
    trace = sum(sum((50 * r[d] - sums[d]) ** 2 for r in x) / 50**3 for d in range(3))
    assert fitted.n == 50 and fitted.sums == sums and fitted.trace == pytest.approx(trace, rel=1e-14)


@pytest.mark.parametrize("seed", range(6))
def test_spectrum_with_close_and_equal_values(seed):
    rng = np.random.default_rng(seed)
    n = 24
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    wanted = np.sort(np.concatenate([[9, 9, 9, 5, 5 + 1e-9, 4, 1e-6, 0, 0, -2], rng.uniform(0, 3, n - 10)]))[::-1]
    matrix = q @ np.diag(wanted) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = Spectrum(matrix).leading(n)
    assert np.allclose(values, wanted, atol=1e-12 * 9)
    assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-11


@pytest.mark.parametrize("seed", range(20))
def test_inertia_and_solve(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 18))
    a = rng.integers(-3, 4, (n, n)).astype(float)
    a = a + a.T
    if seed % 3 == 0:
        np.fill_diagonal(a, 0)  # needs pivots of two rows
    values = np.linalg.eigvalsh(a)
    factor = Factor(a - 0.37 * np.eye(n), np.abs(a).sum(axis=1).max() + 1)
    assert factor.positive == (values > 0.37).sum()
    right = rng.standard_normal(n)
    assert np.allclose((a - 0.37 * np.eye(n)) @ factor.solve(right), right, atol=1e-8)
