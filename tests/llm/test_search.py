"""Nearest neighbours and source mixing."""

import brute
import cases
import numpy as np
import pytest

from hourcast.llm import ann, mixing
from hourcast.llm.common import settle

SCHEMA = "vec_id long, embedding array<double>, label int, leaf long, name string, score double"


def table(spark, data):
    return settle(spark).createDataFrame([(i, v, 1, -1, "x", -2.0) for i, v in data], SCHEMA)


def vectors(n: int = 600) -> list[tuple]:
    rng = np.random.default_rng(9)
    data = [(i, (rng.standard_normal(12) * rng.uniform(0.2, 3)).tolist()) for i in range(n)]
    data += [(10_000 + i, data[5][1]) for i in range(60)]  # equal vectors, some of them queries
    return data


def test_nearest_recall_and_order(spark):
    data = vectors()
    bad = [(20_000, None), (20_020, [0.0] * 12), (20_040, [float("inf")] + [0.0] * 11), (20_060, [None] + [1.0] * 11), (20_080, [1.0] * 5), (None, [1.0] * 12)]
    found = ann.nearest(table(spark, data + bad), leaf_rows=16, branching=4).collect()
    expected = brute.top_products(data, [(i, v) for i, v in data if i % 20 == 0])
    got: dict = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(expected) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 20 for q in got]) >= 0.9
    of = dict(data)
    for q, hits in got.items():
        assert hits == sorted(hits, key=lambda x: (-x[1], x[0])) and q not in {i for i, _ in hits}
        assert all(s == pytest.approx(float(np.dot(of[q], of[i])), rel=1e-12, abs=1e-12) for i, s in hits)


def test_all_leaves_give_the_exact_answer(spark):
    data = vectors(200)
    found = ann.nearest(table(spark, data), leaf_rows=16, recall=1.0, probes=1000).collect()
    expected = brute.top_products(data, [(i, v) for i, v in data if i % 20 == 0])
    assert {q: [i for i, _ in v] for q, v in expected.items()} == {
        q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in expected
    }


def test_few_and_no_vectors(spark):
    few = ann.nearest(table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert [tuple(r) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]
    assert ann.nearest(table(spark, [])).count() == 0
    assert ann.nearest(table(spark, [(0, [1.0])])).count() == 0


def water(sizes: dict) -> dict:
    """Targets by sharing the excess anew until none is above its limit."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and open_:
        total, given = sum(weight[s] for s in open_), 0.0
        for s in sorted(open_, key=names.index):
            part = min(left * weight[s] / total, 2 * sizes[s] - target[s])
            target[s] += part
            given += part
        open_ = {s for s in open_ if target[s] < 2 * sizes[s] - 1e-9}
        left -= given
    return target


def test_mixing_targets(spark):
    data = cases.with_repeats()
    docs = cases.frame(settle(spark), data)
    found = mixing.mix_sources(docs).collect()
    assert len(found) == len(data)
    sizes: dict = {}
    for _, t, _, s in data:
        sizes[s] = sizes.get(s, 0) + len([w for w in (t or "").split() if w])
    expected = water(sizes)
    taken = dict.fromkeys(sizes, 0)
    source = {(i, len((t or "").split())): s for i, t, _, s in data}
    for r in found:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(expected[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] < 1)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - expected[s]) < 1 for s in sizes)


def test_curriculum_follows_the_schedule(spark):
    """A source whose weight rises has fewer documents in the first half than in the second."""
    docs = settle(spark).createDataFrame([(i, "w " * 10, s) for i, s in enumerate(["a", "b", "c"] * 400)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs).collect()
    places = {s: [p for r in rows if "abc"[r["doc_id"] % 3] == s for p in (r["position"], r["position_again"]) if p is not None] for s in "ac"}
    early = {s: np.mean([p < 0.5 for p in places[s]]) for s in "ac"}
    assert early["a"] < 0.5 < early["c"]
    ordered = mixing.mixed_documents(docs)
    assert ordered.columns == docs.columns
    times = [r["count"] for r in ordered.groupBy("doc_id").count().collect()]
    assert set(times) <= {1, 2} and abs(sum(times) - 1.5 * 1200) <= 3


def test_mixed_documents_count_rows_not_ids(spark):
    """NULL and repeated ids over three sources: each row comes as often as its own words are taken, and targets are met."""
    data = [(None if i % 2 else i % 10, " ".join(["w"] * (20 + i)), s) for i, s in enumerate(["a"] * 60 + ["b"] * 300 + ["c"] * 60)]
    docs = settle(spark).createDataFrame(data, "doc_id long, text string, source string")
    sizes = {s: sum(len(t.split()) for _, t, x in data if x == s) for s in "abc"}
    expected = water(sizes)
    times = {r["size"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix_sources(docs).collect()}  # sizes are different
    mixed = mixing.mixed_documents(docs).collect()
    found = dict.fromkeys(times, 0)
    for r in mixed:
        found[len(r["text"].split())] += 1
    assert found == times
    longest = max(len(t.split()) for _, t, _ in data)
    for s in "abc":
        assert abs(sum(len(r["text"].split()) for r in mixed if r["source"] == s) - expected[s]) <= longest


def test_mixing_of_nothing(spark):
    assert mixing.mix_sources(cases.frame(settle(spark), [])).count() == 0
    blank = mixing.mix_sources(cases.frame(spark, [(1, None, "en", None), (2, " ", "en", "a")])).collect()
    assert [(r["taken"], r["target"], r["position"]) for r in blank] == [(0, 0.0, None)] * 2
