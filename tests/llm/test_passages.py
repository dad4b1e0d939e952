"""Substring dedup against a plain version."""

import random
import re

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hourcast.llm import passages
from hourcast.llm.common import settle


def plain(docs, window):
    """(doc_id, n_words, n_removed, kept) of (doc_id, text) rows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    least: dict = {}
    for (i, _), w in zip(docs, words):
        if i is not None:
            for a in range(len(w) - window + 1):
                key = tuple(w[a : a + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        if i is not None:
            for a in range(len(w) - window + 1):
                if least[tuple(w[a : a + window])] < i:
                    gone.update(range(a, a + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def found(docs, **settings):
    return [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in passages.dedup_passages(docs, **settings).collect()]


def mixed_texts(seed, n=120):
    """Texts from a few words, with shared passages in other surroundings, copies, periodic texts and odd white space."""
    rng = random.Random(seed)
    words = ["a", "b", "Aa", "é", "ß-1", " ", "x y", "漢字"]
    gaps = [" ", "  ", "\n", "\t ", "\r\n", "\x0b", "\x0c"]
    shared = [[rng.choice(words) for _ in range(rng.randint(4, 30))] for _ in range(6)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(words) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 25))]
            w += rng.choice(shared)
        out.append((rng.randint(0, 100) * 3 - 50, "".join(x + rng.choice(gaps) for x in w), "en", "a"))
    return out


@pytest.mark.parametrize("hot", [0, 3, 4096])
def test_passages(spark, hot):
    data = mixed_texts(hot) + cases.with_repeats()
    data += [(700 + i, "ha " * k, "en", "b") for i, k in enumerate([3, 7, 700, 1200, 701])]
    data += [(None, data[5][1], "en", "a"), (None, None, "en", "a"), (800, data[9][1], None, None), (800, data[9][1], None, None)]
    docs = cases.frame(settle(spark), data)
    got = found(docs.repartition(3), window=8, mer=3, hot=hot)
    assert sorted(got, key=repr) == sorted(plain([(i, t) for i, t, *_ in data], 8), key=repr)
    assert any(n and n < m for _, m, n, _ in got)


def test_defaults_and_columns(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(60))
    short = " ".join(passage.split()[:40])
    data = [(i, f"{cases.text(rng, 'en', 70)} {passage if i % 2 else short} {cases.text(rng, 'de', 60)}", "en", "a") for i in range(40)]
    docs = cases.frame(settle(spark), data).withColumn("n_words", F.lit("old"))
    out = passages.dedup_passages(docs)
    assert out.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed"]
    rows = out.collect()
    expected = {i: (n, gone, kept) for i, n, gone, kept in plain([(i, t) for i, t, *_ in data], 50)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in rows} == expected
    assert sum(r["n_removed"] > 0 for r in rows) == 19 and {r["size"] for r in rows} == {-1} and {r["source"] for r in rows} == {"a"}


def test_no_documents(spark):
    assert found(cases.frame(settle(spark), [])) == []
    assert found(cases.frame(spark, [(1, None, None, None), (2, "", "en", "a"), (None, " x  y", "en", "a")])) != []


def test_equal_hashes_are_told_apart(monkeypatch):
    """Windows of one hash but other words keep ids of their own."""
    texts = [b"a b c d", b"a b c e", b"z b c d", b"a b c d"]
    raw, begin, end, owner, number = passages.windows_of(pa.array(texts, pa.binary()), np.array([2, 2, 2, 2]), 3)
    ids = np.array([9, 5, 7, 3])[owner]
    expected = [3, 3, 3, 5, 7, 3, 3, 3]
    assert passages.least_ids(raw, begin, end, ids).tolist() == expected
    monkeypatch.setattr(passages, "span_hashes", lambda flat, a, b: np.zeros(len(a), np.uint64))
    assert passages.least_ids(raw, begin, end, ids).tolist() == expected


def test_runs_of_one_minimiser_cover_all_windows():
    texts = [t.encode() for _, t, *_ in mixed_texts(8, 20)] + [b"same " * 900]
    words = passages.Words(texts)
    minis, first, count, owner = passages.runs_of(words, 8, 3)
    covered = [k for a, n in zip(first.tolist(), count.tolist()) for k in range(a, a + n)]
    sizes = np.diff(words.begins)
    assert covered == [b + k for b, n in zip(words.begins[:-1].tolist(), sizes.tolist()) for k in range(max(0, n - 7))]
    assert count.max() <= passages.LONGEST and (owner[1:] >= owner[:-1]).all()
