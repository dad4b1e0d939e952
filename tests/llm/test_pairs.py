"""Line dedup, the Jaccard join, embedding near-dedup, and what they share."""

import random

import brute
import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from hourcast.llm import jaccard, linededup, neardup
from hourcast.llm.common import components, running_total, settle, word_hashes


def test_components_match_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(400, 400 + i) for i in range(100)] + [(600 + i, 601 + i) for i in range(70)]
    found = {r["node"]: r["component"] for r in components(settle(spark).createDataFrame(links, "a long, b long"), "test").collect()}
    expected = brute.groups({x for link in links for x in link}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {k: v for k, v in expected.items() if k in linked}


def test_components_of_nothing(spark):
    assert components(settle(spark).createDataFrame([], "a long, b long"), "test").count() == 0


def test_running_total(spark):
    data = [(g, i % 5, i, i % 7) for g in ("x", None) for i in range(50)]
    found = running_total(settle(spark).createDataFrame(data, "g string, cell long, i long, v long"), "v", "cell", [F.col("i")], ["g"]).collect()
    for r in found:
        assert r["before"] == sum(v for g, c, i, v in data if g == r["g"] and (c, i) < (r["cell"], r["i"]))


def test_equal_words_have_equal_hashes_wherever_they_stand():
    texts = [b"One two  three", b"", b"two\tONE\n", b"three"]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    hashes, begins = word_hashes(flat, np.cumsum([0, *map(len, texts)]))
    assert np.diff(begins).tolist() == [3, 0, 2, 1]
    assert hashes[0] == hashes[4] and hashes[1] == hashes[3] and hashes[2] == hashes[5] and len(set(hashes.tolist())) == 3


def jaccard_of(docs, **options):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs, **options).collect()), key=repr)


def test_jaccard_groups_match_brute_force(spark):
    data = cases.with_repeats()
    expected = sorted(brute.jaccard_rows([(i, t) for i, t, *_ in data]), key=repr)
    assert jaccard_of(cases.frame(settle(spark), data)) == expected


def near_family(seed: int, n: int, words: int, changes: int) -> list[tuple]:
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        out.append(((i * 7919) % 100_003, " ".join(own), "en", "a"))
    return out


@pytest.mark.parametrize("frequent", [1 << 30, 5])
def test_long_lists_lose_no_link(spark, monkeypatch, frequent):
    """Families of near copies whose lists are much longer than NEAR; links among them come and go around the limit."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "NEAR", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    data = near_family(1, 70, 60, 6) + [(i + 200_000, t, *x) for i, t, *x in near_family(2, 50, 30, 5)]
    shared = " ".join(f"p{i}" for i in range(12))
    data += [(300_000 + i, f"{shared} " + " ".join(f"q{i}_{k}" for k in range(i % 9)), "en", "b") for i in range(60)]
    expected = sorted(brute.jaccard_rows([(i, t) for i, t, *_ in data]), key=repr)
    assert jaccard_of(cases.frame(settle(spark), data)) == expected


def test_one_of_each_group(spark):
    data = cases.with_repeats()
    docs = cases.frame(settle(spark), data)
    kept = jaccard.one_of_each_group(docs).collect()
    sets = [brute.shingle_set(t) for _, t, *_ in data]
    links = [(i, j) for i in range(len(data)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    groups = {g for i, g in brute.groups(range(len(data)), links).items() if sets[i]}
    assert jaccard.one_of_each_group(docs).columns == docs.columns
    assert len([r for r in kept if brute.shingle_set(r["text"])]) == len(groups)
    assert len([r for r in kept if not brute.shingle_set(r["text"])]) == len([s for s in sets if not s])


def test_groups_of_one_name_keep_a_row_each(spark):
    """NULL ids, and one id with two texts: counted are groups of linked texts, not their names."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(12)]
    near = [t + " tail" for t in texts]
    data = [(None, t, "en", "a") for t in texts[:6]]
    data += [(None, texts[0], "en", "a"), (None, near[1], "en", "b"), (7, near[2], "en", "b"), (None, None, "en", "a"), (None, "", "en", "a")]
    data += [(9, t, "en", "a") for t in texts[6:9]] + [(10, near[6], "en", "b"), (11, texts[9], "en", "c"), (11, texts[9], "en", "c"), (9, near[7], "en", "c")]
    sets = [brute.shingle_set(t) for _, t, *_ in data]
    links = [(i, j) for i in range(len(data)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    where = brute.groups(range(len(data)), links)
    members = {g: [i for i in where if where[i] == g] for g in set(where.values()) if sets[g]}
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each_group(cases.frame(settle(spark), data)).collect()]
    worded = [row for row in kept if brute.shingle_set(row[1])]
    assert len(members) == 10 and len(worded) == 10
    for rows in members.values():
        ids = [data[i][0] for i in rows if data[i][0] is not None]
        assert sum(row in worded for row in {data[i][:2] for i in rows}) == 1
        assert [row[0] for row in worded if row in [data[i][:2] for i in rows]] == [min(ids, default=None)]
    assert len(kept) - len(worded) == 2


def test_no_documents(spark):
    empty = cases.frame(settle(spark), [])
    assert jaccard.jaccard_groups(empty).count() == 0
    assert linededup.dedup_lines(empty).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def line_docs(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    lines = ["one two three", "a b c d e f g h i", "x", "", "p q r s t u v w", "long " * 12, "k l", "m n o"]
    return [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))), "en", "a") for i in rng.sample(range(1000), 60)]


@pytest.mark.parametrize("guarantee", [1, 8, 20])
def test_line_dedup_matches_brute_force(spark, guarantee):
    data = line_docs(guarantee) + [(2000, None, "en", "a"), (2001, "", "en", "a")]
    found = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(cases.frame(settle(spark), data), guarantee).collect()}
    data.sort()
    expected = brute.deduped([(i, t) for i, t, *_ in data], guarantee)
    assert found == {i: t for (i, *_), t in zip(data, expected)}


def test_line_dedup_cases(spark):
    docs = cases.frame(settle(spark), cases.with_repeats())
    found = linededup.dedup_lines(docs)
    assert [c for c in found.columns if c not in ("n_lines", "n_deleted")] == [c for c in docs.columns if c != "n_lines"]
    rows = found.collect()
    assert len(rows) == docs.count()
    assert [r["text"] for r in rows if r["doc_id"] == 120] == [None]
    assert sum(r["text"] == "" for r in rows if r["doc_id"] in range(100, 105)) == 5  # copies of document 7
    assert sorted(r["text"] == "" for r in rows if r["doc_id"] == 8) == [False, True]  # a repeated row
    long = next(r for r in rows if r["doc_id"] == 125)
    assert long["n_lines"] == 2500


def clusters(seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    out = []
    for i in range(150):
        out.append((i, rng.standard_normal(16).tolist(), int(i % 3)))
    centre = rng.standard_normal(16)
    for i in range(120):
        out.append((1000 + i, (centre + rng.standard_normal(16) * 0.18).tolist(), 1 if i % 4 else 2))
    out += [(2000 + i, out[3][1], 0) for i in range(40)]  # equal vectors
    out += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, [None] + [1.0] * 15, 0), (3004, out[3][1], None), (3005, [], 1)]
    out += [(3006, [1.0] * 8, 1), (3007, [1.0] * 8, 1), (3008, [1e200] * 8, 1), (3, out[3][1], 0)]
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    data = clusters(4)
    found = neardup.near_duplicates(settle(spark).createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) and label is not None for _, v, label in data]
    units = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if k else None for (_, v, _), k in zip(data, ok)]
    links = [
        (i, j) for i in range(len(data)) for j in range(i)
        if ok[i] and ok[j] and data[i][2] == data[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93
    ]
    degree = np.bincount([x for link in links for x in link], minlength=len(data))
    where = brute.groups(range(len(data)), links)
    least = {g: min(data[i][0] for i in range(len(data)) if where[i] == g) for g in set(where.values())}
    expected = [(d[0], int(degree[i]), least[where[i]], least[where[i]] == d[0]) for i, d in enumerate(data)]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_near_duplicates_of_a_label_in_one_direction(spark, caplog):
    """Vectors with a mean cosine of 0.7, a fifth of them near copies, and few passes: the label is centred, and passes are added until pairs are found."""
    rng = np.random.default_rng(8)
    common = rng.standard_normal(32)
    rows = common * 1.53 + rng.standard_normal((2500, 32))
    copies = rows[:500] + rng.standard_normal((500, 32)) * 0.55
    data = np.concatenate([rows, copies])
    units = data / np.linalg.norm(data, axis=1, keepdims=True)
    near = units @ units.T
    real = (near >= 0.93).sum(axis=1) - 1
    assert 0.65 < near.mean() < 0.75 and (real > 0).sum() > 500
    frame = settle(spark).createDataFrame([(i, v, 1) for i, v in enumerate(data.tolist())], "vec_id long, embedding array<double>, label int")
    with caplog.at_level("INFO", neardup.__name__):
        found = {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(frame, passes=2, window=4).collect()}
    assert all(found[i] <= n for i, n in enumerate(real))
    assert np.mean([found[i] / n for i, n in enumerate(real) if n]) >= 0.97
    assert "recall" in caplog.text


def test_an_anchor_on_another_diagonal_is_not_lost(spark):
    long = {name: " ".join(f"{name}{i}" for i in range(8)) for name in "PXYZ"}
    short = {name: " ".join(f"{name}{i}" for i in range(4)) for name in "QR"}
    line = long | short
    data = [(0, "\n".join(line[c] for c in "PQXQRY"), "en", "a"), (1, "\n".join(line[c] for c in "PQRZ"), "en", "a")]
    found = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(cases.frame(settle(spark), data)).collect()}
    assert [found[0], found[1]] == brute.deduped([(i, t) for i, t, *_ in data], 8) == [data[0][1], long["Z"]]


def test_runs_match_all_extensions():
    rng = random.Random(5)
    for _ in range(300):
        own, other = (np.array([rng.randint(0, 2) for _ in range(rng.randint(1, 90))]) for _ in range(2))
        if rng.random() < 0.3:
            other = own
        anchors = sorted((i, j) for i in range(len(own)) for j in range(len(other)) if own[i] == other[j] and rng.random() < 0.1)
        gone = set()
        for i, j in anchors:
            a, b = 0, 0
            while i + a < len(own) and j + a < len(other) and own[i + a] == other[j + a]:
                a += 1
            while i - b > 0 and j - b > 0 and own[i - b - 1] == other[j - b - 1]:
                b += 1
            gone.update(range(i - b, i + a))
        assert linededup.runs(own, other, anchors) == sorted(gone)
