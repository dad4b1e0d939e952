"""License scans, language ID and quality weights."""

import zlib

import brute
import cases
import numpy as np
import pytest

from hourcast.llm import langid, licenses, quality
from hourcast.llm.common import settle


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(settle(spark), cases.with_repeats())


def test_base_phrases_match_brute_force(docs):
    found = licenses.scan_licenses(docs).collect()
    expected = [(r["doc_id"], *brute.license_base(r["text"])) for r in docs.collect()]
    assert sorted([tuple(r)[:6] for r in found], key=repr) == sorted(expected, key=repr)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_overlapping_phrases_count_all_places():
    text = "CC BY NC cc-by.nc x under the MIT License under the mit license apache license, version 2 cc by ncx"
    n, base, first, last, labels, *_ = licenses.scan(text.encode())
    assert (n, base, first, last, labels) == (24, 5, 0, 15 + 2, "apache-2,cc-by-nc,mit") or brute.license_base(text) == (n, base, first, last, labels)


@pytest.mark.parametrize(
    ("written", "order", "free"),
    [
        ("MIT", "MIT", 1.0),
        ("MIT OR GPL-3.0-only", "MIT GPL-3.0-only or", 1.0),
        ("MIT AND GPL-3.0-only", "MIT GPL-3.0-only and", 0.4),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT AND CC-BY-NC-4.0", "GPL-2.0 Classpath-exception-2.0 with MIT CC-BY-NC-4.0 and or", 0.7),
        ("(MIT OR Apache-2.0) AND CC-BY-NC-4.0", "MIT Apache-2.0 or CC-BY-NC-4.0 and", 0.1),
        ("MIT AND", "MIT", 1.0),
        ("((MIT)", "MIT", 1.0),
        ("MIT ) OR Foo", "MIT", 1.0),
        ("MIT and the rest of a sentence", "MIT the and", 0.5),
        ("AND OR", "", 0.5),
        ("", "", 0.5),
        ("MIT OR (", "MIT", 1.0),
    ],
)
def test_shunting_yard(written, order, free):
    found = licenses.postfix(written)
    assert " ".join(found) == order
    assert licenses.evaluate(found)[1] == pytest.approx(free)


def test_tag_adds_labels(docs):
    row = next(r for r in licenses.scan_licenses(docs).collect() if r["doc_id"] == 127)
    assert row["base_labels"] == "cc-by-nc,mit"
    assert row["labels"] == "cc-by-nc,foo-1,gpl-2,mit"
    assert row["expressions"] == ["MIT GPL-2.0-only Classpath-exception-2.0 with or Foo-1 and"]


def test_empty_table_of_texts(spark):
    empty = cases.frame(settle(spark), [])
    assert licenses.scan_licenses(empty).count() == 0
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert quality.resample(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def longest_match_phrases(sample: bytes, text: bytes) -> int:
    """Greedy parse in blocks: each phrase is the longest match in the sample, at least one byte."""
    count = 0
    for at in range(0, len(text), langid.BLOCK):
        block, i = text[at : at + langid.BLOCK], 0
        while i < len(block):
            n = 1
            while i + n < len(block) and block[i : i + n + 1] in sample and block[i : i + 1] in sample:
                n += 1
            i += n
            count += 1
    return count


def test_phrases_match_a_plain_parse():
    samples = {"a": b"the cat sat on the mat and the dog ran", "b": b"le chat est sur le tapis et le chien court"}
    model = langid.Model(samples)
    texts = [b"the dog sat on the cat", b"le chien est sur le chat qqq", b"", b"zzz the", b"the mat " * 400]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    found = model.phrases(flat, np.cumsum([0, *map(len, texts)]))
    for k, language in enumerate(model.languages):
        assert found[k].tolist() == [longest_match_phrases(samples[language], t) for t in texts]


def test_language_of_held_out_documents(spark):
    data = [(i, cases.text(__import__("random").Random(i), lang, 40), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = cases.frame(settle(spark), data)
    found = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    held = [i for i, *_ in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    assert np.mean([found[i]["lang_pred"] == data[i][2] for i in held]) > 0.95


def test_language_cases(docs):
    found = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert [found[i]["lang_pred"] for i in (120, 121, 122, 123)] == ["und"] * 4
    assert found[120]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in found.values())
    kept = langid.keep_identified(docs, langid.fit(docs))
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert kept.count() == docs.count() - 4


def test_no_labelled_document(spark):
    docs = cases.frame(settle(spark), [(1, "some text", None, "a")])
    assert [r["lang_pred"] for r in langid.identify(docs, langid.fit(docs)).collect()] == ["und"]


def test_language_accuracy_on_given_documents(spark):
    docs = settle(spark).read.parquet(f"{cases.SF}/documents.parquet")
    found = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95


def test_log_weight_matches_counts(spark):
    docs = settle(spark).createDataFrame([(0, "a b a"), (1, "b c"), (2, None), (3, "")], "doc_id long, text string")
    target = spark.createDataFrame([(0,)], "doc_id long")
    ratios = quality.log_ratios(docs, target, buckets=1 << 20)
    found = {r["doc_id"]: r for r in quality.weigh(docs, ratios).collect()}
    grams = [["a", "b", "a", "ab", "ba"], ["b", "c", "bc"]]
    raw = {g: sum(d.count(g) for d in grams) for d in grams for g in d}
    size, smooth = 1 << 20, 1.0
    ratio = {g: np.log((grams[0].count(g) + smooth) / (5 + smooth * size)) - np.log((raw[g] + smooth) / (8 + smooth * size)) for g in raw}
    for i, d in enumerate(grams):
        assert found[i]["n_features"] == len(d)
        assert found[i]["log_weight"] == pytest.approx(sum(ratio[g] for g in d))
    assert (found[2]["log_weight"], found[3]["n_features"]) == (0, 0)


def test_highest_takes_exactly_k(spark, monkeypatch):
    monkeypatch.setattr(quality, "SMALL", 40)
    data = [(i, float((i * 37) % 101)) for i in range(1000)]
    table = settle(spark).createDataFrame(data, "doc_id long, key double")
    for k in (0, 1, 7, 500, 999, 1000):
        chosen = {r["doc_id"] for r in quality.highest(table, "key", k).filter("selected").collect()}
        assert chosen == {i for i, _ in sorted(data, key=lambda x: (-x[1], x[0]))[:k]}


def test_resample_cases(spark, docs):
    labels = settle(spark).createDataFrame([(1, 1), (2, 0), (None, 1), (3, 1)], "doc_id long, quality int")
    found = quality.resample(docs, labels).collect()
    assert len(found) == docs.count()
    assert not any(r["selected"] for r in found if r["n_features"] == 0)
    again = quality.resample(docs, labels).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)
