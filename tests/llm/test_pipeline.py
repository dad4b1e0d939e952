"""The pipeline against plain versions of its stages."""

import brute
import cases
import public_tokenizers

import corpus_pipeline
from hourcast.llm.common import settle
from test_tokens import check_pieces


def test_stages_match_plain_versions(spark):
    docs = settle(spark).read.parquet(f"{cases.SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing sources", "packing"]

    found = stages["language ID"](spark, docs, cases.SF).cache()
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    assert found.count() == docs.filter(docs.text.rlike(r"\p{L}")).count()

    rows = sorted((r["doc_id"], r["text"]) for r in found.collect())
    texts = brute.deduped(rows, 8)
    expected = {i: new for (i, old), new in zip(rows, texts) if old == new or new.strip()}
    lines = stages["line dedup"](spark, found, cases.SF).cache()
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    groups = brute.jaccard_rows(sorted(expected.items()))
    near = stages["n-gram Jaccard join"](spark, lines, cases.SF).cache()
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, n, c in groups if i == c or n == 0)

    mixed = stages["mixing sources"](spark, near, cases.SF).cache()
    assert mixed.columns == docs.columns and mixed.exceptAll(near.unionByName(near)).count() == 0

    pieces = stages["packing"](spark, mixed, cases.SF).collect()
    data = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    check_pieces(pieces, data, public_tokenizers.path("word_bpe_49k.json"), 4096)


def test_pipeline_handles_every_case(spark, tmp_path):
    cases.frame(settle(spark), cases.with_repeats()).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_of_nothing(spark, tmp_path):
    cases.frame(settle(spark), []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
