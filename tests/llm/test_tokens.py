"""Encoding, token files and packing."""

import random
from collections import defaultdict

import brute
import cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from hourcast.llm import packing, tokenfiles, tokens
from hourcast.llm.common import bytes_of, scratch, settle
from hourcast.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "ab cA Z'stré \n\t\r  .,!1 2İΣσς é漢字🙂 \xa0　 \x0b\x1c“"


def plain(path, texts):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [np.append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32), np.uint32(2)) for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_library(path):
    rng = random.Random(11)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["", " ", "\n\n", "<|endoftext|> a", "don't DON'T ''s !'s", "a" * 3000, "don’t"]
    encoder = Encoder(path, kept=300)
    for _ in range(2):
        for i in range(0, len(texts), 100):
            part = texts[i : i + 100]
            found = encoder.encode(*bytes_of(pa.array([t.encode() for t in part], pa.binary())))
            assert [x.tolist() for x in found] == [encoder.whole(t) for t in part]


def test_workers_encode_no_known_piece_again(monkeypatch):
    """More distinct words than one task's memory holds: a later task of the worker finds them all."""
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    texts = [" ".join(f"w{i}" for i in range(a, a + 10_000)) for a in range(0, 260_000, 10_000)]
    encoder, counts = tokens.encoder(BYTE), []
    fresh = encoder.fresh
    monkeypatch.setattr(encoder, "fresh", lambda flat, starts, ends: counts.append(len(starts)) or fresh(flat, starts, ends))
    for _ in range(2):
        for text in texts:
            (found,) = encoder.encode(*bytes_of(pa.array([" " + text], pa.string()).cast(pa.binary())))
            if text in (texts[0], texts[-1]):
                assert found.tolist() == encoder.whole(" " + text)
    assert counts == [10_000] * len(texts)


def test_pack_and_unpack():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (2.0 ** rng.uniform(0, 31.9, n)).astype(np.uint32)
        control, data = tokenfiles.pack(ranks)
        assert len(control) == -(-n // 4)
        assert tokenfiles.unpack(control, data, n).tolist() == ranks.tolist()


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 500)
    data = cases.with_repeats()
    folder = scratch(settle(spark), "test")
    tokenfiles.write_token_files(cases.frame(spark, data), folder, BYTE)
    found = tokenfiles.read_token_files(spark, folder).collect()
    ids = plain(BYTE, [t for _, t, *_ in data])
    assert sorted(((r["doc_id"], r["ids"]) for r in found), key=repr) == sorted(((d[0], x.tolist()) for d, x in zip(data, ids)), key=repr)
    at = 0
    for r in sorted(found, key=lambda r: (r["block"], r["place"])):
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]
    names = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert names == sorted(names, key=lambda x: (x is not None, x or 0))
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r["times"] for r in ranks] == sorted((r["times"] for r in ranks), reverse=True)


def test_no_documents(spark):
    folder = scratch(settle(spark), "test")
    tokenfiles.write_token_files(cases.frame(spark, []), folder, BYTE)
    assert tokenfiles.document_checks(spark, folder).count() == 0
    assert packing.pack_documents(cases.frame(spark, []), WORD).count() == 0


def check_pieces(pieces, data, path, window):
    ids = plain(path, [t for _, t, *_ in data])
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    wanted = defaultdict(list)
    for (doc_id, *_), x in zip(data, ids):
        wanted[doc_id, len(x)].append(x)
    assert {k: sum(p["length"] for p in v) for k, v in by_doc.items()} == {k: sum(map(len, v)) for k, v in wanted.items()}
    for key, parts in by_doc.items():
        if len(wanted[key]) == 1:
            (x,), at = wanted[key], 0
            for p in sorted(parts, key=lambda p: p["start"]):
                assert p["start"] == at and p["ids_crc32"] == brute.crc(x[at : at + p["length"]])
                at += p["length"]
    sizes = [sum(n for _, n in parts) for parts in by_sequence.values()]
    return sum(0 if n & (n - 1) == 0 else window - n for n in sizes) / sum(sizes)


def test_packing_cases(spark):
    data = cases.with_repeats()
    pieces = packing.pack_documents(cases.frame(settle(spark), data), WORD, window=512, quantum=16, fillers=2).collect()
    assert check_pieces(pieces, data, WORD, 512) < 0.3


def test_packing_of_given_documents(spark):
    docs = settle(spark).read.parquet(f"{cases.SF}/documents.parquet")
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert check_pieces(packing.pack_documents(docs, WORD).collect(), data, WORD, 4096) < 0.05


def test_nnls_matches_conditions():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((8, 30)), rng.random(8)
        x = packing.nnls(a, b)
        pull = a.T @ (b - a @ x)
        assert (x >= 0).all() and (pull <= 1e-7).all() and (np.abs(pull[x > 1e-9]) < 1e-7).all()


def test_plan_uses_every_document_once():
    rng = np.random.default_rng(4)
    for scale in (1, 5, 1000):
        histogram = np.append(0, rng.integers(0, scale + 1, 64))
        plan = packing.plan_windows(histogram, 5)
        used = np.zeros(65, int)
        for parts, times in plan:
            assert sum(n * c for n, c in parts.items()) <= 64 and times > 0
            for n, c in parts.items():
                used[n] += c * times
        assert used.tolist() == histogram.tolist()
        rows, free = packing.slots(plan, 10)
        assert free == 10 + sum(t for _, t in plan)


def test_combinations_fill_the_window():
    table = packing.combinations(12, 3)
    assert (np.arange(13) @ table == 12).all() and (table.sum(axis=0) <= 3).all()
    assert table.shape[1] == len({tuple(c) for c in table.T}) == 19
