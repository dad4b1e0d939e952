"""Language identification by cross-parsing: the language whose sample explains a text in the fewest phrases wins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourcast.llm.common import bytes_of

UNDECIDED = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, phrases long, n_bytes long"
BLOCK = 1024


def folded_bytes() -> np.ndarray:
    """Letters a-z and bytes from 128 on stay, everything else is a space."""
    table = np.full(256, 32, np.uint8)
    keep = [*range(97, 123), *range(128, 256)]
    table[keep] = keep
    table[65:91] = np.arange(97, 123)
    return table


FOLDED = folded_bytes()


def normal(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with single spaces, and the offsets of the documents in them."""
    out = FOLDED[flat]
    stay = out != 32
    stay[1:] |= out[:-1] != 32
    counts = np.zeros(len(out) + 1, np.int64)
    np.cumsum(stay, out=counts[1:])
    return out[stay], counts[offsets]


def suffix_automaton(text: bytes) -> tuple[list[dict[int, int]], int]:
    """Transitions of the smallest automaton that reads every substring of a text; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return moves, len(moves)


class Model:
    """Parsing tables of all languages, one after the other.

    ``steps[state * width + class]`` is the next state (times width); a negative entry (its complement) says that the longest match ends before this
    byte, so a new phrase begins with it.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        used = sorted({b for text in samples.values() for b in text})
        self.width = len(used) + 1  # the last class stands for bytes that no sample has
        self.classes = np.full(256, len(used), np.uint8)
        self.classes[used] = np.arange(len(used), dtype=np.uint8)
        self.starts, self.bits, tables, base = [], [], [], 0
        for language in self.languages:
            text = samples[language]
            moves, states = suffix_automaton(bytes(self.classes[np.frombuffer(text, np.uint8)]))
            first = np.full(self.width, base * self.width, np.int64)
            for c, to in moves[0].items():
                first[c] = (base + to) * self.width
            table = np.tile(~first, (states, 1))
            for state, out in enumerate(moves):
                if out:
                    table[state, list(out)] = (np.fromiter(out.values(), np.int64, len(out)) + base) * self.width
            table[0] = ~first  # the first byte always opens a phrase
            tables.append(table.astype(np.int32))
            self.starts.append(base * self.width)
            self.bits.append(math.log2(max(2, len(text))))
            base += states
        self.steps = np.concatenate(tables).reshape(-1) if tables else np.zeros(0, np.int32)

    def phrases(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases per language and document. Texts are parsed in blocks of BLOCK bytes, a phrase ends with its block; all blocks advance together."""
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = offsets[owner] + place * BLOCK
        length = np.minimum(BLOCK, offsets[owner + 1] - begin)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        read = np.append(self.classes[flat], np.zeros(BLOCK, np.uint8))
        count = np.zeros((len(self.languages), len(owner)), np.int32)
        state = np.repeat(np.array(self.starts, np.int32)[:, None], len(owner), axis=1)
        active = np.searchsorted(-length, -np.arange(int(length.max()) if len(length) else 0))
        for i, n in enumerate(active.tolist()):
            step = self.steps[state[:, :n] + read[begin[:n] + i]]
            fresh = step >> 31
            count[:, :n] -= fresh
            state[:, :n] = step ^ fresh
        total = np.zeros((len(self.languages), len(sizes)), np.int64)
        for k in range(len(self.languages)):
            total[k] = np.bincount(owner, count[k], len(sizes))
        return total

    def decide(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Best language, score and phrases per document. The cost of a phrase is the logarithm of the sample's size: a place to copy from."""
        found = self.phrases(flat, offsets)
        cost = found * np.array(self.bits)[:, None]
        best = np.argmin(cost, axis=0)
        ranked = np.sort(cost, axis=0)
        if len(self.languages) > 1:
            score = np.where(ranked[1] > 0, 1 - ranked[0] / np.maximum(ranked[1], 1e-9), 0.0)
        else:
            score = np.ones(len(best))
        return [self.languages[b] for b in best], score, found[best, np.arange(len(best))]

    def answer(self, lower: pa.Array, lettered: pa.Array) -> list[pa.Array]:
        """Language, score, phrases and number of parsed bytes of lower-case texts; those without a letter are undecided."""
        flat, offsets = normal(*bytes_of(lower))
        asked = np.array(lettered.to_pylist(), bool)
        if self.languages:
            names, score, phrases = self.decide(flat, offsets)
        else:
            names, score, phrases = [UNDECIDED] * len(asked), np.zeros(len(asked)), np.zeros(len(asked), np.int64)
        names = pa.array([n if ok else UNDECIDED for n, ok in zip(names, asked)], pa.string())
        return [names, pa.array(np.where(asked, score, 0.0)), pa.array(phrases, pa.int64()), pa.array(np.diff(offsets))]


def held_out():
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3) == 1


def labelled_samples(docs: DataFrame, per_language: int, total: int) -> dict[str, bytes]:
    """At most ``per_language`` bytes of normalised text per language (``total`` over all), from documents that are not held out.

    Whole documents are taken in the order of a hash of their id, at most one per 512 bytes asked for; the ids are chosen without reading texts.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    languages = max(1, known.select("lang").distinct().count())
    each = max(1024, min(per_language, total // languages))
    chosen = known.select("lang", "doc_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(8, each // 512))
    ids = [row["doc_id"] for row in chosen.select("doc_id").distinct().collect()]
    texts = known.filter(F.col("doc_id").isin(ids)).select("lang", "doc_id", F.lower(F.substring("text", 1, each)).cast("binary").alias("text"))
    samples: dict[str, bytes] = {}
    for row in sorted(texts.collect(), key=lambda r: (r["lang"], r["doc_id"], bytes(r["text"]))):
        flat, _ = normal(np.frombuffer(bytes(row["text"]), np.uint8), np.array([0, len(row["text"])]))
        samples[row["lang"]] = (samples.get(row["lang"], b"") + flat.tobytes() + b" ")[:each]
    return {k: v for k, v in samples.items() if v.strip()}


def fit(docs: DataFrame, per_language: int = 24_000, total: int = 400_000) -> Model:
    """Automata of a bounded sample of labelled text: ``per_language`` bytes for each language, ``total`` over all of them."""
    return Model(labelled_samples(docs, per_language, total))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The language of every whole text, one row per row of ``docs`` (doc_id, text); lang, source and other columns are not read.

    NULL texts, and texts without a letter, are ``und`` with score 0; so is every text if the model knows no language. Equal costs go to the smaller
    name. A map over the rows; the model is broadcast, its size is bounded by ``fit``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            names, score, phrases, size = shared.value.answer(batch.column(2), batch.column(3))
            columns = [batch.column(0), batch.column(1), names, score, phrases, size]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), held_out(), *_asked()).mapInArrow(run, RESULT)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is found, with it in the column ``lang``; texts that are ``und`` go. Other columns are as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn("lang", F.lit("").cast("string")).schema
    at, width = docs.columns.index("lang"), len(docs.columns)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            columns = batch.columns[:width]
            columns[at] = shared.value.answer(batch.column(width), batch.column(width + 1))[0]
            known = pc.not_equal(columns[at], UNDECIDED)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width]).filter(known)

    return docs.select("*", *_asked()).mapInArrow(run, schema)


def _asked() -> list:
    """What a prediction reads: the lower-case text, and whether it has a letter."""
    return [F.lower("text").cast("binary").alias("__lower"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__lettered")]
