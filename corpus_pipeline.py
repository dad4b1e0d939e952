"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing sources to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and returns documents with the same columns; the last
returns pieces of training sequences. ``run`` writes every result as Parquet to the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm import jaccard, langid, linededup, mixing, packing
from hourcast.llm.common import drop_made, made_so_far, saved, settle

# Large arrays of Python workers go back to the system as soon as they are free: workers outlive the stages of the pipeline.
WORKERS = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
_made: list[tuple[int, int]] = []


def stage(after: bool = True):
    """A stage with its settings. What the stage before it left in the shared folder goes first: its result is written (what ``docs`` still reads stays)."""

    def wrap(run):
        @wraps(run)
        def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            settle(spark)
            spark.sparkContext.environment.update(WORKERS)
            if after:
                for first, last in _made:
                    drop_made(spark, first, last, docs)
            _made.clear()
            first = made_so_far()
            out = run(spark, docs, sf_dir)
            _made.append((first, made_so_far()))
            return out

        return staged

    return wrap


@stage(after=False)
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found (learned from labelled documents of this input that are not held out), with it in ``lang``.

    NULL texts and texts without a letter go, all others stay.
    """
    return langid.keep_identified(docs, langid.fit(docs))


@stage()
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; those of which no word is left go. ``n_chars`` is counted anew."""
    out = linededup.dedup_lines(docs)
    out = out.filter((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)


@stage()
def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (85 % of 4-word shingles in common, by chains of links)."""
    return jaccard.one_of_each_group(docs)


@stage()
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed_documents(docs)


@stage()
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_encoder=False)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

# SQL cannot express tokenisation, cross-parsing or packing; tests/llm holds run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
