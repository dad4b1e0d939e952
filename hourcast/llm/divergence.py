"""Source divergence audit: how the words of each source differ from the other sources of its language, and from the language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourcast.llm.common import saved

LEAST_DOCUMENTS = 10
RANKS = 10
UNITS = 1_000_000_000
ROWS_PER_BUCKET = 100_000
HELD = 200_000
CELLS = 1 << 18
WORD = re.compile(rb"[a-z\x80-\xff]+")
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it), summed inside tasks first. NULLs are ''."""

    def rows_of(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, texts) in held.items():
            terms = list(times)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array([t.decode() for t in terms], pa.string()), pa.array(times.values(), pa.int64()), pa.array([texts[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in rows:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for name, text in zip(names, batch.column(2)):
                words = WORD.findall(text.as_py().translate(LOWER))
                times, texts = held.setdefault(name, (Counter(), Counter()))
                times.update(words)
                texts.update(set(words))
            if sum(len(times) for times, _ in held.values()) > HELD:
                yield from rows_of(held)
                held = {}
        yield from rows_of(held)

    found = named(docs, F.coalesce(F.col("text"), F.lit("")).cast("binary")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def named(docs: DataFrame, *more) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], *more)


def shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact also where the product leaves a long."""
    if int(np.max(count, initial=0)) > 9_000_000_000:
        count = np.asarray(count).astype(object)
    return np.asarray(1 + UNITS * (count + 2) // (total + 2 * terms), np.int64)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)  # shares are at most 10^9 + 1: squares fit a long


def skyband(high: np.ndarray, low: np.ndarray, early: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that fewer than ``k`` others dominate: ``high`` at least as high, ``low`` at least as low, ``early`` earlier.

    In the order (high falling, low, early) every dominator stands before its row; and a row with ``k`` dominators has ``k`` among the rows kept, so only those are compared.
    """
    order = np.lexsort((early, low, -high))
    high, low, early = high[order], low[order], early[order]
    first = np.ones(len(order), bool)
    first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    begin = np.flatnonzero(first)
    fit = np.flatnonzero(np.arange(len(order)) - begin[np.cumsum(first) - 1] < k)  # of equal pairs the first k
    kept = np.zeros(0, np.int64)
    for at in range(0, len(fit), 256):
        part = fit[at : at + 256]
        beaten = ((low[kept][:, None] <= low[part]) & (early[kept][:, None] < early[part])).sum(axis=0)  # high is in order
        part, beaten = part[beaten < k], beaten[beaten < k]
        inside = (low[part][:, None] <= low[part]) & (early[part][:, None] < early[part]) & (np.arange(len(part))[:, None] < np.arange(len(part)))
        chosen = np.zeros(len(part), bool)
        for i in range(len(part)):
            chosen[i] = beaten[i] + (inside[:, i] & chosen).sum() < k
        kept = np.concatenate([kept, part[chosen]])
    return order[kept]


def earliness(terms: list[str]) -> np.ndarray:
    """Places of the terms in the order of their UTF-8 bytes (which is that of code points)."""
    place = {t: i for i, t in enumerate(sorted(set(terms)))}
    return np.array([place[t] for t in terms], np.int64)


PART = "lang string, source string, item string, value long, n long, whole long, slot int"


def _bucket(k: int):
    """Both parts of the work on one bucket of terms of one language: sums of gaps for all pairs of sources, and the skyband of every source."""

    def run(key, rows: pa.Table, stats: pa.Table) -> pa.Table:
        lang, bucket = key[0].as_py(), key[1].as_py()
        names = stats["source"].to_pylist()
        total = np.array(stats["total"].to_pylist(), np.int64)
        terms, whole_total, slots = (stats[c][0].as_py() for c in ("terms", "whole_total", "slots"))
        place = {s: i for i, s in enumerate(names)}
        source = np.array([place[s] for s in rows["source"].to_pylist()], np.int64)
        words = rows["term"].to_pylist()
        early = earliness(words)
        n, whole = (rows[c].to_numpy().astype(np.int64) for c in ("n", "whole"))
        out: list[pa.Table] = []

        def add(who: list[str], items: list[str], value: np.ndarray, own: np.ndarray | None = None, all_: np.ndarray | None = None) -> None:
            count = len(items)
            none = pa.nulls(count, pa.int64())
            columns = [pa.array([lang] * count, pa.string()), pa.array(who, pa.string()), pa.array(items, pa.string()), pa.array(value, pa.int64()), none if own is None else pa.array(own), none if all_ is None else pa.array(all_), pa.array([bucket % slots] * count, pa.int32())]
            out.append(pa.Table.from_arrays(columns, names=[c.split()[0] for c in PART.split(", ")]))

        # terms that stand higher in the source than in the language
        for s in np.unique(source).tolist():
            at = np.flatnonzero(source == s)
            p, q = shares(n[at], int(total[s]), terms), shares(whole[at], whole_total, terms)
            at, p, q = at[p > q], p[p > q], q[p > q]
            best = skyband(n[at], whole[at], early[at], k)
            if len(best):
                add([names[s]] * len(best), [words[i] for i in at[best]], gaps(p[best], q[best]), n[at[best]], whole[at[best]])
        # all sources against each other: a few terms at a time, all sources' shares of them as one matrix
        sums = np.zeros((len(names), len(names)), np.int64)
        if terms:
            count = int(early.max(initial=-1)) + 1
            order = np.argsort(early, kind="stable")
            width = max(1, CELLS // len(names))
            rest = shares(np.zeros(len(names), np.int64), total, terms)
            for start in range(0, count, width):
                wide = min(width, count - start)
                at = order[np.searchsorted(early[order], start) : np.searchsorted(early[order], start + wide)]
                p = np.repeat(rest[:, None], wide, axis=1)
                p[source[at], early[at] - start] = shares(n[at], total[source[at]], terms)
                for s in range(len(names)):
                    sums[s, s + 1 :] += gaps(p[s], p[s + 1 :]).sum(axis=1)
            sums += sums.T
        for s in range(len(names)):
            other = [i for i in range(len(names)) if i != s]
            if other:
                add([names[s]] * len(other), [names[i] for i in other], sums[s, other])
        if not out:
            add([], [], np.zeros(0, np.int64))
        return pa.concat_tables(out)

    return run


def _merge(k: int):
    """Skybands of several buckets of one source as one."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        best = skyband(rows["n"].to_numpy(), rows["whole"].to_numpy(), earliness(rows["item"].to_pylist()), k)
        return rows.take(pa.array(np.sort(best)))

    return run


def audit_sources(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Divergence of every (lang, source) group: lang, source, part, item, value, rank.

    NULL text, lang and source are ''. Terms are runs of letters A-Z, a-z and characters beyond ASCII, A-Z lower-cased. A language keeps the terms that at
    least ``least_documents`` of its rows hold. A group and a language give a kept term the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares
    are floor((p - q)^2 / (p + q)) apart. Part ``pair``: the sum over all kept terms, for each other source of the language. Part ``term``: the ``ranks``
    terms that stand out most in the group against its language (count > 0 and p > q). Ranks fall by value; ties go to the item that is earlier in UTF-8.

    The value of a term rises with its count in the group and falls with its count in the language, so of terms that ``ranks`` others dominate in both
    (and in the order of ties) none is needed: buckets of terms keep their skybands, skybands of buckets are merged, the rest is ranked exactly.

    Every row of the input is a document, also a repeated one. A group without terms has pairs, and no row if it is alone in its language; an empty table has no row.
    A language is cut into buckets of terms by hash, so one language or source with most of the rows is spread over tasks; a task holds one bucket and the sources of its language.
    """
    counts = saved(term_counts(docs), "term-counts")
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_documents).drop("docs")
    kept = saved(counts.select("lang", "source", "term", "n").join(whole, ["lang", "term"]), "kept-terms")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    kept_terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    groups = named(docs).distinct().join(own, ["lang", "source"], "left").na.fill(0, ["total", "cells"])
    langs = groups.groupBy("lang").agg(F.sum("total").alias("whole_total"), F.greatest(F.lit(1), F.ceil(F.sum("cells") / rows_per_bucket)).cast("int").alias("buckets"))
    langs = langs.join(kept_terms, "lang", "left").na.fill(0, ["terms"]).withColumn("slots", F.ceil(F.sqrt("buckets")).cast("int"))
    stats = saved(groups.drop("cells").join(langs, "lang"), "group-stats")
    cut = stats.select("lang", "buckets").distinct()
    left = kept.join(cut, "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")).drop("buckets")
    right = stats.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).drop("buckets")
    parts = saved(left.groupBy("lang", "bucket").cogroup(right.groupBy("lang", "bucket")).applyInArrow(_bucket(ranks), PART), "divergence")
    pairs = parts.filter("n IS NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = parts.filter("n IS NOT NULL").groupBy("lang", "source", "slot").applyInArrow(_merge(ranks), PART).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value"]
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.select(columns).unionByName(terms.select(columns)).withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= ranks))


SQL = """WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
  w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
  l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
  c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
  g AS (SELECT lang, source, coalesce(max(t), 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
    LEFT JOIN (SELECT lang, source, sum(n) AS t FROM c GROUP BY 1, 2) USING (lang, source) GROUP BY 1, 2),
  p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
      1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.total + 2 * l.v) AS p,
      1 + (1000000000 * (k.n + 2)::HUGEINT) // (l.total + 2 * l.v) AS q
    FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 4
    UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      WHERE a.lang NOT IN (SELECT lang FROM l)
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM r WHERE part = 'pair' OR k <= 10"""
