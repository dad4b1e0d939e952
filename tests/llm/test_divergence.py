"""Source divergence against a plain version, and the skyband against all comparisons."""

import random
import re
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest

from hourcast.llm import divergence
from hourcast.llm.common import settle


def plain(docs, least, ranks):
    """Rows of (text, lang, source)."""
    words = []
    for text, lang, source in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        words.append((lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found]))
    out = set()
    for lang in {x for x, _, _ in words}:
        held = Counter(t for x, _, w in words if x == lang for t in set(w))
        kept = [t for t, n in held.items() if n >= least]
        counts = defaultdict(Counter)
        for x, s, w in words:
            if x == lang:
                counts[s].update(t for t in w if t in held and held[t] >= least)
        whole = sum(counts.values(), Counter())

        def share(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        shares, all_ = {s: share(c) for s, c in counts.items()}, share(whole)
        for s, p in shares.items():
            pairs = [(sum(gap(p[t], q[t]) for t in kept), o) for o, q in shares.items() if o != s]
            terms = [(gap(p[t], all_[t]), t) for t in kept if counts[s][t] and p[t] > all_[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, item, value, i + 1))
    return out


def audited(spark, data, **settings):
    rows = divergence.audit_sources(cases.frame(settle(spark), data), **settings).collect()
    found = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("bucket", [7, 100_000])
def test_audit(spark, bucket):
    data = cases.with_repeats()
    data += [(500 + i, f"Été ÉTÉ über STRASSE straße z{i % 3} ẞ \U00020000", None, s) for i, s in enumerate(["a", None, "", "b", "b", "b", "a", "c"])]
    found = audited(spark, data, least_documents=3, rows_per_bucket=bucket)
    assert found == plain([(t, x, s) for _, t, x, s in data], 3, 10)


def test_no_kept_terms_and_single_groups(spark):
    data = [(1, "only here", "en", "a"), (2, None, "en", "b"), (3, "", "en", None), (4, "alone", "fr", "a"), (None, None, None, None)]
    assert audited(spark, data) == {("en", a, "pair", b, 0, i + 1) for a in ("a", "b", "") for i, b in enumerate(sorted({"a", "b", ""} - {a}))}
    assert audited(spark, []) == set()


def test_ranks_cut_ties_by_item(spark):
    """Thirty terms of one value: the first ten in UTF-8 stay."""
    names = [f"t{c}" for c in "abcdefghijklmnopqrstuvwxyzäöü\U00010400"]
    data = [(i, " ".join(random.Random(i).sample(names, len(names))), "en", "a") for i in range(3)] + [(9, "u v", "en", "b")] * 3
    found = audited(spark, data, least_documents=3, rows_per_bucket=4)
    assert sorted(x[3].encode() for x in found if x[1] == "a" and x[2] == "term") == sorted(n.encode() for n in names)[:10]
    assert found == plain([(t, x, s) for _, t, x, s in data], 3, 10)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_skyband(k):
    rng = np.random.default_rng(k)
    for size in (0, 1, 40, 900):
        high = rng.integers(1, 30, size)
        low = high + rng.integers(0, 40, size)
        early = rng.permutation(size)
        dominated = ((high[:, None] >= high) & (low[:, None] <= low) & (early[:, None] < early)).sum(axis=0)
        assert sorted(divergence.skyband(high, low, early, k).tolist()) == np.flatnonzero(dominated < k).tolist()


def test_shares_beyond_a_long():
    count, total = 40_000_000_000_000, 900_000_000_000_000
    assert divergence.shares(np.array([count, 0]), total, 1000).tolist() == [1 + 10**9 * (c + 2) // (total + 2000) for c in (count, 0)]
