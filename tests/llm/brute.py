"""Plain versions of the operators, on lists."""

from __future__ import annotations

import re
import zlib

import numpy as np


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def groups(nodes, links) -> dict:
    """Smallest node reachable from each node."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def fold(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text: str | None, size: int = 4) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def jaccard_rows(docs, size: int = 4, percent: int = 85) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [shingle_set(t, size) for _, t in docs]
    links = []
    holders: dict = {}
    for i, s in enumerate(sets):
        seen = {j for x in s for j in holders.get(x, ())}
        for j in seen:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                links.append((j, i))
        for x in s:
            holders.setdefault(x, []).append(i)
    where = groups(range(len(docs)), links)
    least: dict = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[where[i]] = min(least.get(where[i], doc_id), doc_id)
    return [(d, len(sets[i]), least.get(where[i])) for i, (d, _) in enumerate(docs)]


def license_base(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels)."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    hits = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def deduped(docs, guarantee: int) -> list[str | None]:
    """Texts of (doc_id, text) rows in the order of the ids after line dedup; ids are different."""
    lines = [None if t is None else t.split("\n") for _, t in docs]
    words = [[] if x is None else [len(re.findall(r"[^ \t\n\x0b\x0c\r]+", line)) for line in x] for x in lines]
    first: dict = {}
    gone = [set() for _ in docs]
    for d, own in enumerate(lines):
        for a in range(len(own or ())):
            if not words[d][a]:
                continue
            b, total = a, words[d][a]
            while total < guarantee and b + 1 < len(own):
                b += 1
                total += words[d][b]
            if total < guarantee:
                continue
            source = first.setdefault(tuple(own[a : b + 1]), (d, a))
            if source == (d, a):
                continue
            other, there = lines[source[0]], source[1]
            i = 0
            while a + i < len(own) and there + i < len(other) and own[a + i] == other[there + i]:
                gone[d].add(a + i)
                i += 1
            i = 1
            while a - i >= 0 and there - i >= 0 and own[a - i] == other[there - i]:
                gone[d].add(a - i)
                i += 1
    return [None if x is None else "\n".join(line for i, line in enumerate(x) if i not in gone[d]) for d, x in enumerate(lines)]


def top_products(rows, queries, k: int = 20) -> dict:
    """Nearest by inner product: query id to [(vec_id, score)], rows (vec_id, vector)."""
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], float)
    out = {}
    for i, v in queries:
        scores = (matrix * np.array(v, float)).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(scores[j])) for j in order]
    return out
