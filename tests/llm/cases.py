"""Small tables with the awkward cases: NULLs, empty and very long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, uid long, n_lines string, component_id string, `rank` long, token long"
WORDS = {
    "en": "the of and house river walks under morning light with other people while some stay near their old garden".split(),
    "de": "der die und haus fluss geht unter morgen licht mit andere leute während einige bleiben nahe ihrem alten garten".split(),
    "fr": "le la et maison rivière marche sous matin lumière avec autres gens pendant certains restent près leur vieux jardin".split(),
}


def text(rng: random.Random, lang: str, words: int, line: int = 12) -> str:
    out = [rng.choice(WORDS[lang]) + rng.choice(["", "", "", ",", ".", "s", "e"]) for _ in range(words)]
    return "\n".join(" ".join(out[i : i + line]) for i in range(0, len(out), line))


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out: list[tuple] = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, text(rng, lang, rng.randint(1, 90)), lang if rng.random() < 0.9 else None, rng.choice(["a", "b", "b", "b", None])))
    base = out[7][1]
    out += [(100 + i, base, "en", "a") for i in range(5)]  # exact copies
    long = text(rng, "en", 150)
    for i in range(6):  # near copies
        words = long.split(" ")
        words[20 * i] = "changed"
        out.append((110 + i, " ".join(words), "en", "b"))
    out.append((120, None, "en", "a"))
    out.append((121, "", None, None))
    out.append((122, " \n\t ", "de", "b"))
    out.append((123, "12 34 -- !!", "de", "b"))
    out.append((124, "one", "en", "b"))
    out.append((125, text(rng, "en", 30_000), "en", "b"))  # very long
    out.append((126, "x" * 70_000, "fr", "b"))
    out.append((127, "Under the MIT License\nSPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Foo-1\nCC BY-NC", "en", "c"))
    out.append((None, text(rng, "fr", 25), "fr", "c"))
    return out


def frame(spark, data: list[tuple] | None = None):
    """Documents with five more columns whose names operators use inside."""
    data = rows() if data is None else data
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None, -1, -2, "x", "y", -3, -4) for i, t, lang, s in data], SCHEMA)


def with_repeats() -> list[tuple]:
    """The rows, some of them twice, and one id with two texts."""
    data = rows()
    return data + data[5:12] + [(3, "another text under one id with some words of its own", "en", "a")]
