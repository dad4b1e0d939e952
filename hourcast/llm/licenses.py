"""License scans: an Aho-Corasick automaton finds notices and identifier tags, a shunting-yard parser evaluates the expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import bytes_of

# The base phrases and their labels, as the contract states them.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Further notice phrases (words in lower case) and the labels they stand for.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution share alike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "cc0 1 0": "cc0",
    "all rights reserved": "all-rights-reserved",
}

# How freely text under a label may be used for training, from 0 to 1. Unknown identifiers count as UNKNOWN.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "cc0": 1.0, "cc-by": 0.9, "mpl-2": 0.7, "lgpl": 0.6, "cc-by-sa": 0.5,
    "gpl-2": 0.4, "gpl-3": 0.4, "agpl-3": 0.3, "cc-by-nc": 0.1, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.5
NO_NOTICE = 0.5

# SPDX identifiers (lower case, without -only, -or-later, + and a trailing .0) by label.
IDENTIFIERS = {
    "mit": "mit", "apache-2": "apache-2", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "0bsd": "bsd", "cc0-1": "cc0",
    "cc-by-4": "cc-by", "cc-by-sa-4": "cc-by-sa", "cc-by-nc-4": "cc-by-nc", "mpl-2": "mpl-2", "lgpl-2.1": "lgpl", "lgpl-3": "lgpl",
    "gpl-2": "gpl-2", "gpl-3": "gpl-3", "agpl-3": "agpl-3",
}

TAG = "spdx license identifier"
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"
)

_SEPARATE = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_TAG_TEXT = re.compile(rb"spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier[^0-9a-z\x80-\xff\n(]*", re.IGNORECASE)
_PIECE = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", (phrase, len(phrase) + 2))
    found.make_automaton()
    return found


def identifier_label(name: str) -> str:
    """The label of an SPDX identifier, or the identifier itself if it is not known."""
    plain = name.lower().rstrip("+").removesuffix("-only").removesuffix("-or-later").removesuffix(".0")
    return IDENTIFIERS.get(plain, plain)


def postfix(text: str) -> list[str]:
    """A licence expression at the start of a text in postfix order, by shunting-yard: or < and < with, operators bind to the left.

    Reading stops where the expression does: before a name that follows a name, before an unmatched bracket, at the end of the line. An operator
    without a right side, and brackets that stay open, are dropped.
    """
    out: list[str] = []
    waiting: list[str] = []
    want_name = True
    for match in _PIECE.finditer(text.split("\n", 1)[0]):
        piece = match[0].rstrip(".-") or match[0]
        word = piece.lower()
        if want_name:
            if piece == "(":
                waiting.append("(")
            elif piece == ")" or word in _BINDS:
                break
            else:
                out.append(piece)
                want_name = False
        elif piece == ")":
            if "(" not in waiting:
                break
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif word in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                out.append(waiting.pop())
            waiting.append(word)
            want_name = True
        else:
            break
    if want_name and waiting and waiting[-1] != "(":
        waiting.pop()
    while want_name and waiting and waiting[-1] == "(":  # a bracket opened with nothing behind it, and the operator before it
        waiting.pop()
        if waiting and waiting[-1] != "(":
            waiting.pop()
    return out + [x for x in reversed(waiting) if x != "("]


def evaluate(order: list[str]) -> tuple[set[str], float]:
    """Labels and freedom of a postfix expression: and is the less free side, or the freer one, an exception frees half of the rest."""
    stack: list[tuple[set[str], float]] = []
    for piece in order:
        if piece in _BINDS:
            (right, more), (left, free) = stack.pop(), stack.pop()
            if piece == "with":
                stack.append((left, free + (1 - free) / 2))
            else:
                stack.append((left | right, min(free, more) if piece == "and" else max(free, more)))
        else:
            label = identifier_label(piece)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
    return stack[0] if stack else (set(), NO_NOTICE)


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and expressions of one text."""
    words = text.translate(_SEPARATE).split()
    line = b" " + b" ".join(words) + b" "
    plain = line.decode("latin-1")
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    free: list[float] = []
    tagged = False
    at = word = 0
    for end, (phrase, size) in sorted(automaton().iter(plain), key=lambda hit: hit[0] - hit[1][1]):
        begin = end - size + 1
        word, at = word + line.count(b" ", at, begin), begin
        if phrase in BASE:
            starts.append(word)
            base.add(BASE[phrase])
        if phrase == TAG:
            tagged = True
        else:
            label = BASE.get(phrase) or NOTICES[phrase]
            labels.add(label)
            free.append(FREEDOM[label])
    written = []
    for match in _TAG_TEXT.finditer(text) if tagged else ():
        order = postfix(text[match.end() : text.find(b"\n", match.end()) % (len(text) + 1)].decode("utf-8", "replace"))
        named, value = evaluate(order)
        if named:
            labels |= named
            free.append(value)
            written.append(" ".join(order))
    score = min(free, default=NO_NOTICE)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, written


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence notices and tags of every whole text, one row per row of ``docs`` (doc_id, text); other columns are not read.

    NULL text is empty; an empty text has no words, empty labels, NULL first and last word and the score of a text without notice. The score is the
    freedom of the least free notice or expression. A map over the rows: nothing is shuffled.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            flat, offsets = bytes_of(batch.column(1))
            whole = flat.tobytes()
            found = [scan(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
            columns = [pa.array(list(x), kind) for x, kind in zip(zip(*found), kinds)] if found else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, RESULT)
