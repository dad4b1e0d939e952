"""Tokenising whole texts with a public vocabulary, by batches: each distinct piece of a batch is encoded once, known pieces never again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourcast.llm.common import bytes_of, span_hashes

# White space of other kinds than these four could join with its neighbours; texts that have any are encoded as they are.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_RARE_CONTROL = [11, 12, 28, 29, 30, 31]
_RARE_LEAD = np.zeros(256, bool)
_RARE_LEAD[[*_RARE_CONTROL, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)  # ASCII signs: neither letters, digits nor white space
_MARK[33:127] = True
_MARK[48:58] = False
_MARK &= ~_LETTER
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BEYOND = np.zeros(256, bool)  # bytes of rare white space, and of letters beyond Latin-1
_BEYOND[[11, 12, 28, 29, 30, 31, 0xC2]] = True
_BEYOND[0xC4:] = True
KEPT_PIECES = 200_000
KEPT_BY_WORKER = 1_000_000
STRETCH = 1 << 19


class Encoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids`` with special strings as plain text.

    A piece ends where one of four white-space bytes follows another byte, where an ASCII sign follows a letter, and where a letter follows a sign
    other than an apostrophe: no token of the vocabularies in use reaches over such a place, so the ids of a text are the ids of its pieces. Pieces
    are told apart by 64-bit hashes. The memory for known pieces is bounded: when not all new ones fit, those that occur once are encoded again.
    The latest known pieces have a list of their own, which joins the other at an eighth of its length: few pieces are moved for a batch.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kept = kept
        self.keeps_space = self.tokenizer.normalizer is None
        self.folds = self.whole("A") == self.whole("a")
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.width = np.array([len(x.removesuffix("</w>") if not self.keeps_space else x) for x in names])  # bytes of a token
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known = [none, none]  # of the older and the latest known pieces: hashes, sorted, where their ids begin, and how many they have
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0  # ids from here on are of the batch at hand

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pieces(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin and end. With a vocabulary that keeps white space, a piece has the space before it."""
        n = len(flat)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        space = _SPACE[flat]
        cut = np.zeros(n + 1, bool)
        if n:
            letter, mark = _LETTER[flat], _MARK[flat]
            cut[1:n] = (letter[:-1] & mark[1:]) | (letter[1:] & mark[:-1] & (flat[:-1] != 39))
        cut |= edge
        if self.keeps_space:
            begin = cut[:n]
            begin[1:] |= space[1:] & ~space[:-1]
            starts = np.flatnonzero(begin)
            return starts, np.append(starts[1:], n)[: len(starts)]
        begin, end = ~space, ~space
        begin[1:] &= space[:-1] | cut[1:n]
        end[:-1] &= space[1:] | cut[1:n]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    def _joined(self, words: list[bytes], sizes: np.ndarray, glue: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, encoded as one text and cut by the bytes that the tokens stand for."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([glue.join(words).decode()], add_special_tokens=False)[0].ids, np.int64)
        return ids, np.diff(np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes)) + 1, prepend=0)

    def _by_place(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same, cut by the places in the text that the library gives: for letters whose case folding may change their bytes."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        texts = [w.decode() for w in words]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.array([a for a, _ in found.offsets], np.int64)
        return np.array(found.ids, np.int64), np.diff(np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts])), prepend=0)

    def fresh(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and how many each has."""
        whole = flat.tobytes()
        words = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if self.keeps_space:  # a piece without space at its begin, or with nothing but space, could join with its neighbours
            alone = ~_SPACE[flat[starts]] | _SPACE[flat[ends - 1]]
            rest = [self.whole(words[i].decode()) for i in np.flatnonzero(alone).tolist()]
            others = np.array([x for ids in rest for x in ids], np.int64), np.array([len(ids) for ids in rest], np.int64)
        else:
            beyond = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(_BEYOND[flat], out=beyond[1:])
            alone = beyond[ends] > beyond[starts]
            others = self._by_place([words[i] for i in np.flatnonzero(alone).tolist()])
        row = np.flatnonzero(~alone)
        ids, sizes = self._joined([words[i] for i in row.tolist()], (ends - starts)[row], b"" if self.keeps_space else b" ")
        size = np.zeros(len(words), np.int64)
        size[row], size[alone] = sizes, others[1]
        out = np.zeros(int(size.sum()), np.uint32)
        from_row = np.repeat(~alone, size)
        out[from_row], out[~from_row] = ids, others[0]
        return out, size

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of every document of a batch of UTF-8 texts."""
        starts, ends = self.pieces(flat, offsets)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        names, first, which, times = np.unique(span_hashes(_FOLD[flat] if self.folds else flat, starts, ends), return_index=True, return_inverse=True, return_counts=True)
        known, at, size = np.zeros(len(names), bool), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for kept_names, kept_at, kept_size in self.known:
            place = np.searchsorted(kept_names, names)
            here = np.flatnonzero(place < len(kept_names))
            here = here[kept_names[place[here]] == names[here]]
            known[here], at[here], size[here] = True, kept_at[place[here]], kept_size[place[here]]
        new = np.flatnonzero(~known)
        if len(new):
            ids, sizes = self.fresh(flat, starts[first[new]], ends[first[new]])
            at[new], size[new] = self.used + np.cumsum(sizes) - sizes, sizes
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + len(ids), np.uint32)])
            self.ids[self.used : self.used + len(ids)] = ids
        sizes = size[which]
        before = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=before[1:])
        out = self.ids[np.repeat(at[which] - before[:-1], sizes) + np.arange(before[-1])]
        room = self.kept - sum(len(kept_names) for kept_names, *_ in self.known)
        fit = new if len(new) <= room else new[times[new] > 1]
        if 0 < len(fit) <= room:
            self._keep(names[fit], at[fit], size[fit])
        cuts = before[np.searchsorted(starts, offsets)]
        found = [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for i in np.unique(np.searchsorted(offsets, rare_spaces(flat), "right") - 1).tolist():
            found[i] = np.array(self.whole(flat[offsets[i] : offsets[i + 1]].tobytes().decode()), np.uint32)
        return found

    def _keep(self, names: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        before = np.cumsum(size) - size
        count = int(size.sum())
        self.ids[self.used : self.used + count] = self.ids[np.repeat(at - before, size) + np.arange(count)]
        old, late = self.known
        late = _merged(late, (names, self.used + before, size))
        self.used += count
        self.known = [old, late] if 8 * len(late[0]) < len(old[0]) else [_merged(old, late), tuple(x[:0] for x in late)]


def _merged(a: tuple, b: tuple) -> tuple:
    """Two lists of known pieces as one: both are sorted, and no piece is in both."""
    place = np.searchsorted(a[0], b[0])
    return tuple(np.insert(x, place, y) for x, y in zip(a, b))


def rare_spaces(flat: np.ndarray) -> np.ndarray:
    """Where white space begins that is none of space, tab, line feed and carriage return, in UTF-8."""
    at = np.flatnonzero(_RARE_LEAD[flat])
    if not len(at):
        return at
    more = np.append(flat, np.zeros(2, np.uint8))
    a, b, c = flat[at], more[at + 1], more[at + 2]
    found = (a < 0x80) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E))
    found |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8F) | (c >= 0xA8) & (c <= 0xAF)) | (b == 0x81) & (c >= 0x9F) & (c <= 0xAF))
    found |= (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
    return at[found]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, keep: bool = True) -> Encoder:
    """One encoder per Python worker and vocabulary, which knows more pieces the longer it works; with ``keep`` false a new one, which goes when the caller lets it go."""
    if not keep:
        return Encoder(path)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, KEPT_BY_WORKER)
    return _ENCODERS[path]


def id_kind(path: str) -> str:
    """Type of an id in intermediate tables."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def crc(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_batches(rows: Iterator[pa.RecordBatch], path: str, end_id: int, keep: bool = True) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches (doc_id, text as binary) with the ids of their texts, end id included; NULL text is empty and has the end id alone.

    Texts are encoded half a megabyte at a time: the arrays of a stretch are several times its size. Workers keep their encoder for
    later tasks, or with ``keep`` false free it with the task: known pieces are then encoded again, but nothing is held while they work on something else."""
    own = encoder(path, keep)
    for batch in rows:
        flat, offsets = bytes_of(batch.column(1))
        found: list[np.ndarray] = []
        while len(found) < batch.num_rows:
            first = len(found)
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STRETCH, "right")) - 1)
            ids = own.encode(flat[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            found += [np.append(x, np.uint32(end_id)) for x in ids]
        yield batch, found


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
