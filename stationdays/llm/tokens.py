"""Token ids of whole texts, by public tokenizers; a helper of packing and token files.

The vocabularies split a text at white space before they merge anything, so a text's ids
are those of its pieces in a row: its words, with the white space before each where the
vocabulary keeps white space. There a run of white space is never cut, also where ASCII and
other white space meet in it. Most pieces come again and again. Every Python worker keeps
the ids and the bytes of pieces it has seen and encodes only new ones; texts are put
together in numpy. Tests hold this against the library's ids of whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from stationdays.llm.words import LOWER, find_words, range_hashes, range_ids, runs, same_ranges

MOST_KNOWN = 2_000_000
"""Pieces a worker remembers before it starts afresh; about 70 bytes each."""

_encoders: dict[str, PieceEncoder] = {}


def after_wide_space(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character before each end may be white space that isn't ASCII.

    What only some engines take for white space counts too: not cutting is always right.
    """
    one, two, three = (data[np.maximum(ends - i, 0)] for i in (1, 2, 3))
    # control characters 1C to 1F; U+0085 and U+00A0
    found = (one >= 0x1C) & (one <= 0x1F) | (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    # U+1680, U+180E, U+205F, U+3000 and U+FEFF
    for a, b, c in ((0xE1, 0x9A, 0x80), (0xE1, 0xA0, 0x8E), (0xE2, 0x81, 0x9F), (0xE3, 0x80, 0x80),
                    (0xEF, 0xBB, 0xBF)):
        found |= (three == a) & (two == b) & (one == c)
    # U+2000 to U+200F, U+2028 to U+202F
    wide = (one >= 0x80) & (one <= 0x8F) | (one >= 0xA8) & (one <= 0xAF)
    return found | (three == 0xE2) & (two == 0x80) & wide


def fold_ascii_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Lower case in words of ASCII alone; others are composed before case is folded."""
    folded = LOWER[data]
    other = np.unique(np.searchsorted(starts, np.flatnonzero(data >= 128), side="right") - 1)
    if len(other):
        step = np.zeros(len(data) + 1, np.int8)
        step[starts[other]] += 1
        step[ends[other]] -= 1
        as_written = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        folded[as_written] = data[as_written]
    return folded


class PieceEncoder:
    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._keeps_space = self._whole(" a") != self._whole("a")
        self._folds_case = self._whole("A") == self._whole("a")
        self._forget()

    def _whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.uint64)
        self._starts = np.zeros(0, np.int64)
        self._lengths = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)
        self._bytes = np.zeros(0, np.uint8)
        self._byte_starts = np.zeros(0, np.int64)
        self._byte_lengths = np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new pieces start, and how many they are."""
        found: list[list[int]] = []
        for i in range(0, len(pieces), 4096):
            some = [p.decode() for p in pieces[i : i + 4096]]
            batch = self._tokenizer.encode_batch_fast(some, add_special_tokens=False)
            found += [e.ids for e in batch]
        lengths = np.array([len(x) for x in found], np.int64)
        starts = len(self._ids) + np.cumsum(lengths) - lengths
        self._ids = np.concatenate([self._ids, np.array([i for x in found for i in x], np.uint32)])
        sizes = np.array([len(p) for p in pieces], np.int64)
        places = len(self._bytes) + np.cumsum(sizes) - sizes
        self._bytes = np.concatenate([self._bytes, np.frombuffer(b"".join(pieces), np.uint8)])
        # of pieces with one hash the first to come is remembered
        fresh, first = np.unique(hashes, return_index=True)
        at = np.searchsorted(self._hashes, fresh)
        if len(self._hashes):
            new = self._hashes[np.minimum(at, len(self._hashes) - 1)] != fresh
            at, first = at[new], first[new]
        self._hashes = np.insert(self._hashes, at, hashes[first])
        self._starts = np.insert(self._starts, at, starts[first])
        self._lengths = np.insert(self._lengths, at, lengths[first])
        self._byte_starts = np.insert(self._byte_starts, at, places[first])
        self._byte_lengths = np.insert(self._byte_lengths, at, sizes[first])
        return starts, lengths

    def _known(
        self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Which pieces are remembered, byte for byte, and at what place."""
        if not len(self._hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
        lengths = ends - starts
        known = (self._hashes[at] == hashes) & (self._byte_lengths[at] == lengths)
        some = np.flatnonzero(known)
        known[some] = same_ranges(
            data, starts[some], self._bytes, self._byte_starts[at[some]], lengths[some]
        )
        return known, at

    def _pieces(self, texts: Sequence[bytes]) -> tuple[np.ndarray, ...]:
        """Buffer, starts and ends of pieces, and each text's first piece."""
        words = find_words(texts)
        data, starts, ends, first = words.data, words.starts, words.ends, words.first
        if self._keeps_space:
            counts = np.diff(first)
            text_ends = words.text_starts[1:] - 1
            before = np.empty_like(starts)
            before[1:] = ends[:-1]
            before[first[:-1][counts > 0]] = words.text_starts[:-1][counts > 0]
            # white space at the end of a text is a piece without a word
            last = words.text_starts[:-1].copy()
            last[counts > 0] = ends[first[1:][counts > 0] - 1]
            tail = last < text_ends
            at = first[1:][tail]
            starts, ends = np.insert(before, at, last[tail]), np.insert(ends, at, text_ends[tail])
            first = first + np.concatenate([[0], np.cumsum(tail)])
            # what follows white space of another kind belongs to the piece before
            more = np.zeros(len(starts), bool)
            more[1:] = after_wide_space(data, ends[:-1])
            more[first[:-1][np.diff(first) > 0]] = False
            begins = np.flatnonzero(~more)
            starts, ends = starts[begins], ends[np.append(begins, len(ends))[1:] - 1]
            first = np.searchsorted(begins, first)
        elif self._folds_case and b"<|" not in data.tobytes():
            # what looks like a special token must be seen as it is written
            data = fold_ascii_words(data, starts, ends)
        return data, starts, ends, first

    def __call__(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin, with the end."""
        data, starts, ends, first = self._pieces(texts)
        example, place = range_ids(data, starts, ends)
        starts, ends = starts[example], ends[example]
        hashes = range_hashes(data, starts, ends)
        if len(self._hashes) + len(hashes) > MOST_KNOWN:
            self._forget()
        known, at = self._known(data, starts, ends, hashes)
        begin, length = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        begin[known], length[known] = self._starts[at[known]], self._lengths[at[known]]
        if not known.all():
            whole = data.tobytes()
            new = zip(starts[~known].tolist(), ends[~known].tolist())
            begin[~known], length[~known] = self._learn(
                hashes[~known], [whole[a:b] for a, b in new]
            )
        begin, length = begin[place], length[place]
        to = np.concatenate([[0], np.cumsum(length)])
        ids = self._ids[np.repeat(begin - to[:-1], length) + np.arange(to[-1])]
        return ids, to[first]


def encoder(vocabulary: str) -> PieceEncoder:
    """One encoder for all tasks of a Python worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = PieceEncoder(vocabulary)
    return _encoders[vocabulary]


def forget_encoders() -> None:
    """Drops all that this worker remembers of pieces; the next task to ask starts afresh."""
    _encoders.clear()


def vocabulary_place(name: str) -> str:
    """Place of a public vocabulary on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as bytes; a null is an empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def encode_batch(
    batch: pa.RecordBatch, vocabulary: str, end: int, text: str = "text"
) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For runs of a batch's rows: which rows, their ids each with `end` after, starts."""
    encode = encoder(vocabulary_place(vocabulary))
    texts = utf8(batch.column(text))
    for rows in runs([len(t) for t in texts]):
        ids, starts = encode(texts[rows])
        ids = np.insert(ids, starts[1:], end)
        yield rows, ids, starts + np.arange(len(starts))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
