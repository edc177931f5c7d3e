"""Words, word windows and their 64-bit hashes for many texts at once, in numpy.

A word is a longest run of bytes outside space and tab to carriage return, which are
the same bytes in UTF-8 and in ASCII. Hashes are fixed functions of the bytes, so every
task of a cluster and every run gives the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd

BATCH_BYTES = 1 << 20
"""Texts are worked on in runs of about so many bytes; one long text may exceed it."""

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
LONG_RANGE = 256
"""Ranges of more bytes are hashed one by one."""
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x; no two x give the same."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = n + n // 4
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = pow(_BASE, -1, 1 << 64)
        _inverses = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n], _inverses[:n]


def blocks_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of a buffer as a number; zeros follow its end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of a buffer.

    Eight bytes at a time are mixed into what the bytes before gave, so no structure of the
    bytes can cancel out; the rare long ranges go through a cryptographic hash.
    """
    lengths = ends - starts
    blocks = blocks_of(data)
    found = mix(lengths.astype(np.uint64) + np.uint64(_BASE))
    todo = np.flatnonzero((lengths > 0) & (lengths <= LONG_RANGE))
    done = 0
    while len(todo):
        block = blocks[starts[todo] + done] & _HEAD[np.minimum(lengths[todo] - done, 8)]
        found[todo] = mix(found[todo] ^ block)
        done += 8
        todo = todo[lengths[todo] > done]
    view = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(lengths > LONG_RANGE).tolist():
        digest = blake2b(view[starts[i] : ends[i]], digest_size=8).digest()
        found[i] = int.from_bytes(digest, "little")
    return found


def same_ranges(
    a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray
) -> np.ndarray:
    """Whether ranges of equal length in two buffers hold the same bytes."""
    found = np.ones(len(lengths), bool)
    x, y = blocks_of(a), blocks_of(b)
    todo = np.flatnonzero((lengths > 0) & (lengths <= LONG_RANGE))
    done = 0
    while len(todo):
        differ = (x[a_starts[todo] + done] ^ y[b_starts[todo] + done]) & _HEAD[
            np.minimum(lengths[todo] - done, 8)
        ]
        found[todo[differ != 0]] = False
        done += 8
        todo = todo[lengths[todo] > done]
    for i in np.flatnonzero(lengths > LONG_RANGE).tolist():
        n = lengths[i]
        found[i] = np.array_equal(a[a_starts[i] : a_starts[i] + n], b[b_starts[i] : b_starts[i] + n])
    return found


class RangeHash:
    """Hashes of short byte ranges that overlap, each in a few array steps.

    The sum of (byte + 1) * base**place over a range, moved to place 0, modulo 2**64. Texts
    built for it can make ranges of about a thousand bytes collide, so ranges are a few
    hundred bytes at most; others go through `range_hashes`.
    """

    def __init__(self, data: np.ndarray):
        powers, self._inverses = _powers_to(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inside = (self._sums[ends] - self._sums[starts]) * self._inverses[starts]
        return mix(inside ^ (ends - starts).astype(np.uint64))


class Words(NamedTuple):
    """Words of a run of texts, in order. `first[i]:first[i + 1]` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text_starts: np.ndarray
    """Where each text starts in `data`; one byte of white space stands between texts."""


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each followed by a line feed; where each starts, and the end."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8), starts


def find_words(texts: Sequence[bytes], lower: bool = False) -> Words:
    data, text_starts = joined(texts)
    if lower:
        data = LOWER[data]
    space = IS_SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edges = np.concatenate([[0], edges])
    # the buffer ends in white space, so every word has an end
    starts, ends = edges[0::2], edges[1::2]
    return Words(data, starts, ends, np.searchsorted(starts, text_starts), text_starts)


def word_hashes(words: Words) -> np.ndarray:
    return range_hashes(words.data, words.starts, words.ends)


def range_ids(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For every number given the first range that has it, and the number of each range:
    the same for ranges of the same bytes and for no others."""
    hashes = range_hashes(data, starts, ends)
    _, example, ids = np.unique(hashes, return_index=True, return_inverse=True)
    lengths, model = ends - starts, example[ids]
    same = lengths == lengths[model]
    same &= same_ranges(data, starts, data, starts[model], np.minimum(lengths, lengths[model]))
    if not same.all():
        # different ranges with one hash are told apart by their bytes
        whole, known, more = data.tobytes(), {}, []
        for i in np.flatnonzero(~same).tolist():
            piece = whole[starts[i] : ends[i]]
            if piece not in known:
                known[piece] = len(example) + len(more)
                more.append(i)
            ids[i] = known[piece]
        example = np.append(example, np.array(more, example.dtype))
    return example, ids


def word_ids(words: Words) -> np.ndarray:
    """A number for each word, the same for words of the same bytes and for no others."""
    return range_ids(words.data, words.starts, words.ends)[1]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` neighbouring entries, from every place; order counts."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        step = pow(_BASE, 2 * i + 1, 1 << 64)
        total += mix(hashes[i : i + n] ^ np.uint64(step))  * np.uint64(step | 1)
    return mix(total)


def windows_of(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of, and text of, every window of `width` words that lies within one text."""
    found = window_hashes(hashes, width)
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = owner[: len(found)] == owner[width - 1 :]
    return found[inside], owner[: len(found)][inside]


def runs(lengths: Sequence[int], most: int = BATCH_BYTES) -> Iterator[slice]:
    """Slices that cut rows into runs of about `most` bytes each."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def encoded(texts: pd.Series) -> list[bytes]:
    """UTF-8 of each text; a null is an empty text."""
    return [t.encode() if isinstance(t, str) else b"" for t in texts]
