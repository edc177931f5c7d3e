"""Counts over the bytes, words and lines of many texts at once, in numpy.

Each measure is an array with one number per text. A null text has no words and one
empty line.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np

from stationdays.llm.words import (
    Words,
    find_words,
    mix,
    range_hashes,
    window_hashes,
    word_hashes,
)

SPACE, UPPER, LOWER, DIGIT, SYMBOL, BANG, PUNCTUATION, MANY, INNER = range(9)
"""Classes of bytes; MANY starts a character of several bytes, INNER goes on with one."""

SYMBOLS = b"#*$%&|<>"
BYTE_CLASS = np.full(256, PUNCTUATION, np.uint8)
BYTE_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
BYTE_CLASS[65:91] = UPPER
BYTE_CLASS[97:123] = LOWER
BYTE_CLASS[48:58] = DIGIT
BYTE_CLASS[list(SYMBOLS)] = SYMBOL
BYTE_CLASS[33] = BANG
BYTE_CLASS[128:192] = INNER
BYTE_CLASS[192:] = MANY
LETTERS = (UPPER, LOWER, MANY)


class Texts:
    """A run of texts; what several measures need is worked out once, when first asked for."""

    def __init__(self, texts: Sequence[bytes]):
        self.texts = texts

    def __len__(self) -> int:
        return len(self.texts)

    def some(self, which: np.ndarray) -> Texts:
        return Texts([self.texts[i] for i in np.flatnonzero(which)])

    @cached_property
    def words(self) -> Words:
        return find_words(self.texts)

    @cached_property
    def classes(self) -> np.ndarray:
        return BYTE_CLASS[self.words.data]

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return word_hashes(self.words)

    @cached_property
    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.first)

    def bytes_of(self, *classes: int) -> np.ndarray:
        """Bytes of some classes in each text; what ends a text in the buffer isn't part of it."""
        if not len(self):
            return np.zeros(0, np.int64)
        chosen = np.zeros(9, np.int64)
        chosen[list(classes)] = 1
        found = np.add.reduceat(chosen[self.classes], self.words.text_starts[:-1])
        return found - chosen[SPACE]

    def per_text(self, words: np.ndarray) -> np.ndarray:
        """Sums of one number per word."""
        sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
        return np.diff(sums[self.words.first])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.bytes_of(UPPER, LOWER, DIGIT, SYMBOL, BANG, PUNCTUATION, MANY)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all lines."""
        ends = np.flatnonzero(self.words.data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        owner = np.searchsorted(self.words.text_starts, starts, side="right") - 1
        return starts, ends, owner

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[2], minlength=len(self)).astype(np.int64)

    def dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of the text."""
        starts, ends, owner = self.lines
        filled = np.concatenate([[0], np.cumsum(self.classes != SPACE)])
        worded = filled[ends] > filled[starts]
        key = range_hashes(self.words.data, starts, ends) ^ mix(owner.astype(np.uint64) + np.uint64(1))
        again = np.ones(len(starts), bool)
        again[np.unique(key, return_index=True)[1]] = False
        return np.bincount(owner[again & worded], minlength=len(self)).astype(np.int64)

    def repeat_words(self, width: int = 3) -> np.ndarray:
        """Words in windows of `width` words that the text has twice or more."""
        n = len(self.word_hashes)
        if n < width:
            return np.zeros(len(self), np.int64)
        hashes = window_hashes(self.word_hashes, width)
        start = np.flatnonzero(self.owners[: n - width + 1] == self.owners[width - 1 :])
        key = hashes[start] ^ mix(self.owners[start].astype(np.uint64) + np.uint64(1))
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        found = start[count[place] > 1]
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, found, 1)
        np.add.at(change, found + width, -1)
        return self.per_text(np.cumsum(change[:-1]) > 0)

    def word_kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: how many different words, and how often the commonest comes."""
        key = self.word_hashes ^ mix(self.owners.astype(np.uint64) + np.uint64(1))
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        owner = self.owners[first]
        most = np.zeros(len(self), np.int64)
        np.maximum.at(most, owner, count)
        return np.bincount(owner, minlength=len(self)).astype(np.int64), most

    def same_as_before(self) -> np.ndarray:
        """Words equal to the word before them."""
        same = np.zeros(len(self.word_hashes), bool)
        hashes, owners = self.word_hashes, self.owners
        same[1:] = (hashes[1:] == hashes[:-1]) & (owners[1:] == owners[:-1])
        return self.per_text(same)

    def lettered_words(self) -> np.ndarray:
        """Words with a letter: a-z, A-Z, or a character of several bytes."""
        letter = np.isin(np.arange(9), LETTERS)[self.classes]
        sums = np.concatenate([[0], np.cumsum(letter)])
        return self.per_text(sums[self.words.ends] > sums[self.words.starts])

    def words_ending_in(self, *classes: int) -> np.ndarray:
        last = self.classes[self.words.ends - 1]
        return self.per_text(np.isin(last, classes))
