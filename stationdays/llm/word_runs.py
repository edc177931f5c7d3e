"""Periodic runs of words, by Kruskal's algorithm over suffix classes.

A run of period q is a longest stretch of words that equal the words q places on; q is its
smallest period. Its first place s and s + q begin suffixes with a common prefix of all but q
of its words, and no place between them begins one so long.

Suffixes of each text are sorted by doubling and joined to their neighbours in that order by
edges, whose weight is the common prefix (LCP). Edges are taken by descending weight, as in
Kruskal's algorithm, and unite classes in a union-find whose classes keep their places in
order. When two places of different classes become neighbours at a distance within the LCP,
they seed the run from the first of them to the last word of the common prefix.

Only runs of four periods or more, and six words, are asked for. So a seed's LCP is three
times its distance or more: only classes with a place whose next occurrence is so near
are united, and edges below five words are never taken. Both leave no run out.

All of it works on one batch of texts at a time; a text is one row and one task's. Null,
empty and blank texts have no runs. Rows are independent, repeated rows give repeated
results, and an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationdays.llm.tokens import utf8
from stationdays.llm.words import find_words, runs, word_ids

PERIODS = 4
LEAST_WORDS = 6
BLOCK_PLACES = 512
"""An ordered set of places is kept in blocks of at most twice so many."""


class Run(NamedTuple):
    start: int
    length: int
    period: int


class Places:
    """An ordered set of places."""

    def __init__(self, place: int):
        self.blocks = [[place]]
        self.size = 1

    def _block(self, place: int) -> int:
        low, high = 0, len(self.blocks) - 1
        while low < high:
            middle = (low + high) // 2
            if self.blocks[middle][-1] < place:
                low = middle + 1
            else:
                high = middle
        return low

    def around(self, place: int) -> tuple[int | None, int | None]:
        """The nearest members below and above a place that is no member."""
        i = self._block(place)
        block = self.blocks[i]
        at = bisect_left(block, place)
        below = block[at - 1] if at else self.blocks[i - 1][-1] if i else None
        return below, block[at] if at < len(block) else None

    def add(self, place: int) -> None:
        i = self._block(place)
        block = self.blocks[i]
        insort(block, place)
        self.size += 1
        if len(block) > 2 * BLOCK_PLACES:
            self.blocks[i : i + 1] = [block[:BLOCK_PLACES], block[BLOCK_PLACES:]]

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def text_ids(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row, with a number of its own after each text and
    different numbers for the same word of different texts; and where each text starts."""
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    _, own = np.unique(owner * (ids.max(initial=0) + 1) + ids, return_inverse=True)
    starts = first + np.arange(len(first))
    row = np.empty(starts[-1], np.int64)
    row[np.arange(len(ids)) + owner] = own
    row[starts[1:] - 1] = len(own) + np.arange(len(counts))
    return row, starts


def _classes(row: np.ndarray, width: int) -> np.ndarray:
    """A number for each place whose `width` words come again in its text, the same for the
    same words; -1 for other places."""
    _, level, count = np.unique(row, return_inverse=True, return_counts=True)
    here = np.flatnonzero(count[level] > 1)
    done = 1
    while done < width and len(here):
        # the words from a place and those `step` places on, which may overlap
        step = min(done, width - done)
        here = here[here + step < len(row)]
        key = level[here] * (2 * len(row)) + level[here + step]
        _, found, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[found] > 1
        here, found = here[again], found[again]
        # a place that is no longer here equals no other place
        level = len(row) + np.arange(len(row))
        level[here] = found
        done += step
    out = np.full(len(row), -1)
    out[here] = level[here]
    return out


def seeding_places(row: np.ndarray) -> np.ndarray:
    """Places of all classes of suffixes, equal in their first LEAST_WORDS - 1 words, of which
    one place may be the first of a run."""
    width = LEAST_WORDS - 1
    level = _classes(row, width)
    here = np.flatnonzero(level >= 0)
    if not len(here):
        return here
    order = here[np.argsort(level[here], kind="stable")]
    near = level[order[1:]] == level[order[:-1]]
    distance = np.full(len(row), len(row))
    distance[order[:-1][near]] = (order[1:] - order[:-1])[near]
    # words from a place on that come again, at least: to the end of its stretch of places
    ends = np.flatnonzero(np.append(np.diff(here) > 1, True))
    stretch = here[ends[np.searchsorted(ends, np.arange(len(here)))]]
    able = (PERIODS - 1) * distance[here] <= stretch - here + width
    return here[np.isin(level[here], np.unique(level[here[able]]))]


def suffix_order(row: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in the order of their suffixes, and each place's rank by its first 1, 2, 4, ...
    words, of which equal words have the same."""
    order = np.argsort(row, kind="stable")
    bounds = np.append(True, row[order[1:]] != row[order[:-1]])
    rank = np.empty(len(row), np.int64)
    rank[order] = np.flatnonzero(bounds)[np.cumsum(bounds) - 1]
    levels, width = [rank.astype(np.int32)], 1
    while True:
        groups = np.bincount(rank, minlength=len(row))
        open_places = np.flatnonzero(groups[rank] > 1)
        if not len(open_places):
            break
        # a repeated string ends before its text does, so there is a place behind it
        key = rank[open_places] * (len(row) + 1) + rank[open_places + width]
        by_key = np.argsort(key, kind="stable")
        places, key = open_places[by_key], key[by_key]
        old = rank[places]
        at = np.arange(len(places))
        new_group = np.append(True, old[1:] != old[:-1])
        new_class = np.append(True, key[1:] != key[:-1])
        group_start = at[new_group][np.cumsum(new_group) - 1]
        class_start = at[new_class][np.cumsum(new_class) - 1]
        rank[places] = old + class_start - group_start
        levels.append(rank.astype(np.int32))
        width *= 2
    order = np.empty(len(row), np.int64)
    order[rank] = np.arange(len(row))
    return order, levels


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words the suffixes from places a and b have in common."""
    total = np.zeros(len(a), np.int64)
    last = len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + total, last), np.minimum(b + total, last)
        total += np.where(levels[k][x] == levels[k][y], 1 << k, 0)
    return total


def seeds(edges: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(place, next place, LCP) of places that become neighbours, near enough for a run, as
    edges (LCP, a, b) of descending LCP unite their classes."""
    above: dict[int, int] = {}
    members: dict[int, Places] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above.setdefault(up, up)
        return x

    for lcp, a, b in edges:
        a, b = root(a), root(b)
        large = members.get(a) or Places(a)
        small = members.get(b) or Places(b)
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        most = lcp // (PERIODS - 1)
        moved = list(small)
        before = -1
        for i, place in enumerate(moved):
            below, over = large.around(place)
            if below is not None and below > before and place - below <= most:
                yield below, place, lcp
            after = moved[i + 1] if i + 1 < len(moved) else None
            if over is not None and over - place <= most and (after is None or over < after):
                yield place, over, lcp
            before = place
        for place in moved:
            large.add(place)
        above[b] = a
        members.pop(b, None)
        members[a] = large


def runs_of(ids: np.ndarray, first: np.ndarray) -> list[list[Run]]:
    """The runs of each text, by start and period, from the numbers of its words."""
    found: list[list[Run]] = [[] for _ in range(len(first) - 1)]
    if not len(ids):
        return found
    row, starts = text_ids(ids, first)
    wanted = seeding_places(row)
    if not len(wanted):
        return found
    # only texts with such places are sorted
    texts = np.unique(np.searchsorted(starts, wanted, side="right") - 1)
    spans = [np.arange(starts[t], starts[t + 1]) for t in texts.tolist()]
    chosen = np.concatenate(spans)
    _, part = np.unique(row[chosen], return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
    order, levels = suffix_order(part)
    keep = np.isin(chosen, wanted, assume_unique=True)
    order = order[keep[order]]
    a, b = order[:-1], order[1:]
    lcp = common_prefixes(a, b, levels)
    strong = np.flatnonzero(lcp >= LEAST_WORDS - 1)
    strong = strong[np.argsort(-lcp[strong], kind="stable")]
    edges = zip(lcp[strong].tolist(), a[strong].tolist(), b[strong].tolist())
    for place, other, common in seeds(edges):
        period = other - place
        text = int(np.searchsorted(offsets, place, side="right")) - 1
        start = place - int(offsets[text])
        if common + period < LEAST_WORDS or (start and part[place - 1] == part[other - 1]):
            # too short, or the run begins further left and is seeded there
            continue
        found[texts[text]].append(Run(start, common + period, period))
    for one in found:
        one.sort(key=lambda r: (r.start, r.period))
    return found


def dropped_words(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words lie in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for run in found:
        change[run.start + run.period] += 1
        change[run.start + run.length] -= 1
    return np.cumsum(change[:-1]) > 0


def find_runs(texts: list[bytes]) -> tuple[list[list[Run]], list[bytes]]:
    """The runs of each text, and its words, joined by spaces, without their repetitions."""
    words = find_words(texts)
    found = runs_of(word_ids(words), words.first)
    collapsed = []
    for i, text in enumerate(texts):
        cut = text.split()
        if found[i]:
            drop = dropped_words(len(cut), found[i]).tolist()
            cut = [w for w, gone in zip(cut, drop) if not gone]
        collapsed.append(b" ".join(cut))
    return found, collapsed


RUN_FIELDS = "array<struct<start: bigint, length: bigint, period: bigint>>"
RUN_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in Run._fields]))


def word_runs(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    edit: Callable[[int | None, bytes], bytes] | None = None,
) -> DataFrame:
    """id, `runs`, an array of (start, length, period) by start and period, and `collapsed`,
    the text's words without those that repeat a run's first period, for every row.

    `edit`, if given, makes the text that is looked at of a row's id and text.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            texts = utf8(batch.column(1))
            if edit is not None:
                texts = [edit(i, t) for i, t in zip(ids.to_pylist(), texts)]
            for part in runs([len(t) for t in texts]):
                found, collapsed = find_runs(texts[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(part.start, part.stop - part.start),
                        pa.array([[r._asdict() for r in one] for one in found], RUN_TYPE),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    [id, "runs", "collapsed"],
                )

    return documents.select(F.col(id).cast("long").alias(id), F.col(text)).mapInArrow(
        rows, f"`{id}` long, runs {RUN_FIELDS}, collapsed string"
    )


def looped(doc_id: int | None, text: bytes) -> bytes:
    """Text with a loop at its end, for one id in ten: a checksum of the id chooses where
    it begins and how long it is."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not (words := text.split()):
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])


def run_digest(documents: DataFrame) -> DataFrame:
    """What the contract asks of every document, from its runs."""
    found = word_runs(documents, edit=looped)
    best = F.array_min(
        F.transform(
            "runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])
        )
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    length = -F.col("best.less")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE = r"""
WITH given AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own,
           xor(
               list_reduce(
                   flatten(list_transform(
                       range(0, length(CAST(doc_id AS VARCHAR)) + 1),
                       lambda i: CASE WHEN i = 0 THEN [4294967295::BIGINT] ELSE
                           [ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
                       END
                   )),
                   lambda c, x: CASE
                       WHEN x >= 0 THEN xor(c, x)
                       WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT)
                       ELSE c // 2 END
               ),
               4294967295::BIGINT
           ) AS h
    FROM documents
),
loops AS (
    SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p
    FROM (SELECT *, len(own) AS n FROM given)
),
words AS (
    SELECT r, n, i, own[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS w
    FROM (SELECT *, unnest(range(0, n)) AS i FROM loops)
),
grams AS (
    SELECT r, n, i,
           w || ' ' || lead(w, 1) OVER t || ' ' || lead(w, 2) OVER t || ' ' || lead(w, 3) OVER t
             || ' ' || lead(w, 4) OVER t AS gram
    FROM words WINDOW t AS (PARTITION BY r ORDER BY i)
),
matches AS (
    SELECT x.r, x.i, y.i - x.i AS q
    FROM grams x JOIN grams y ON x.r = y.r AND x.gram = y.gram AND x.i < y.i
    WHERE 4 * (y.i - x.i) <= x.n
),
stretches AS (
    SELECT r, q, min(i) AS start, count(*) + 4 + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM matches)
    GROUP BY r, q, island
),
found AS (
    SELECT r, start, length, min(q) AS period
    FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length
),
summed AS (
    SELECT r, count(*) AS n_runs,
           min({'less': -length, 'start': start, 'period': period}) AS best,
           string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs
    FROM found GROUP BY r
),
gone AS (
    SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM found
),
collapsed AS (
    SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, -best.less AS length,
       best.period AS period, CAST(-1000 * best.less // best.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM given LEFT JOIN summed USING (r) LEFT JOIN collapsed USING (r)
"""
