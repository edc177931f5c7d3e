"""Packing token pieces into sequences of one length, by patterns fitted to a histogram.

Patterns of one to three lengths that fill a sequence get repeat counts by non-negative
least squares against the histogram, with lengths rounded up to units, which keeps the
patterns few; counts are rounded. Each pattern then takes pieces of such lengths, and what
is left is packed best fit by true lengths, also into the room that is left in patterns;
best fit alone is taken where it makes fewer sequences.
All of this works on counts, on a histogram with an entry per length, however many
pieces there are. Pieces are then numbered within their length, and the number says which
sequence has the piece.

A null text is an empty one, of the end id alone. Rows with one document id are packed as
documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationdays.llm.tokens import crc32, encode_batch
from stationdays.llm.kept import cut_lineage, small_batches
from stationdays.llm.workers import thrifty

VOCABULARY = "byte_bpe_50k.json"
END = 0
SEQUENCE = 2048
UNIT = 8
ROWS_AT_ONCE = 2048
"""Rows whose texts Python gets in one batch."""


class Pattern(NamedTuple):
    units: tuple[int, ...]
    count: int


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets; few entries are above 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        active[best] = True
        while True:
            on = np.flatnonzero(active)
            solution = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (solution > 0).all():
                x[:] = 0
                x[on] = solution
                break
            low = solution <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - solution[low], 1e-300))
            x[on] += step * (solution - x[on])
            active[on[x[on] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def full_patterns(lengths: np.ndarray, whole: int) -> list[tuple[int, ...]]:
    """All ways to fill a sequence with one to three of the given lengths, longest first."""
    there = set(lengths.tolist())
    found = [(whole,)] if whole in there else []
    for a in sorted(there, reverse=True):
        rest = whole - a
        if rest in there and rest <= a:
            found.append((a, rest))
        for b in there:
            if b <= a and 0 < rest - b <= b and rest - b in there:
                found.append((a, b, rest - b))
    return found


def best_fit(
    counts: dict[int, int], whole: int, begun: list[Pattern] | None = None
) -> list[Pattern]:
    """Longest lengths first, each where it leaves the least room, also in packs that others
    have begun; equal packs at once. All packs."""
    room: dict[int, list[Pattern]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: Pattern) -> None:
        if gap not in room:
            insort(gaps, gap)
        room.setdefault(gap, []).append(pattern)

    def take(gap: int) -> Pattern:
        pattern = room[gap].pop()
        if not room[gap]:
            del room[gap]
            gaps.remove(gap)
        return pattern

    for pattern in begun or []:
        put(whole - sum(pattern.units), pattern)
    for units in sorted(counts, reverse=True):
        left = counts[units]
        while left and (at := bisect_left(gaps, units)) < len(gaps):
            gap = gaps[at]
            pattern = take(gap)
            # as many of them into each pack as there is room for
            each = min(gap // units, left)
            taken = min(pattern.count, left // each)
            put(gap - each * units, Pattern(pattern.units + (units,) * each, taken))
            if taken < pattern.count:
                put(gap, Pattern(pattern.units, pattern.count - taken))
            left -= taken * each
        each = whole // units
        for size, many in ((each, left // each), (left % each, 1)):
            if size and many:
                put(whole - size * units, Pattern((units,) * size, many))
    return [p for patterns in room.values() for p in patterns]


def fitted_patterns(counts: dict[int, int], whole: int) -> list[Pattern]:
    """Full patterns with rounded counts, of no length more often than it is there."""
    left = {u: n for u, n in counts.items() if n}
    lengths = np.array(sorted(left))
    patterns = full_patterns(lengths, whole)
    if not patterns:
        return []
    place = {u: i for i, u in enumerate(lengths.tolist())}
    a = np.zeros((len(lengths), len(patterns)))
    for j, pattern in enumerate(patterns):
        for u in pattern:
            a[place[u], j] += 1
    b = np.array([left[u] for u in lengths.tolist()], float)
    x = nonnegative_least_squares(a, b)
    packed = []
    for j in np.argsort(-x, kind="stable"):
        need = Counter(patterns[j])
        many = min(int(x[j] + 0.5), *(left[u] // n for u, n in need.items()))
        if many > 0:
            packed.append(Pattern(patterns[j], many))
            for u, n in need.items():
                left[u] -= n * many
    return packed


def with_true_lengths(
    patterns: list[Pattern], counts: dict[int, int], unit: int
) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns of units as patterns of lengths, the longest of a unit first, and how many
    pieces of each length are left."""
    waiting: dict[int, list[list[int]]] = {}
    for length in sorted(counts):
        if counts[length]:
            waiting.setdefault(-(-length // unit), []).append([length, counts[length]])
    packed = []
    for pattern in patterns:
        need, left = Counter(pattern.units), pattern.count
        while left:
            # as many packs as the pieces of one length make, or one of several lengths
            many = min(left, *(max(1, waiting[u][-1][1] // n) for u, n in need.items()))
            lengths: list[int] = []
            for u, n in need.items():
                wanted = n * many
                while wanted:
                    last = waiting[u][-1]
                    taken = min(wanted, last[1])
                    lengths += [last[0]] * (taken // many)
                    last[1] -= taken
                    wanted -= taken
                    if not last[1]:
                        waiting[u].pop()
            packed.append(Pattern(tuple(lengths), many))
            left -= many
    return packed, {length: n for rest in waiting.values() for length, n in rest}


def fit_patterns(counts: dict[int, int], whole: int, unit: int = 1) -> list[Pattern]:
    """Patterns that together hold every length exactly as often as it is there.

    Lengths a little above and below a unit's end may go together better than units can tell,
    so if best fit alone makes fewer packs, these are taken.
    """
    by_unit: Counter[int] = Counter()
    for length, n in counts.items():
        by_unit[-(-length // unit)] += n
    fitted = fitted_patterns(by_unit, whole // unit)
    packed, left = with_true_lengths(fitted, counts, unit)
    ways = best_fit(left, whole, packed), best_fit(counts, whole)
    return min(ways, key=lambda packs: sum(p.count for p in packs))


def slots_of(patterns: list[Pattern]) -> pd.DataFrame:
    """Which pieces go where: the `low`-th to next pieces of so many units fill `each` places
    from place `slot` on, of sequences `sequence` and following."""
    rows, used, sequence = [], {}, 0
    for pattern in patterns:
        for units in sorted(set(pattern.units), reverse=True):
            each = pattern.units.count(units)
            low = used.get(units, 0)
            rows.append((units, low, each, pattern.units.index(units), sequence))
            used[units] = low + each * pattern.count
        sequence += pattern.count
    return pd.DataFrame(rows, columns=["units", "low", "each", "slot", "sequence"]).sort_values(
        ["units", "low"], ignore_index=True
    )


def token_pieces(
    documents: DataFrame,
    vocabulary: str = VOCABULARY,
    end: int = END,
    sequence: int = SEQUENCE,
    keep_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece.

    Only texts longer than a sequence are cut; of these the first piece may be shorter.
    """
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, ids, starts in encode_batch(batch, vocabulary, end):
                sizes = np.diff(starts)
                counts = -(-sizes // sequence)
                owner = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = sizes - (counts - 1) * sequence
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * sequence)
                length = np.where(piece == 0, first[owner], sequence)
                at = starts[owner] + start
                docs = batch.column("doc_id").slice(which.start, which.stop - which.start)
                columns = [
                    docs.take(pa.array(owner)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([crc32(ids[a : a + n]) for a, n in zip(at, length)], pa.int64()),
                ]
                if keep_ids:
                    bounds = pa.array(np.append(at, starts[-1]).astype(np.int32))
                    values = pa.array(ids.astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(bounds, values))
                yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * keep_ids)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        thrifty(rows, encodes=True), fields + ", ids array<int>" * keep_ids
    )


def pack_pieces(
    pieces: DataFrame, sequence: int = SEQUENCE, unit: int = UNIT, order: tuple[str, ...] = ()
) -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces, which have a `length` of 1 to `sequence`.

    `order` names columns that tell pieces apart; pieces equal in these are numbered in
    any order. Numbers are given inside shards of each length, so a length that many
    pieces have is no single task's work.
    """
    spark = pieces.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in order] or [F.col("length")]
    kept = cut_lineage(
        pieces.withColumn("__units", F.col("length").cast("int")).withColumn(
            "__shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")
        )
    )
    counts = kept.groupBy("__units", "__shard").agg(F.count("*").alias("__n"))
    # at most `sequence` rows
    total = counts.groupBy("__units").agg(F.sum("__n").alias("n")).collect()
    slots = slots_of(fit_patterns({r["__units"]: r["n"] for r in total}, sequence, unit))
    before = (
        Window.partitionBy("__units").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select(
        "__units", "__shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from")
    )
    inside = Window.partitionBy("__units", "__shard").orderBy(*keys)
    numbered = kept.join(starts, ["__units", "__shard"]).withColumn(
        "__number", F.col("__from") + F.row_number().over(inside) - 1
    )
    wide = np.int64(1 << 40)
    keys_low = slots["units"].to_numpy(np.int64) * wide + slots["low"].to_numpy(np.int64)
    each, slot, first, low = (
        slots[c].to_numpy(np.int64) for c in ("each", "slot", "sequence", "low")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("__units").to_numpy().astype(np.int64)
            number = batch.column("__number").to_numpy()
            at = np.searchsorted(keys_low, units * wide + number, side="right") - 1
            behind = number - low[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    pa.array(first[at] + behind // each[at]),
                    pa.array(slot[at] + behind % each[at]),
                ],
                [*names, "sequence_id", "__slot"],
            )

    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    placed = numbered.select(
        *names, "__units", F.col("__number").cast("long").alias("__number")
    ).mapInArrow(thrifty(place, encodes=True), schema + ", sequence_id long, __slot long")
    earlier = (
        Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")
    return placed.withColumn("offset", offset).drop("__slot")


def pack_documents(
    documents: DataFrame, vocabulary: str = VOCABULARY, keep_ids: bool = False
) -> DataFrame:
    pieces = token_pieces(documents, vocabulary, keep_ids=keep_ids)
    # the texts are read while the pieces are written
    with small_batches(documents.sparkSession, ROWS_AT_ONCE):
        return pack_pieces(pieces, order=("doc_id", "piece", "length", "ids_crc32"))
