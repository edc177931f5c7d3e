"""Repeated byte strings: every byte covered by a string of `least` bytes that starts
anywhere else too is taken out.

Where two equal strings of `least` bytes lie, the smallest hash of their `GRAM`-byte parts
is at the same place in both: their anchor. So starts are told apart by anchor, and, BLOCK
places at a time, by the bytes that all strings from those starts have in common. Only
starts whose common bytes come twice or more go on, each with its context, the bytes that
the strings from its block of starts cover.

Equal contexts are one entry with a weight. Entries that differ are indexed in shards by
their common bytes: a Burrows-Wheeler transform of each shard is expanded from the empty
string backward, breadth first, one byte longer at a time. An interval's end marks a border
between suffixes that have just that many bytes in common, and each border is set once, so
the work is in proportion to the shard. Expansion stops at `least` bytes; borders not set by
then lie between strings that are equal for at least `least` bytes.

A block of starts with very many different contexts is not indexed whole: its strings are
grouped one start at a time.

A null text is an empty one, and texts under `least` bytes have nothing repeated. Every row
is a document, so rows repeated whole are copies of one another. An empty table gives an
empty result. Common bytes and contexts are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationdays.llm.tokens import utf8
from stationdays.llm.words import RangeHash, joined, mix, runs
from stationdays.llm.kept import cut_lineage

LEAST = 200
GRAM = 32
BLOCK = 64
SHARD_BYTES = 1 << 20
MOST_CONTEXTS = 2000
"""Contexts of one block of starts that are indexed together."""

PLACE_BITS = 16
"""A location is an anchor's place in its text, then the block's first and last offset."""


# ------------------------------------------------------------------ candidates


def anchored_blocks(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """For each block of starts: its text, anchor, last and first offset before the anchor,
    key of the common bytes, key of the context."""
    gram, block = min(GRAM, least), min(BLOCK, least)
    data, begins = joined(texts)
    sizes = np.diff(begins) - 1
    long = np.flatnonzero(sizes >= least)
    none = np.zeros(0, np.int64)
    if not len(long):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hasher = RangeHash(data)
    place = np.arange(len(data) - gram + 1)
    bits = np.uint64(len(data).bit_length())
    smallest = (hasher(place, place + gram) >> bits << bits) | place.astype(np.uint64)
    # the least of `width` neighbours, from the least of two halves that overlap
    width, reach = 1, least - gram + 1
    while 2 * width <= reach:
        smallest = np.minimum(smallest[:-width], smallest[width:])
        width *= 2
    if reach > width:
        smallest = np.minimum(smallest[: width - reach], smallest[reach - width :])
    counts = sizes[long] - least + 1
    owner = np.repeat(long, counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    anchor = (smallest[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    offset = anchor - start
    change = np.ones(len(start), bool)
    change[1:] = (
        (anchor[1:] != anchor[:-1]) | (offset[1:] // block != offset[:-1] // block)
        | (owner[1:] != owner[:-1])
    )
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(start)) - 1
    anchor, owner, high, low = anchor[first], owner[first], offset[first], offset[last]
    part = high // block
    common = anchor - part * block
    salt = mix(part.astype(np.uint64) + np.uint64(1))
    key = mix(hasher(common, common + least - block + 1) ^ salt)
    shape = mix((high << 16 | low).astype(np.uint64))
    context = mix(hasher(anchor - high, anchor - low + least) ^ shape)
    return owner, anchor - begins[owner], high, low, key, context


def block_rows(texts: DataFrame, least: int) -> DataFrame:
    """document, key, context, location of every block of starts of (document, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = utf8(batch.column("text"))
            documents = batch.column("document").to_numpy()
            for run in runs([len(t) for t in whole]):
                owner, place, high, low, key, context = anchored_blocks(whole[run], least)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(documents[run][owner]),
                        pa.array(key.view(np.int64)),
                        pa.array(context.view(np.int64)),
                        pa.array((place << 2 * PLACE_BITS) | (high << PLACE_BITS) | low),
                    ],
                    ["document", "key", "context", "location"],
                )

    return texts.mapInArrow(rows, "document long, key long, context long, location long")


def _high(location: np.ndarray) -> np.ndarray:
    return (location >> PLACE_BITS) & ((1 << PLACE_BITS) - 1)


def _low(location: np.ndarray) -> np.ndarray:
    return location & ((1 << PLACE_BITS) - 1)


# ------------------------------------------------------------------------ index


def suffix_order(data: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of strings put one after another, each ended by a 0 of its own.

    `data` has bytes plus 1 and 0 at the ends; an end comes before any byte, and ends come
    in order of their strings. By doubling the length that is compared.
    """
    n = len(data)
    left = ends[owner] - np.arange(n)
    key, width = np.zeros(n, np.uint64), 7
    for i in range(width):
        # nothing counts after the string's end
        inside = np.zeros(n, np.uint64)
        inside[: max(n - i, 0)] = data[i:]
        key = key << np.uint64(9) | np.where(left >= i, inside, 0).astype(np.uint64)
    tie = np.where(left < width, owner, 0)
    order = np.lexsort((tie, key))
    while True:
        sk, st = key[order], tie[order]
        new = np.append(True, (sk[1:] != sk[:-1]) | (st[1:] != st[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - width, 0)] = rank[width:]
        # suffixes that end before that are told apart already
        key = (rank.astype(np.uint64) << np.uint64(32)) | np.where(left >= width, ahead, 0).astype(np.uint64)
        tie = np.zeros(n, np.int64)
        order = np.argsort(key, kind="stable")
        width *= 2


def equal_prefix_groups(strings: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String and place of every suffix with at least `least` bytes, and a number that those
    have in common whose first `least` bytes are equal."""
    sizes = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(sizes) - 1
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    data[ends] = 0
    n = len(data)
    owner = np.repeat(np.arange(len(strings)), sizes)
    order = suffix_order(data, owner, ends)
    before = order - 1
    last = data[before]  # the transform: the byte before each suffix
    # a suffix is extended backward by going to the suffix one byte longer
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    longer = row[before]
    by_byte = np.argsort(last, kind="stable")
    following, preceding = np.full(n, n), np.full(n, -1)
    same = last[by_byte[1:]] == last[by_byte[:-1]]
    following[by_byte[:-1][same]] = by_byte[1:][same]
    preceding[by_byte[1:][same]] = by_byte[:-1][same]

    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    border[: len(strings) + 1] = True  # suffixes of nothing but an end
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(least):
        if not len(low):
            break
        width = high - low + 1
        to = np.cumsum(width)
        inside = np.arange(to[-1]) + np.repeat(low - to + width, width)
        inside_low, inside_high = np.repeat(low, width), np.repeat(high, width)
        real = last[inside] > 0
        first = real & (preceding[inside] < inside_low)
        final = real & (following[inside] > inside_high)
        # of each interval and byte the first and the last row: the longer string's interval
        next_low = np.sort(longer[inside[first]])
        next_high = np.sort(longer[inside[final]])
        fresh = ~border[next_high + 1]
        low, high = next_low[fresh], next_high[fresh]
        border[high + 1] = True
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(border[:-1])
    place = np.arange(n) - (ends - sizes + 1)[owner]
    enough = sizes[owner] - 1 - place >= least
    return owner[enough], place[enough], group[enough]


def repeated_runs(
    strings: list[bytes], weights: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places at which a string of `least` bytes begins that begins twice or more:
    the string, the run's first place and its last."""
    owner, place, group = equal_prefix_groups(strings, least)
    times = np.bincount(group, weights[owner])
    found = times[group] > 1
    return as_runs(owner[found], place[found])


def as_runs(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(owner)) - 1 if len(first) else first
    return owner[first], place[first], place[final]


# ----------------------------------------------------------------------- whole job


def context_bytes(entries: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """Adds the bytes of its context to every entry (key, context, weight, document, location)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"key": [], "context": [], "weight": [], "bytes": []}
            for text, entry in zip(utf8(batch.column("text")), batch.column("entries").to_pylist()):
                for e in entry:
                    at = e["location"] >> 2 * PLACE_BITS
                    high, low = _high(e["location"]), _low(e["location"])
                    for name in ("key", "context", "weight"):
                        out[name].append(e[name])
                    out["bytes"].append(text[at - high : at - low + least])
            yield pa.RecordBatch.from_pydict(out, pa.schema(
                [("key", pa.int64()), ("context", pa.int64()), ("weight", pa.int64()), ("bytes", pa.binary())]
            ))

    wanted = entries.groupBy("document").agg(
        F.collect_list(F.struct("key", "context", "weight", "location")).alias("entries")
    )
    one = texts.join(wanted, "document")
    schema = "key long, context long, weight long, bytes binary"
    # a document that comes several times gives its entries each time
    return one.select("text", "entries").mapInArrow(rows, schema).dropDuplicates(["key", "context"])


def indexed_runs(entries: DataFrame, least: int) -> DataFrame:
    """key, context, first, last: runs of repeated places in contexts, by shards' indexes."""
    total = entries.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def index(frame: pd.DataFrame) -> pd.DataFrame:
        weights = frame["weight"].to_numpy(float)
        owner, first, final = repeated_runs(list(frame["bytes"]), weights, least)
        return pd.DataFrame(
            {
                "key": frame["key"].to_numpy()[owner],
                "context": frame["context"].to_numpy()[owner],
                "first": first,
                "last": final,
            }
        )

    sharded = entries.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(
        index, "key long, context long, first long, last long"
    )


def single_starts(entries: DataFrame, least: int) -> DataFrame:
    """The same runs, each of one place, for blocks with very many contexts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column("bytes").to_pylist()
            data, begins = joined(strings)
            counts = np.array([len(s) - least + 1 for s in strings], np.int64)
            owner = np.repeat(np.arange(len(strings)), counts)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            start = begins[owner] + place
            string = RangeHash(data)(start, start + least)
            columns = [batch.column(c).take(pa.array(owner)) for c in ("key", "context", "weight")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(place), pa.array(string.view(np.int64))],
                ["key", "context", "weight", "place", "string"],
            )

    every = entries.mapInArrow(
        rows, "key long, context long, weight long, place long, string long"
    )
    times = every.groupBy("key", "string").agg(F.sum("weight").alias("times")).where("times > 1")
    return every.join(times, ["key", "string"]).select(
        "key", "context", F.col("place").alias("first"), F.col("place").alias("last")
    )


def repeated_spans(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """document, begin, end of stretches of (document, text) to take out; they may overlap."""
    blocks = block_rows(texts, least)
    twice = blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    kept = cut_lineage(blocks.join(twice, "key", "left_semi"))
    entries = kept.groupBy("key", "context").agg(
        F.count("*").alias("weight"), F.min(F.struct("document", "location")).alias("one")
    )
    entries = cut_lineage(
        entries.select("key", "context", "weight", "one.document", "one.location")
    )
    many = entries.groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1")
    differ = cut_lineage(context_bytes(entries.join(many.select("key"), "key", "left_semi"), texts, least))
    large = many.where(F.col("contexts") > MOST_CONTEXTS).select("key")
    found = indexed_runs(differ.join(large, "key", "left_anti"), least).unionByName(
        single_starts(differ.join(large, "key", "left_semi"), least)
    )
    whole = entries.where("weight > 1").select("key", "context")
    at = F.shiftright("location", 2 * PLACE_BITS)
    mask = F.lit((1 << PLACE_BITS) - 1)
    high = F.shiftright("location", PLACE_BITS).bitwiseAND(mask)
    low = F.col("location").bitwiseAND(mask)
    by_context = kept.join(found, ["key", "context"]).select(
        "document",
        (at - high + F.col("first")).alias("begin"),
        (at - high + F.col("last") + least).alias("end"),
    )
    by_weight = kept.join(whole, ["key", "context"], "left_semi").select(
        "document", (at - high).alias("begin"), (at - low + least).alias("end")
    )
    return by_context.unionByName(by_weight)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans put together where they overlap or touch, in order."""
    result: list[tuple[int, int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
        if result and begin <= result[-1][1]:
            result[-1] = (result[-1][0], max(result[-1][1], end))
        else:
            result.append((begin, end))
    return result


def without_repeats(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, the bytes kept, and how many and where they were taken out, per document."""
    texts = documents.select(
        F.col("doc_id").cast("long"), "text",
        F.xxhash64("doc_id", "text").alias("document"),
    )
    spans = (
        repeated_spans(texts.select("document", "text"), least)
        .distinct()
        .groupBy("document")
        .agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "spans": [], "kept": []}
            for text, found in zip(utf8(batch.column("text")), batch.column("spans").to_pylist()):
                gone = merged(found)
                bounds = [0, *(x for span in gone for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["spans"].append([{"begin": a, "end": b} for a, b in gone])
                out["kept"].append(kept)
            part = pa.RecordBatch.from_pydict(out, pa.schema(
                [
                    ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                    ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    ("kept", pa.binary()),
                ]
            ))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *part.columns], ["doc_id", *part.schema.names]
            )

    return texts.join(spans, "document", "left").select("doc_id", "text", "spans").mapInArrow(
        rows,
        "doc_id long, n_bytes long, n_removed long, "
        "spans array<struct<begin:long,end:long>>, kept binary",
    )


def repeat_digest(documents: DataFrame, least: int = LEAST) -> DataFrame:
    return without_repeats(documents.select("doc_id", "text"), least).select(
        "doc_id", "n_bytes", "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
