"""Jaccard metric-space join of documents' word shingles, exact.

Distance is 1 - |A n B| / |A u B|, a metric. Pivots divide the documents into regions;
a document near a border is replicated into every region in which the triangle inequality
leaves it a partner; regions that stay large are divided again.

1. Documents with the same set are one node.
2. The first pivots are sets of one shingle. The nearest of them to a node are its own
   shingles, all equally near, so the tie goes by a fixed order of shingles, rare ones
   first. A partner misses at most a fifth of the node's shingles, so it shares one of the
   first fifth (and one): these are the regions that the node is replicated to. Unrelated
   texts are at distance 1 from one another, so document pivots cannot part them; one-
   shingle pivots do.
3. In each region the most central node becomes pivot, and members' distances d to it are
   computed exactly. Members within the limit t are linked to it, and so all of one class.
   Two others can be linked only if their distances to the pivot differ by at most t:
   the ball of radius 2 t around a pivot is joined on its own, window by window; what lies
   beyond, with the border between t and 2 t, is the region of the next round.
4. Regions that are small after a round are joined within themselves, and large ones are
   divided again as long as that makes them smaller; what never comes near a pivot is
   joined block by block. In all of this a pair is looked at closely only if the sizes
   of its sets and their images in spaces of few counts allow a link: a sketch of 32
   counts travels with the members, so that other pairs are never rows of a table.

Links within the class that is already known are not looked for; all links between
classes are. The classes are then merged along all links found.

A null or empty text has no shingles and is linked with nothing. Rows without a doc_id
belong to their class but don't name it. Rows with one doc_id are documents of their own
and may be in different classes. An empty table gives an empty result. Sets are told apart
by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationdays.llm.components import components
from stationdays.llm.tokens import utf8
from stationdays.llm.words import find_words, mix, runs, window_hashes, windows_of, word_hashes
from stationdays.llm.workers import thrifty
from stationdays.llm.kept import cut_lineage, forget, small_batches

WIDTH = 5
PERCENT = 80

SKETCH_BITS = 20
COUNT_PARTS = 16
SMALL_REGION = 64
"""Regions of up to so many members are joined pair by pair after the first round."""
LEAST_PROGRESS = 0.75
"""Large regions are divided again if the last time left at most this share of their rows;
what is left else are texts far from one another and from every pivot."""
ROWS_AT_ONCE = 256
"""Rows that Python gets in one batch."""
FEATURE_BITS = 5
"""A sketch counts shingles for each value of so many leading bits."""
BLOCK_SHINGLES = 400_000
"""Balls with more shingles than this in all are joined in blocks of about so many."""


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Of each text the ascending hashes of its different shingles; a text with fewer words
    has its whole sequence as one."""
    words = find_words(texts, lower=True)
    hashes = word_hashes(words)
    found, owner = windows_of(words, hashes, width)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = [
            window_hashes(hashes[words.first[i] : words.first[i + 1]], int(counts[i]))
            ^ np.uint64(counts[i])
            for i in short
        ]
        found, owner = np.concatenate([found, *whole]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        keep = np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]))
        found, owner = found[keep], owner[keep]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [found[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _each_set(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[np.ndarray]]]:
    texts = utf8(batch.column("text"))
    for rows in runs([len(t) for t in texts]):
        yield rows, shingle_sets(texts[rows])


def node_of(shingles: np.ndarray) -> int:
    """The name of a set: a hash of all its shingles."""
    return int(mix(np.array([mix(shingles).sum() + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def shingle_counts(documents: DataFrame) -> np.ndarray:
    """How often shingles come, summed over all documents for each value of their leading
    bits: a table of fixed size that orders shingles by rarity, roughly."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, sets in _each_set(batch):
                if sets:
                    places = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
                    total += np.bincount(places.astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"counts": [total.astype("<u4").tobytes()]})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for one in batch.column("counts").to_pylist():
                total += np.frombuffer(one, "<u4")
        total = np.minimum(total, np.iinfo(np.uint32).max)
        yield pa.RecordBatch.from_pydict({"counts": [total.astype("<u4").tobytes()]})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in summed(batches):
            whole = batch.column("counts").to_pylist()[0]
            size = len(whole) // COUNT_PARTS
            yield pa.RecordBatch.from_pydict(
                {
                    "part": list(range(COUNT_PARTS)),
                    "counts": [whole[i * size : (i + 1) * size] for i in range(COUNT_PARTS)],
                }
            )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "counts"))):
                one = np.frombuffer(counts, "<u4").astype(np.int64)
                totals[part] = totals[part] + one if part in totals else one
        for part, total in totals.items():
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "counts": [total.astype("<u8").tobytes()]}
            )

    # the tables of all tasks are summed up by the root of their number of tasks, then part
    # by part; the driver gets one table
    parts = documents.select("text").mapInArrow(thrifty(counted), "counts binary")
    some = parts.repartition(max(8, math.isqrt(documents.rdd.getNumPartitions())))
    found = (
        some.mapInArrow(thrifty(cut), "part long, counts binary")
        .repartition(COUNT_PARTS, "part")
        .mapInArrow(thrifty(joined), "part long, counts binary")
        .orderBy("part")
        .collect()
    )
    return np.concatenate([np.frombuffer(r["counts"], "<u8") for r in found]).astype(np.int64)


def rarity_levels(counts: np.ndarray) -> np.ndarray:
    """0 for values that come no more often than chance has it, then more by powers of 2.

    A value stands for many shingles, whose number varies by about its square root; what
    exceeds that four times is due to a shingle that comes often.
    """
    usual = max(float(counts.mean()), 1.0)
    excess = (counts - usual) / (4 * np.sqrt(usual))
    return np.maximum(np.ceil(np.log2(np.maximum(excess, 1e-9))) + 1, 0).astype(np.uint8)


def first_fifth(shingles: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles, in the fixed order, of which every partner's set has one.

    A partner shares at least percent of this set; so at most the rest of it is missing.
    """
    missing = len(shingles) * (100 - percent) // 100
    order = np.lexsort((shingles, levels[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
    return shingles[order[: missing + 1]]


def shape_of(shingles: np.ndarray) -> bytes:
    """How many shingles there are for each value of their leading bits, one byte each.

    Of two sets, these counts differ in all by at most what the sets differ by, so they
    give a least distance in a sixteenth of the space of the sets.
    """
    bits = max(4, int(len(shingles)).bit_length() - 1)
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """The same for a fixed number of values."""
    leading = (shingles >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    return np.bincount(leading, minlength=1 << FEATURE_BITS).astype(np.int32)


def shape_difference(a: bytes, b: bytes) -> int:
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (a, b))
    while len(x) > len(y):
        x = x[::2] + x[1::2]
    while len(y) > len(x):
        y = y[::2] + y[1::2]
    return int(np.abs(x - y).sum())


def node_rows(documents: DataFrame, levels: np.ndarray) -> DataFrame:
    """document, doc_id, node, n, first shingles, shape and sketch of each row of documents.

    `document` tells rows apart that differ in id or text.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, sets in _each_set(batch):
                ids = batch.column("doc_id").slice(which.start, which.stop - which.start)
                own = batch.column("document").slice(which.start, which.stop - which.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        own,
                        ids,
                        pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(
                            [first_fifth(s, levels).tobytes() if len(s) else None for s in sets],
                            pa.binary(),
                        ),
                        pa.array([shape_of(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(
                            [sketch_of(s) if len(s) else None for s in sets], pa.list_(pa.int32())
                        ),
                    ],
                    ["document", "doc_id", "node", "n", "first", "shape", "sketch"],
                )

    return documents.select(
        F.xxhash64(F.col("doc_id").cast("long"), "text").alias("document"),
        F.col("doc_id").cast("long"), "text",
    ).mapInArrow(
        thrifty(rows),
        "document long, doc_id long, node long, n long, first binary, shape binary,"
        " sketch array<int>",
    )


def memberships(nodes: DataFrame) -> DataFrame:
    """region, node, n: every node in the region of each of its first shingles, without
    regions of one node."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [np.frombuffer(b, np.int64) for b in batch.column("first").to_pylist()]
            if not first:
                continue
            sizes = np.array([len(f) for f in first])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(first)),
                    pa.array(np.repeat(batch.column("node").to_numpy(), sizes)),
                    pa.array(np.repeat(batch.column("n").to_numpy(), sizes)),
                ],
                ["region", "node", "n"],
            )

    every = nodes.mapInArrow(thrifty(rows), "region long, node long, n long")
    shared = every.groupBy("region").agg(F.count("*").alias("members")).where("members > 1")
    return every.join(shared.select("region"), "region", "left_semi")


def similar(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two ascending arrays."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common, len(a) + len(b) - common


def _shape(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def set_rows(documents: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, shingles of the nodes in pairs (a, b), one row each, from the texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _each_set(batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([node_of(s) for s in sets], pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["node", "shingles"],
                )

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # one document of each node; rows equal in id and text give a node twice
    chosen = nodes.join(asked, "node", "left_semi").groupBy("node").agg(
        F.min("document").alias("of")
    )
    texts = documents.select(
        F.xxhash64(F.col("doc_id").cast("long"), "text").alias("document"), "text"
    ).join(chosen, F.col("document") == F.col("of"), "left_semi")
    return (
        texts.select("text").mapInArrow(thrifty(rows), "node long, shingles binary")
        .groupBy("node").agg(F.first("shingles").alias("shingles"))
    )


def near_pairs(pairs: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and shapes allow them to share so many percent."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.array(
                [
                    shape_difference(x, y)
                    for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist())
                ],
                np.int64,
            )
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy() + least
            able = pa.array(200 * least <= (100 - percent) * total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(able), batch.column("b").filter(able)], ["a", "b"]
            )

    sides = (
        shapes.select(
            F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("shape").alias(f"x{c}")
        )
        for c in "ab"
    )
    sized = pairs.join(next(sides), "a").join(next(sides), "b")
    sized = sized.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(thrifty(rows), "a long, b long")


def with_pivots(member: DataFrame) -> DataFrame:
    """region, node, n, pivot: each region's most central node, for its members.

    Central is who shares regions with most others, for its size.
    """
    sized = member.join(
        member.groupBy("region").agg(F.count("*").alias("members")), "region"
    )
    central = sized.groupBy("node", "n").agg((F.sum("members") / F.col("n")).alias("central"))
    ranked = member.join(central.select("node", "central"), "node")
    # by sizes, then by the fixed number of the node
    best = ranked.groupBy("region").agg(
        F.max(F.struct("central", "node", "n")).alias("best"), F.count("*").alias("members")
    )
    return member.join(best, "region").select(
        "region", "node", "n", F.col("best.node").alias("pivot"),
        F.col("best.n").alias("pivot_n"), "members",
    )


def pair_distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds `common` and `either`, sizes of intersection and union, to pairs (a, b)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [
                similar(_shape(a), _shape(b))
                for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("a"),
                    batch.column("b"),
                    pa.array([s[0] for s in sizes], pa.int64()),
                    pa.array([s[1] for s in sizes], pa.int64()),
                ],
                ["a", "b", "common", "either"],
            )

    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return (
        pairs.join(first, "a").join(second, "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(thrifty(rows), "a long, b long, common long, either long")
    )


def _within(percent: int) -> Column:
    return 100 * F.col("common") >= percent * F.col("either")


def ball_links(balls: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: links inside balls (pivot, node, n, common, either) with a member beyond the
    limit; those within it are one class by their links to the pivot.

    A ball is cut into blocks of bounded size and every two blocks meet in a task of their
    own, if one of them has a member beyond the limit.
    """
    outer = ~_within(percent)
    sized = balls.groupBy("pivot").agg(
        F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"), F.max(outer).alias("needed")
    ).where("needed").select("pivot", "blocks")
    dealt = balls.join(sized, "pivot").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks"))
    ).withColumn("outer", outer)
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    # outer members of block i ask all members of block j: as askers they go to every j
    asked = dealt.withColumn("asker", F.explode(every)).select(
        "pivot", F.col("asker").alias("i"), F.col("block").alias("j"),
        F.lit(False).alias("asks"), "node", "common", "either",
    )
    askers = dealt.where("outer").withColumn("other", F.explode(every)).select(
        "pivot", F.col("block").alias("i"), F.col("other").alias("j"),
        F.lit(True).alias("asks"), "node", "common", "either",
    )
    meetings = asked.unionByName(askers).join(sets, "node")
    limit = (100 - percent) / 100

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        rows, mine = frame[~asks], frame[asks]
        found_a, found_b = [], []
        if len(rows) and len(mine):
            shingles = [_shape(b) for b in rows["shingles"]]
            sizes = np.array([len(s) for s in shingles])
            values, codes = np.unique(np.concatenate(shingles), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            nodes = rows["node"].to_numpy()
            common, either = rows["common"].to_numpy(), rows["either"].to_numpy()
            distance = 1 - common / either
            # classes as known here; those within the limit of the pivot are one already
            of = np.where(100 * common >= percent * either, -1, np.arange(len(rows)))
            here = {node: i for i, node in enumerate(nodes.tolist())}
            for node, blob, c, e in zip(
                mine["node"].tolist(), mine["shingles"], mine["common"], mine["either"]
            ):
                own = _shape(blob)
                mark = np.zeros(len(values), bool)
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                mark[at[values[at] == own]] = True
                # the window that the triangle inequality leaves, a little wider than it is
                near = np.abs(distance - (1 - c / e)) <= limit + 1e-9
                shared = np.add.reduceat(mark[codes], starts, dtype=np.int64)
                linked = near & (100 * shared >= percent * (sizes + len(own) - shared))
                known = of[here[node]] if node in here else None
                for label in np.unique(of[linked & (nodes != node)]).tolist():
                    # one link into a class is as good as all
                    if label != known:
                        found_a.append(node)
                        found_b.append(nodes[np.flatnonzero(linked & (of == label))[0]])
                    if known is None:
                        known = label
                    else:
                        of[of == label] = known
        return pd.DataFrame({"a": found_a, "b": found_b}, dtype="int64")

    return meetings.groupBy("pivot", "i", "j").applyInPandas(join, "a long, b long")


def region_pairs(member: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Different pairs of members of small regions whose sizes and sketches allow a link.

    A region is one row with its members by size; only pairs that pass become rows.
    """
    listed = (
        member.join(sketches, "node")
        .groupBy("region")
        .agg(F.sort_array(F.collect_list(F.struct("n", "node", "sketch"))).alias("all"))
    )
    pairs = F.expr(f"""
        flatten(transform(all, (x, i) -> transform(
            filter(slice(all, i + 2, size(all)), y ->
                100 * x.n >= {percent} * y.n
                AND {100 + percent} * aggregate(
                    zip_with(x.sketch, y.sketch, (p, q) -> abs(p - q)), 0, (total, d) -> total + d
                ) <= {100 - percent} * (x.n + y.n)),
            y -> struct(least(x.node, y.node) AS a, greatest(x.node, y.node) AS b))))""")
    return listed.select(F.explode(pairs).alias("pair")).select("pair.*").where("a <> b").distinct()


def block_pairs(placed: DataFrame, shapes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Different pairs of nodes of one pivot's regions whose shapes allow a link.

    Every two blocks of bounded size of a pivot's nodes meet in a task of their own.
    """
    own = placed.select("pivot", "node").distinct().join(shapes, "node")
    sized = own.groupBy("pivot").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    dealt = own.join(sized, "pivot").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks"))
    ).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    meetings = dealt.select(
        "pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "n", "shape",
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        # one size of shape at a time, so that shapes are rows of one array
        frame = frame.sort_values("n", ignore_index=True)
        sizes, nodes = frame["n"].to_numpy(), frame["node"].to_numpy()
        block, width = frame["block"].to_numpy(), frame["shape"].map(len).to_numpy()
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        shapes_of = [np.frombuffer(s, np.uint8).astype(np.int32) for s in frame["shape"]]
        folded: dict[int, np.ndarray] = {}
        for size in np.unique(width).tolist():
            # shapes of twice the size, folded, may still be near enough in size
            rows = [
                s if len(s) == size else s.reshape(-1, len(s) // size).sum(1)
                for s in shapes_of if len(s) in (size, 2 * size)
            ]
            folded[size] = np.array(rows)
        places = {s: np.flatnonzero((width == s) | (width == 2 * s)) for s in folded}
        for x in range(len(frame)):
            size = int(width[x])
            at = places[size]
            mine = folded[size][np.searchsorted(at, x)]
            able = (at > x) & (100 * sizes[x] >= percent * sizes[at])
            if i != j:
                able &= block[at] != block[x]
            at, rows = at[able], folded[size][able]
            least = np.abs(rows - mine).sum(1)
            near = at[200 * least <= (100 - percent) * (sizes[x] + sizes[at] + least)]
            found_a.append(np.full(len(near), nodes[x]))
            found_b.append(nodes[near])
        return pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    pairs = meetings.groupBy("pivot", "i", "j").applyInPandas(compare, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(
        "a <> b"
    ).distinct()


def links(documents: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> list[DataFrame]:
    """Tables a, b of links between nodes that join the same nodes together as all links would."""
    wide = 2 * percent - 100
    kept = nodes.where("node IS NOT NULL")
    single = cut_lineage(
        kept.groupBy("node", "n").agg(
            *[F.first(c).alias(c) for c in ("first", "shape", "sketch")]
        )
    )
    shapes, sketches = single.select("node", "n", "shape"), single.select("node", "sketch")
    member = cut_lineage(memberships(single.select("node", "n", "first")))
    left, found = member.count(), []
    while left:
        placed = cut_lineage(with_pivots(member))
        pairs = (
            placed.where("node <> pivot")
            .select(F.col("node").alias("a"), F.col("pivot").alias("b"))
            .distinct()
        )
        # what isn't near by sizes and shapes is beyond twice the limit
        pairs = cut_lineage(near_pairs(pairs, shapes, wide))
        sets = cut_lineage(set_rows(documents, kept, pairs))
        measured = cut_lineage(pair_distances(pairs, sets), pairs)
        stars = measured.where(_within(percent)).select("a", "b")
        # twice the limit: beyond it no member can be linked to one within the limit
        ball = measured.where(_within(wide))
        ball = ball.select(F.col("b").alias("pivot"), F.col("a").alias("node"), "common", "either")
        ball = ball.join(single.select("node", "n"), "node")
        found.append(cut_lineage(stars.unionByName(ball_links(ball, sets, percent)), sets))
        far = placed.where("node <> pivot").join(
            measured.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "common", "either"),
            ["node", "pivot"], "left",
        )
        inside = F.coalesce(_within(percent), F.lit(False))
        beyond = ~F.coalesce(_within(wide), F.lit(False))
        rest = far.where(~inside).select("region", "node", "n", beyond.alias("beyond"))
        open_regions = rest.groupBy("region").agg(
            F.max("beyond").alias("any_beyond"), F.count("*").alias("left")
        ).where("any_beyond AND left > 1")
        rest = cut_lineage(
            rest.join(open_regions, "region").select("region", "node", "n", "left"),
            placed, measured, member,
        )
        small = rest.where(F.col("left") <= SMALL_REGION).select("region", "node", "n")
        found.append(
            _close_links(documents, kept, shapes, region_pairs(small, sketches, percent), percent)
        )
        member = cut_lineage(
            rest.where(F.col("left") > SMALL_REGION).select("region", "node", "n"), rest
        )
        before, left = left, member.count()
        if left > LEAST_PROGRESS * before:
            blocks = block_pairs(with_pivots(member), shapes, percent)
            found.append(_close_links(documents, kept, shapes, blocks, percent))
            break
    forget(member, single)
    return found


def _close_links(
    documents: DataFrame, nodes: DataFrame, shapes: DataFrame, pairs: DataFrame, percent: int
) -> DataFrame:
    """The pairs that are links, by their whole sets."""
    close = cut_lineage(near_pairs(pairs, shapes, percent))
    sets = set_rows(documents, nodes, close)
    return cut_lineage(
        pair_distances(close, sets).where(_within(percent)).select("a", "b"), close
    )


def jaccard_classes(documents: DataFrame) -> DataFrame:
    """document, doc_id, n_shingles and `node`, the class of equal sets, `component`, the
    class of linked sets; both null for documents without words."""
    rows = documents.select("doc_id", "text")
    # a row may hold two sets of a long text each
    with small_batches(documents.sparkSession, ROWS_AT_ONCE):
        levels = rarity_levels(shingle_counts(rows))
        nodes = cut_lineage(node_rows(rows, levels))
        found = links(rows, nodes)
        every = reduce(DataFrame.unionByName, found) if found else no_links(nodes)
        joined = components(every)
    return cut_lineage(
        nodes.join(joined, "node", "left").select(
            "document", "doc_id", F.col("n").alias("n_shingles"), "node",
            F.coalesce("component", "node").alias("component"),
        ),
        nodes, joined, *found,
    )


def no_links(nodes: DataFrame) -> DataFrame:
    return nodes.where("false").select(F.col("node").alias("a"), F.col("node").alias("b"))


def jaccard_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    classes = jaccard_classes(documents)
    smallest = (
        classes.where("component IS NOT NULL")
        .groupBy("component").agg(F.min("doc_id").alias("smallest"))
    )
    return classes.join(smallest, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id")
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """Rows of documents, one of each class of linked ones: the smallest doc_id stays.

    Documents without words all stay, but of rows that are equal in id and text one stays.
    A class without any doc_id keeps one of its texts.
    """
    classes = jaccard_classes(documents)
    linked = classes.where("component IS NOT NULL").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "document")).alias("first")
    )
    stay = linked.select("first.document").unionByName(
        classes.where("component IS NULL").select("document").distinct()
    )
    own = documents.withColumn("__document", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    stay = stay.withColumnRenamed("document", "__stay")
    kept = own.join(stay, F.col("__document") == F.col("__stay"), "left_semi")
    again = classes.groupBy("document").agg(F.count("*").alias("rows")).where("rows > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["__document"])
    return kept.drop("__document")
