"""Prefix trie of conversations, built and summed up by halving its depth.

As in the van Emde Boas layout, a trie over depths [low, high) is cut at half depth. Every
prefix that ends just above the cut has a name; the upper trie takes one sequence for each
such name, however many go on below, and each name has a lower trie of its own. Upper and
lower parts are cut again, all parts of a level at once, until parts are one deep: then
there is one row per node. Totals go the other way: part by part of one height, what the
lower tries' roots have is summed up per name and grafted on every node of the upper trie's
path that ends in it, which the cut has kept.

A prefix is named by two 64-bit hashes of all its turns and their places, so a name is the
same wherever the prefix comes. Copies of a conversation are one sequence after the first
shuffle. Rows carry names and numbers; texts are read once. The number of steps is that of
halvings of the longest conversation; every step is written to the shared folder.

Turns come in the order of turn (null first), then role, then text. Null roles and texts
are empty ones, rows without a conv_id belong to no conversation. Repeated rows are turns of
their own. An empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationdays.llm.kept import cut_lineage, forget

CHUNK_BITS = 12
"""Ids that end in one node are written down together for each range of 2**12."""

FAMILY = 5
MOST_SHARED = 9


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place from 0, turn hash `ha`, `hb` and UTF-8 bytes `n_bytes` of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), "role", "ha", "hb"
    )
    told_apart = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    return (
        conversations.where("conv_id IS NOT NULL")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
            text.alias("text"),
        )
        .select(
            "conv_id", "turn", "role", F.octet_length("text").cast("long").alias("n_bytes"),
            F.md5(told_apart).alias("digest"),
        )
        .select(
            "conv_id", "turn", "role", "n_bytes",
            _half("digest", 0).alias("ha"), _half("digest", 1).alias("hb"),
        )
        .select("conv_id", (F.row_number().over(order) - 1).alias("place"), "ha", "hb", "n_bytes")
    )


def _half(digest: str, half: int) -> Column:
    """Half of a digest in hexadecimal digits as a signed number of 64 bits."""
    return F.conv(F.substring(digest, 1 + 16 * half, 16), 16, -10).cast("long")


def with_shared_starts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations rebuilt on the first turns of their family's first one, and
    their ids, also of those that are left without a turn."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    own = F.col("conv_id") % FAMILY == 0
    ids = (
        sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .join(bases, "base", "left")
        .withColumn("h", F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED)
        .select(
            "conv_id", "base", "h",
            F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))).alias("taken"),
        )
    )
    kept = turns.join(ids.select("conv_id", "h", "taken"), "conv_id").where(
        own | (F.col("place") >= F.col("h"))
    )
    kept = kept.select(
        "conv_id",
        F.when(own, F.col("place")).otherwise(F.col("place") - F.col("h") + F.col("taken")).alias("place"),
        "ha", "hb", "n_bytes",
    )
    first = turns.where(F.col("place") < MOST_SHARED - 1).withColumnRenamed("conv_id", "of")
    given = (
        ids.where(~own & (F.col("taken") > 0))
        .join(first, F.col("base") == F.col("of"))
        .where(F.col("place") < F.col("taken"))
        .select("conv_id", "place", "ha", "hb", "n_bytes")
    )
    return kept.unionByName(given), ids.select("conv_id")


# ------------------------------------------------------------------------ building


def named_prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for every prefix of every conversation, the empty one included: its name (a, b),
    that of the prefix before it (pa, pb) and of the whole conversation (ka, kb), the bytes
    of its last text and of all its texts."""
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    tags = turns.select(
        "conv_id", "place", "n_bytes",
        F.xxhash64(F.lit("a"), "ha", "hb", "place").alias("ta"),
        F.xxhash64(F.lit("b"), "hb", "ha", "place").alias("tb"),
    )
    whole = tags.groupBy("conv_id").agg(
        F.bit_xor("ta").alias("ka"), F.bit_xor("tb").alias("kb")
    )
    zero = F.lit(0).cast("long")
    keys = ids.join(whole, "conv_id", "left").select(
        "conv_id", F.coalesce("ka", zero).alias("ka"), F.coalesce("kb", zero).alias("kb")
    )
    rows = (
        tags.withColumn("a", F.bit_xor("ta").over(upto))
        .withColumn("b", F.bit_xor("tb").over(upto))
        .withColumn("upto_bytes", F.sum("n_bytes").over(upto))
        .join(keys, "conv_id")
        .select(
            "conv_id", "ka", "kb", (F.col("place") + 1).cast("long").alias("depth"), "a", "b",
            F.col("a").bitwiseXOR(F.col("ta")).alias("pa"),
            F.col("b").bitwiseXOR(F.col("tb")).alias("pb"),
            "n_bytes", "upto_bytes",
        )
    )
    nothing = F.lit(None).cast("long")
    roots = keys.select(
        "conv_id", "ka", "kb", zero.alias("depth"), zero.alias("a"), zero.alias("b"),
        nothing.alias("pa"), nothing.alias("pb"), zero.alias("n_bytes"),
        zero.alias("upto_bytes"),
    )
    return rows.unionByName(roots)


def build(prefixes: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """One row per node; for each height of the parts, from the lowest, the paths (a, b) above
    each cut, by the name (ka, kb) that they end in; and the tables that all this reads."""
    rows = cut_lineage(
        prefixes.drop("conv_id").dropDuplicates(["ka", "kb", "depth"])
    )
    tables, paths = [rows], []
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    for k in reversed(range(deepest.bit_length())):
        part, half = F.shiftright("depth", k + 1), 1 << k
        in_upper = F.col("depth").bitwiseAND(F.lit(half)) == 0
        # the last node above the cut, for each sequence that gets so far
        last = rows.where(F.col("depth") % (2 * half) == half - 1).select(
            F.col("ka").alias("oa"), F.col("kb").alias("ob"), part.alias("of"),
            F.col("a").alias("ca"), F.col("b").alias("cb"),
        )
        met = (F.col("ka") == F.col("oa")) & (F.col("kb") == F.col("ob")) & (part == F.col("of"))
        upper = cut_lineage(
            rows.where(in_upper)
            .join(last, met, "left")
            .select(
                F.coalesce("ca", "ka").alias("ka"), F.coalesce("cb", "kb").alias("kb"),
                *[c for c in rows.columns if c not in ("ka", "kb")],
                F.col("ca").isNotNull().alias("cut"),
            )
            .dropDuplicates(["ka", "kb", "depth"])
        )
        tables.append(upper)
        paths.insert(0, upper.where("cut").select("ka", "kb", "a", "b", "pa", "pb", "depth"))
        rows = upper.drop("cut").unionByName(rows.where(~in_upper))
    return rows.drop("ka", "kb"), paths, tables


def subtree_totals(
    nodes: DataFrame, paths: list[DataFrame], sums: list[str], least: list[str]
) -> tuple[DataFrame, list[DataFrame]]:
    """a, b and, of the columns `sums` and `least` of nodes (a, b, pa, pb, depth, ...), the sums
    and minima over each node's subtree; and the tables that they are read from."""
    totals = [F.sum(c).alias(c) for c in sums] + [F.min(c).alias(c) for c in least]
    place = ["a", "b", "pa", "pb", "depth"]
    known, gains = nodes.select(*place, *sums, *least), []
    for k, path in enumerate(paths):
        half = 1 << k
        # what the roots of lower tries have, for each end of an upper trie's path
        below = (
            known.where(F.col("depth") % (2 * half) == half)
            .groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(*totals)
        )
        gains.append(cut_lineage(path.join(below, ["ka", "kb"]).groupBy(*place).agg(*totals)))
        known = known.unionByName(gains[-1])
    return known.groupBy("a", "b").agg(*totals), gains


def end_digests(ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256: of the ids, ascending and joined by commas, of conversations that
    end in a node. The ids of a node pass through one task, some thousand in a row of text,
    and none is kept there."""
    chunks = ends.groupBy("a", "b", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>")).alias("ids")
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, sha256()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"a": [name[0]], "b": [name[1]], "ends_sha256": [digest.hexdigest()]}
            )

        for batch in batches:
            found = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if (a, b) == name:
                    digest.update(b"," + ids.encode())
                    continue
                if name is not None:
                    found.append(row())
                name, digest = (a, b), sha256(ids.encode())
            if found:
                yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]
        if name is not None:
            yield row()

    dealt = chunks.repartition("a", "b").sortWithinPartitions("a", "b", "chunk")
    return dealt.select("a", "b", "ids").mapInArrow(digests, "a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences `turns` (conv_id, place, ha, hb, n_bytes), whose
    ids, also those without a turn, are `ids`.

    A row has the node's name (a, b), its smallest member, depth, the parent's smallest
    member, numbers of members, children and leaves, the bytes that sharing saves, and a
    digest of the members that end there.
    """
    prefixes = cut_lineage(named_prefixes(turns, ids))
    rows, paths, tables = build(prefixes)
    ends = prefixes.where("depth = 0").select(F.col("ka").alias("a"), F.col("kb").alias("b"), "conv_id")
    ended = ends.groupBy("a", "b").agg(
        F.count("*").alias("ended"), F.min("conv_id").alias("conv_id")
    )
    children = rows.where("pa IS NOT NULL").groupBy(
        F.col("pa").alias("a"), F.col("pb").alias("b")
    ).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    nodes = cut_lineage(
        rows.join(ended, ["a", "b"], "left").join(children, ["a", "b"], "left").select(
            "a", "b", "pa", "pb", "depth", "n_bytes", "upto_bytes", "conv_id",
            F.coalesce("n_children", zero).alias("n_children"),
            F.coalesce("ended", zero).alias("n_convs"),
            F.col("n_children").isNull().cast("long").alias("n_leaves"),
            (F.coalesce("ended", zero) * F.col("upto_bytes")).alias("ended_bytes"),
            F.col("n_bytes").alias("node_bytes"),
        )
    )
    totals, gains = subtree_totals(
        nodes, paths, ["n_convs", "n_leaves", "ended_bytes", "node_bytes"], ["conv_id"]
    )
    # all members' bytes from the node on, less one copy of each
    above = F.col("upto_bytes") - F.col("n_bytes")
    saved = F.col("ended_bytes") - F.col("n_convs") * above - F.col("node_bytes")
    found = cut_lineage(
        nodes.select("a", "b", "pa", "pb", "depth", "n_bytes", "upto_bytes", "n_children")
        .join(totals, ["a", "b"])
        .select(
            "a", "b", "pa", "pb", "conv_id", "depth", "n_convs", "n_children", "n_leaves",
            saved.alias("saved_tokens"),
        )
    )
    parents = found.select(
        F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id")
    )
    result = cut_lineage(
        found.join(parents, ["pa", "pb"], "left")
        .join(end_digests(ends), ["a", "b"], "left")
        .select(
            "a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
    forget(prefixes, nodes, found, *gains, *tables)
    return result


def trie_report(conversations: DataFrame) -> DataFrame:
    turns = cut_lineage(ordered_turns(conversations))
    nodes = prefix_trie(*with_shared_starts(turns)).drop("a", "b")
    forget(turns)
    return nodes


ORACLE = """
WITH numbered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (
               PARTITION BY conv_id
               ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')
           ) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base,
           xor(
               list_reduce(
                   flatten(list_transform(
                       range(0, length(CAST(conv_id AS VARCHAR)) + 1),
                       lambda i: CASE WHEN i = 0 THEN [4294967295::BIGINT] ELSE
                           [ascii(CAST(conv_id AS VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
                       END
                   )),
                   lambda c, x: CASE
                       WHEN x >= 0 THEN xor(c, x)
                       WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT)
                       ELSE c // 2 END
               ),
               4294967295::BIGINT
           ) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM numbered)
),
rebuilt AS (
    SELECT i.conv_id, n.place, n.role, n.text
    FROM ids i JOIN numbered n ON n.conv_id = i.base AND n.place < i.h
    UNION ALL
    SELECT i.conv_id, n.place, n.role, n.text
    FROM ids i JOIN numbered n ON n.conv_id = i.conv_id AND n.place >= i.h
),
sequences AS (
    SELECT i.conv_id,
           coalesce(
               list(sha256(concat(length(r.role), ':', r.role, r.text)) ORDER BY r.place)
               FILTER (WHERE r.place IS NOT NULL), []
           ) AS names,
           coalesce(list(strlen(r.text) ORDER BY r.place) FILTER (WHERE r.place IS NOT NULL), []) AS sizes
    FROM ids i LEFT JOIN rebuilt r USING (conv_id)
    GROUP BY i.conv_id
),
members AS (
    SELECT conv_id, d AS depth, len(names) = d AS ends,
           array_to_string(names[1:d], '') AS node,
           array_to_string(names[1:d - 1], '') AS parent,
           CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS n_bytes
    FROM (SELECT *, unnest(range(0, len(names) + 1)) AS d FROM sequences)
),
nodes AS (
    SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
           (count(*) - 1) * any_value(n_bytes) AS saved,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM members GROUP BY node, depth
),
children AS (
    SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent
),
below AS (
    SELECT m.node, count(DISTINCT CASE WHEN c.n IS NULL THEN n.node END) AS n_leaves
    FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth
    LEFT JOIN children c ON c.node = n.node
    GROUP BY m.node
),
saved AS (
    SELECT m.node, sum(n.saved) AS saved_tokens
    FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth
    GROUP BY m.node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, b.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent
LEFT JOIN children c ON c.node = n.node
JOIN below b ON b.node = n.node
JOIN saved s ON s.node = n.node
"""
