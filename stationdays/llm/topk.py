"""Exact top-k by inner product with MaxScore.

A dimension is a term and a component's sign tells which of its two posting lists has the
vector: for a query component q, vectors with a component of the same sign gain score from
that list, others gain none. A list's bound is the greatest gain it gives in its shard.
Lists that even together cannot lift a vector to the k-th best score found are not
essential: a vector in none of the essential lists is out, and the remaining lists are
probed in descending order of bounds, only for vectors that can still get there.

Vectors are dealt out in shards, queries in blocks, and every block meets every shard;
each meeting keeps k rows per query, which are merged.

Vectors that are null, or hold a null or non-finite component, take no part. Only vectors
of a query's own length are its candidates. Rows with one vec_id are all candidates, but
never of queries with that id. Ties go to the smaller vec_id. An empty table gives an
empty result. Scores must fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
QUERY_EVERY = 50
K = 5
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
PROBE = 8
"""Lists probed between two looks at which vectors are still competitive."""

EXACT = 1 << 53


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * component), and dim; without vectors that take no part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(v.isNotNull() & finite & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
        F.size(v).alias("dim"),
    )


def _packed(rows: DataFrame, group: str) -> DataFrame:
    """One row per (dim, group): the ids and the matrix of its vectors as bytes."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        ids = frame["vec_id"].to_numpy(np.int64)
        matrix = np.array(frame["v"].tolist(), np.int64).reshape(len(ids), -1)
        return pd.DataFrame(
            {
                "dim": [frame["dim"].iloc[0]],
                group: [frame[group].iloc[0]],
                f"{group}_ids": [ids.tobytes()],
                f"{group}_vectors": [_narrow(matrix).tobytes()],
                f"{group}_width": [_narrow(matrix).itemsize],
            }
        )

    return rows.groupBy("dim", group).applyInPandas(
        pack,
        f"dim int, {group} long, {group}_ids binary, {group}_vectors binary, {group}_width int",
    )


def _narrow(matrix: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if not matrix.size or np.abs(matrix).max() <= np.iinfo(kind).max:
            return matrix.astype(kind)
    return matrix


def _unpack(ids: bytes, vectors: bytes, width: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(vectors, f"i{width}").reshape(len(own), dim).astype(np.int64)


class Shard:
    """Posting lists of one shard: for each dimension its greatest and least component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.highest = vectors.max(0) if len(ids) else np.zeros(vectors.shape[1], np.int64)
        self.lowest = vectors.min(0) if len(ids) else self.highest
        self.vectors = vectors
        self._floats = vectors.astype(np.float64)

    def _columns(self, q: np.ndarray) -> np.ndarray:
        """Components in a type in which sums of products with q are exact."""
        most = max(int(np.abs(self.highest).max(initial=0)), int(np.abs(self.lowest).max(initial=0)))
        whole = most * int(np.abs(q).sum())
        if whole >= 1 << 63:
            raise OverflowError("inner products beyond 64 bits")
        return self._floats if whole < EXACT else self.vectors

    def search(self, q: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, best first."""
        columns = self._columns(q)
        q = q.astype(columns.dtype)
        gain = np.maximum(np.maximum(q * self.highest, q * self.lowest), 0)
        order = np.argsort(-gain, kind="stable")
        columns, q, gain = columns[:, order], q[order], gain[order]
        # what this list and all after it can still add
        rest = np.append(np.cumsum(gain[::-1])[::-1], 0)
        lead = min(PROBE, len(q))
        score = columns[:, :lead] @ q[:lead]
        other = self.ids != own_id
        # a first threshold: exact scores of vectors that lead after a few lists
        few = min(len(score), 4 * k + 1)
        best = np.argpartition(-score, few - 1)[:few] if few else np.zeros(0, int)
        exact = np.sort((columns[best] @ q)[other[best]])
        threshold = exact[-k] if len(exact) >= k else -np.inf
        # lists from `essential` on lift no vector to the threshold by themselves
        essential = int(np.searchsorted(-rest, -threshold, side="right"))
        essential = min(max(essential, lead), len(q))
        listed = ((columns[:, :essential] * q[:essential]) > 0).any(1) if essential < len(q) else True
        alive = np.flatnonzero(other & listed & (score + rest[lead] >= threshold))
        score, done = score[alive], lead
        while done < len(q) and len(alive):
            to = min(done + PROBE, len(q))
            score = score + columns[alive, done:to] @ q[done:to]
            done = to
            if len(score) >= k:
                # parts that are sure: what is left can take away at most this much
                keep = score + rest[done] >= threshold
                alive, score = alive[keep], score[keep]
        top = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive[top]], score[top].astype(np.int64)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other vectors of every query.

    Both tables have vec_id, v and dim. Blocks and shards are met as rows of a join by
    length, a block and a shard at a time; their sizes are bounded, their numbers grow.
    """
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    dealt = F.xxhash64("vec_id", "v")
    packed = _packed(vectors.withColumn("shard", F.pmod(dealt, F.lit(shards))), "shard")
    asked = _packed(queries.withColumn("block", F.pmod(dealt, F.lit(blocks))), "block")
    every = F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")
    # each shard goes once to every block, each pair to a task of its own
    meetings = packed.withColumn("block", F.explode(every)).join(asked, ["dim", "block"])
    meetings = meetings.repartition(shards * blocks, "shard", "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                shard = Shard(*_unpack(row.shard_ids, row.shard_vectors, row.shard_width, row.dim))
                ids, vectors = _unpack(row.block_ids, row.block_vectors, row.block_width, row.dim)
                found = [shard.search(q, i, k) for i, q in zip(ids.tolist(), vectors)]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(ids, [len(f[0]) for f in found]),
                        "vec_id": np.concatenate([f[0] for f in found]),
                        "score": np.concatenate([f[1] for f in found]),
                    }
                )

    found = meetings.mapInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def embedding_top_k(embeddings: DataFrame) -> DataFrame:
    vectors = whole_vectors(embeddings.select("vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (
    SELECT q.vec_id AS query_id, c.vec_id, q.v AS a, c.v AS b
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
scored AS (
    SELECT query_id, vec_id,
           CAST(list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i])) AS BIGINT) AS score
    FROM parts
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
      FROM scored)
WHERE place <= 5
"""
