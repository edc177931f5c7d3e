"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationdays.llm.kept import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of links (a, b) is joined to.

    Every round hangs all larger neighbours of a node, then all its smaller ones, on the
    smallest of them, until nothing moves; a node with many neighbours is only ever the
    key of a minimum and of a join. Nodes without a link to another have no row. Links may
    come repeatedly and in either direction.
    """
    edges = cut_lineage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b").distinct()
    )
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        ).distinct()
        large = cut_lineage(large.where("a <> b"))
        # now every row goes from a node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a")
        edges = cut_lineage(
            small.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(least.select("a", F.col("least").alias("b")))
            .distinct(),
            edges, large,
        )
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return cut_lineage(
        edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
            roots.select("node", F.col("node").alias("component"))
        ),
        edges,
    )
