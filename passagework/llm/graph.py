"""Connected components of an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import save


def _smallest(links: DataFrame) -> DataFrame:
    """For every node of directed links the smallest of itself and its neighbours."""
    return links.groupBy("a").agg(F.min("b").alias("low")).select(
        "a", F.least("a", "low").alias("low")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge table; the component is its smallest node.

    Alternates large and small stars: every round hangs the neighbours of a node on the
    smallest node that it knows, first the larger neighbours, then the smaller ones, until
    nothing moves. Rounds are few (logarithmic in the longest path in practice), each
    writes the edges to the shared folder, and no node's neighbours are gathered in one
    row, so a node that holds a third of all edges is only a skewed join key.

    Edges with a null end are ignored; loops keep their node; repeated edges count once.
    """
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )
    now = save(
        given.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    nodes = now.select("a").union(now.select("b")).distinct()
    mark = None
    while True:
        both = now.where("a != b").unionByName(now.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_smallest(both), "a").where("b > a").select(
            F.col("b").alias("a"), F.col("low").alias("b")
        ).distinct()
        low = _smallest(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        star = small.unionByName(low.select("a", F.col("low").alias("b")))
        now = save(star.where("a != b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return nodes.select(F.col("a").alias("node")).join(
        now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left"
    ).select("node", F.coalesce("component", "node").alias("component"))
