"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import staged
from ruleloom.session import shuffled


def _stars(edges: DataFrame, smaller: bool) -> DataFrame:
    """One round: each node's neighbours (all larger ones, or all smaller ones) move to its least one."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = back if smaller else edges.unionByName(back)
    least = staged(near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
    if smaller:
        moved = near.join(shuffled(least), "a").select(F.col("b").alias("x"), "m")
        moved = moved.unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        moved = near.where("b > a").join(shuffled(least), "a").select(F.col("b").alias("x"), "m")
    return moved.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node in ``links`` (a, b); ``root`` is the component's least node.

    Self-links and repeated links do no harm; a link with a null end is none. Each round is one
    aggregate and one join over the links, so a hub with most of the links is summed map-side and
    its join partition can be split. The number of rounds grows with the logarithm of the longest
    chain. No table gives an empty result.
    """
    edges = staged(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state(edges)
    while seen[0]:
        edges = staged(_stars(staged(_stars(edges, smaller=False)), smaller=True))
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
