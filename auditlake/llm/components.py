"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (partial aggregates) and a join with it, so a node with very many links is no large
group; each round is written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import materialise


def _hang(arcs: DataFrame) -> DataFrame:
    """From arcs (node, other): each ``other`` linked to the smallest of ``node`` and all its others, as (low, high)."""
    least = arcs.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("low"))
    return arcs.join(least, "node").select("low", F.explode(F.array("node", "other")).alias("high")).where("low < high").distinct()


def large_star(links: DataFrame) -> DataFrame:
    """Links (low, high): every larger neighbour of a node goes to the least of the node's neighbourhood."""
    both = links.select(F.col("low").alias("node"), F.col("high").alias("other")).union(links.select(F.col("high").alias("node"), F.col("low").alias("other")))
    least = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("low"))
    return both.where("other > node").join(least, "node").select("low", F.col("other").alias("high")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Links (low, high): a node and its smaller neighbours go to the least of these."""
    return _hang(links.select(F.col("high").alias("node"), F.col("low").alias("other")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (low, high; low < high); root is the least node that can be reached, roots included."""
    links = materialise(links.distinct(), "links")
    before = None
    while True:
        links = materialise(small_star(large_star(links)), "links")
        state = links.agg(F.count("*"), F.sum(F.col("low").cast("decimal(38,0)")), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return links.select(F.col("high").alias("node"), F.col("low").alias("root")).union(links.select("low", "low").distinct())
