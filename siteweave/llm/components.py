"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import durable


def _totals(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.hash("src", "dst").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(src, dst): every node that is not the least of its component, once, with that least.

    edges(src long, dst long) may have repeats, loops and either direction. Each round is two aggregations by node and
    two joins with their results, written to the shared folder; nothing is collected but a count and a checksum.
    """
    edges = durable(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = _totals(edges)
    for _ in range(most_rounds):
        if not before[0]:
            return edges
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        large = both.join(low, "src").filter("dst > src and dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(least, "src").filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        edges = durable(small.union(least.select("src", F.col("low").alias("dst"))).distinct())
        after = _totals(edges)
        if after == before:
            return edges
        before = after
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
