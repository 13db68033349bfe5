"""Connected components of an edge table, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` (smallest node of its component) for every node of
    ``edges`` that is not itself a root.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the smallest node it knows; no round makes more edges than it got.  Minima
    are partial on the map side and written before they are joined, so that
    both sides of a join are plain shuffles, which AQE splits at a hot node.
    Each round is written to the shared folder; the loop ends when a round
    changes nothing."""
    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                 .where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), "large")
        # a node has few smaller neighbours left here, so this join has no hot node
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = stored(small, "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
