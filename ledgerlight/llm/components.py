"""Connected components of a link table, by alternating large-star and small-star steps.

Each step replaces links so that every node points at the smallest node near
it; the tables stay distributed, and no node's neighbours are ever gathered:
the smallest neighbour is an aggregate that Spark combines before the shuffle,
and it goes back to the links by a join that splits the links of a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import attached, discard, stored

ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node reachable, for each node that has a link."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "links")
    before = None
    for _ in range(ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, nodes = now, 2 * now[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = attached(both, least, "u", "v", nodes).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = attached(large, least, "u", "v", nodes).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        last, edges = edges, stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "links")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
