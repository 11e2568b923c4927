"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointset.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v), longs -> rows (node, component): for every node that has a link, the smallest node that it reaches.

    Each round hangs a node's larger neighbours, then its smaller ones, on its smallest neighbour, and both halves are written to the
    shared folder; stars, once they are all, stay as they are, and the round that changes nothing is the last.  Rounds are
    few (logarithmic in a component's size), and a node with very many links is never gathered in one task: only minima are.
    Null ends and links of a node to itself are left out; an empty table gives an empty one.
    """
    digest = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("digest"))
    e, now = scratch.written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links", *digest)
    before = None
    while now != before and now["n"]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = now
        e, now = scratch.written(small.unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "links", *digest)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select("v", "v").toDF("node", "component").distinct())
