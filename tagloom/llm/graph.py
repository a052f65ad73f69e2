"""Connected components of links, without gathering a component anywhere."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stash


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), root being the smallest node that can be reached.

    Alternates the large-star and small-star steps of Kiveris et al. until the links no longer change. A step is a minimum by node,
    aggregated before the shuffle, and an equi-join back to the links: the links of a hub are rows, never a list. Every round is
    written to the shared folder. A null end or a link to itself is ignored; no links give no rows.
    """
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
        state, before = seen, edges
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = stash(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        forget(before)
