"""Connected components of undirected links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import materialize


def link_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every id that has a link; ``comp`` is the smallest id it can reach.

    Alternates two steps until nothing changes: every node points its larger neighbours to its
    smallest one, then its smaller neighbours.  Links become stars around the smallest id in a
    number of rounds that grows with the logarithm of the size.  Rounds are written, and a hot
    node is only aggregated and joined, never gathered.
    """
    cur = materialize(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "stars")
    seen = None
    while True:
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        cur = materialize(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "stars")
        sums = cur.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if sums == seen:
            break
        seen = sums
    ends = cur.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))
    return ends.unionByName(cur.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())
