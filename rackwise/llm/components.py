"""Connected components of a table of links, without a graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackwise.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked to by any path, for every node of ``links`` (``a``, ``b``).

    Rounds of two steps: every node hands its larger neighbours to the smallest one it knows, then
    every node's smaller neighbours (and itself) go to the smallest. The number of rounds grows with
    the logarithm of the longest chain. Each round is written to the shared folder. Minima are taken
    before the join, so a node with very many links is folded in the tasks that read them, and the
    join is one that Spark can split.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "links-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        links = stored(small.select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct(), "links-small")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
