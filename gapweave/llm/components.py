"""Connected components of an edge table, by rounds of joins; nothing is collected."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b long.  node, root long for every node on an edge: root is the smallest node of its component.

    Large-star and small-star rounds: every node's larger neighbours are hung below its smallest one, then its smaller
    ones; the number of rounds grows with the logarithm of a component's size.  Each round is written to the shared
    folder, which cuts the lineage.
    """
    now = materialised(edges.select("a", "b").filter("a <> b").distinct(), "cc")
    before = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = materialised(small.union(low2.select("a", F.col("m").alias("b"))).distinct(), "cc")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
