"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def components(links: DataFrame, what: str = "components") -> DataFrame:
    """node and root (the smallest node reachable) for every node of links (a, b); a = b is allowed.

    Each round is written to the shared folder, which cuts the lineage.  Hubs
    are joined, not collected, so AQE can split them.  The number of rounds
    grows with the logarithm of the longest chain.
    """
    def seal(df):
        df = materialise(df.where("a != b").distinct(), what)
        n, total = df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        return df, (n, total)

    edges, mark = seal(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while mark[0]:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges, now = seal(small)
        if now == mark:
            break
        mark = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
