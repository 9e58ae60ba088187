"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelspark.llm.storage import write_table


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, label): every node that has a link, with the smallest node of its component.

    Alternates large-star and small-star steps, in which every node points its larger (then its smaller) neighbours to the
    smallest one it knows.  The number of rounds grows with the logarithm of the component's size.  Each round is a table
    in the shared folder; neighbours are reduced by an aggregation, never gathered.
    """
    edges = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = write_table(small, "stars")
        # Done once every node points to one root, and no root points anywhere.
        roots = edges.select(F.col("b").alias("a")).distinct()
        more = edges.groupBy("a").count().where("count > 1").select("a").unionByName(edges.select("a").join(roots, "a", "left_semi"))
        if more.isEmpty():
            break
    roots = edges.select(F.col("b").alias("a"), "b").distinct()
    return edges.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("label"))
