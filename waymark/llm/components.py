"""Connected components over a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.sources.warehouse import staged


def connected(links: DataFrame) -> DataFrame:
    """Links (``a``, ``b``), longs → (``node``, ``root``) of every linked node.

    Alternating large-star and small-star steps: each step points the larger
    neighbours of a node at the smallest one it knows, until every component is a
    star around its smallest node. A node is only ever grouped by its minimum, so
    a component that holds a third of all nodes needs no large group. Nulls and
    links of a node to itself are ignored. Every round is written, so a lost
    executor costs one round.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = staged(ends, "links"), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before or state["n"] == 0:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        edges = staged(hooked.unionByName(own).where("a <> b").distinct(), "small-star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
