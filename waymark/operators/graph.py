"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.sources.warehouse import staged


def connected(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) of every node of the links (``a``, ``b``): root is the smallest node that links lead to.

    Each round every node looks at the smallest root among its neighbours, and roots that have met
    a smaller one point to it, over which their nodes then jump. Nodes only ever exchange minima, so
    a component of any size is never gathered. A written table is one round's state.
    """
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = staged(both.distinct(), "component_links")
    state = staged(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), "component_roots")
    while True:
        seen = edges.join(state.select(F.col("node").alias("b"), F.col("root").alias("other")), "b")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("other").alias("least"))
        told = state.join(least, "node")
        # a root moves to the least that any of its nodes has met
        moves = staged(told.groupBy("root").agg(F.min("least").alias("to")).where("to < root"), "component_moves")
        if moves.isEmpty():
            return state
        # and along with it, as far as the roots it moves to move themselves
        while True:
            further = moves.select(F.col("root").alias("to"), F.col("to").alias("next"))
            jumped = moves.join(further, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("on"))
            jumped = staged(jumped, "component_jumps")
            moves = jumped.select("root", "to")
            if jumped.where("on").isEmpty():
                break
        state = staged(state.join(moves, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "component_roots")
