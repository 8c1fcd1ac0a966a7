"""Connected components of a link table by alternating large-star and small-star steps.

Links stay distributed; each round is two aggregations and joins whose lineage is cut through the
shared checkpoint folder. The number of rounds grows with the logarithm of the longest chain.

Few links are held in few partitions, and their nodes' smallest neighbours are broadcast: a round then
is a handful of tasks, where each exchange to all partitions would leave thousands of small files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links up to which they are held in few partitions and joined by broadcasts, and those of a partition.
FEW_LINKS, LINKS_A_PART = 200_000, 50_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of links: the component is its smallest node.

    Links may repeat, point either way or at themselves. An empty table gives an empty one.
    """
    edges = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    n = edges.count()
    # a round makes at most two links of one
    parts = -(-2 * n // LINKS_A_PART) if n <= FEW_LINKS else 0
    held = (lambda df: df.coalesce(max(1, parts))) if n <= FEW_LINKS else (lambda df: df)
    sent = F.broadcast if n <= FEW_LINKS else (lambda df: df)
    edges, before = held(edges), None
    while True:
        # large star: a node's larger neighbours, and with them its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = held(both.join(sent(held(low)), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node's smaller neighbours and itself point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(sent(held(low)), "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = cut(held(small))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(state):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                held(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            )
        before = tuple(state)
