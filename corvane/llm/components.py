"""Connected components of an edge table by rounds of re-rooting, then pointer jumping; nothing reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.scratch import dropped, few, small, stored


def components(edges: DataFrame, most: int = 100, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), root being the least node of its component.

    Edges point from the larger node a to the smaller b. A round keeps, for every a, the edge to its least b, and turns
    each other edge (a, b) into (b, least). The least b of each a are added up before the exchange, written, and
    broadcast up to `broadcast_rows` of them (beyond, joined to a written side, which leaves a hot node to be split), so
    a node's edges never have to meet in one task. When every node has one edge left these form trees, whose depth
    pointer jumping halves. The table is written after each round. An empty table gives an empty result; loops and
    repeated edges change nothing.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    n = e.count()  # no later table has more rows
    for _ in range(most):
        least = small(few(e.groupBy("a").agg(F.min("b").alias("m")), n), "least", broadcast_rows)
        pairs = F.when(F.col("b") == F.col("m"), F.struct("a", F.col("m").alias("b"), F.lit(False).alias("moved"))).otherwise(F.struct(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved")))
        old = [e, least]
        e = stored(few(e.join(least, "a").select(pairs.alias("p")).select("p.*").groupBy("a", "b").agg(F.max("moved").alias("moved")), n), "cc")
        for x in old:
            dropped(x)
        if not e.where("moved").limit(1).count():
            break
        e = e.select("a", "b")
    else:
        raise RuntimeError("components did not settle")
    up = e.select("a", "b")
    for _ in range(most):
        above = small(few(up.select(F.col("a").alias("b"), F.col("b").alias("c")), n), "above", broadcast_rows)
        old = [up, above]
        up = stored(few(up.join(above, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), n), "cc")
        for x in old:
            dropped(x)
        if not up.where("moved").limit(1).count():
            break
        up = up.select("a", "b")
    return up.select(F.col("a").alias("node"), F.col("b").alias("root")).union(up.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
