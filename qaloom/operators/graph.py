"""Connected components of links, in joined tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.plans.staging import staged


def link_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`node` and `root`, the least node of its component, for every row of `nodes`; `links` has `a`, `b`.

    Parents start as least neighbours. A round hooks the root of each end of a link to the smaller root and then jumps
    from parents to their parents, so a chain takes a logarithmic number of rounds. Each ends in the checkpoint folder.
    """
    ties = links.where("a <> b").select("a", "b")
    ties = staged(ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    least = ties.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
    parent = staged(least.select("node", F.least("node", "b").alias("parent")))
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        flat = parent.join(up, "parent").select("node", F.col("root").alias("parent"))  # every parent is a node with links
        pa, pb = (flat.select(F.col("node").alias(x), F.col("parent").alias(f"p{x}")) for x in ("a", "b"))
        hooks = ties.join(pa, "a").join(pb, "b").where("pa <> pb").groupBy(F.greatest("pa", "pb").alias("node")).agg(F.min(F.least("pa", "pb")).alias("hook"))
        new = flat.join(hooks, "node", "left").select("node", F.least("parent", F.coalesce("hook", "parent")).alias("parent"))
        new = staged(new)
        same = new.join(parent.withColumnRenamed("parent", "before"), "node").where("parent <> before").isEmpty()
        parent = new
        if same:
            break
    return nodes.select("node").distinct().join(parent, "node", "left").select("node", F.coalesce("parent", "node").alias("root"))
