"""Roots and depths of parent links, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import materialise

#: Rounds at most: chains of up to 2 ** ROUNDS links.
ROUNDS = 40


def chains(links: DataFrame) -> DataFrame:
    """``node, root, depth`` for every node of ``links(node, parent)``, one row a node.

    A parent that is null or no node ends a chain. Each round joins the table with itself
    and doubles how far every node has come, so a chain of a thousand links takes ten
    rounds. Only a count reaches the driver. Links in a circle are an error. Rows with a
    null node are left out.
    """
    nodes = links.where("node is not null").select("node", "parent")
    known = nodes.select(F.col("node").alias("parent")).withColumn("known", F.lit(True))
    held = nodes.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("up"))
    table = materialise(held.select("node", "up", F.coalesce("up", "node").alias("root"), F.col("up").isNotNull().cast("long").alias("depth")), "lineage")
    for _ in range(ROUNDS):
        if table.where("up is not null").limit(1).count() == 0:
            return table.select("node", "root", "depth")
        far = table.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        step = table.join(far, "up", "left")
        table = materialise(step.select("node", F.col("up2").alias("up"), F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")), "lineage")
    raise ValueError("parent links form a circle")
