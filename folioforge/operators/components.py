"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import materialise


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Columns ``node, component`` for every node of ``edges(src, dst)`` that has an edge.

    ``component`` is the smallest node reachable. Nulls and self-loops are ignored;
    nodes without edges do not appear. Each round is two joins on materialised
    tables; nothing but a count and a checksum reaches the driver.
    """
    kept = (
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("big"), F.least("src", "dst").alias("small"))
        .distinct()
    )
    kept = materialise(kept, "cc-edges")
    mark = _mark(kept)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = kept.select(F.col("big").alias("u"), F.col("small").alias("v")).unionByName(
            kept.select(F.col("small").alias("u"), F.col("big").alias("v"))
        )
        lows = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("low")), "cc-lows")
        large = both.where("v > u").join(lows, "u").where("v <> low").select(F.col("v").alias("big"), F.col("low").alias("small"))
        large = materialise(large.distinct(), "cc-large")
        lows = materialise(large.groupBy("big").agg(F.min("small").alias("low")), "cc-lows")
        hung = large.join(lows, "big").where("small <> low").select(F.col("small").alias("big"), F.col("low").alias("small"))
        small = hung.unionByName(lows.select("big", F.col("low").alias("small"))).distinct()
        kept = materialise(small, "cc-edges")
        now = _mark(kept)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return kept.select(F.col("big").alias("node"), F.col("small").alias("component")).unionByName(
        kept.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])
