"""Multi-select facets in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet_counts(docs: DataFrame, groups: dict[str, Column], values: dict[str, Column], within: bool = False) -> DataFrame:
    """``facet, value, n`` of ``docs``.

    ``groups`` are the filters by facet, ``values`` the arrays of a row's values by
    facet. A row counts for a facet if no filter but that facet's own rejects it
    (``within``: none at all). Every row is read once: it carries the facets whose
    filter it fails, and is dropped at once if there are two. Null values are left out.
    """
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in groups.items()]))

    def named(facet: str, value: Column) -> Column:
        return F.transform(F.coalesce(value, F.array().cast("array<string>")), lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("value")))

    pairs = F.flatten(F.array(*[named(facet, value) for facet, value in values.items()]))
    few = docs.withColumn("failed", failed).where(F.size("failed") <= (0 if within else 1))
    each = few.select("failed", F.explode(pairs).alias("p")).where((F.size("failed") == 0) | (F.get("failed", F.lit(0)) == F.col("p.facet")))
    return each.select("p.facet", "p.value").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))
