"""Every registered query of the library's own operators, with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.plans import catalog, duplicates, extraction, names, relational, rules, search, streams, vectors  # noqa: F401


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: every benchmark passage as a search over the archive."""
    return search.search_partial(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)
