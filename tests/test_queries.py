"""Every registered query of the library against DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from folioforge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    out = registry.queries()[name](spark, sf_dir)
    rows = out.collect()
    assert len(set(out.columns)) == len(out.columns)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(out.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in rows) == want
