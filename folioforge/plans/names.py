"""Dictionary matches: every sentence of every benchmark passage is a name, looked for in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import names as N
from folioforge.plans.catalog import query
from folioforge.plans.search import SENTENCES_SQL, TOKENS, sentences
from folioforge.session import table

FOUND_SQL = f"""WITH {SENTENCES_SQL}, k AS (SELECT query_id AS name_id, array_to_string({TOKENS}, ' ') AS key FROM sentences),
    t AS (SELECT doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL),
    found AS (SELECT doc_id, name_id, key, instr(t, ' ' || key || ' ')::INT AS first_at FROM t JOIN k ON key <> '' AND contains(t, ' ' || key || ' '))"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.names_found(table(spark, sf_dir, "documents"), sentences(spark, sf_dir).select(F.col("query_id").alias("name_id"), F.col("text").alias("name")))


@query(FOUND_SQL + " SELECT doc_id, name_id, key, first_at FROM found")
def names_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


@query(
    FOUND_SQL + """, e AS (SELECT DISTINCT doc_id, key, first_at, length(key) AS n FROM found),
    r AS (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at, key) AS place, count(*) OVER (PARTITION BY doc_id) AS n_names, count(*) OVER (PARTITION BY doc_id, n) AS rivals FROM e)
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN key END AS sender, coalesce(n_names, 0) AS n_names,
        CASE WHEN l.doc_id IS NOT NULL THEN 'locked' WHEN key IS NULL THEN 'none' WHEN rivals > 1 THEN 'suggested' ELSE 'applied' END AS state
    FROM documents d LEFT JOIN (SELECT * FROM r WHERE place = 1) r USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id"""
)
def sender_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good are locked; the others get the longest name in their text."""
    locked = table(spark, sf_dir, "labels").where("quality = 1")
    return N.proposals(table(spark, sf_dir, "documents"), _found(spark, sf_dir), locked)
