"""Queries by meaning. Every vector whose id is divisible by 50 is a search, against all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import vectors as V
from folioforge.operators.search import top
from folioforge.plans.catalog import archive, chunks, query

SIMS_SQL = """q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM chunks WHERE vec_id % 50 = 0),
    sims AS (SELECT q.query_id, c.vec_id, c.owner, c.kind, list_dot_product(q.v, c.embedding::DOUBLE[]) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS sim FROM q CROSS JOIN chunks c)"""
BEST_SQL = f"""WITH {SIMS_SQL}, b AS (SELECT query_id, owner, max(sim) FILTER (kind < 2) AS large, max(sim) FILTER (kind = 2) AS small FROM sims GROUP BY query_id, owner),
    best AS (SELECT query_id, owner, CASE WHEN large IS NULL THEN small WHEN small IS NULL THEN large ELSE {{value}} END AS sim FROM b)"""


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = chunks(spark, sf_dir)
    return c.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), c


@query(BEST_SQL.format(value="large") + " SELECT query_id, owner, sim, place FROM (SELECT query_id, owner, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, owner) AS place FROM best) WHERE place <= 20", ("chunks",))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest owners of each search."""
    return V.nearest(*_both(spark, sf_dir), 20).select("query_id", "owner", "sim", "place")


@query(BEST_SQL.format(value="(large + small) / 2") + " SELECT query_id, owner, round(sim, 6) AS sim FROM best", ("chunks",))
def best_chunk_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.best_per_owner(*_both(spark, sf_dir), question=True).withColumn("sim", F.round("sim", 6))


@query(
    BEST_SQL.format(value="large") + """, s AS (SELECT query_id, avg(sim) AS mean, stddev_pop(sim) AS std, count(*) AS n, max(sim) AS top FROM best GROUP BY query_id)
    SELECT query_id, owner, round(sim, 6) AS sim FROM best JOIN s USING (query_id) WHERE (sim >= 0.22 OR (n >= 10 AND (sim - mean) / std >= greatest(2.0, sqrt(2 * ln(n)) - 0.8) AND sim >= 0.7 * 0.22)) AND sim >= top - 0.15""",
    ("chunks",),
)
def near_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.near_enough(*_both(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@query(
    BEST_SQL.format(value="large") + """, m AS (SELECT query_id, owner AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, owner) AS p2 FROM best QUALIFY p2 <= 20),
    w AS (SELECT q.query_id, owner AS doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY n DESC, owner) AS p1 FROM q JOIN (SELECT label, owner, count(*) AS n FROM chunks GROUP BY label, owner) USING (label) QUALIFY p1 <= 20)
    SELECT query_id, doc_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(p1, 1000000), doc_id) AS place FROM (
        SELECT query_id, doc_id, p1, round(coalesce(1.0 / (60 + p1), 0) + coalesce(0.5 / (60 + p2), 0), 9) AS score FROM w FULL OUTER JOIN m USING (query_id, doc_id))) WHERE place <= 10""",
    ("chunks",),
)
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking by label counts (for the words) fused with one by meaning."""
    c = chunks(spark, sf_dir)
    words = c.groupBy("label", "owner").agg(F.count("*").alias("n"))
    # The twenty best of a label are those of each of its searches.
    words = top(words.withColumnRenamed("label", "query_id"), 20, F.col("n").desc(), F.col("owner")).withColumnRenamed("query_id", "label")
    searches = c.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    words = words.join(searches, "label").select("query_id", F.col("owner").alias("doc_id"), "place")
    meaning = V.nearest(*_both(spark, sf_dir), 20).select("query_id", F.col("owner").alias("doc_id"), "place")
    fused = V.fuse(words, meaning)
    return top(fused, 10, F.col("score").desc(), F.coalesce("p1", F.lit(1_000_000)), F.col("doc_id")).select("query_id", "doc_id", "score", "place")


SCOPED_SQL = """WITH c AS (SELECT c.*, a.document_type, a.correspondent FROM chunks c LEFT JOIN archive a ON a.doc_id = c.owner),
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, document_type AS t, CASE WHEN vec_id % 100 = 0 THEN correspondent END AS s FROM c WHERE vec_id % 50 = 0),
    sims AS (SELECT q.query_id, c.owner, c.kind, list_dot_product(q.v, c.embedding::DOUBLE[]) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS sim
        FROM q JOIN c ON (t IS NULL OR t = c.document_type) AND (s IS NULL OR s = c.correspondent)),
    b AS (SELECT query_id, owner, max(sim) FILTER (kind < 2) AS large, max(sim) FILTER (kind = 2) AS small FROM sims GROUP BY query_id, owner),
    best AS (SELECT query_id, owner, round(coalesce((large + small) / 2, large, small), 6) AS sim FROM b)
    SELECT query_id, owner, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, owner) AS place FROM best QUALIFY place <= 20"""


@query(SCOPED_SQL, ("chunks", "archive"))
def meaning_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions under filters: each search keeps to the type of its own document, every second one to its sender as well."""
    about = archive(spark, sf_dir).select(F.col("doc_id").alias("owner"), "document_type", "correspondent")
    c = chunks(spark, sf_dir).join(about, "owner", "left")
    sender = F.when(F.col("vec_id") % 100 == 0, F.col("correspondent"))
    q = c.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "document_type", sender.alias("correspondent"))
    return V.nearest(q, c, 20, question=True, filters=("document_type", "correspondent")).select("query_id", "owner", "sim", "place")


def _pieces_sql(text: str) -> str:
    """Pieces of both sizes; the pattern language repeats at most a thousand times, so 1,200 is written as two halves."""
    large, small = " *(.{1,600}.{0,600}$|.{600}.{0,599} |.{600}.{600})", " *(.{1,600}$|.{300,599} |.{600})"
    each = ", ".join(f"(SELECT list_transform(regexp_extract_all({text}, '{p}', 1), lambda x: rtrim(x, ' '))) AS {n}" for p, n in ((large, "large"), (small, "small")))
    return f"SELECT doc_id, title, {each}, length({text}) AS n"


CHUNKS_SQL = f"""WITH t AS (SELECT doc_id, title, trim(regexp_replace(body, '[\\s]+', ' ', 'g')) AS now, trim(regexp_replace(regexp_replace(body, '\\n[^\\n]*$', ''), '[\\s]+', ' ', 'g')) AS before FROM archive),
    a AS ({_pieces_sql("now")} FROM t), b AS ({_pieces_sql("before")} FROM t),
    flat AS (SELECT 'a' AS side, * FROM a UNION ALL SELECT 'b', * FROM b),
    p AS (SELECT side, doc_id, 0 AS kind, 0 AS piece, title AS text FROM flat
        UNION ALL SELECT side, doc_id, 1, unnest(range(len(large))), unnest(large) FROM flat
        UNION ALL SELECT side, doc_id, 2, unnest(range(len(small))), unnest(small) FROM flat WHERE n > 600)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.kind, b.kind) AS kind, coalesce(a.piece, b.piece)::INT AS piece, coalesce(sha256(a.text), sha256(b.text)) AS hash,
        CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'gone' WHEN a.text = b.text THEN 'kept' ELSE 'changed' END AS state
    FROM (SELECT * FROM p WHERE side = 'a') a FULL OUTER JOIN (SELECT * FROM p WHERE side = 'b') b ON a.doc_id = b.doc_id AND a.kind = b.kind AND a.piece = b.piece"""


@query(CHUNKS_SQL, ("archive",))
def chunk_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pieces need a new vector after a document has grown by its last line; unchanged ones keep theirs by their hash."""
    a = archive(spark, sf_dir).select("doc_id", "title", "body")
    before = V.pieces_of(a.withColumn("body", F.regexp_replace("body", r"\n[^\n]*\z", "")))
    return V.upkeep(before, V.pieces_of(a))


@query(
    "WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM chunks), s AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) / 127 AS scale FROM u) SELECT vec_id, round(scale, 9) AS scale, list_sum(list_transform(e, lambda x: round_even(x / scale, 0)::INT))::BIGINT AS total, list_max(list_transform(e, lambda x: round_even(x / scale, 0)::INT)) AS largest FROM s",
    ("chunks",),
)
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = chunks(spark, sf_dir).select("vec_id", V.packed(F.col("embedding")).alias("p"))
    total = F.aggregate("p.codes", F.lit(0).cast("long"), lambda s, x: s + x)
    return p.select("vec_id", F.round("p.scale", 9).alias("scale"), total.alias("total"), F.array_max("p.codes").alias("largest"))


@query("SELECT count(*) FILTER (label = owner % 10) AS embedded, count(*) AS total FROM (SELECT owner, max(label) AS label FROM chunks GROUP BY owner)", ("chunks",))
def embedding_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = chunks(spark, sf_dir).groupBy("owner").agg(F.max("label").alias("label"))
    return per.agg(F.count_if(F.col("label") == F.col("owner") % 10).alias("embedded"), F.count("*").alias("total"))
