"""Filters, joins, aggregates, windows, sorts and set operations of the archive.

Nearly all are statements that the planner handles best as they are: each is one
declarative query, written in the SQL that Spark and DuckDB share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.operators.lineage import chains
from folioforge.plans.catalog import archive, portable, query
from folioforge.session import table

# --- filters -------------------------------------------------------------------------------

portable("filter_correspondent", "SELECT doc_id, correspondent, document_type FROM {archive} WHERE correspondent IN ('src0', 'src3', 'src7') AND document_type IN ('en', 'de')")
portable(
    "filter_tags_all",
    "SELECT a.doc_id, a.correspondent FROM {archive} a WHERE EXISTS (SELECT 1 FROM {tagged} t WHERE t.doc_id = a.doc_id AND t.tag = 'quality') AND EXISTS (SELECT 1 FROM {tagged} t WHERE t.doc_id = a.doc_id AND t.tag = 'toxic')",
)
portable("filter_tags_any", "SELECT a.doc_id FROM {archive} a WHERE EXISTS (SELECT 1 FROM {tagged} t WHERE t.doc_id = a.doc_id AND t.tag IN ('quality', 'toxic'))")
portable("filter_year", "SELECT doc_id, document_date FROM {archive} WHERE document_date BETWEEN '2024-01-01' AND '2024-12-31'")
portable("filter_dates", "SELECT doc_id, document_date FROM {archive} WHERE document_date >= '2023-06-01' AND document_date <= '2024-02-29'")
portable("filter_received", "SELECT doc_id, received_at FROM {archive} WHERE substr(received_at, 1, 10) BETWEEN '2024-01-05' AND '2024-01-12'")
portable("filter_status", "SELECT id, doc_id, status FROM {jobs} WHERE status IN ('click', 'purchase')")
portable(
    "filter_field_range",
    "SELECT o.o_orderkey AS doc_id, o.o_totalprice FROM {orders} o WHERE EXISTS (SELECT 1 FROM {fields} f WHERE f.doc_id = o.o_orderkey AND f.key = 'total' AND f.value_num >= 100000 AND f.value_num <= 250000)",
)
portable("filter_null_safe", "SELECT a.doc_id, b.doc_id AS other FROM {archive} a JOIN {archive} b ON a.doc_id + 7 = b.doc_id AND a.document_date IS NOT DISTINCT FROM b.document_date")
portable("filter_filed", "SELECT doc_id, quality IS NOT NULL AS filed FROM {archive} WHERE NOT (quality IS NULL AND toxic IS NULL AND document_date IS NULL)")
portable(
    "keyset_page",
    "SELECT doc_id, received_at, seq FROM {archive} WHERE received_at < '2024-01-15' OR (received_at = '2024-01-15' AND seq < 100) ORDER BY received_at DESC, seq DESC LIMIT 50",
)
portable("name_prefix", "SELECT DISTINCT p_name FROM {part} WHERE lower(p_name) LIKE 'a%' OR lower(p_name) LIKE '% a%'")
portable("number_substring", "SELECT DISTINCT doc_id, value_text FROM {fields} WHERE kind = 'string' AND replace(replace(replace(lower(value_text), ' ', ''), '.', ''), '-', '') LIKE '%12%'")
portable("sender_allowed", "SELECT c_custkey, c_name FROM {customer} WHERE lower(c_mktsegment) IN ('building', 'machinery') AND NOT (c_acctbal < 0)")

# --- joins ---------------------------------------------------------------------------------

portable("docs_with_chunks", "SELECT a.doc_id, a.correspondent, c.vec_id FROM {archive} a LEFT JOIN {chunks} c ON a.doc_id = c.owner")
portable(
    "pending_chunks",
    "SELECT a.doc_id, a.received_at FROM {archive} a LEFT JOIN (SELECT owner, max(label) AS label FROM {chunks} GROUP BY owner) c ON a.doc_id = c.owner WHERE c.owner IS NULL OR c.label <> a.doc_id % 10",
)
portable("jobless_documents", "SELECT a.doc_id FROM {archive} a WHERE NOT EXISTS (SELECT 1 FROM {jobs} j WHERE j.doc_id = a.doc_id AND j.status = 'purchase')")
portable("orphan_chunks", "SELECT vec_id, owner FROM {chunks} WHERE owner IS NOT NULL AND owner NOT IN (SELECT doc_id FROM {tagged} WHERE doc_id IS NOT NULL)")
portable("tag_scope", "SELECT t.tag, count(*) AS n FROM {tagged} t WHERE t.doc_id IN (SELECT doc_id FROM {archive} WHERE correspondent = 'src1') GROUP BY t.tag")
portable(
    "open_pairs",
    "SELECT p.a, p.b, x.correspondent AS correspondent_a, y.correspondent AS correspondent_b FROM (SELECT min(doc_id) AS a, max(doc_id) AS b FROM {archive} GROUP BY body HAVING count(*) > 1) p JOIN {archive} x ON x.doc_id = p.a JOIN {archive} y ON y.doc_id = p.b",
)
portable(
    "same_amount",
    "WITH c AS (SELECT o_orderkey, o_totalprice, CAST(floor(o_totalprice * 100) AS BIGINT) AS cents FROM {orders}), near AS (SELECT o_orderkey, o_totalprice, cents - 1 AS bin FROM c UNION ALL SELECT o_orderkey, o_totalprice, cents FROM c UNION ALL SELECT o_orderkey, o_totalprice, cents + 1 FROM c) "
    "SELECT c.o_orderkey AS a, n.o_orderkey AS b FROM c JOIN near n ON c.cents = n.bin AND c.o_orderkey < n.o_orderkey AND abs(c.o_totalprice - n.o_totalprice) <= 0.005",
)
portable(
    "neighbours",
    "WITH n AS (SELECT seq, correspondent, lag(seq, 1) OVER w AS before, lead(seq, 1) OVER w AS after FROM {archive} WINDOW w AS (PARTITION BY correspondent ORDER BY seq)) SELECT seq, before, after, least(coalesce(seq - before, 1000000), coalesce(after - seq, 1000000)) AS gap FROM n",
)


@query(
    """WITH RECURSIVE n AS (SELECT conv_id * 10000 + turn AS node, conv_id * 10000 + turn - 1 AS parent, turn FROM conversations),
    up(node, root, depth) AS (SELECT node, node, 0 FROM n WHERE parent NOT IN (SELECT node FROM n) UNION ALL SELECT n.node, u.root, u.depth + 1 FROM up u JOIN n ON n.parent = u.node)
    SELECT node, root, depth::BIGINT AS depth FROM up"""
)
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn's chain of predecessors begins, and how long it is."""
    c = table(spark, sf_dir, "conversations")
    node = F.col("conv_id") * 10_000 + F.col("turn")
    return chains(c.select(node.alias("node"), (node - 1).alias("parent")))


portable("term_lookup", "SELECT a.doc_id, n.n_nationkey FROM {archive} a JOIN {nation} n ON n.n_nationkey = CAST(substr(a.correspondent, 4) AS INT)")
portable("field_owners", "SELECT f.doc_id, f.value_text, c.c_name FROM {fields} f JOIN {customer} c ON f.key = 'number' AND CAST(f.value_text AS BIGINT) = c.c_custkey")

# --- aggregates ----------------------------------------------------------------------------

portable("facet_correspondent", "SELECT correspondent, count(*) AS n FROM {archive} GROUP BY correspondent ORDER BY n DESC, correspondent")
portable("facet_tags", "SELECT t.tag, count(*) AS n FROM {tagged} t JOIN {archive} a ON a.doc_id = t.doc_id GROUP BY t.tag")
portable("facet_sender", "SELECT lower(c_mktsegment) AS sender, count(*) AS n FROM {customer} GROUP BY lower(c_mktsegment) HAVING lower(c_mktsegment) IS NOT NULL")
portable(
    "timeline_months",
    "SELECT substr(document_date, 1, 7) AS month, count(*) AS n FROM {archive} WHERE document_date IS NOT NULL GROUP BY substr(document_date, 1, 7) UNION ALL SELECT 'undated', count(*) FROM {archive} WHERE document_date IS NULL",
)
portable(
    "term_counts",
    "SELECT 'correspondent' AS kind, correspondent AS name, count(*) AS n FROM {archive} GROUP BY correspondent UNION ALL SELECT 'document_type', document_type, count(*) FROM {archive} GROUP BY document_type UNION ALL SELECT 'tag', tag, count(*) FROM {tagged} GROUP BY tag",
)
portable("field_inventory", "SELECT key, kind, count(*) AS n FROM {fields} GROUP BY key, kind")
portable("field_values", "SELECT f.doc_id, f.value_text, f.value_num FROM {fields} f WHERE lower(f.key) = 'ordered' AND f.doc_id IN (SELECT l_orderkey FROM {lineitem} WHERE l_returnflag = 'R')")
portable("recurring_numbers", "SELECT value_text, count(DISTINCT doc_id) AS n FROM {fields} WHERE key = 'number' GROUP BY value_text HAVING count(DISTINCT doc_id) > 2")
portable(
    "ai_costs",
    "WITH u AS (SELECT doc_id, status, created_at, k FROM {jobs}), s AS (SELECT 'all' AS scope, * FROM u UNION ALL SELECT 'month', * FROM u WHERE created_at >= '2024-01-15' UNION ALL SELECT 'day', * FROM u WHERE created_at >= '2024-01-29') "
    "SELECT scope, count(*) AS runs, count(DISTINCT doc_id) AS docs, CAST(sum(k) AS BIGINT) AS tokens, round(CAST(sum(k) AS DOUBLE) * 27 / 4000000, 9) AS cost, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM s GROUP BY scope",
)
portable("binder_overview", "SELECT correspondent AS binder, min(received_at) AS oldest, max(received_at) AS newest, count(*) AS n FROM {archive} GROUP BY correspondent")
portable(
    "job_counts",
    "WITH known AS (SELECT 'click' AS status UNION ALL SELECT 'view' UNION ALL SELECT 'purchase' UNION ALL SELECT 'waiting' UNION ALL SELECT 'failed') SELECT k.status, count(j.id) AS n FROM known k LEFT JOIN {jobs} j ON j.status = k.status GROUP BY k.status",
)
portable("next_sequence", "SELECT greatest(max(a), max(b)) + 1 AS next FROM (SELECT max(seq) AS a, CAST(0 AS BIGINT) AS b FROM {archive} UNION ALL SELECT CAST(0 AS BIGINT), max(item_id) FROM {benchmark}) x")
portable(
    "suggestion_groups",
    "WITH g AS (SELECT status, k, count(*) AS n, avg(value) AS mean_value FROM {jobs} GROUP BY status, k), r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY n DESC, k) AS place, sum(n) OVER (PARTITION BY status) AS total FROM g) "
    "SELECT status, k AS suggestion, place, n, CAST(total AS BIGINT) AS total, round(mean_value, 6) AS mean_value FROM r WHERE place <= 3",
)
portable(
    "open_tasks",
    "SELECT a.n + b.n + c.n AS n FROM (SELECT count(*) AS n FROM {archive} WHERE quality = 0) a CROSS JOIN (SELECT count(*) AS n FROM {jobs} WHERE status = 'error') b CROSS JOIN (SELECT count(*) AS n FROM {archive} WHERE document_date IS NULL) c",
)
portable(
    "session_summary",
    "WITH m AS (SELECT *, CASE WHEN lag(created_at) OVER w IS NULL OR substr(lag(created_at) OVER w, 1, 10) <> substr(created_at, 1, 10) THEN 1 ELSE 0 END AS fresh FROM {jobs} WINDOW w AS (PARTITION BY doc_id ORDER BY created_at, id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS session FROM m) "
    "SELECT doc_id, CAST(session AS BIGINT) AS session, count(*) AS jobs, CAST(sum(CASE WHEN status = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS done, min(created_at) AS began, max(created_at) AS ended FROM s GROUP BY doc_id, session",
)
portable(
    "dashboard",
    "SELECT 'documents' AS what, count(*) AS n FROM {archive} UNION ALL SELECT 'undated', count(*) FROM {archive} WHERE document_date IS NULL UNION ALL SELECT 'jobs', count(*) FROM {jobs} UNION ALL SELECT 'senders', count(DISTINCT correspondent) FROM {archive} UNION ALL SELECT 'chunks', count(*) FROM {chunks}",
)
portable(
    "sender_rows",
    "SELECT coalesce(a.sender, b.sender) AS sender, coalesce(a.n, 0) AS n, b.sender IS NOT NULL AS named FROM (SELECT correspondent AS sender, count(*) AS n FROM {archive} GROUP BY correspondent) a FULL OUTER JOIN (SELECT concat('src', CAST(n_nationkey AS STRING)) AS sender FROM {nation}) b ON a.sender = b.sender",
)
portable("section_list", "SELECT DISTINCT substr(received_at, 1, 7) AS section, document_type FROM {archive}")
portable("recent_batches", "SELECT count(*) AS n FROM {jobs} WHERE status LIKE 'p%' AND created_at > '2024-01-20 00:00:00'")
portable("title_estimate", "SELECT correspondent, document_type, count(*) AS titles, CAST(sum(length(title)) AS BIGINT) AS characters FROM {archive} GROUP BY correspondent, document_type")
portable("attempts", "SELECT doc_id, substr(created_at, 1, 13) AS hour, count(*) AS n FROM {jobs} GROUP BY doc_id, substr(created_at, 1, 13) HAVING count(*) >= 2")

# --- windows -------------------------------------------------------------------------------

portable(
    "filing_position",
    "SELECT doc_id, correspondent, row_number() OVER d AS from_top, count(*) OVER (PARTITION BY correspondent) AS total, lag(doc_id) OVER d AS above, lead(doc_id) OVER d AS below FROM {archive} WINDOW d AS (PARTITION BY correspondent ORDER BY seq DESC)",
)
portable(
    "reversed_stack",
    "WITH r AS (SELECT doc_id, correspondent, seq, row_number() OVER (PARTITION BY correspondent ORDER BY seq) AS up, row_number() OVER (PARTITION BY correspondent ORDER BY seq DESC) AS down FROM {archive}) SELECT a.doc_id, b.seq AS new_seq FROM r a JOIN r b ON a.correspondent = b.correspondent AND a.up = b.down",
)


@query("SELECT doc_id, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next FROM archive WHERE quality = 0 WINDOW w AS (ORDER BY received_at DESC, seq DESC)", ("archive",))
def next_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document to review after each, newest first, the first after the last.

    Neighbours are found within a day; only the days themselves, with their first
    documents, stand in one order.
    """
    a = archive(spark, sf_dir).where("quality = 0").select("doc_id", "received_at", "seq")
    inside = a.withColumn("after", F.lead("doc_id").over(Window.partitionBy("received_at").orderBy(F.col("seq").desc())))
    days = a.groupBy("received_at").agg(F.max_by("doc_id", "seq").alias("first"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("received_at").desc())
    # One row a day.
    turned = days.select("received_at", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("begin"))
    return inside.join(turned, "received_at").select("doc_id", F.coalesce("after", "begin").alias("next"))


portable("latest_run", "SELECT doc_id, status, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, status ORDER BY created_at DESC, id DESC) AS rn FROM {jobs}) r WHERE rn = 1")
portable("rate_window", "SELECT event_id AS id, user_id AS doc_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM {events}")
portable("stack_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM {conversations}")
portable("rank_positions", "SELECT vec_id, kind, row_number() OVER (PARTITION BY kind ORDER BY label, vec_id) AS place FROM {chunks}")

# --- sorts and limits ----------------------------------------------------------------------

portable("sort_received", "SELECT doc_id, received_at, seq FROM {archive} ORDER BY received_at DESC, seq DESC LIMIT 100")
portable("sort_document_date", "SELECT doc_id, document_date FROM {archive} ORDER BY document_date DESC NULLS LAST, received_at DESC, seq DESC LIMIT 100")
portable("sort_title", "SELECT doc_id, title FROM {archive} ORDER BY lower(title), received_at DESC, seq DESC LIMIT 100 OFFSET 50")
portable("sort_job_priority", "SELECT id, status FROM {jobs} ORDER BY CASE WHEN status = 'error' THEN 0 WHEN status = 'purchase' THEN 1 ELSE 2 END, id LIMIT 200")
portable("sort_distance", "SELECT doc_id, abs(seq - 77) AS far FROM {archive} ORDER BY abs(seq - 77), doc_id LIMIT 20")

# --- set operations and changes ------------------------------------------------------------

portable("names_union", "SELECT lower(p_name) AS name FROM {part} UNION SELECT lower(p_brand) FROM {part} UNION SELECT lower(correspondent) FROM {archive}")
portable("affected_documents", "SELECT doc_id FROM {archive} WHERE correspondent = 'src2' UNION SELECT doc_id FROM {tagged} WHERE tag = 'toxic'")
portable(
    "pattern_parts",
    "SELECT doc_id FROM {archive} WHERE body LIKE '%an%' INTERSECT SELECT doc_id FROM {archive} WHERE body LIKE '%the%' INTERSECT SELECT doc_id FROM {archive} WHERE body LIKE '%ion%'",
)
portable("untagged", "SELECT doc_id FROM {archive} EXCEPT SELECT doc_id FROM {tagged}")
portable(
    "upsert_fields",
    "WITH u AS (SELECT doc_id, key, value_num, 0 AS rank FROM {fields} WHERE kind = 'monetary' UNION ALL SELECT l_orderkey, 'total', round(sum(l_extendedprice), 2), 1 FROM {lineitem} GROUP BY l_orderkey), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY rank DESC) AS rn FROM u) SELECT doc_id, key, value_num FROM r WHERE rn = 1",
)
portable("merged_terms", "SELECT doc_id, CASE WHEN correspondent IN ('src1', 'src2') THEN 'src1' ELSE correspondent END AS correspondent, CASE WHEN correspondent = 'src2' THEN 'src2' END AS alias FROM {archive}")
portable("deleted_term", "SELECT doc_id, tag FROM {tagged} WHERE tag <> 'toxic'")
portable("tag_overrides", "SELECT doc_id, tag FROM (SELECT doc_id, tag FROM {tagged} EXCEPT SELECT doc_id, 'toxic' AS tag FROM {archive} WHERE document_type = 'de' UNION SELECT doc_id, 'kept' FROM {archive} WHERE document_type = 'fr') x")
portable("insert_or_ignore", "SELECT min(doc_id) AS doc_id, count(*) AS seen FROM {archive} GROUP BY correspondent, title, received_at")
portable(
    "import_merge",
    "WITH mine AS (SELECT doc_id, body FROM {archive} WHERE document_type <> 'fr'), theirs AS (SELECT doc_id, CASE WHEN toxic = 1 THEN concat(body, '.') ELSE body END AS body FROM {archive} WHERE document_type <> 'es') "
    "SELECT coalesce(m.doc_id, t.doc_id) AS doc_id, CASE WHEN t.doc_id IS NULL THEN 'only here' WHEN m.doc_id IS NULL THEN 'new' WHEN m.body = t.body THEN 'unchanged' ELSE 'conflict' END AS verdict FROM mine m FULL OUTER JOIN theirs t ON m.doc_id = t.doc_id",
)
portable("retention", "SELECT id, doc_id FROM {jobs} WHERE created_at >= '2024-01-10 00:00:00'")
portable("purge_references", "SELECT p.p_partkey FROM {part} p WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)")
portable(
    "integrity_issues",
    "SELECT 'label without document' AS issue, l.doc_id FROM {labels} l WHERE NOT EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = l.doc_id) UNION ALL SELECT 'wrong length', doc_id FROM {documents} WHERE n_chars <> length(text) UNION ALL SELECT 'order without lines', o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey) "
    "UNION ALL SELECT 'empty text', doc_id FROM {documents} WHERE length(trim(text)) = 0",
)
portable("coalesced_jobs", "SELECT doc_id, count(DISTINCT status) AS stages, min(id) AS first_job, max(created_at) AS last_at FROM {jobs} GROUP BY doc_id")
portable("backoff", "SELECT id, least(60.0 * power(2, k % 12), 21600.0) AS wait FROM {jobs}")
