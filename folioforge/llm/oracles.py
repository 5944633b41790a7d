"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: The cuts of :data:`folioforge.llm.line_dedup.CUTS`, one row each.
CUTS = "(VALUES (1, 1, 0, false), (1, 1, 1, true), (1, 2, 0, false), (1, 2, 1, true), (1, 4, 0, false), (1, 4, 1, true), (2, 1, 0, false), (2, 1, 1, true)) c(span, power, value, early)"

OP2 = f"""
WITH d AS (SELECT doc_id, text, md5(coalesce(text, '')) AS tag FROM documents),
raw AS (SELECT doc_id, tag, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, tag, text FROM d) WHERE text IS NOT NULL),
lines AS (SELECT doc_id, tag, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM raw),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT % 2147483647 AS h FROM lines),
rolled AS (SELECT *, (coalesce(lag(h) OVER (PARTITION BY doc_id, tag ORDER BY pos), 0) * 31 + h) % 2147483647 AS r FROM hashed),
anchor AS (SELECT doc_id, tag, pos, line, span, power, early, CASE WHEN ((CASE WHEN span = 1 THEN h ELSE r END) // power) % 2 = value THEN 1 ELSE 0 END AS hit
           FROM rolled, {CUTS}),
cut AS (SELECT *, coalesce(sum(hit) OVER (PARTITION BY doc_id, tag, span, power, early ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  + CASE WHEN early THEN hit ELSE 0 END AS idx FROM anchor),
part AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, tag, span, power, early, idx ORDER BY pos) - 1) // 16 AS piece FROM cut),
chunk AS (SELECT doc_id, tag, min(pos) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS body
          FROM part GROUP BY doc_id, tag, span, power, early, idx, piece),
multi AS (SELECT DISTINCT * FROM chunk WHERE n >= 2 AND length(trim(translate(body, chr(10) || chr(9) || chr(13), '   '), ' ')) > 0),
ranked AS (SELECT doc_id, tag, start, n, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, tag, start) AS rn FROM multi),
gone AS (SELECT doc_id, tag, start, n FROM ranked WHERE rn > 1),
counts AS (SELECT doc_id, tag, count(*) AS chunks FROM gone GROUP BY ALL),
lost AS (SELECT DISTINCT doc_id, tag, unnest(range(start, start + n)) AS pos FROM gone),
done AS (SELECT l.doc_id, l.tag, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (o.pos IS NULL), '') AS text, count(*) AS n_lines, count(o.pos) AS n_removed_lines
         FROM lines l LEFT JOIN lost o ON l.doc_id IS NOT DISTINCT FROM o.doc_id AND l.tag = o.tag AND l.pos = o.pos GROUP BY l.doc_id, l.tag)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE x.text END AS text, coalesce(x.n_lines, 0) AS n_lines,
       coalesce(x.n_removed_lines, 0) AS n_removed_lines, coalesce(k.chunks, 0) AS n_removed_chunks
FROM d LEFT JOIN done x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.tag = x.tag AND d.text IS NOT NULL
LEFT JOIN counts k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.tag = k.tag AND d.text IS NOT NULL
"""

#: All pairs of one table's vectors: for small tables only.
UNITS = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

OP6 = f"""
WITH RECURSIVE {UNITS},
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE vec_id IS NOT NULL AND list_dot_product(e, e) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                      AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
part AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT e.vec_id, coalesce(d.n_links, 0) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e LEFT JOIN part p ON p.x = e.vec_id LEFT JOIN degree d ON d.x = e.vec_id
"""

OP10 = f"""
WITH {UNITS},
f AS (SELECT vec_id, list_transform(e, lambda x: floor(1024 * x)) AS e FROM v WHERE vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM f q JOIN f c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10
"""


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS ts FROM documents),
sized AS (SELECT row, doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sized),
tf AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(ts) AS term FROM sized) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term, docs),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term), corpus GROUP BY item_id, row, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op6_embedding_dedup": OP6, "op10_mtree_search": OP10, "op13_ranked_search": OP13}
