"""How queries are registered, and the views of the given tables that they share.

The archive's columns that the tables lack (dates, tags, custom fields) are derived
from them by the rules below; the rules are this project's own.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.functions.words import word_totals
from folioforge.operators.index import Index, create, exists
from folioforge.session import materialise, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a function under its name, with DuckDB SQL over the same views where SQL can say it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, views)
        return f

    return register


def portable(name: str, sql: str, views: tuple[str, ...] = ()) -> None:
    """Registers a statement that Spark and DuckDB read alike; ``{name}`` stands for a table or view."""
    names = tuple(dict.fromkeys(w for w in _fields(sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in names})

    QUERIES[name] = run
    ORACLES[name] = with_views(sql.format(**{n: n for n in names}), names)


def _fields(sql: str) -> list[str]:
    return [f for _, f, _, _ in string.Formatter().parse(sql) if f]


# --- views ---------------------------------------------------------------------------------


def archive(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """The archive, or of it what ``only(doc_id)`` names."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    if only is not None:
        docs = docs.join(only, "doc_id", "left_semi")
    day = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), ((F.col("doc_id") * 37) % 730).cast("int")), "yyyy-MM-dd")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("doc_id").alias("seq"),
        F.col("text").alias("body"),
        X.first_line(F.col("text")).alias("title"),
        F.col("source").alias("correspondent"),
        F.col("lang").alias("document_type"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd").alias("received_at"),
        F.when(F.col("doc_id") % 7 != 0, day).alias("document_date"),
        "quality",
        "toxic",
    )


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    pair = F.explode(F.array(F.struct(F.lit("quality").alias("tag"), F.col("quality").alias("on")), F.struct(F.lit("toxic").alias("tag"), F.col("toxic").alias("on"))))
    return labels.select("doc_id", pair.alias("p")).where("p.on = 1").select("doc_id", "p.tag")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom fields of the orders: a number, an amount, a date and a status each."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")

    def field(key: str, kind: str, text: str | Column, num: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.lit(kind).alias("kind"), (F.col(text) if isinstance(text, str) else text).alias("value_text"), num.cast("double").alias("value_num"))

    none = F.lit(None)
    each = F.array(
        field("number", "string", F.col("o_custkey").cast("string"), none), field("total", "monetary", none.cast("string"), F.col("o_totalprice")), field("ordered", "date", day, none), field("status", "string", "o_orderstatus", none)
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), F.inline(each))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col("user_id").alias("doc_id"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, col, pos, term`` for title and body."""
    a = archive(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(c).alias("col"), X.tokens(F.col(c)).alias("terms")) for c in ("title", "body")])
    return a.select("doc_id", F.inline(each)).select("doc_id", "col", F.posexplode("terms").alias("pos", "term"))


#: Where the search's columns come from; their weights are those of :data:`folioforge.operators.search.WEIGHTS`.
def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, col, text``: the eleven columns of a document's description that searches read.

    The archive's own columns; custom fields of the order and the file name of the page
    with the document's number, and the first turn of that conversation as its note.
    """
    a = archive(spark, sf_dir)
    tags = tagged(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), " ").alias("tags"))
    value = F.coalesce("value_text", F.round(F.col("value_num") * 100).cast("long").cast("string"), F.lit(""))
    custom = fields(spark, sf_dir).select("doc_id", F.concat_ws(" ", "key", value).alias("f")).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("f")), " ").alias("custom"))
    names = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.substring_index("url", "/", -1).alias("filename"))
    notes = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("notes"))
    both = a.join(tags, "doc_id", "left").join(custom, "doc_id", "left").join(names, "doc_id", "left").join(notes, "doc_id", "left")
    digits = F.filter(X.tokens(F.concat_ws(" ", "custom", "title", "filename")), lambda t: t.rlike("[0-9]"))
    days = F.concat_ws(" ", *[F.substring(c, 1, n) for c in ("document_date", "received_at") for n in (4, 7, 10)])
    own = {
        "ident": F.array_join(F.array_sort(F.array_distinct(digits)), " "), "title": F.col("title"), "correspondent": F.col("correspondent"), "doctype": F.col("document_type"), "tags": F.col("tags"), "custom": F.col("custom"),
        "filename": F.col("filename"), "dates": days, "summary": F.regexp_extract("body", r"^[^.!?\n]*", 0), "body": F.col("body"), "notes": F.col("notes"),
    }
    each = F.array(*[F.struct(F.lit(c).alias("col"), t.alias("text")) for c, t in own.items()])
    return both.select("doc_id", F.inline(each)).where("text <> ''")


_indexes: dict[tuple[str, str], Index] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of :func:`columns`, written once for a session and a folder of tables and then shared by all searches."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes or not exists(spark, _indexes[key].segments):
        _indexes[key] = create(columns(spark, sf_dir))
    return _indexes[key]


def one_row_each(rows: DataFrame) -> DataFrame:
    """``doc_id, words``: the folded words of ``rows(doc_id, body)``, one row a document; only bodies of documents with several rows are shuffled."""
    several = materialise(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "several-rows")
    each, met = rows.select("doc_id", "body"), F.col("doc_id").eqNullSafe(F.col("again"))
    alone = each.join(several, met, "left_anti").select("doc_id", X.tokens(F.col("body")).alias("words"))
    texts = each.join(several, met, "left_semi").groupBy("doc_id").agg(F.collect_list("body").alias("texts"))
    return alone.unionByName(texts.select("doc_id", F.flatten(F.transform("texts", X.tokens)).alias("words")))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, words``: the folded words of each document's text."""
    return one_row_each(archive(spark, sf_dir))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``term, docs, cnt``: the words of all texts."""
    return word_totals(bodies(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks: five to an owner, in three kinds."""
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.floor(F.col("vec_id") / 5).alias("owner"), (F.col("vec_id") % 3).alias("kind"), "embedding", "label")


VIEWS = {"archive": archive, "tagged": tagged, "fields": fields, "jobs": jobs, "columns": columns, "postings": postings, "vocab": vocab, "chunks": chunks}

_FOLD = "lower({})"
for _letter, _spelt in X.SPELT:
    _FOLD = f"replace({_FOLD}, '{_letter}', '{_spelt}')"
FOLD = f"translate({_FOLD}, '{X.ACCENTED}', '{X.PLAIN}')"

VIEW_SQL = {
    "archive": """SELECT d.doc_id, d.doc_id AS seq, d.text AS body, substr(trim(regexp_extract(d.text, '([^\\n]*\\S[^\\n]*)', 1)), 1, 200) AS title,
        d.source AS correspondent, d.lang AS document_type, strftime(DATE '2024-01-01' + (d.doc_id % 30)::INT, '%Y-%m-%d') AS received_at,
        CASE WHEN d.doc_id % 7 <> 0 THEN strftime(DATE '2023-01-01' + ((d.doc_id * 37) % 730)::INT, '%Y-%m-%d') END AS document_date, l.quality, l.toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "tagged": "SELECT doc_id, 'quality' AS tag FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1",
    "fields": """SELECT o_orderkey AS doc_id, 'number' AS key, 'string' AS kind, o_custkey::VARCHAR AS value_text, NULL::DOUBLE AS value_num FROM orders
        UNION ALL SELECT o_orderkey, 'total', 'monetary', NULL, o_totalprice FROM orders
        UNION ALL SELECT o_orderkey, 'ordered', 'date', strftime(o_orderdate, '%Y-%m-%d'), NULL FROM orders
        UNION ALL SELECT o_orderkey, 'status', 'string', o_orderstatus, NULL FROM orders""",
    "jobs": """SELECT event_id AS id, event_type AS status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, user_id AS doc_id, value,
        json_extract_string(props, '$.k')::BIGINT AS k FROM events""",
    "postings": f"""SELECT doc_id, col, unnest(range(len(ts)))::INT AS pos, unnest(ts) AS term FROM (
        SELECT doc_id, 'body' AS col, regexp_extract_all({FOLD.format("body")}, '[\\p{{L}}\\p{{N}}]+') AS ts FROM archive
        UNION ALL SELECT doc_id, 'title', regexp_extract_all({FOLD.format("title")}, '[\\p{{L}}\\p{{N}}]+') FROM archive)""",
    "columns": f"""SELECT doc_id, col, text FROM (UNPIVOT (SELECT a.doc_id, list_aggregate(list_sort(list_distinct(list_filter(regexp_extract_all({FOLD.format("concat_ws(' ', custom, title, filename)")}, '[\\p{{L}}\\p{{N}}]+'), lambda t: regexp_matches(t, '[0-9]')))), 'string_agg', ' ') AS ident,
        title, correspondent, document_type AS doctype, tags, custom, filename, concat_ws(' ', left(document_date, 4), left(document_date, 7), document_date, left(received_at, 4), left(received_at, 7), received_at) AS dates,
        regexp_extract(body, '^[^.!?\\n]*') AS summary, body, notes FROM archive a
        LEFT JOIN (SELECT doc_id, string_agg(tag, ' ' ORDER BY tag) AS tags FROM tagged GROUP BY doc_id) USING (doc_id)
        LEFT JOIN (SELECT doc_id, string_agg(f, ' ' ORDER BY f) AS custom FROM (SELECT doc_id, key || ' ' || coalesce(value_text, round(value_num * 100)::BIGINT::VARCHAR, '') AS f FROM fields) GROUP BY doc_id) USING (doc_id)
        LEFT JOIN (SELECT page_id AS doc_id, regexp_extract(url, '[^/]*$') AS filename FROM pages) USING (doc_id)
        LEFT JOIN (SELECT conv_id AS doc_id, text AS notes FROM conversations WHERE turn = 0) USING (doc_id)) ON ident, title, correspondent, doctype, tags, custom, filename, dates, summary, body, notes INTO NAME col VALUE text) WHERE text <> ''""",
    "terms": f"""SELECT doc_id, col, unnest(range(len(ts)))::INT AS pos, unnest(ts) AS term FROM (SELECT doc_id, col, regexp_extract_all({FOLD.format("text")}, '[\\p{{L}}\\p{{N}}]+') AS ts FROM columns)""",
    "vocab": "SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS cnt FROM postings WHERE col = 'body' GROUP BY term",
    "chunks": "SELECT vec_id, vec_id // 5 AS owner, vec_id % 3 AS kind, embedding, label FROM embeddings",
}
NEEDS = {"postings": ("archive",), "vocab": ("archive", "postings"), "columns": ("archive", "tagged", "fields"), "terms": ("archive", "tagged", "fields", "columns")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir) if name in VIEWS else table(spark, sf_dir, name)


def with_views(sql: str, names: tuple[str, ...]) -> str:
    """``sql`` with the views that it names as common table expressions."""
    wanted = [n for n in VIEW_SQL if n in names or any(n in NEEDS.get(m, ()) for m in names)]
    if not wanted:
        return sql
    head = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in wanted)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"

