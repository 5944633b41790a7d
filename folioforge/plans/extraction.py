"""Fields from text: dates, numbers, types, page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import dates as DT
from folioforge.functions import text as X
from folioforge.plans.catalog import query
from folioforge.session import table
from folioforge.sources.html import html_to_text


@query("SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS first_day, CASE WHEN day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN 2 ELSE 1 END AS n FROM orders")
def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written out as ``31.12.1998``; every reading counts, so day and month may change places."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.concat(F.lit("Rechnung vom "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" an")).alias("line"))
    found = o.withColumn("found", DT.dates_in("line")).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return found.select(F.col("o_orderkey").alias("doc_id"), F.element_at(F.filter("found", lambda d: d == F.col("day")), 1).alias("first_day"), F.size("found").alias("n"))


@query("SELECT o_orderkey AS doc_id, round(o_totalprice, 2) AS german, round(o_totalprice, 2) AS english FROM orders")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written in German and English notation come back as they were."""
    english = F.format_number(F.round("o_totalprice", 2), 2)
    german = F.concat(F.translate(english, ",.", ".,"), F.lit(" €"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", english.alias("e"), german.alias("g"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.round(X.parse_number(F.col("g")), 2).alias("german"), F.round(X.parse_number(F.concat(F.lit("EUR "), F.col("e"))), 2).alias("english"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'brass|copper') THEN 'invoice' WHEN regexp_matches(lower(p_type), 'steel') THEN 'contract' WHEN regexp_matches(lower(p_type), 'tin|nickel') THEN 'letter' ELSE 'other' END AS kind FROM part")
def document_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pattern that matches decides."""
    t = F.lower("p_type")
    kind = F.when(t.rlike("brass|copper"), "invoice").when(t.rlike("steel"), "contract").when(t.rlike("tin|nickel"), "letter").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@query("SELECT p_partkey, p_name || ' Q' || (p_size % 4 + 1) || ' ' || (1950 + p_size) AS quarter, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || (1950 + p_size) ELSE (1950 + p_size) || ' ' || p_name || ' 2001' END AS yearly FROM part")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in their usual form: quarters as ``Q3 2020``, however they are written, and a single year at the end."""
    number, year = F.col("p_size") % 4 + 1, (F.col("p_size") + 1950).cast("string")
    n = number.cast("string")
    roman = F.element_at(F.array(*[F.lit(r.upper()) for r in X.ROMAN]), number)
    kind = F.col("p_partkey") % 4
    typed = F.when(kind == 0, F.concat(n, F.lit(". Quartal "), year)).when(kind == 1, F.concat(roman, F.lit(" quartal/"), year)).when(kind == 2, F.concat(year, F.lit(" Q"), n)).otherwise(F.concat(F.lit("Quartal "), n, F.lit("-"), year))
    lead = F.when(F.col("p_partkey") % 2 == 0, F.concat(year, F.lit(" - "), "p_name")).otherwise(F.concat(year, F.lit(" "), "p_name", F.lit(" 2001")))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("  "), typed, F.lit(" -")).alias("q"), lead.alias("y"))
    return p.select("p_partkey", X.usual_titles("q").alias("quarter"), X.usual_titles("y").alias("yearly"))


@query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown text of the raw pages; a parser, so SQL has no form of it."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", html_to_text("html").alias("text"))
    return p.select("page_id", "url", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS pages FROM conversations WHERE length(trim(text)) > 0 GROUP BY conv_id")
def pages_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's text from its pages in order, blank ones left out."""
    c = table(spark, sf_dir, "conversations").where(F.length(F.trim("text")) > 0)
    per = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("pages"))
    return per.select("conv_id", F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("text"), F.size("pages").cast("long").alias("pages"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(date_trunc('quarter', ts), '%Y-%m-%d') AS quarter, strftime(last_day(ts), '%Y-%m-%d') AS month_end FROM events")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = "yyyy-MM-dd"
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.date_format(F.date_trunc("week", "ts"), day).alias("week"),
        F.date_format(F.date_trunc("quarter", "ts"), day).alias("quarter"),
        F.date_format(F.last_day("ts"), day).alias("month_end"),
    )


@query("SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE concat(left(text, 400), right(text, 100)) END AS excerpt, sha256(text) AS sha, sha256(left(text, 64)) AS head_sha FROM documents")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts as their first four fifths and last fifth of 500 characters."""
    t = F.col("text")
    cut = F.when(F.length(t) <= 500, t).otherwise(F.concat(F.substring(t, 1, 400), F.substring(t, -100, 100)))
    return table(spark, sf_dir, "documents").select("doc_id", cut.alias("excerpt"), F.sha2(t, 256).alias("sha"), F.sha2(F.substring(t, 1, 64), 256).alias("head_sha"))
