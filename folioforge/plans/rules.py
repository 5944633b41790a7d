"""Rules over fields, names, dates and batches: reading, validation, derived states.

Where the tables hold no such texts, a query writes them out of the tables' own values
(an order's date as a phrase, its price as an invoice line), so that the counterpart in
SQL can give the values themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import phrases as P
from folioforge.functions import text as X
from folioforge.plans.catalog import FOLD, archive, portable, postings, query, vocab
from folioforge.session import table

TODAY = "1998-08-02"
TERMS = f"regexp_extract_all({FOLD.format('text')}, '[\\p{{L}}\\p{{N}}]+')"

# --- date phrases ----------------------------------------------------------------------------


@query(
    f"""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(d, '%Y-01-01') WHEN 1 THEN strftime(date_trunc('month', d), '%Y-%m-%d') WHEN 2 THEN '1900-01-01' WHEN 3 THEN strftime(d, '%Y-01-01')
        WHEN 4 THEN (year(d) + 1) || '-01-01' WHEN 5 THEN strftime(DATE '{TODAY}' - (1 + o_orderkey % 90)::INT, '%Y-%m-%d') END AS date_from,
    CASE o_orderkey % 7 WHEN 0 THEN strftime(d, '%Y-12-31') WHEN 1 THEN strftime(last_day(d), '%Y-%m-%d') WHEN 2 THEN strftime(last_day(d), '%Y-%m-%d') WHEN 3 THEN (year(d) + 1) || '-12-31' WHEN 4 THEN '2100-12-31' WHEN 5 THEN '{TODAY}' END AS date_to
    FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)"""
)
def date_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each order, with its date in words; the range that the words mean."""
    year, month = F.year("o_orderdate").cast("string"), F.element_at(F.array(*[F.lit(names.split()[0]) for names in P.MONTH_NAMES]), F.month("o_orderdate"))
    kind = F.col("o_orderkey") % 7
    typed = (
        F.when(kind == 0, F.concat(F.lit("Vertrag im Jahr "), year)).when(kind == 1, F.concat(month, F.lit(" "), year, F.lit(" Rechnung"))).when(kind == 2, F.concat(F.lit("until "), month, F.lit(" "), year))
        .when(kind == 3, F.concat(F.lit("zwischen "), year, F.lit(" und "), (F.year("o_orderdate") + 1).cast("string"))).when(kind == 4, F.concat(F.lit("after "), year, F.lit(" invoice")))
        .when(kind == 5, F.concat(F.lit("last "), (1 + F.col("o_orderkey") % 90).cast("string"), F.lit(" days"))).otherwise(F.concat(F.lit('"seit '), year, F.lit('" Brief')))
    )
    found = table(spark, sf_dir, "orders").select("o_orderkey", P.date_range(typed, F.lit(TODAY).cast("date")).alias("r"))
    return found.select("o_orderkey", "r.date_from", "r.date_to")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(d, '%Y-01-01') WHEN 1 THEN strftime(d, '%Y-%m-01') WHEN 2 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%Y-01-01') END AS date_from,
    CASE o_orderkey % 4 WHEN 0 THEN strftime(d, '%Y-12-31') WHEN 1 THEN strftime(last_day(d), '%Y-%m-%d') WHEN 2 THEN strftime(d, '%Y-%m-%d') ELSE strftime(last_day(d), '%Y-%m-%d') END AS date_to FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)"""
)
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters written as a year, a month, a day or a span of these."""
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 4
    typed = F.when(kind == 0, F.date_format(d, "yyyy")).when(kind == 1, F.date_format(d, "yyyy-MM")).when(kind == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(d, "yyyy"), F.lit(".."), F.date_format(d, "yyyy-MM")))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.partial_range(typed).alias("r")).select("o_orderkey", "r.date_from", "r.date_to")


@query(
    "WITH p AS (SELECT DISTINCT substr(document_date, 1, 4) AS y FROM archive WHERE document_date IS NOT NULL) SELECT 'seit ' || p.y AS phrase, count(*) AS n FROM p JOIN archive a ON a.document_date >= p.y || '-01-01' AND a.document_date <= '2024-06-30' GROUP BY p.y",
    ("archive",),
)
def phrase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the range of each phrase. Days are counted first, so the range join sees one row a day."""
    days = archive(spark, sf_dir).where("document_date is not null").groupBy("document_date").agg(F.count("*").alias("n"))
    typed = days.select(F.concat(F.lit("seit "), F.substring("document_date", 1, 4)).alias("phrase")).distinct()
    ranges = typed.withColumn("r", P.date_range(F.col("phrase"), F.lit("2024-06-30").cast("date")))
    return ranges.join(days, F.col("document_date").between(F.col("r.date_from"), F.col("r.date_to"))).groupBy("phrase").agg(F.sum("n").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 AND o_orderdate::DATE + 30 > DATE '1997-06-30' THEN NULL WHEN o_orderkey % 3 = 2 THEN strftime(o_orderdate::DATE + 30, '%Y-%m-%d')
    WHEN o_orderdate::DATE > DATE '1997-06-30' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS as_of FROM orders""")
def as_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day that a statement is made up to: after "per", else the end of a period, else after "Stand"; none after the day it came."""
    day = lambda c: F.date_format(c, "dd.MM.yyyy")
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 3
    line = F.when(kind == 0, F.concat(F.lit("Depotauszug per "), day(d))).when(kind == 1, F.concat(F.lit("Bedingungen, Stand: "), day(d))).otherwise(F.concat(F.lit("Zeitraum vom "), day(d), F.lit(" bis "), day(F.date_add(d, 30))))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.as_of(line, F.lit("1997-06-30")).alias("as_of"))


# --- searches as typed -----------------------------------------------------------------------

STOPWORDS = ("the", "of", "and", "that", "with", "for", "this", "in", "on", "at", "by", "or", "is", "it", "to", "an", "as", "ed", "es", "er")
_STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)


@query(
    f"""WITH t AS (SELECT item_id, {TERMS} AS t FROM benchmark), m AS (SELECT item_id, t, list_filter(t, lambda w: w NOT IN ({_STOP_SQL})) AS kept FROM t)
    SELECT item_id, len(CASE WHEN len(kept) > 0 THEN kept ELSE t END) AS terms, CASE WHEN len(kept) > 0 THEN len(t) - len(kept) ELSE 0 END AS function_words,
    len(CASE WHEN len(kept) > 0 THEN kept ELSE t END) >= 3 AND CASE WHEN len(kept) > 0 THEN len(t) - len(kept) ELSE 0 END >= 2 AS question FROM m"""
)
def stopwords_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function words need not occur, unless there are no others; three other words and two of them make a written question."""
    b = table(spark, sf_dir, "benchmark").select("item_id", X.tokens(F.col("text")).alias("t"))
    kept = F.filter("t", lambda w: ~w.isin(*STOPWORDS))
    b = b.withColumn("kept", F.when(F.size(kept) > 0, kept).otherwise(F.col("t")))
    b = b.select("item_id", F.size("kept").cast("long").alias("terms"), (F.size("t") - F.size("kept")).cast("long").alias("function_words"))
    return b.withColumn("question", (F.col("terms") >= 3) & (F.col("function_words") >= 2))


portable(
    "number_runs",
    "WITH n AS (SELECT doc_id, col, pos, term, pos - row_number() OVER (PARTITION BY doc_id, col ORDER BY pos) AS run FROM {postings} WHERE translate(term, '0123456789', '') = ''), "
    "r AS (SELECT doc_id, col, run, min(pos) AS first_pos, count(*) AS numbers FROM n GROUP BY doc_id, col, run) SELECT doc_id, col, first_pos, numbers FROM r WHERE numbers >= 2",
)
portable(
    "merged_boxes",
    "WITH c AS (SELECT doc_id, pos, length(term) AS width, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM {postings} WHERE col = 'title' AND term LIKE '%th%') "
    "SELECT doc_id, min(pos) AS first_word, max(pos) AS last_word, CAST(sum(width) AS BIGINT) AS width FROM c GROUP BY doc_id, island",
)
portable("case_titles", "SELECT title, min(doc_id) AS doc_id FROM {archive} GROUP BY title HAVING count(*) = 1")
portable("suggested_names", "SELECT label, n FROM (SELECT correspondent AS label, count(*) AS n FROM {archive} GROUP BY correspondent UNION ALL SELECT document_type, count(*) FROM {archive} GROUP BY document_type) s WHERE lower(label) LIKE '%1%' OR lower(label) LIKE 'e%' ORDER BY CASE WHEN lower(label) LIKE 'e%' THEN 0 ELSE 1 END, n DESC, label LIMIT 10")


@query(
    """WITH d AS (SELECT doc_id, sha256(text) AS sha FROM documents), k AS (SELECT DISTINCT left(sha, 8 + (doc_id % 5)::INT) AS typed FROM d WHERE doc_id % 3 = 0)
    SELECT typed, min(doc_id) AS doc_id FROM k JOIN d ON starts_with(d.sha, typed) WHERE regexp_matches(typed, '[0-9]') AND regexp_matches(typed, '[a-f]') GROUP BY typed HAVING count(*) = 1"""
)
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of content hashes, with a digit and a letter, that one document alone has: an equality join on eight characters, then the rest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha")).withColumn("k", F.substring("sha", 1, 8))
    typed = d.where("doc_id % 3 = 0").select(F.expr("left(sha, 8 + cast(doc_id % 5 as int))").alias("typed")).distinct()
    typed = typed.where(F.col("typed").rlike("[0-9]") & F.col("typed").rlike("[a-f]")).withColumn("k", F.substring("typed", 1, 8))
    met = typed.join(d, "k").where(F.col("sha").startswith(F.col("typed")))
    return met.groupBy("typed").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(
    """WITH b AS (SELECT term, regexp_replace(term, '^([a-z]{5,}?)(en|es|e|n|s)$', '\\1') AS base FROM vocab)
    SELECT term, base, CASE WHEN base <> term THEN regexp_replace(base, '^(.*)([aou])e(.{0,3})$', '\\1\\2\\3') ELSE term END AS plain FROM b""",
    ("vocab",),
)
def word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likely base forms of every indexed word."""
    forms = vocab(spark, sf_dir).select("term", X.word_forms(F.col("term")).alias("f"))
    base = F.coalesce(F.get("f", F.lit(1)), F.col("term"))
    return forms.select("term", base.alias("base"), F.coalesce(F.get("f", F.lit(2)), base).alias("plain"))


@query(
    """WITH g AS (SELECT p_partkey, p_name, list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2)) AS g FROM part),
    n AS (SELECT p_partkey, p_name, unnest(g) AS pair FROM g), c AS (SELECT p_partkey, pair, count(*) AS n FROM n GROUP BY ALL),
    m AS (SELECT x.p_partkey AS a, y.p_partkey AS b, sum(least(x.n, y.n)) AS shared FROM c x JOIN c y ON x.pair = y.pair AND y.p_partkey = x.p_partkey + 1 GROUP BY ALL)
    SELECT a, b, shared::BIGINT AS shared, shared >= greatest(length(x.p_name), length(y.p_name)) - 1 - 3 * 2 AS close FROM m JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b"""
)
def close_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheap test before an edit distance: letter pairs that two names share, here of neighbouring parts."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    pairs = p.where(F.length("p_name") > 1).select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.length("p_name") - 1), lambda i: F.substr("p_name", i, F.lit(2)))).alias("pair"))
    c = pairs.groupBy("p_partkey", "pair").agg(F.count("*").alias("n"))
    other = c.select((F.col("p_partkey") - 1).alias("p_partkey"), "pair", F.col("n").alias("m"))
    # Both sides grow with the parts: a planner that goes by the size of files would send one of them through the driver.
    met = c.hint("merge").join(other, ["p_partkey", "pair"]).groupBy("p_partkey").agg(F.sum(F.least("n", "m")).alias("shared"))
    sized = p.select("p_partkey", F.length("p_name").alias("la")).hint("merge").join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.length("p_name").alias("lb")), "p_partkey")
    both = met.hint("merge").join(sized, "p_partkey")
    return both.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), "shared", (F.col("shared") >= F.greatest("la", "lb") - 7).alias("close"))


@query(f"SELECT doc_id, len(list_filter({TERMS}, lambda t: t IN ('license', 'software', 'the'))) AS hits FROM documents")
def count_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often words of a search stand in each text."""
    hits = F.filter(X.tokens(F.col("text")), lambda t: t.isin("license", "software", "the"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.size(hits), F.lit(0)).cast("long").alias("hits"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line_no FROM documents)
    SELECT doc_id, count(*) AS lines, sum(n)::BIGINT AS hits, min(line_no) AS first_line, max(line_no) AS last_line FROM (SELECT *, len(regexp_extract_all(line, '[0-9]{3,}')) AS n FROM l) WHERE n > 0 GROUP BY doc_id"""
)
def regex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match a pattern, with totals for each document; all within the row, nothing is exploded or shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n", -1), lambda x: F.regexp_count(x, F.lit("[0-9]{3,}"))).alias("n"))
    at = F.filter(F.transform("n", lambda n, i: F.when(n > 0, i + 1)), lambda i: i.isNotNull())
    found = docs.withColumn("at", at).where(F.size("at") > 0)
    return found.select("doc_id", F.size("at").cast("long").alias("lines"), F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n).alias("hits"), F.array_min("at").alias("first_line"), F.array_max("at").alias("last_line"))


# --- chunks ------------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS t FROM documents), p AS (SELECT doc_id, list_transform(regexp_extract_all(t, ' *(.{1,200}$|.{100,199} |.{200})', 1), lambda x: rtrim(x, ' ')) AS pieces FROM t)
    SELECT doc_id, len(pieces) AS n, md5(array_to_string(pieces, '|')) AS hash FROM p"""
)
def chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in pieces of at most 200 characters, cut at the last space of the second half; their hash tells whether a document has changed."""
    t = F.trim(F.regexp_replace("text", r"[\t\n\f\r ]+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", X.pieces(t, 200).alias("pieces"))
    return docs.select("doc_id", F.size("pieces").cast("long").alias("n"), F.md5(F.array_join("pieces", "|")).alias("hash"))


portable(
    "changed_chunks",
    "WITH old AS (SELECT doc_id, md5(text) AS hash FROM {documents} WHERE doc_id % 11 <> 0), new AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN concat(text, '.') ELSE text END) AS hash FROM {documents}) "
    "SELECT n.doc_id FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.doc_id = n.doc_id AND o.hash = n.hash)",
)
portable("filtered_vectors", "SELECT vec_id, owner FROM {chunks} c WHERE c.owner IN (SELECT doc_id FROM {archive} WHERE document_type = 'de' AND correspondent IN ('src0', 'src1', 'src2', 'src3'))")

# --- fields and names ----------------------------------------------------------------------------


@query("SELECT o_orderkey, 'R-' || o_custkey || '/' || (1000 + o_orderkey % 9000) AS number, round(o_totalprice, 2) AS amount FROM orders")
def field_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice number and amount out of a letter's text: the value after its keyword."""
    o = table(spark, sf_dir, "orders")
    amount = F.translate(F.format_number(F.round("o_totalprice", 2), 2), ",.", ".,")
    letter = F.concat(F.lit("Sehr geehrte Damen,\nRechnungsnummer: R-"), F.col("o_custkey").cast("string"), F.lit("/"), (1000 + F.col("o_orderkey") % 9000).cast("string"), F.lit("\nGesamtbetrag "), amount, F.lit(" EUR zum 1.1.\n"))
    return o.select("o_orderkey", X.field_after(letter, "rechnungsnummer", "invoice number").alias("number"), X.amount_after(letter, "gesamtbetrag", "amount due").alias("amount"))


portable(
    "validated_fields",
    "WITH p AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS kind, o_totalprice AS value, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS quoted, o_orderpriority AS text, o_orderstatus AS evidence FROM {orders}) "
    "SELECT doc_id, CASE WHEN kind IN (0, 1) AND abs(abs(value) - abs(quoted)) < 0.005 THEN 'applied' WHEN kind IN (0, 1) THEN 'number not in the text' WHEN kind = 2 AND instr(lower(text), 'high') > 0 THEN 'applied' WHEN kind = 2 THEN 'text not found' WHEN length(trim(evidence)) = 0 THEN 'no evidence' ELSE 'suggested' END AS verdict FROM p",
)


@query("SELECT DISTINCT p_name, length(p_name) <= 60 AND len(string_split(trim(p_name), ' ')) <= 4 AND regexp_full_match(p_name, '[A-Za-z0-9][A-Za-z0-9 .&-]*') AS plausible FROM part")
def plausible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a new name may be one: its length, its words, its characters."""
    good = (F.length("p_name") <= 60) & (F.size(F.split(F.trim("p_name"), " ")) <= 4) & F.col("p_name").rlike(r"^[A-Za-z0-9][A-Za-z0-9 .&-]*$")
    return table(spark, sf_dir, "part").select("p_name", good.alias("plausible")).distinct()


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '#Archive: ' || p_name END AS subject, p_partkey % 4 IN (1, 3) AS forwarded, p_partkey % 2 = 0 AS has_keyword FROM part")
def mail_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects without their marks and the keyword, and what these said; a word that only begins like the keyword stays."""
    k = F.col("p_partkey") % 4
    subject = F.concat(F.when(k == 0, "Re: ").when(k == 1, "WG: AW: ").when(k == 2, "").otherwise("Fwd:Re: "), F.when(F.col("p_partkey") % 2 == 0, "#Archiv ").otherwise("#Archive: "), F.col("p_name"))
    read = table(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(X.subject_parts(subject))))
    words = F.split("subject", " +")
    is_key = lambda w: F.lower(w) == "#archiv"
    return read.select("p_partkey", F.array_join(F.filter(words, lambda w: ~is_key(w)), " ").alias("subject"), "forwarded", F.exists(words, is_key).alias("has_keyword"))


portable(
    "temporary_names",
    "WITH n AS (SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN '.' WHEN 1 THEN '~' ELSE '' END, lower(p_name), CASE p_partkey % 7 WHEN 0 THEN '.part' WHEN 1 THEN '.tmp' WHEN 2 THEN '~' ELSE '.pdf' END) AS name FROM {part}) "
    "SELECT p_partkey, name FROM n WHERE NOT (name LIKE '.%' OR name LIKE '~%' OR name LIKE '%~' OR name LIKE '%.part' OR name LIKE '%.tmp' OR name LIKE '%.crdownload')",
)
portable(
    "skipped_attachments",
    "WITH a AS (SELECT p_partkey, p_size * 1024 AS bytes, CASE WHEN p_partkey % 3 = 0 THEN 'image/png' ELSE 'application/pdf' END AS type, p_partkey % 2 = 0 AS inline, concat('logo', p_partkey % 9, '.png') AS name FROM {part}) "
    "SELECT p_partkey, CASE WHEN type LIKE 'image/%' AND inline AND bytes < 20 * 1024 THEN 'small inline image' WHEN type LIKE 'image/%' AND name LIKE 'logo_.png' THEN 'excluded name' ELSE 'kept' END AS verdict FROM a",
)


@query("SELECT p_partkey, p_size::BIGINT AS first_page, (p_size + p_partkey % 6)::BIGINT AS last_page, (p_partkey % 6 + 2)::BIGINT AS pages FROM part")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page lists such as "3-7, 900": the pages that they name, a span at most 500 beyond its start."""
    spec = F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + F.col("p_partkey") % 6).cast("string"), F.lit(", 900 ,x"))
    span = F.transform(F.split(F.replace(spec, F.lit(" "), F.lit("")), ","), lambda s: F.struct(F.get(F.split(s, "-"), F.lit(0)).try_cast("int").alias("lo"), F.get(F.split(s, "-"), F.size(F.split(s, "-")) - 1).try_cast("int").alias("hi")))
    span = F.filter(span, lambda s: s["lo"].isNotNull() & (s["hi"] >= s["lo"]))
    pages = F.array_distinct(F.flatten(F.transform(span, lambda s: F.sequence(s["lo"], F.least(s["hi"], s["lo"] + 500)))))
    out = table(spark, sf_dir, "part").select("p_partkey", pages.alias("pages"))
    return out.select("p_partkey", F.array_min("pages").cast("long").alias("first_page"), F.array_max(F.filter("pages", lambda x: x < 900)).cast("long").alias("last_page"), F.size("pages").cast("long").alias("pages"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '[^/]*$') = '' THEN 'untitled' ELSE left(regexp_extract(url, '[^/]*$'), 200) END AS name FROM pages")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.trim(F.regexp_replace(F.substring_index(F.replace("url", F.lit("\\"), F.lit("/")), "/", -1), r"\p{Cntrl}", ""))
    return table(spark, sf_dir, "pages").select("page_id", F.when(last == "", "untitled").otherwise(F.substring(last, 1, 200)).alias("name"))


portable("sniffed_types", "SELECT page_id, CASE WHEN lower(substr(trim(html), 1, 9)) = '<!doctype' OR lower(substr(trim(html), 1, 5)) = '<html' THEN 'html' WHEN substr(html, 1, 4) = '%PDF' THEN 'pdf' WHEN substr(html, 1, 1) = '<' THEN 'markup' ELSE 'text' END AS type FROM {pages}")


@query("SELECT doc_id, length(regexp_replace(text, '(\\p{L})-\\n(\\p{L})', '\\1\\2', 'g')) AS characters FROM documents")
def unbroken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.unbroken(F.col("text"))).cast("long").alias("characters"))


@query(f"SELECT DISTINCT p_name, array_to_string(regexp_extract_all({FOLD.format('p_name')}, '[\\p{{L}}\\p{{N}}]+'), ' ') AS key FROM part")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys by which names are compared."""
    return table(spark, sf_dir, "part").select("p_name", X.normal_name(F.col("p_name")).alias("key")).distinct()


@query("SELECT conv_id, turn, length(regexp_replace(text, ' \\n', ' ', 'g')) AS characters FROM conversations")
def unflowed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flowed mail lines: one that ends in a space goes on in the next."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.regexp_replace("text", " \n", " ")).cast("long").alias("characters"))


portable("body_choice", "SELECT page_id, CASE WHEN length(trim(url)) < 0.3 * length(html) THEN 'html' ELSE 'plain' END AS body FROM {pages}")

# --- states and batches ----------------------------------------------------------------------------

portable("derived_status", "SELECT doc_id, CASE WHEN length(trim(body)) = 0 THEN 'failed' WHEN quality = 0 OR document_date IS NULL THEN 'needs_review' ELSE 'done' END AS status FROM {archive}")
#: What a million tokens cost: model, read, written. Figures of this project, for its examples; a user gives their own.
PRICES = (("alpha", 3.0, 12.0), ("beta", 0.75, 3.5), ("gamma", 0.1, 0.4))
#: Reading into a cache and from it, as shares of the price of reading.
CACHE_WRITE, CACHE_READ = 1.2, 0.2


def _model_costs_sql(prices: tuple) -> str:
    rows = ", ".join(f"('{m}', {i}, {o})" for m, i, o in prices)
    return (
        f"WITH price AS (SELECT * FROM (VALUES {rows}) AS t(model, p_in, p_out)), u AS (SELECT id, k, CASE id % 4 WHEN 0 THEN 'gamma-2' WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta-1' ELSE 'other' END AS model FROM {{jobs}}) "
        f"SELECT u.id, round(CAST((u.k * p.p_in + u.k * p.p_in * {CACHE_WRITE} + u.k * p.p_in * {CACHE_READ} + u.k * p.p_out) / 1000000 AS DOUBLE), 9) AS cost FROM u LEFT JOIN price p ON substr(u.model, 1, length(p.model)) = p.model"
    )


portable("model_costs", _model_costs_sql(PRICES))
portable(
    "catch_up",
    "SELECT a.doc_id FROM {archive} a WHERE a.quality IS NULL AND NOT EXISTS (SELECT 1 FROM {jobs} j WHERE j.doc_id = a.doc_id AND j.status = 'click') AND (SELECT count(*) FROM {jobs} WHERE status = 'none such') = 0 ORDER BY a.doc_id LIMIT 25",
)
portable(
    "settled_suggestions",
    "SELECT l.doc_id, CASE WHEN l.quality IS NULL OR l.toxic IS NULL THEN 'skipped' WHEN l.quality = l.toxic THEN 'accepted' WHEN a.document_type = 'de' THEN 'dismissed' ELSE 'open' END AS state FROM {labels} l JOIN {archive} a ON a.doc_id = l.doc_id",
)
portable(
    "stored_pairs",
    "WITH old AS (SELECT doc_id AS a, doc_id + 1 AS b, CASE WHEN doc_id % 4 = 0 THEN 'kept_both' ELSE 'open' END AS state FROM {archive} WHERE doc_id % 2 = 0), new AS (SELECT doc_id AS a, doc_id + 1 AS b FROM {archive} WHERE doc_id % 3 = 0) "
    "SELECT coalesce(o.a, n.a) AS a, coalesce(o.b, n.b) AS b, CASE WHEN o.state = 'kept_both' THEN 'kept_both' ELSE 'open' END AS state FROM old o FULL OUTER JOIN new n ON o.a = n.a AND o.b = n.b WHERE n.a IS NOT NULL OR o.state = 'kept_both'",
)
portable(
    "renamed_term",
    "SELECT a.doc_id, CASE WHEN a.correspondent = 'src3' AND NOT EXISTS (SELECT 1 FROM {archive} x WHERE x.correspondent = 'Stadtwerke') THEN 'Stadtwerke' ELSE a.correspondent END AS correspondent, CASE WHEN a.correspondent = 'src3' THEN 'src3' END AS alias FROM {archive} a",
)
portable("binder_filter", "SELECT doc_id, substr(received_at, 1, 7) AS section FROM {archive} WHERE correspondent = 'src5' AND substr(received_at, 1, 7) = '2024-01'")
portable("source_check", "SELECT w.source, w.source IN ('src0', 'src1', 'src2', 'src3') AS known, count(*) AS n FROM {documents} w GROUP BY w.source")
portable("title_names", "SELECT a.doc_id, n.n_name, r.r_name FROM {archive} a JOIN {nation} n ON n.n_nationkey = a.doc_id % 25 JOIN {region} r ON r.r_regionkey = n.n_regionkey")
portable("part_order", "SELECT id, k FROM {jobs} ORDER BY k NULLS LAST, id LIMIT 100")


@query("SELECT coalesce(source, '') AS batch, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS items, count(*) AS n FROM documents WHERE doc_id % 10 = 3 GROUP BY source")
def trash_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was thrown away together, in order."""
    d = table(spark, sf_dir, "documents").where("doc_id % 10 = 3")
    per = d.groupBy(F.coalesce("source", F.lit("")).alias("batch")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return per.select("batch", F.array_join("ids", ",").alias("items"), F.size("ids").cast("long").alias("n"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn DESC) AS lineage, max(turn) AS last FROM conversations GROUP BY conv_id")
def source_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that a combined document was made from, the last first."""
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role")), False).alias("parts"), F.max("turn").alias("last"))
    return per.select("conv_id", F.array_join(F.transform("parts", lambda p: p["role"]), ">").alias("lineage"), "last")


@query(
    """WITH RECURSIVE g AS (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY source) AS i FROM documents GROUP BY lang, source),
    f AS (SELECT lang, source, n, i, 1 AS batch, n AS size FROM g WHERE i = 1 UNION ALL SELECT g.lang, g.source, g.n, g.i, CASE WHEN f.size + g.n > 80 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.size + g.n > 80 THEN g.n ELSE f.size + g.n END FROM f JOIN g ON g.lang = f.lang AND g.i = f.i + 1)
    SELECT lang, source, batch FROM f"""
)
def title_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of titles packed in order into batches of at most 80, none divided: a fold over each language's few groups."""
    g = table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang", "source").agg(F.count("*").cast("int").alias("n"))
    per = g.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    none = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("size"), F.array().cast("array<struct<source:string,batch:int>>").alias("out"))

    def step(a, x):
        fresh = (a["batch"] == 0) | (a["size"] + x["n"] > 80)
        batch = a["batch"] + F.when(fresh, 1).otherwise(0)
        return F.struct(batch.alias("batch"), F.when(fresh, x["n"]).otherwise(a["size"] + x["n"]).alias("size"), F.concat(a["out"], F.array(F.struct(x["source"].alias("source"), batch.alias("batch")))).alias("out"))

    return per.select("lang", F.inline(F.aggregate("groups", none, step, lambda a: a["out"])))


@query("SELECT correspondent, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS fingerprint FROM archive GROUP BY correspondent", ("archive",))
def result_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value for the set of documents of each sender; the ids meet in order, whatever the partitions."""
    per = archive(spark, sf_dir).groupBy("correspondent").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return per.select("correspondent", F.sha2(F.array_join("ids", ","), 256).alias("fingerprint"))


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS bytes, source || '/' || doc_id || '.txt' AS path FROM documents")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export lists for each file."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), path.alias("path"))


@query("SELECT doc_id, source, lang, length(text) AS characters FROM documents")
def rebuilt_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from their JSON sidecars."""
    d = table(spark, sf_dir, "documents")
    side = d.select(F.to_json(F.struct("doc_id", "source", "lang", "text")).alias("json"))
    return side.select(F.from_json("json", "doc_id long, source string, lang string, text string").alias("r")).select("r.doc_id", "r.source", "r.lang", F.length("r.text").cast("long").alias("characters"))


@query("""SELECT to_json({'field': status, 'value': k % 3}) AS suggestion, count(*) AS n FROM jobs GROUP BY 1""", ("jobs",))
def grouped_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal suggestions, whatever the order of their keys when they were stored."""
    from folioforge.plans.catalog import jobs

    return jobs(spark, sf_dir).groupBy(F.to_json(F.struct(F.col("status").alias("field"), (F.col("k") % 3).alias("value"))).alias("suggestion")).agg(F.count("*").alias("n"))


@query("SELECT item_id, (SELECT max(seq) FROM archive) + row_number() OVER (ORDER BY item_id) AS seq FROM benchmark", ("archive",))
def renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New numbers after the last one. Rows are numbered within ranges of ids; only the ranges' counts meet in one place."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.floor(F.col("item_id") / 4096).alias("range"))
    counts = b.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    top = archive(spark, sf_dir).agg(F.max("seq").alias("top"))
    own = b.withColumn("own", F.row_number().over(Window.partitionBy("range").orderBy("item_id")))
    return own.join(before, "range").join(F.broadcast(top)).select("item_id", (F.col("top") + F.col("before") + F.col("own")).alias("seq"))


@query(
    """WITH y AS (SELECT substr(document_date, 1, 4)::INT AS year, count(*) AS n FROM archive WHERE document_date IS NOT NULL GROUP BY 1), s AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM y)
    SELECT s.year::INT AS year, coalesce(y.n, 0) AS n FROM s LEFT JOIN y ON y.year = s.year""",
    ("archive",),
)
def timeline_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year from the first to the last, those without documents, too."""
    y = archive(spark, sf_dir).where("document_date is not null").groupBy(F.substring("document_date", 1, 4).cast("int").alias("year")).agg(F.count("*").alias("n"))
    spine = y.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    return spine.join(y, "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(
    """WITH d AS (SELECT l_orderkey AS o, list_distinct(list(strftime(l_shipdate, '%Y-%m-%d'))) AS days FROM lineitem GROUP BY l_orderkey),
    j AS (SELECT x.o AS a, y.o AS b, list_filter(x.days, lambda t: NOT list_contains(y.days, t)) AS oa, list_filter(y.days, lambda t: NOT list_contains(x.days, t)) AS ob FROM d x JOIN d y ON y.o = x.o + 1)
    SELECT a, b, CASE WHEN len(oa) = 0 OR len(ob) = 0 THEN false WHEN len(oa) = 1 AND len(ob) = 1 THEN hamming(oa[1], ob[1]) > 1 ELSE true END AS conflict FROM j"""
)
def date_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of two documents names a day that the other lacks; one day on each side that differs in one digit may be misread."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("days"))
    x, y = d.select(F.col("l_orderkey").alias("a"), F.col("days").alias("da")), d.select((F.col("l_orderkey") - 1).alias("a"), F.col("days").alias("db"))
    both = x.join(y, "a").select("a", (F.col("a") + 1).alias("b"), F.array_except("da", "db").alias("oa"), F.array_except("db", "da").alias("ob"))
    digits = F.zip_with(F.split(F.get("oa", F.lit(0)), ""), F.split(F.get("ob", F.lit(0)), ""), lambda p, q: (p != q).cast("int"))
    differ = F.aggregate(digits, F.lit(0), lambda s, z: s + z)
    conflict = F.when((F.size("oa") == 0) | (F.size("ob") == 0), False).when((F.size("oa") == 1) & (F.size("ob") == 1), differ > 1).otherwise(True)
    return both.select("a", "b", conflict.alias("conflict"))


@query(f"""SELECT doc_id, list_aggregate(list_sort(list_distinct(list_filter({TERMS}, lambda t: t IN ('januar', 'january', 'jan', 'mai', 'may', 'q1', 'q2', 'juni', 'june', 'jun')))), 'string_agg', ' ') AS words FROM documents WHERE len(list_filter({TERMS}, lambda t: t IN ('januar', 'january', 'jan', 'mai', 'may', 'q1', 'q2', 'juni', 'june', 'jun'))) > 0""")
def period_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words by which letters name their period."""
    words = F.array_sort(F.array_distinct(F.filter(X.tokens(F.col("text")), lambda t: t.isin("januar", "january", "jan", "mai", "may", "q1", "q2", "juni", "june", "jun"))))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0).select("doc_id", F.array_join("w", " ").alias("words"))


@query("WITH h AS (SELECT DISTINCT doc_id, term FROM postings WHERE term IN ('license', 'software')), a AS (SELECT doc_id FROM h GROUP BY doc_id HAVING count(*) = 2) SELECT doc_id FROM h GROUP BY doc_id HAVING count(*) >= CASE WHEN (SELECT count(*) FROM a) > 0 THEN 2 ELSE 1 END", ("postings",))
def all_or_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all words of a search or, if there are none, with any: decided by the counts, in the plan."""
    h = postings(spark, sf_dir).where(F.col("term").isin("license", "software")).groupBy("doc_id").agg(F.count_distinct("term").alias("n"))
    need = h.agg(F.coalesce(F.max("n"), F.lit(1)).alias("most"))
    return h.join(F.broadcast(need)).where(F.col("n") >= F.when(F.col("most") == 2, 2).otherwise(1)).select("doc_id")
