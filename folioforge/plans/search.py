"""Text, vocabulary, search and facet queries over the whole archive.

The searches are the sentences of the benchmark's passages, each with all its words of
four letters and more; all of them run at once, as joins with the stored index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import stems
from folioforge.functions import text as X
from folioforge.functions.words import telling_candidates, word_totals
from folioforge.operators import index as I
from folioforge.operators import ranking as R
from folioforge.operators import search as S
from folioforge.operators.facets import facet_counts
from folioforge.operators.similar import most_similar
from folioforge.plans.catalog import FOLD, archive, bodies, columns, query, stored_index, tagged, vocab
from folioforge.session import materialise, table

TOKENS = f"regexp_extract_all({FOLD.format('text')}, '[\\p{{L}}\\p{{N}}]+')"
#: Searches of one passage have consecutive numbers from a multiple of this on.
PER_ITEM = 1000


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, text``: every sentence of every passage."""
    parts = F.posexplode(F.split("text", "[.!?\\n]+")).alias("ix", "text")
    return table(spark, sf_dir, "benchmark").select("item_id", parts).select((F.col("item_id") * PER_ITEM + F.col("ix")).alias("query_id"), "text")


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.filter(X.tokens(F.col("text")), lambda t: F.length(t) >= 4))
    return sentences(spark, sf_dir).select("query_id", F.posexplode(words).alias("term_ix", "term"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of every sentence, in order."""
    return sentences(spark, sf_dir).select("query_id", F.posexplode(X.tokens(F.col("text"))).alias("term_ix", "term"))


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``term, other``: a table of words for the same thing, made from the tables: the longest word of each passage and that of the next one."""
    t = F.filter(X.tokens(F.col("text")), lambda w: F.length(w) >= 4)
    word = F.get(F.reverse(F.array_sort(F.transform(t, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), F.lit(0))["w"]
    each = table(spark, sf_dir, "benchmark").select("item_id", word.alias("word")).where("word is not null")
    after = each.select((F.col("item_id") - 1).alias("item_id"), F.col("word").alias("other"))
    return each.join(after, "item_id").where("word <> other").select(F.col("word").alias("term"), "other").distinct()


SENTENCES_SQL = f"""sentences AS (SELECT item_id * {PER_ITEM} + ix AS query_id, text FROM (SELECT item_id, unnest(range(len(p))) AS ix, unnest(p) AS text FROM (SELECT item_id, string_split_regex(text, '[.!?\n]+') AS p FROM benchmark)))"""
SEARCHES_SQL = f"""{SENTENCES_SQL}, searches AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY p) - 1)::INT AS term_ix, term FROM (
        SELECT query_id, term, min(p) AS p FROM (SELECT query_id, unnest({TOKENS}) AS term, unnest(range(len({TOKENS}))) AS p FROM sentences)
        WHERE length(term) >= 4 GROUP BY query_id, term))"""
PHRASES_SQL = f"{SENTENCES_SQL}, phrases AS (SELECT query_id, unnest({TOKENS}) AS term, unnest(range(len({TOKENS}))) AS ix FROM sentences)"
SYNONYMS_SQL = f"""longest AS (SELECT item_id, list_sort(list_transform(list_filter({TOKENS}, lambda w: length(w) >= 4), lambda w: {{'n': length(w), 'w': w}}), 'DESC')[1]['w'] AS word FROM benchmark),
    synonyms AS (SELECT DISTINCT a.word AS term, b.word AS other FROM longest a JOIN longest b ON b.item_id = a.item_id + 1 WHERE a.word <> b.word)"""
STATS_SQL = """words AS (SELECT DISTINCT term AS word FROM terms), sized AS (SELECT doc_id, count(*) AS dl FROM terms GROUP BY doc_id),
    corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM sized)"""
_LETTERS = "regexp_full_match({}, '\\p{{L}}+')"
FORMS_SQL = f"""wf AS (SELECT query_id, term_ix, term, unnest(list_distinct([term, base, CASE WHEN base <> term THEN regexp_replace(base, '^(.*)([aou])e(.{{0,3}})$', '\\1\\2\\3') ELSE term END])) AS form
        FROM (SELECT *, regexp_replace(term, '^([a-z]{{5,}}?)(en|es|e|n|s)$', '\\1') AS base FROM searches)),
    both_sides AS (SELECT word AS w FROM words UNION SELECT term FROM searches), {stems.stem_sql("both_sides", "w")},
    same AS (SELECT s.query_id, s.term_ix, s.term, w.word FROM searches s JOIN stems a ON a.word = s.term JOIN stems b ON b.stem = a.stem JOIN words w ON w.word = b.word
        WHERE length(s.term) >= 4 AND length(a.stem) >= 3 AND w.word <> s.term AND {_LETTERS.format("s.term")} AND {_LETTERS.format("w.word")}),
    usable AS (SELECT DISTINCT query_id, term_ix, form FROM (SELECT query_id, term_ix, term, form FROM wf WHERE {_LETTERS.format("term")} UNION ALL SELECT query_id, term_ix, term, word FROM same) WHERE length(term) >= 5 AND length(form) >= 4),
    comp AS (SELECT u.query_id, u.term_ix, w.word FROM usable u JOIN words w ON contains(substr(w.word, 2), u.form) WHERE {_LETTERS.format("w.word")} AND (
        len(list_filter(['', 'en', 'es', 'e', 'n', 's', 'er', 'ern'], lambda e: ends_with(w.word, u.form || e) AND length(w.word) > length(u.form || e))) > 0
        OR length(u.form) >= 6 AND length(w.word) >= length(u.form) + 7 AND contains(substr(w.word, 4, length(w.word) - 7), u.form)))"""
_STARTS = "w.word = {0} OR (length({0}) >= 3 AND NOT regexp_matches({0}, '[0-9]') AND starts_with(w.word, {0}))"
WEIGHT_SQL = "CASE p.col " + " ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in S.WEIGHTS.items()) + " END"
META_SQL = ", ".join(f"'{c}'" for c in S.META)


def expanded_sql(level: int) -> str:
    """What each term stands for up to a level, and the matches."""
    parts = [f"SELECT s.query_id, s.term_ix, w.word, 0 AS level FROM wf s JOIN words w ON {_STARTS.format('s.form')}"]
    if level >= S.FORMS:
        parts += ["SELECT query_id, term_ix, word, 1 FROM same", "SELECT query_id, term_ix, word, 1 FROM comp"]
    if level >= S.RELATED:
        parts.append(f"SELECT s.query_id, s.term_ix, w.word, 2 FROM searches s JOIN synonyms y USING (term) JOIN words w ON {_STARTS.format('y.other')}")
    return f"""{FORMS_SQL}, expanded AS (SELECT query_id, term_ix, word, min(level) AS level FROM ({" UNION ALL ".join(parts)}) GROUP BY query_id, term_ix, word),
    found AS (SELECT e.query_id, p.doc_id, e.term_ix, min(e.level) AS level, min(CASE WHEN p.col IN ({META_SQL}) THEN e.level END) AS meta_level, min(CASE WHEN p.col = 'title' THEN e.level END) AS title_level,
        {", ".join(f"sum(CASE WHEN e.level <= {lv} THEN {WEIGHT_SQL} ELSE 0 END) AS tf{lv}" for lv in range(3))}
        FROM expanded e JOIN (SELECT doc_id, col, term FROM terms) p ON p.term = e.word GROUP BY e.query_id, p.doc_id, e.term_ix)"""


def bm25_sql(name: str, tf: str) -> str:
    return f"""{name} AS (SELECT f.query_id, f.doc_id, -sum(greatest(ln((c.n_docs - d.df + 0.5) / (d.df + 0.5)), 1e-6) * f.{tf} * 2.2 / (f.{tf} + 1.2 * (0.25 + 0.75 * z.dl / c.avg_dl))) AS bm25
        FROM found f JOIN (SELECT query_id, term_ix, count(*) AS df FROM found WHERE {tf} > 0 GROUP BY query_id, term_ix) d USING (query_id, term_ix) JOIN sized z USING (doc_id) CROSS JOIN corpus c WHERE f.{tf} > 0 GROUP BY f.query_id, f.doc_id)"""


# --- text and vocabulary ---------------------------------------------------------------------


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, coalesce(t[1], '') AS first_token FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def fold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_token"))


@query("SELECT term, docs, cnt FROM vocab", ("vocab",))
def vocab_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab(spark, sf_dir).select("term", "docs", "cnt")


@query("SELECT term, docs FROM vocab WHERE term >= 'the' AND term < 'thf' AND length(term) BETWEEN 4 AND 9", ("vocab",))
def vocab_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab(spark, sf_dir).where((F.col("term") >= "the") & (F.col("term") < "thf") & F.length("term").between(4, 9)).select("term", "docs")


@query(
    f"WITH {SEARCHES_SQL} SELECT s.query_id, s.term_ix, count(*) AS n FROM searches s JOIN vocab v ON length(s.term) >= 6 AND ends_with(v.term, s.term) AND length(v.term) >= length(s.term) + 3 GROUP BY s.query_id, s.term_ix",
    ("vocab",),
)
def compound_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = searches(spark, sf_dir).where(F.length("term") >= 6).withColumn("k", F.substring("term", -3, 3))
    words = vocab(spark, sf_dir).select(F.col("term").alias("word")).withColumn("k", F.substring("word", -3, 3))
    hits = typed.join(words, "k").where(F.col("word").endswith(F.col("term")) & (F.length("word") >= F.length("term") + 3))
    return hits.groupBy("query_id", "term_ix").agg(F.count("*").alias("n"))


@query()
def similar_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition errors count as one edit, which SQL cannot say; tested against the plain function."""
    hits = S.similar_words(searches(spark, sf_dir), vocab(spark, sf_dir).select(F.col("term").alias("word")))
    return S.top(hits.withColumn("query_id", F.struct("query_id", "term_ix")), 12, F.col("edits"), F.col("word")).select("query_id.query_id", "query_id.term_ix", "term", "word", "edits")


@query(
    f"""WITH {SEARCHES_SQL}, typed AS (SELECT query_id, term_ix, term || 'x' AS term FROM searches WHERE length(term) >= 5)
    SELECT query_id, term_ix, term, word FROM (SELECT t.*, v.term AS word, row_number() OVER (PARTITION BY query_id, term_ix ORDER BY levenshtein(t.term, v.term), v.docs DESC, v.term) AS rn
    FROM typed t JOIN vocab v ON left(v.term, 1) = left(t.term, 1) AND abs(length(v.term) - length(t.term)) <= 2 AND levenshtein(t.term, v.term) <= 2) WHERE rn = 1""",
    ("vocab",),
)
def typo_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest indexed word for words with a stray letter: first letter and length first, edit distance last."""
    typed = searches(spark, sf_dir).where(F.length("term") >= 5).withColumn("term", F.concat("term", F.lit("x")))
    return closest_words(typed, vocab(spark, sf_dir))


def closest_words(typed: DataFrame, words: DataFrame) -> DataFrame:
    """``query_id, term_ix, term, word``; a term that many searches have meets ``words(term, docs)`` once."""
    left = typed.select("term").distinct().withColumn("k", F.substring("term", 1, 1)).withColumn("n", F.explode(F.sequence(F.length("term") - 2, F.length("term") + 2)))
    right = words.select(F.col("term").alias("word"), "docs").withColumn("k", F.substring("word", 1, 1)).withColumn("n", F.length("word"))
    near = left.join(right, ["k", "n"]).withColumn("d", F.levenshtein("term", "word", 2)).where("d >= 0")
    best = near.groupBy("term").agg(F.min(F.struct("d", -F.col("docs"), "word")).alias("b"))
    return typed.join(best, "term").select("query_id", "term_ix", "term", "b.word")


@query(
    f"""WITH {SEARCHES_SQL}, w AS (SELECT term, docs FROM vocab WHERE length(term) >= 3), cuts AS (SELECT query_id, term_ix, term, unnest(range(3, length(term) - 2)) AS i FROM searches WHERE length(term) >= 7),
    split AS (SELECT c.query_id, c.term_ix, c.term, h.term AS head, t.term AS tail, round(sqrt(h.docs * t.docs::DOUBLE), 6) AS score, least(length(h.term), length(t.term)) AS short FROM cuts c JOIN w h ON h.term = left(c.term, c.i) JOIN w t ON t.term = substr(c.term, c.i + 1))
    SELECT query_id, term_ix, head, tail, score FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id, s.term_ix ORDER BY score DESC, short DESC, head DESC) AS rn, coalesce(v.docs, 0) AS whole FROM split s LEFT JOIN vocab v ON v.term = s.term) WHERE rn = 1 AND score > whole""",
    ("vocab",),
)
def compound_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compound's two parts: those whose counts have the largest geometric mean, if it beats the whole word's."""
    words = vocab(spark, sf_dir).select("term", "docs")
    typed = searches(spark, sf_dir).where(F.length("term") >= 7)
    cuts = typed.withColumn("i", F.explode(F.sequence(F.lit(3), F.length("term") - 3)))
    cuts = cuts.withColumn("head", F.expr("left(term, i)")).withColumn("tail", F.expr("substring(term, i + 1)"))
    heads, tails = words.select(F.col("term").alias("head"), F.col("docs").alias("nh")), words.select(F.col("term").alias("tail"), F.col("docs").alias("nt"))
    split = cuts.join(heads, "head").join(tails, "tail").withColumn("score", F.round(F.sqrt(F.col("nh") * F.col("nt").cast("double")), 6))
    best = split.groupBy("query_id", "term_ix", "term").agg(F.max(F.struct("score", F.least(F.length("head"), F.length("tail")), "head", "tail")).alias("b"))
    best = best.join(words, "term", "left").where(F.col("b.score") > F.coalesce("docs", F.lit(0)))
    return best.select("query_id", "term_ix", "b.head", "b.tail", "b.score")


@query(f"WITH voc AS (SELECT term FROM vocab WHERE regexp_full_match(term, '[a-z]+')), {stems.stem_sql('voc', 'term')} SELECT word AS term, stem, count(*) OVER (PARTITION BY stem) AS words FROM stems", ("vocab",))
def stem_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every indexed word, and how many words share it."""
    words = vocab(spark, sf_dir).where(F.col("term").rlike("^[a-z]+$")).select("term")
    stemmed = materialise(stems.with_stem(words, "term"), "stems")
    return stemmed.join(stemmed.groupBy("stem").agg(F.count("*").alias("words")), "stem").select("term", "stem", "words")


# --- search ----------------------------------------------------------------------------------


def _found(typed: DataFrame, index: I.Index, level: int, others: DataFrame | None = None, **more: bool | DataFrame) -> list[R.Found]:
    """What the searches find, made once; the words found are few and read their own buckets of postings."""
    return R.find(typed, index, level, others, **more)


@query(
    f"WITH {SEARCHES_SQL}, {STATS_SQL}, {expanded_sql(S.LITERAL)}, {bm25_sql('scored', 'tf0')} SELECT query_id, doc_id, score, rn AS place FROM (SELECT query_id, doc_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6), doc_id DESC) AS rn FROM scored) WHERE rn <= 10",
    ("terms",),
)
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each search, any of its words, as typed, over all columns by their weights."""
    return _bm25(searches(spark, sf_dir), stored_index(spark, sf_dir))


def _bm25(typed: DataFrame, index: I.Index) -> DataFrame:
    return _best_ten(_found(typed, index, S.LITERAL))


def _best_ten(found: list[R.Found]) -> DataFrame:
    scored = R.best(found, lambda part: part.bm25(10)).withColumn("score", F.round("rank", 6))
    return S.top(scored, 10, F.col("score"), F.col("doc_id").desc()).select("query_id", "doc_id", "score", "place")


_CHANGED_SQL = """SELECT doc_id, col, CASE WHEN col = 'body' AND doc_id % 50 = 7 THEN reverse(split_part(text, '.', 1)) || ' ' || split_part(text, '.', 2) ELSE text END AS text FROM columns WHERE doc_id % 50 <> 13"""


@query(
    f"WITH {SEARCHES_SQL}, changed AS ({_CHANGED_SQL}), later AS (SELECT doc_id, col, unnest({TOKENS}) AS term FROM changed), {STATS_SQL.replace('terms', 'later')}, {expanded_sql(S.LITERAL).replace('FROM terms', 'FROM later')}, {bm25_sql('scored', 'tf0')} "
    "SELECT query_id, doc_id, score, rn AS place FROM (SELECT query_id, doc_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6), doc_id DESC) AS rn FROM scored) WHERE rn <= 10",
    ("columns",),
)
def index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same searches after one document in fifty got another text and another one was removed: a delta segment instead of a new index."""
    old = columns(spark, sf_dir)
    text = F.when((F.col("col") == "body"), F.concat_ws(" ", F.reverse(F.split_part("text", F.lit("."), F.lit(1))), F.split_part("text", F.lit("."), F.lit(2)))).otherwise(F.col("text"))
    changed = old.where("doc_id % 50 = 7").select("doc_id", "col", text.alias("text"))
    removed = old.where("doc_id % 50 = 13").select("doc_id").distinct()
    return _bm25(searches(spark, sf_dir), I.update(stored_index(spark, sf_dir), changed, removed))


NEAR_SQL = """size AS (SELECT query_id, count(*) AS size FROM searches GROUP BY query_id),
    hit AS (SELECT s.query_id, p.doc_id, p.col, s.term_ix, p.pos, z.size FROM searches s JOIN size z USING (query_id) JOIN terms p ON p.term = s.term WHERE z.size > 1),
    held AS (SELECT * FROM hit JOIN (SELECT query_id, doc_id, col FROM hit GROUP BY query_id, doc_id, col HAVING count(DISTINCT term_ix) = max(size)) USING (query_id, doc_id, col)),
    near AS (SELECT DISTINCT query_id, doc_id FROM (SELECT a.query_id, a.doc_id, a.col, a.pos FROM held a JOIN held b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.col = b.col AND b.pos BETWEEN a.pos - 11 AND a.pos
        GROUP BY a.query_id, a.doc_id, a.col, a.pos HAVING count(DISTINCT b.term_ix) = max(a.size)))"""
TIERS_SQL = f"""WITH {SEARCHES_SQL}, {STATS_SQL}, {SYNONYMS_SQL}, {expanded_sql(S.RELATED)}, {", ".join(bm25_sql(f"b{lv}", f"tf{lv}") for lv in range(3))}, {NEAR_SQL},
    per AS (SELECT query_id, doc_id, count(*) AS got, max(level) AS level, count(meta_level) AS described, max(meta_level) AS meta_level, count(title_level) AS titled FROM found GROUP BY query_id, doc_id),
    tier AS (SELECT p.query_id, p.doc_id, titled = size AS in_title, CASE WHEN described = size THEN meta_level ELSE level + 3 END AS tier FROM per p JOIN size s USING (query_id) WHERE got = size),
    ranked AS (SELECT t.query_id, t.doc_id, t.tier::INT AS tier, a.received_at, round(t.tier * 10000.0::DOUBLE + CASE t.tier % 3 WHEN 0 THEN b0.bm25 WHEN 1 THEN b1.bm25 ELSE b2.bm25 END
            * (1 + CASE WHEN in_title THEN 1 ELSE 0 END + CASE WHEN n.doc_id IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN left(a.document_date, 4) = (2023 + t.query_id // {PER_ITEM} % 2)::VARCHAR THEN 0.5 ELSE 0 END), 6) AS rank
        FROM tier t LEFT JOIN b0 USING (query_id, doc_id) LEFT JOIN b1 USING (query_id, doc_id) LEFT JOIN b2 USING (query_id, doc_id) LEFT JOIN near n USING (query_id, doc_id) JOIN archive a ON a.doc_id = t.doc_id)"""


def _dated(spark: SparkSession, sf_dir: str, typed: DataFrame) -> dict[str, DataFrame | bool]:
    """What tiers ask of documents and searches: dates, words near each other, and the year that a search names, 2023 or 2024, by its passage."""
    day = F.translate("received_at", "-", "").cast("long")
    dates = archive(spark, sf_dir).select("doc_id", day.alias("received"), F.substring("document_date", 1, 4).cast("long").alias("year"))
    named = (2023 + F.floor(F.col("query_id") / PER_ITEM) % 2).cast("long")
    return {"near": True, "dates": dates, "years": typed.select("query_id").distinct().withColumn("year", named)}


@query(
    TIERS_SQL + " SELECT query_id, doc_id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, received_at DESC, doc_id DESC) AS rn FROM ranked) WHERE rn <= 20",
    ("archive", "terms"),
)
def search_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches whose words must all occur: the description before the text, words as typed before their forms and other words, then BM25 with its boosts; the newest first among equals."""
    index = stored_index(spark, sf_dir)
    typed = materialise(searches(spark, sf_dir), "search-typed")
    found = _found(typed, index, S.RELATED, synonyms(spark, sf_dir), **_dated(spark, sf_dir, typed))
    ranked = R.best(found, lambda part: part.tiers(20)).withColumn("rank", F.round("rank", 6))
    return S.top(ranked, 20, F.col("rank"), F.col("when").desc(), F.col("doc_id").desc()).select("query_id", "doc_id", F.col("tier").cast("int").alias("tier"), "rank")


@query(
    f"""WITH {SEARCHES_SQL}, {STATS_SQL}, {SYNONYMS_SQL}, {expanded_sql(S.RELATED)}, size AS (SELECT query_id, count(*) AS size FROM searches GROUP BY query_id),
    per AS (SELECT query_id, doc_id, count(*) AS got, max(level) AS level, count(meta_level) AS described, max(meta_level) AS meta_level FROM found GROUP BY query_id, doc_id)
    SELECT query_id, CASE WHEN described = size THEN meta_level ELSE level + 3 END::INT AS tier, count(*) AS n FROM per JOIN size USING (query_id) WHERE got = size GROUP BY ALL""",
    ("terms",),
)
def search_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each tier of a search has, with the words that a table of synonyms gives."""
    typed = materialise(searches(spark, sf_dir), "search-typed")
    found = _found(typed, stored_index(spark, sf_dir), S.RELATED, synonyms(spark, sf_dir))
    return R.best(found, lambda part: part.tier_counts())


@query()
def search_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches with a stray letter in their second word, all levels at once; recognition errors have no SQL; tests hold the words against the plain function and tiers on made documents."""
    typed = searches(spark, sf_dir).withColumn("term", F.when(F.col("term_ix") == 1, F.concat("term", F.lit("x"))).otherwise(F.col("term")))
    typed = materialise(typed, "search-typed")
    index = stored_index(spark, sf_dir)
    found = _found(typed, index, S.SIMILAR, near=True)
    ranked = R.best(found, lambda part: part.tiers(20)).withColumn("rank", F.round("rank", 6))
    return S.top(ranked, 20, F.col("rank"), F.col("doc_id").desc()).select("query_id", "doc_id", F.col("tier").cast("int").alias("tier"), "rank")


COVERAGE_SQL = f"""{bm25_sql("strongly", "tf1")},
    counts AS (SELECT query_id, term_ix, ln(1 + n_docs / greatest(1, count(*) FILTER (level <= 1))) AS idf_strong, ln(1 + n_docs / count(*)) AS idf_weak FROM found CROSS JOIN corpus GROUP BY query_id, term_ix, n_docs),
    whole AS (SELECT query_id, sum(idf_strong) AS whole FROM counts GROUP BY query_id),
    parts AS (SELECT query_id, doc_id, round_even(round(sum(CASE WHEN level <= 1 THEN idf_strong ELSE 0.5 * idf_weak END) / max(whole), 9), 1) AS coverage FROM found JOIN counts USING (query_id, term_ix) JOIN whole USING (query_id) GROUP BY query_id, doc_id),
    covered AS (SELECT p.query_id, p.doc_id, p.coverage, round((1 - p.coverage) * 1000000 + coalesce(s.bm25, 0), 6) AS rank FROM parts p LEFT JOIN strongly s USING (query_id, doc_id))"""
PARTIAL_SQL = f"WITH {SEARCHES_SQL}, {STATS_SQL}, {SYNONYMS_SQL}, {expanded_sql(S.RELATED)}, {COVERAGE_SQL}"


@query(
    PARTIAL_SQL + " SELECT query_id, doc_id, coverage, rank, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id DESC) AS rn FROM covered) WHERE rn <= 10",
    ("terms",),
)
def search_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches ranked by how much of them a document covers; other words for a word count half."""
    index = stored_index(spark, sf_dir)
    found = _found(searches(spark, sf_dir), index, S.RELATED, synonyms(spark, sf_dir))
    ranked = R.best(found, lambda part: part.coverage(10)).withColumn("rank", F.round("rank", 6))
    return S.top(ranked, 10, F.col("rank"), F.col("doc_id").desc()).select("query_id", "doc_id", "coverage", "rank", "place")


@query(
    f"""{TIERS_SQL}, {COVERAGE_SQL}, every AS (SELECT query_id, doc_id, false AS partial, rank FROM ranked UNION ALL SELECT query_id, doc_id, true, rank FROM covered WHERE query_id NOT IN (SELECT query_id FROM ranked))
    SELECT query_id, doc_id, partial, rank, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id DESC) AS rn FROM every) WHERE rn <= 10""",
    ("archive", "terms"),
)
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: all words where any document has them all, else partial matches; decided for each search by itself."""
    index = stored_index(spark, sf_dir)
    typed = materialise(searches(spark, sf_dir), "search-typed")
    found = _found(typed, index, S.RELATED, synonyms(spark, sf_dir), **_dated(spark, sf_dir, typed))
    columns_ = ["query_id", "doc_id", F.round("rank", 6).alias("rank")]
    # The ten best of a task are enough, as equal ranks go by the document alone here.
    whole = materialise(R.best(found, lambda part: part.tiers(10, dated=False)).select(*columns_, F.lit(False).alias("partial")), "search-whole")
    rest = R.best(found, lambda part: part.coverage(10)).select(*columns_, F.lit(True).alias("partial"))
    part = rest.join(S.sent(whole.select("query_id").distinct(), "search-answered"), "query_id", "left_anti")
    return S.top(whole.unionByName(part), 10, F.col("rank"), F.col("doc_id").desc()).select("query_id", "doc_id", "partial", "rank", "place")


VOTES_SQL = f"""{PHRASES_SQL}, phrase_size AS (SELECT query_id, count(*) AS size FROM phrases GROUP BY query_id),
    votes AS (SELECT l.query_id, p.doc_id, p.col, p.pos - l.ix AS start, count(*) AS votes FROM phrases l JOIN terms p ON p.term = l.term GROUP BY ALL),
    stood AS (SELECT query_id, doc_id, col, start FROM votes JOIN phrase_size USING (query_id) WHERE votes = size)"""


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored_index(spark, sf_dir)
    typed = materialise(phrases(spark, sf_dir), "search-phrases")
    return S.phrase_hits(typed, index.postings(typed), index.words())


@query(f"WITH {VOTES_SQL} SELECT query_id, doc_id, col, count(*) AS hits FROM stood GROUP BY query_id, doc_id, col", ("terms",))
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where all words of each sentence stand side by side."""
    return _phrases(spark, sf_dir)


@query(f"WITH {SEARCHES_SQL}, {NEAR_SQL} SELECT query_id, doc_id FROM near", ("terms",))
def search_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = materialise(searches(spark, sf_dir), "search-typed")
    return S.near_hits(typed, stored_index(spark, sf_dir).postings(typed))


@query(
    PARTIAL_SQL
    + f""", placed AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id DESC) AS place FROM covered QUALIFY place <= 10), {VOTES_SQL.replace(SENTENCES_SQL + ", ", "")},
    judged AS (SELECT DISTINCT s.query_id, t.doc_id FROM (SELECT DISTINCT query_id FROM searches) s JOIN stood t ON t.query_id // {PER_ITEM} = s.query_id // {PER_ITEM} AND t.query_id <> s.query_id),
    ideal AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN i <= 10 THEN 3 / log2(i + 1) END) AS ideal FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS i FROM judged) GROUP BY query_id),
    own AS (SELECT query_id, min(place) AS first, count(*) AS n, sum(3 / log2(place + 1)) AS dcg FROM placed JOIN judged USING (query_id, doc_id) GROUP BY query_id)
    SELECT count(*) AS searches, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(median(coalesce(1.0 / first, 0)), 6) AS median_rr, round(max(coalesce(first, 11)), 6)::BIGINT AS worst, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0 END), 6) AS success1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS success5, round(avg(coalesce(n, 0) / least(relevant, 10)), 6) AS recall, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg
    FROM ideal LEFT JOIN own USING (query_id)""",
    ("terms",),
)
def search_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a search for one sentence of a passage finds the documents that hold another sentence of it, word for word."""
    held = materialise(R.standing(phrases(spark, sf_dir), stored_index(spark, sf_dir)).distinct(), "eval-held")
    item = F.floor(F.col("query_id") / PER_ITEM).alias("item")
    typed = searches(spark, sf_dir).select("query_id", item).distinct()
    pairs = typed.join(held.select(F.col("query_id").alias("other"), item, "doc_id"), "item").where("other <> query_id")
    judged = pairs.select("query_id", "doc_id").distinct().withColumn("grade", F.lit(2))
    each = S.quality(search_partial(spark, sf_dir), judged)
    means = [F.round(F.avg(c), 6).alias(name) for c, name in (("rr", "mrr"), ("success1", "success1"), ("success5", "success5"), ("recall", "recall"), ("ndcg", "ndcg"))]
    worst = F.max(F.when(F.col("rr") > 0, F.round(1 / F.col("rr")).cast("long")).otherwise(11)).alias("worst")
    return each.agg(F.count("*").alias("searches"), F.round(F.median("rr"), 6).alias("median_rr"), worst, *means)


@query(
    """WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM postings WHERE col = 'body' GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
    w AS (SELECT t.doc_id, t.term, round(sqrt(t.tf) * ln(n.n / d.df), 9) AS weight FROM tf t JOIN df d USING (term) CROSS JOIN n WHERE d.df >= 2 AND d.df <= n.n / 2)
    SELECT doc_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rn FROM w) WHERE rn <= 12""",
    ("postings",),
)
def telling_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve terms that tell most about each document: frequent in it, rare elsewhere."""
    docs = bodies(spark, sf_dir)
    totals = materialise(word_totals(docs), "vocabulary")
    n = docs.where("size(words) > 0").count()
    w = telling_candidates(docs, totals, n, n / 2, 12)
    w = w.withColumn("weight", F.round(F.sqrt("tf") * F.ln(F.lit(n) / F.col("df")), 9))
    best = w.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("weight").desc(), "term"))).where("rn <= 12")
    return best.select("doc_id", "term", "weight")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line_no FROM documents)
    SELECT doc_id, line_no, line, before, after FROM (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) WHERE contains(lower(line), 'license')""",
)
def find_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a pattern, with their neighbours; the neighbours come from the array, so nothing is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    each = docs.select("doc_id", "lines", F.posexplode("lines").alias("at", "line")).where(F.lower("line").contains("license"))
    return each.select("doc_id", (F.col("at") + 1).alias("line_no"), "line", F.when(F.col("at") > 0, F.get("lines", F.col("at") - 1)).alias("before"), F.get("lines", F.col("at") + 1).alias("after"))


@query(
    f"""WITH {SEARCHES_SQL}, hit AS (SELECT s.query_id, p.doc_id, p.col, s.term_ix FROM searches s JOIN terms p ON p.term = s.term)
    SELECT query_id, doc_id, string_agg(DISTINCT col, ',' ORDER BY col) AS columns, count(DISTINCT term_ix) AS words FROM hit GROUP BY query_id, doc_id""",
    ("terms",),
)
def match_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a document is in a result: the columns that hold words of the search, and how many words."""
    typed = S.sent(searches(spark, sf_dir), "search-typed")
    # A bit for each column; a word of a document is one row, and meets the searches where the document's words lie.
    names = sorted(S.WEIGHTS)
    bit = F.coalesce(*[F.when(F.col("col") == c, F.lit(1 << i)) for i, c in enumerate(names)])
    rows = stored_index(spark, sf_dir).postings(typed).repartition("doc_id").groupBy("doc_id", "term").agg(F.bit_or(bit).alias("cols"))
    hits = rows.join(typed, "term").groupBy("query_id", "doc_id").agg(F.bit_or("cols").alias("cols"), F.count("*").alias("words"))
    shown = F.array_join(F.array_compact(F.array(*[F.when(F.col("cols").bitwiseAND(F.lit(1 << i)) != 0, c) for i, c in enumerate(names)])), ",")
    return hits.select("query_id", "doc_id", shown.alias("columns"), "words")


#: Words of a snippet, from its first hit on, and words before that.
SHOWN, BEFORE = 24, 4


@query(
    f"""WITH {SEARCHES_SQL}, {STATS_SQL}, {expanded_sql(S.LITERAL)}, {bm25_sql('scored', 'tf0')}, best AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6), doc_id DESC) AS place FROM scored QUALIFY place <= 10),
    spots AS (SELECT DISTINCT b.query_id, b.doc_id, t.pos FROM best b JOIN expanded e USING (query_id) JOIN terms t ON t.doc_id = b.doc_id AND t.term = e.word AND t.col = 'body'),
    win AS (SELECT x.query_id, x.doc_id, x.pos, count(*) AS n FROM spots x JOIN spots y ON x.query_id = y.query_id AND x.doc_id = y.doc_id AND y.pos BETWEEN x.pos AND x.pos + {SHOWN - 1} GROUP BY ALL),
    spot AS (SELECT query_id, doc_id, greatest(0, arg_min(pos, -n * 100000000 + pos) - {BEFORE}) AS first FROM win GROUP BY query_id, doc_id),
    marks AS (SELECT query_id, doc_id, list(pos) AS marks FROM spots GROUP BY query_id, doc_id),
    shown AS (SELECT b.query_id, b.place, b.doc_id, a.title, coalesce(s.first, 0) AS first, coalesce(m.marks, []) AS marks, regexp_extract_all(a.body, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS pieces, regexp_matches(a.body, '^[\\p{{L}}\\p{{N}}]')::INT AS lead
        FROM best b JOIN archive a USING (doc_id) LEFT JOIN spot s USING (query_id, doc_id) LEFT JOIN marks m USING (query_id, doc_id)),
    bounds AS (SELECT *, 2 * first + 2 - lead AS lo, least(len(pieces), 2 * (first + {SHOWN + BEFORE - 1}) + 2 - lead) AS hi FROM shown)
    SELECT query_id, place, doc_id, title, CASE WHEN first > 0 THEN '…' ELSE '' END || coalesce(array_to_string(list_transform(range(lo, hi + 1), lambda i: CASE WHEN (i + lead) % 2 = 0 AND list_contains(marks, (i + lead) // 2 - 1) THEN '<mark>' || pieces[i] || '</mark>'
        ELSE replace(replace(replace(pieces[i], '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END), ''), '') || CASE WHEN hi < len(pieces) THEN '…' ELSE '' END AS snippet FROM bounds""",
    ("archive", "terms"),
)
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages: the stretch of each text with the most words of the search, these marked, everything else escaped.

    Ranks are worked out on narrow rows, and places of words come from the index; titles
    and texts join only what is shown. A text is cut into words and what stands between
    them, so that a word's number leads to it as it is written, whatever its folded form.
    """
    index = stored_index(spark, sf_dir)
    typed = searches(spark, sf_dir)
    found = _found(typed, index, S.LITERAL)
    best = materialise(_best_ten(found).select("query_id", "doc_id", "place"), "search-best")
    # The documents shown are as few as the searches: their ids go to the postings and to the texts.
    docs = S.sent(best.select("doc_id").distinct(), "search-shown")
    body = materialise(index.of_documents(docs).where("col = 'body'").select("doc_id", F.col("term").alias("word"), "places"), "search-bodies")
    wanted = R.best(found, lambda part: best.join(part.typed, "query_id").join(part.words.terms, "term").select("query_id", "doc_id", "term"))
    held = R.best(found, lambda part: body.join(part.words.each, "word").join(part.words.terms, "t").select("doc_id", "term", "places"))
    at = wanted.join(held.distinct(), ["doc_id", "term"]).select("query_id", "doc_id", F.explode("places").alias("pos")).distinct()
    ahead = Window.partitionBy("query_id", "doc_id").orderBy("pos").rangeBetween(0, SHOWN - 1)
    spot = at.withColumn("n", F.count("*").over(ahead)).groupBy("query_id", "doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "pos"))["pos"].alias("hit"), F.collect_list("pos").alias("marks"))
    shown = best.join(spot, ["query_id", "doc_id"], "left").join(archive(spark, sf_dir, docs).select("doc_id", "title", "body"), "doc_id")
    first = F.greatest(F.lit(0), F.coalesce("hit", F.lit(0)) - BEFORE)
    pieces = F.regexp_extract_all("body", F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"))
    lead = F.col("body").rlike(r"^[\p{L}\p{N}]").cast("int")
    cut = shown.select("query_id", "place", "doc_id", "title", first.alias("first"), "marks", pieces.alias("pieces"), lead.alias("lead"))
    cut = cut.withColumn("lo", 2 * F.col("first") + 2 - F.col("lead")).withColumn("hi", F.least(F.size("pieces"), 2 * (F.col("first") + SHOWN + BEFORE - 1) + 2 - F.col("lead")))
    plain = lambda p: F.replace(F.replace(F.replace(p, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def piece(p: Column, k: Column) -> Column:
        i = F.col("lo") + k + F.col("lead")
        marked = (i % 2 == 0) & F.array_contains("marks", F.floor(i / 2).cast("int") - 1)
        return F.when(F.coalesce(marked, F.lit(False)), F.concat(F.lit("<mark>"), p, F.lit("</mark>"))).otherwise(plain(p))

    some = F.slice("pieces", F.col("lo"), F.greatest(F.lit(0), F.col("hi") - F.col("lo") + 1))
    snippet = F.concat(F.when(F.col("first") > 0, "…").otherwise(""), F.array_join(F.transform(some, piece), ""), F.when(F.col("hi") < F.size("pieces"), "…").otherwise(""))
    return cut.select("query_id", "place", "doc_id", "title", snippet.alias("snippet"))


@query(
    """WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM postings WHERE col = 'body' GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
    w AS (SELECT t.doc_id, t.term, round(sqrt(t.tf) * ln(n.n / d.df), 9) AS weight FROM tf t JOIN df d USING (term) CROSS JOIN n WHERE d.df >= 2 AND d.df <= n.n / 2),
    t AS (SELECT doc_id, term, weight FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 12),
    s AS (SELECT a.doc_id, b.doc_id AS other, sum(a.weight * b.weight) AS score FROM t a JOIN t b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    r AS (SELECT s.doc_id, s.other, round(score * CASE WHEN x.correspondent = y.correspondent THEN 1.6 ELSE 1 END * CASE WHEN x.document_type = y.document_type THEN 1.2 ELSE 1 END, 5) AS score FROM s JOIN archive x ON x.doc_id = s.doc_id JOIN archive y ON y.doc_id = s.other)
    SELECT doc_id, other, score FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other) <= 5""",
    ("archive", "postings"),
)
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents most like each, by the terms that tell most; same sender and type count more."""
    t = materialise(telling_terms(spark, sf_dir), "telling-terms")
    kinds = archive(spark, sf_dir).select("doc_id", F.struct("correspondent", "document_type").alias("kind"))
    same = [F.when(F.col(f"kind_a.{c}") == F.col(f"kind_b.{c}"), w).otherwise(1.0) for c, w in (("correspondent", 1.6), ("document_type", 1.2))]
    return most_similar(t, kinds, same[0] * same[1], 1.6 * 1.2)


# --- facets ----------------------------------------------------------------------------------

_FACET_CLAUSES = ("correspondent IN ('src0', 'src1', 'src2')", "document_type IN ('en', 'de')")
_FACET_SQL = """SELECT 'correspondent' AS facet, correspondent AS value, count(*) AS n FROM archive WHERE {not_correspondent} GROUP BY correspondent
    UNION ALL SELECT 'document_type', document_type, count(*) FROM archive WHERE {not_type} GROUP BY document_type
    UNION ALL SELECT 'month', substr(document_date, 1, 7), count(*) FROM archive WHERE {both} AND document_date IS NOT NULL GROUP BY substr(document_date, 1, 7)
    UNION ALL SELECT 'tag', t.tag, count(*) FROM archive a JOIN tagged t USING (doc_id) WHERE {both} GROUP BY t.tag"""
_BOTH = " AND ".join(_FACET_CLAUSES)


def _faceted(spark: SparkSession, sf_dir: str, within: bool) -> DataFrame:
    tags = tagged(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("tag").alias("tags"))
    docs = archive(spark, sf_dir).join(tags, "doc_id", "left")
    groups = {"correspondent": F.expr(_FACET_CLAUSES[0]), "document_type": F.expr(_FACET_CLAUSES[1])}
    month = F.substring("document_date", 1, 7)
    values = {"correspondent": F.array("correspondent"), "document_type": F.array("document_type"), "month": F.array(month), "tag": F.col("tags")}
    return facet_counts(docs, groups, values, within)


@query(_FACET_SQL.format(not_correspondent=_FACET_CLAUSES[1], not_type=_FACET_CLAUSES[0], both=_BOTH), ("archive", "tagged"))
def facets_or_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group of alternatives is counted without its own filter."""
    return _faceted(spark, sf_dir, within=False)


@query(_FACET_SQL.format(not_correspondent=_BOTH, not_type=_BOTH, both=_BOTH), ("archive", "tagged"))
def facets_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faceted(spark, sf_dir, within=True)
