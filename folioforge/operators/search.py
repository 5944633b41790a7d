"""Full-text search as joins: many searches at once over a stored index.

``searches(query_id, term_ix, term)`` are the searches; the index gives ``postings(doc_id,
col, term, n, places)``, ``words(term, docs, stem)`` and the pieces inside words. Terms
are looked up among the words first (a small table); only then do the words found meet
their postings, by equality. Everything a document needs for its rank comes from one
aggregate per (search, document, term).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import stems
from folioforge.functions import text as X
from folioforge.operators.index import GRAM
from folioforge.session import materialise

#: Column weights, the columns that describe a document, levels and rank constants.
WEIGHTS = {"ident": 12.0, "title": 10.0, "correspondent": 8.0, "doctype": 6.0, "tags": 6.0, "custom": 7.0, "filename": 3.0, "dates": 4.0, "summary": 2.5, "body": 1.0, "notes": 5.0}
META = ("ident", "title", "correspondent", "doctype", "tags", "custom", "dates", "notes")
LITERAL, FORMS, RELATED, SIMILAR = 0, 1, 2, 3
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
TIER_STEP, TITLE_BOOST, NEAR_BOOST, YEAR_BOOST, WEAK, NEAR = 10_000.0, 1.0, 0.5, 0.5, 0.5, 10
#: Endings that a compound's last part may have, and how long words must be to be looked up by stem, in compounds, and inside them.
ENDINGS = ("en", "es", "e", "n", "s", "er", "ern")
STEM_WORD, COMPOUND_WORD, INNER_PART, BEFORE_INNER, AFTER_INNER = 4, 5, 6, 3, 4


#: A table of searches, of their words or of what these stand for is sent to all tasks up to so many rows.
SENT = 400_000


def sent(df: DataFrame, label: str) -> DataFrame:
    """A table about searches, stored; it goes to where the documents are, if it has at most :data:`SENT` rows."""
    df = materialise(df, label)
    return F.broadcast(df) if df.count() <= SENT else df


def with_sizes(found: DataFrame, sized: DataFrame) -> DataFrame:
    """Matches with the sizes of their documents, if they are without; both sides grow with the documents."""
    return found if "dl" in found.columns else found.join(sized.hint("merge"), "doc_id")


def may_start(term: Column) -> Column:
    """Whether a typed word also stands for words that it begins; digits and short words are exact."""
    return (F.length(term) >= 3) & ~term.rlike("[0-9]")


def beginning(terms: DataFrame, words: DataFrame, rank: int) -> DataFrame:
    """``query_id, term_ix, word, level``: the words that each of ``terms`` is or begins.

    Every word stands under each of its beginnings, so the join is by equality with the
    typed word, and no beginning that many words share is a key unless it is typed.
    """
    starts = F.explode(F.sequence(F.lit(1), F.length("word")))
    keys = words.withColumn("n", starts).select("word", F.expr("substring(word, 1, n)").alias("term"), (F.col("n") == F.length("word")).alias("whole"))
    # The typed words go to the beginnings, which are many more.
    found = keys.join(sent(terms.select("query_id", "term_ix", "term"), "search-begins"), "term").where(F.col("whole") | may_start(F.col("term")))
    return found.select("query_id", "term_ix", "word", F.lit(rank).alias("level"))


def forms_of(typed: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``query_id, term_ix, word``: the words with a typed word's stem; and ``query_id, term_ix, form``, what to look for in compounds."""
    letters = typed.where(F.col("term").rlike(r"^\p{L}+$") & (F.length("term") >= STEM_WORD))
    stemmed = materialise(stems.with_stem(letters, "term"), "search-stems").where(F.length("stem") >= 3)
    same = stemmed.join(words.where("stem is not null").select("word", "stem"), "stem").where("word <> term").select("query_id", "term_ix", "word", "term")
    own = letters.select("query_id", "term_ix", "term", F.explode(X.word_forms(F.col("term"))).alias("form"))
    both = own.unionByName(same.select("query_id", "term_ix", "term", F.col("word").alias("form")))
    usable = both.where((F.length("term") >= COMPOUND_WORD) & (F.length("form") >= STEM_WORD)).select("query_id", "term_ix", "form").distinct()
    return same.select("query_id", "term_ix", "word"), usable


def compounds(forms: DataFrame, grams: DataFrame) -> DataFrame:
    """``query_id, term_ix, word``: words that end in a form, with or without an ending, or hold a longer one between other parts.

    A form is met at its first four letters, wherever they stand inside a word.
    """
    met = grams.join(sent(forms.withColumn("gram", F.left("form", F.lit(GRAM))), "search-forms"), "gram")
    met = met.where(F.expr("substring(word, at + 1, length(form)) = form")).withColumn("rest", F.expr("substring(word, at + 1 + length(form))"))
    last = F.col("rest").isin("", *ENDINGS)
    inner = (F.length("form") >= INNER_PART) & (F.col("at") >= BEFORE_INNER) & (F.length("rest") >= AFTER_INNER)
    return met.where(last | inner).select("query_id", "term_ix", "word").distinct()


def expand(searches: DataFrame, words: DataFrame, grams: DataFrame, synonyms: DataFrame | None = None, level: int = SIMILAR) -> DataFrame:
    """``query_id, term_ix, word, level``: the indexed words that each term stands for, at their best level.

    LITERAL: the word or a base form of it, or words that begin with these. FORMS: words
    of the same stem, and compounds. RELATED: ``synonyms(term, other)`` and what begins
    with them. SIMILAR: words with the same first two letters within the allowed edits.
    All of these are equality joins and a filter.
    """
    typed = searches.select("query_id", "term_ix", "term")
    words = words.select(F.col("term").alias("word"), "stem")
    plain = words.select("word")
    forms = typed.select("query_id", "term_ix", F.explode(X.word_forms(F.col("term"))).alias("term"))
    found = [beginning(forms, plain, LITERAL)]
    if level >= FORMS:
        same, usable = forms_of(typed, words)
        found += [df.select("query_id", "term_ix", "word", F.lit(FORMS).alias("level")) for df in (same, compounds(usable, grams))]
    if level >= RELATED and synonyms is not None:
        found.append(beginning(typed.join(synonyms, "term").select("query_id", "term_ix", F.col("other").alias("term")), plain, RELATED))
    if level >= SIMILAR:
        found.append(similar_words(typed, plain).select("query_id", "term_ix", "word", F.lit(SIMILAR).alias("level")))
    return reduce(DataFrame.unionByName, found).groupBy("query_id", "term_ix", "word").agg(F.min("level").alias("level"))


def similar_words(typed: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs within the allowed edits, with ``edits``. The built-in distance, with room for swaps and recognition errors, decides who reaches the exact one."""
    most = X.allowed_edits(F.col("term"))
    left = typed.where((most > 0) & F.col("term").rlike(r"^\p{L}+$")).withColumn("most", most)
    # An edit changes the length by one at most, and is two plain ones at most: a swap, or two letters for one.
    left = left.withColumn("k", F.substring("term", 1, 2)).withColumn("n", F.explode(F.sequence(F.length("term") - most, F.length("term") + most)))
    right = words.where(F.col("word").rlike(r"^\p{L}+$")).withColumn("k", F.substring("word", 1, 2)).withColumn("n", F.length("word"))
    plain = F.when(F.col("most") == 1, F.levenshtein("term", "word", 2)).otherwise(F.levenshtein("term", "word", 4))
    pairs = left.join(right, ["k", "n"]).where("term <> word").where(plain >= 0)
    return pairs.withColumn("edits", X.spelling_edits("term", "word")).where("edits <= most")


def matches(expanded: DataFrame, postings: DataFrame, weights: dict[str, float] | None = None, sized: DataFrame | None = None) -> DataFrame:
    """Per search, document and term: ``level`` (the best), ``meta_level`` and ``title_level`` (the best in those columns), and the weighted frequency of the words at each level (``tf0`` to ``tf3``).

    Postings are dealt by document once, a document's columns put together, and the
    words sought are sent to them; so the many rows per search are summed where they
    arise. With ``sized``, each row has the sizes of its document as well.
    """
    weight = F.coalesce(*[F.when(F.col("col") == c, F.lit(w)) for c, w in (weights or WEIGHTS).items()], F.lit(0.0))
    rows = postings.select("doc_id", "col", F.col("term").alias("word"), "n").repartition("doc_id")
    each = rows.groupBy("doc_id", "word").agg(F.sum(weight * F.col("n")).alias("tf"), F.max(F.col("col").isin(*META)).alias("meta"), F.max(F.col("col") == "title").alias("titled"))
    keys = ["query_id", "doc_id", "term_ix"]
    if sized is not None:
        each, keys = each.hint("merge").join(sized, "doc_id"), [*keys, "n_docs", "avg_dl", "dl"]
    hits = each.join(sent(expanded, "search-sought"), "word")
    tf = [F.sum(F.when(F.col("level") <= lv, F.col("tf")).otherwise(0.0)).alias(f"tf{lv}") for lv in range(4)]
    best = [F.min("level").alias("level"), F.min(F.when(F.col("meta"), F.col("level"))).alias("meta_level"), F.min(F.when(F.col("titled"), F.col("level"))).alias("title_level")]
    return hits.groupBy(*keys).agg(*best, *tf)


def bm25(found: DataFrame, sized: DataFrame, level: int) -> DataFrame:
    """Adds ``bm25``, lower is better: Okapi over the words up to ``level``, one term for all that a typed word stands for."""
    tf = F.col(f"tf{level}")
    df = sent(found.where(tf > 0).groupBy("query_id", "term_ix").agg(F.count("*").alias("df")), "search-df")
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    norm = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    scored = with_sizes(found.where(tf > 0).join(df, ["query_id", "term_ix"]), sized)
    return scored.groupBy("query_id", "doc_id").agg((-F.sum(idf * norm)).alias("bm25"))


def top(ranked: DataFrame, k: int, *order: Column) -> DataFrame:
    """The ``k`` best of each search, with ``place``; the planner keeps only ``k`` rows of a group before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def phrase_hits(searches: DataFrame, postings: DataFrame, words: DataFrame) -> DataFrame:
    """``query_id, doc_id, col``, how often the words of a search stand side by side in a column.

    ``searches`` have a row for each place of the phrase, ``words(term, docs)`` say how
    rare a word is. Only the places of a phrase's rarest word are starts; each start then
    asks every other word's postings of that document and column for its place.
    """
    known = searches.join(words.select("term", "docs"), "term", "left")
    size = known.groupBy("query_id").agg(F.count("*").alias("size"), F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "term_ix", "term")).alias("rarest"))
    size = size.where("rarest.docs > 0")
    anchors = sent(size.select("query_id", "size", F.col("rarest.term").alias("term"), F.col("rarest.term_ix").alias("ix")), "search-anchors")
    postings = postings.select("doc_id", "col", "term", "places")
    starts = postings.join(anchors, "term").select("query_id", "size", "ix", "doc_id", "col", F.transform("places", lambda p: p - F.col("ix")).alias("starts"))
    others = sent(searches.select("query_id", "term_ix", "term"), "search-others")
    asked = starts.where("size > 1").join(others, "query_id").where("term_ix <> ix").select("query_id", "size", "doc_id", "col", "starts", "term_ix", "term")
    # Starts and places of a column meet as two lists.
    held = asked.hint("merge").join(postings, ["doc_id", "col", "term"]).select("query_id", "size", "doc_id", "col", F.explode(F.array_intersect("starts", F.transform("places", lambda p: p - F.col("term_ix")))).alias("start"))
    whole = held.groupBy("query_id", "size", "doc_id", "col", "start").agg(F.count("*").alias("votes")).where("votes = size - 1")
    alone = starts.where("size = 1").select("query_id", "doc_id", "col", F.explode("starts").alias("start"))
    return whole.select("query_id", "doc_id", "col", "start").unionByName(alone).groupBy("query_id", "doc_id", "col").agg(F.count("*").alias("hits"))


def near_hits(searches: DataFrame, postings: DataFrame, distance: int = NEAR) -> DataFrame:
    """``query_id, doc_id``: all words of a search within ``distance`` words between them, in one column.

    Searches of two or more words. Places count only in columns that hold all words;
    from each, the span to the nearest earlier place of every other word decides.
    """
    postings = postings.select("doc_id", "col", "term", "places")
    held = postings.groupBy("term").agg(F.count("*").alias("held"))
    known = sent(searches.join(held, "term", "left").select("query_id", "term_ix", "term", F.coalesce("held", F.lit(0)).alias("held")), "search-known")
    # Only columns with the rarest word of a search are asked for its other words.
    size = known.groupBy("query_id").agg(F.count("*").alias("size"), F.min(F.struct("held", "term")).alias("rarest")).where("size > 1 and rarest.held > 0")
    anchors = sent(size.select("query_id", "size", F.col("rarest.term").alias("term")), "search-anchors")
    asked = postings.select("doc_id", "col", "term").join(anchors, "term").drop("term").join(known.drop("held"), "query_id")
    hits = asked.hint("merge").join(postings, ["doc_id", "col", "term"])
    held = hits.groupBy("query_id", "size", "doc_id", "col").agg(F.count("*").alias("got"), F.collect_list(F.struct("term_ix", "places")).alias("each")).where("got = size")
    places = held.select("query_id", "size", "doc_id", "col", F.explode("each").alias("e")).select("query_id", "size", "doc_id", "col", "e.term_ix", F.explode("e.places").alias("pos"))
    reach = Window.partitionBy("query_id", "doc_id", "col").orderBy("pos").rangeBetween(-(distance + 1), 0)
    spans = places.withColumn("seen", F.size(F.collect_set("term_ix").over(reach))).where("seen = size")
    return spans.select("query_id", "doc_id").distinct()


def bm25_levels(found: DataFrame, sized: DataFrame) -> DataFrame:
    """``query_id, doc_id, bm25s``: the sums of :func:`bm25` over the words up to each level, from one aggregate."""
    df = found.groupBy("query_id", "term_ix").agg(*[F.sum((F.col(f"tf{lv}") > 0).cast("long")).alias(f"df{lv}") for lv in range(4)])
    scored = with_sizes(found.join(sent(df, "search-df"), ["query_id", "term_ix"]), sized)

    def part(lv: int) -> Column:
        tf, n = F.col(f"tf{lv}"), F.col(f"df{lv}")
        idf = F.greatest(F.ln((F.col("n_docs") - n + 0.5) / (n + 0.5)), F.lit(IDF_FLOOR))
        norm = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
        return -F.sum(F.when(tf > 0, idf * norm))

    return scored.groupBy("query_id", "doc_id").agg(F.array(*[part(lv) for lv in range(4)]).alias("bm25s"))


def tier_of(found: DataFrame, searches: DataFrame) -> DataFrame:
    """``query_id, doc_id, in_title, tier`` of the documents that have every word of a search; see :func:`tiers`."""
    size = searches.groupBy("query_id").agg(F.count("*").alias("size"))
    own = [F.count("meta_level").alias("described"), F.max("meta_level").alias("meta_level"), F.count("title_level").alias("titled")]
    per = found.groupBy("query_id", "doc_id").agg(F.count("*").alias("got"), F.max("level").alias("level"), *own)
    whole = per.join(sent(size, "search-size"), "query_id").where("got = size").withColumn("in_title", F.col("titled") == F.col("size"))
    in_meta = (F.col("described") == F.col("size")) & (F.col("meta_level") <= RELATED)
    tier = F.when(in_meta, F.col("meta_level")).when(F.col("level") <= RELATED, F.col("level") + 3).otherwise(6)
    return whole.select("query_id", "doc_id", "in_title", tier.alias("tier"))


def tiers(found: DataFrame, searches: DataFrame, near: DataFrame, sized: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """Documents that have every word of a search: ``tier, bm25, boost, rank``, lower is better.

    Tier: the columns that describe the document have all words as typed (0), in their
    forms (1), in related words (2); any column so (3, 4, 5); at least similar spellings
    (6). BM25 counts the words of the tier's own level; it counts more if the title has
    all words, if they stand near each other, and for the ``years(query_id, doc_id)``
    that a search names.
    """
    whole = tier_of(found, searches).withColumn("at", F.when(F.col("tier") == 6, SIMILAR).otherwise(F.col("tier") % 3))
    every = bm25_levels(found, sized)
    value = F.element_at("bm25s", (F.col("at") + 1).cast("int"))
    scored = whole.join(every, ["query_id", "doc_id"]).withColumn("bm25", value)
    boost = 1 + F.when(F.col("in_title"), TITLE_BOOST).otherwise(0.0) + F.when(F.col("near"), NEAR_BOOST).otherwise(0.0)
    done = scored.join(near.withColumn("near", F.lit(True)), ["query_id", "doc_id"], "left")
    if years is not None:
        done = done.join(years.select("query_id", "doc_id").distinct().withColumn("dated", F.lit(True)), ["query_id", "doc_id"], "left")
        boost = boost + F.when(F.col("dated"), YEAR_BOOST).otherwise(0.0)
    done = done.withColumn("boost", boost)
    return done.select("query_id", "doc_id", "tier", "bm25", "boost", (F.col("tier") * TIER_STEP + F.col("bm25") * F.col("boost")).alias("rank"))


def coverage(found: DataFrame, sized: DataFrame) -> DataFrame:
    """Partial matches: ``coverage`` in steps of a tenth (half to even), ``bm25``, ``rank``.

    Each word weighs by its rarity; a word found only through related words or similar
    spellings counts half.
    """
    tf = F.col(f"tf{FORMS}")
    counts = found.groupBy("query_id", "term_ix").agg(F.count("*").alias("weak"), F.count_if(F.col("level") <= FORMS).alias("strong"), F.count_if(tf > 0).alias("df"))
    n = sized.select("n_docs").limit(1)
    counts = counts.join(F.broadcast(n))
    counts = counts.withColumn("idf_strong", F.ln(1 + F.col("n_docs") / F.greatest(F.lit(1), F.col("strong")))).withColumn("idf_weak", F.ln(1 + F.col("n_docs") / F.col("weak")))
    counts = sent(counts.drop("n_docs"), "search-counts")
    whole = sent(counts.groupBy("query_id").agg(F.sum("idf_strong").alias("whole")), "search-whole-idf")
    got = F.sum(F.when(F.col("level") <= FORMS, F.col("idf_strong")).otherwise(WEAK * F.col("idf_weak")))
    # As in bm25, but of the same pass.
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    norm = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    rows = with_sizes(found.join(counts, ["query_id", "term_ix"]), sized)
    per = rows.groupBy("query_id", "doc_id").agg(got.alias("got"), F.coalesce(-F.sum(F.when(tf > 0, idf * norm)), F.lit(0.0)).alias("bm25")).join(whole, "query_id")
    scored = per.withColumn("coverage", F.bround(F.round(F.col("got") / F.col("whole"), 9), 1))
    return scored.select("query_id", "doc_id", "coverage", "bm25", ((1 - F.col("coverage")) * TIER_STEP * 100 + F.col("bm25")).alias("rank"))


def quality(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """Per search: ``rr, success1, success5, recall, ndcg`` of ``ranked(query_id, doc_id, place)`` against ``judged(query_id, doc_id, grade)``."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = judged.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("i") <= k, gain / F.log2(F.col("i") + 1))).alias("ideal"), F.count("*").alias("relevant"))
    hits = ranked.where(F.col("place") <= k).join(judged, ["query_id", "doc_id"])
    own = hits.groupBy("query_id").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.sum(gain / F.log2(F.col("place") + 1)).alias("dcg"))
    both = ideal.join(own, "query_id", "left")
    return both.select(
        "query_id",
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0)).alias("success1"),
        F.coalesce((F.col("first") <= 5).cast("double"), F.lit(0.0)).alias("success5"),
        (F.coalesce("n", F.lit(0)) / F.least(F.col("relevant"), F.lit(k))).alias("recall"),
        (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"),
    )
