"""Ranks made where documents lie, against the same ranks made as joins over all matches."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.operators import index as I
from folioforge.operators import ranking as R
from folioforge.operators import search as S


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    words = ["garten", "gaerten", "gartenbau", "haus", "hausbau", "wiese", "fahrt", "strasse", "strassen", "x1"]
    rows = [(d, c, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for d in range(60) for c in ("title", "tags", "body")]
    rows += [(d + 100, c, t) for d, c, t in rows]
    typed = [(q, i, w) for q in range(12) for i, w in enumerate(rng.sample(words, rng.randrange(1, 4)))] + [(50, 0, "haus"), (50, 1, "never")]
    index = I.create(spark.createDataFrame(rows, "doc_id long, col string, text string"), 4)
    others = spark.createDataFrame([("wiese", "fahrt")], "term string, other string")
    return index, spark.createDataFrame(typed, "query_id long, term_ix int, term string"), others


def rows_of(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def same_as_joins(made, level):
    index, typed, others = made
    found = S.matches(S.expand(typed, index.words(), index.grams(), others, level), index.postings(), sized=index.sizes())
    got = R.find(typed, index, level, others, near=True)
    whole = S.tiers(found, typed, S.near_hits(typed, index.postings(typed)), index.sizes())
    columns = ["query_id", "doc_id", "tier", "bm25", "boost", "rank"]
    assert rows_of(R.best(got, lambda p: p.tiers(1000)), *columns) == rows_of(whole, *columns)
    counts = S.tier_of(found, typed).groupBy("query_id", "tier").agg(F.count("*").alias("n"))
    assert rows_of(R.best(got, lambda p: p.tier_counts()), "query_id", "tier", "n") == rows_of(counts, "query_id", "tier", "n")
    part = S.coverage(found, index.sizes())
    assert rows_of(R.best(got, lambda p: p.coverage(1000)), "query_id", "doc_id", "coverage", "rank") == rows_of(part, "query_id", "doc_id", "coverage", "rank")
    scored = S.bm25(found, index.sizes(), S.LITERAL)
    assert rows_of(R.best(got, lambda p: p.bm25(1000)), "query_id", "doc_id", "rank") == rows_of(scored, "query_id", "doc_id", "bm25")
    few = S.top(R.best(got, lambda p: p.bm25(3)).withColumn("score", F.round("rank", 6)), 3, F.col("score"), F.col("doc_id").desc())
    want = S.top(scored.withColumn("score", F.round("bm25", 6)), 3, F.col("score"), F.col("doc_id").desc())
    assert rows_of(few, "query_id", "doc_id", "place") == rows_of(want, "query_id", "doc_id", "place")


def test_ranks_equal_those_of_joins(made):
    same_as_joins(made, S.SIMILAR)


def test_in_parts_and_small_blocks(made, monkeypatch):
    """Searches in several parts, words beyond those sent, blocks of few rows and arrays of few cells."""
    monkeypatch.setattr(S, "SENT", 9)
    monkeypatch.setattr(R, "CELLS", 20)
    monkeypatch.setattr(R, "HELD", 10)
    assert len(R._slices(made[1])) > 1
    same_as_joins(made, S.RELATED)


def test_phrases_equal_those_of_joins(made):
    index, typed, _ = made
    want = S.phrase_hits(typed, index.postings(typed), index.words()).select("query_id", "doc_id").distinct()
    assert want.count() > 0 and rows_of(R.standing(typed, index).distinct(), "query_id", "doc_id") == rows_of(want, "query_id", "doc_id")


def test_rows_of_searches_do_not_leave_tasks(spark, made):
    """Only a task's best rows do; before, each (search, document) was shuffled."""
    index, typed, _ = made
    found = R.find(typed, index, S.LITERAL)
    each = R.best(found, lambda p: p.bm25(2))
    tasks = each.rdd.getNumPartitions()
    assert each.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * tasks).count() == 0
    assert "Exchange" not in each._jdf.queryExecution().executedPlan().toString()


def test_few_pairs_of_words_reach_the_exact_distance(spark, monkeypatch):
    """Three plain edits are no single one, nor are lengths two apart; before, such pairs were compared in Python."""
    typed = spark.createDataFrame([(1, 0, "garten")], "query_id long, term_ix int, term string")
    words = spark.createDataFrame([("gartxyz",), ("gartenen",), ("gatren",), ("garen",), ("gartem",), ("gartern",)], "word string")
    assert {r.word: r.edits for r in S.similar_words(typed, words).collect()} == {"gatren": 1, "garen": 1, "gartem": 1, "gartern": 1}
    monkeypatch.setattr(S.X, "spelling_edits", lambda a, b: F.lit(0))
    assert {r.word for r in S.similar_words(typed, words).collect()} == {"gatren", "garen", "gartem", "gartern"}


def test_words_and_pieces_are_not_shuffled_to_what_is_typed(spark, made, monkeypatch):
    """Beginnings and inner pieces of all words stay where they are; before, they were dealt by their letters, here as no table is sent by itself."""
    index, typed, _ = made
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = index.stored(index.segments[0], "words").select(F.col("term").alias("word"))
        for df in (S.beginning(typed, words, 0), S.compounds(typed.select("query_id", "term_ix", F.col("term").alias("form")), index.grams())):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(term" not in plan and "hashpartitioning(gram" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rounding_is_the_engines():
    values = [0.0000005, 1.0000005, -2.3456785, 12345.6789125, 60000.0000015, -0.0000014999]
    want = [float(Decimal(repr(v)).quantize(Decimal("1e-6"), ROUND_HALF_UP).scaleb(6)) for v in values]
    assert list(R.rounded(np.array(values))) == want


def test_nothing_found(spark, made):
    index, _, _ = made
    typed = spark.createDataFrame([(1, 0, "nothing")], "query_id long, term_ix int, term string")
    found = R.find(typed, index, S.LITERAL, near=True)
    assert all(R.best(found, f).count() == 0 for f in (lambda p: p.bm25(3), lambda p: p.coverage(3), lambda p: p.tiers(3), lambda p: p.tier_counts()))
    assert R.standing(typed, index).count() == 0
    none = typed.limit(0)
    assert R.best(R.find(none, index, S.LITERAL), lambda p: p.bm25(3)).count() == 0
