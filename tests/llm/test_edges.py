"""Nulls, empty and very long texts, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import bpe, embedding_dedup, line_dedup, mixing, mtree_search, ngram_join, pseudonyms, secrets, substring_dedup, toxicity
from folioforge.session import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, row long, features string, score string, id long, of string, kept0 int, n_lines string, sid int"
#: Not a double.
BIG = 2**60 + 1
LONG = "word and more words. " * 12_000
ROWS = [
    (None, "Without an id.\nTwo lines.", "en", None),
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, LONG, "en", "b"),
    (4, "One line here.\nAnd another one.\nAnd a third one.", None, "b"),
    (4, "One line here.\nAnd another one.\nAnd a third one.", None, "b"),
    (5, " \n\t\n", "de", None),
    (6, "x", "de", "c"),
    (7, "x", "de", "c"),
    (BIG, "An id that no double holds.", "en", "b"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "t", 1, "f", "s", 9, "o", 3, "l", 2) for r in rows], SCHEMA)


LABELS = [(3, 1, 0), (4, 1, 1), (6, None, 1), (None, 1, 1), (6, 1, 0), (7, 1, None)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "secrets": lambda d, s, lab: secrets.scan_secrets(d),
    "line_dedup": lambda d, s, lab: line_dedup.dedup_lines(d),
    "toxicity": lambda d, s, lab: toxicity.score_documents(d, labels(s, lab)),
    "substring_dedup": lambda d, s, lab: substring_dedup.dedup_spans(d),
    "ngram_join": lambda d, s, lab: ngram_join.near_copies(d),
    "mixing": lambda d, s, lab: mixing.mix(d),
    "bpe": lambda d, s, lab: bpe.encode_documents(d, public_tokenizers.path("byte_bpe_50k.json")),
    "pseudonyms": lambda d, s, lab: pseudonyms.pseudonymise(d, b"k"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_rows(spark, name):
    got = OPERATORS[name](frame(spark, ROWS), spark, LABELS).collect()
    assert len(got) == len(ROWS)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == sorted(-1 if r[0] is None else r[0] for r in ROWS)
    if name == "ngram_join":
        assert BIG in {r["component_id"] for r in got}
    twice = [r for r in got if r["doc_id"] == 4]
    if name != "mixing":
        assert twice[0] == twice[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, []), spark, []).collect() == []


def test_edge_values(spark):
    docs = frame(spark, ROWS)
    by = lambda out: {r["doc_id"]: r for r in out.collect()}
    lines = by(line_dedup.dedup_lines(docs))
    assert lines[1]["text"] is None and lines[2]["text"] == "" and lines[4]["text"] == ROWS[4][1]
    near = by(ngram_join.near_copies(docs))
    assert near[None]["component_id"] is None and near[2]["component_id"] == 2 and near[5]["n_shingles"] == 0 and near[7]["component_id"] == 6
    mixed = by(mixing.mix(docs))
    assert mixed[1]["size"] == 0 and mixed[1]["taken"] == 0 and mixed[3]["size"] == 48_000
    coded = by(bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))
    assert coded[1]["n_tokens"] == 0 and coded[3]["decoded"] == LONG
    hidden = by(pseudonyms.pseudonymise(docs, b"k"))
    assert hidden[1]["text"] is None and hidden[3]["text"] == LONG and hidden[3]["tag"] == "t"
    scored = by(toxicity.score_documents(docs, labels(spark, LABELS)))
    assert scored[None]["held_out"] is False and 0 <= scored[2]["score"] <= 1


VECTORS = [(0, [0.1, 0.2]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [0.1, 0.2]), (4, [0.1, 0.2]), (5, []), (None, [0.1, 0.2]), (6, [1.0, 2.0, 3.0]), (100, [0.2, 0.4]), (7, [None, 1.0]), (8, [float("inf"), 0.0]), (BIG, [1.0, 2.0, 3.0, 4.0])]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], "vec_id long, embedding array<double>, sig string, rep int")


def test_embedding_edges(spark):
    got = embedding_dedup.near_duplicates(vectors(spark, VECTORS)).collect()
    assert len(got) == len(VECTORS)
    by = {r["vec_id"]: r for r in got}
    assert by[0]["n_links"] == 3 and by[4]["component_id"] == 0 and by[100]["component_id"] == 0 and not by[100]["kept"]
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (1, 2, 3, 5, 6, 7, 8, BIG)) and by[None]["component_id"] is None
    assert embedding_dedup.near_duplicates(vectors(spark, [])).collect() == []


def test_two_vectors_under_one_id(spark):
    got = embedding_dedup.near_duplicates(vectors(spark, [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [1.0, 0.02])])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1)]


def test_long_text_without_spaces(spark):
    """One text of a megabyte and one line, for each operator on texts."""
    long = "".join(np.random.default_rng(2).choice(list("abcXYZ019+/"), 1_000_000))
    docs = frame(spark, [(1, long, "en", "a"), (2, "short", "en", "a")])
    for name, run in OPERATORS.items():
        assert len(run(docs, spark, LABELS).collect()) == 2, name


def test_search_edges(spark):
    got = mtree_search.top_k(vectors(spark, VECTORS)).collect()
    by = {}
    for r in sorted(got):
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert by == {0: [(1, 100, 204 * 102 + 409 * 204), (2, 4, 102 * 102 + 204 * 204), (3, 4, 102 * 102 + 204 * 204), (4, 2, 0)], 100: [(1, 0, 204 * 102 + 409 * 204), (2, 4, 204 * 102 + 409 * 204), (3, 4, 204 * 102 + 409 * 204), (4, 2, 0)]}
    assert mtree_search.top_k(vectors(spark, [])).collect() == []


@pytest.fixture
def labelled_dir(spark, tmp_path):
    # Nothing is toxic, so that the stages after the first have rows to work on.
    labels(spark, [(3, 1, 0), (4, 1, 0), (6, None, 0), (None, 1, 1), (7, 1, None)]).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("rows", [ROWS, []], ids=["edges", "empty"])
def test_pipeline_stages(spark, labelled_dir, rows):
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, labelled_dir), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert out.dtypes == docs.dtypes
            assert out.where("tag <> 't' or score <> 's' or n_lines <> 'l'").count() == 0
            docs = out
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= {r[0] for r in rows}
        if rows and name in ("toxicity", "line dedup", "n-gram Jaccard join"):
            assert BIG in ids and None in ids, name
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)


def test_pipeline_decisions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = materialise(stages["toxicity"](spark, docs, sf_dir), "test-toxic")
    assert 0.7 * docs.count() < kept.count() <= docs.count()
    once = materialise(stages["n-gram Jaccard join"](spark, kept, sf_dir), "test-near")
    groups = ngram_join.near_copies(kept, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert once.count() == groups.select("component_id").distinct().count()
    assert once.join(groups.where("doc_id = component_id"), "doc_id", "left_anti").count() == 0
    mixed = materialise(stages["mixing sources to target weights"](spark, once, sf_dir), "test-mixed")
    assert mixed.where(F.length("text") != F.col("n_chars")).count() == 0
    coded = stages["BPE encoding and decoding"](spark, mixed, sf_dir)
    both = coded.groupBy("decoded_sha256").count().join(mixed.groupBy(F.sha2("text", 256).alias("decoded_sha256")).agg(F.count("*").alias("n")), "decoded_sha256")
    assert both.where("count = n").count() == mixed.select("text").distinct().count()


def test_repeated_rows_join_as_one(spark, sf_dir):
    """A table united with itself, and made-up repeats: the same groups as each row once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    a = [f"a{i}" for i in range(103)]
    near = [*a[:100], "z1", "z2", "z3"]  # 97 of 103 shingles
    half = [f"h{i}" for i in range(53)]
    made = [(-1, " ".join(a)), (-2, " ".join(near)), (-3, " ".join([*half, *a[:50]])), (-4, " ".join([*half, *(f"b{i}" for i in range(50))]))]
    docs = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    want = {tuple(r) for r in ngram_join.near_copies(docs).collect()}
    got = ngram_join.near_copies(docs.unionByName(docs)).collect()
    assert {tuple(r) for r in got} == want and len(got) == 2 * len(want)
    by = {r[0]: r[2] for r in want}
    assert by[-1] == by[-2] == -2 and by[-3] == -3 and by[-4] == -4
    once = corpus_pipeline.drop_near_copies(spark, docs.unionByName(docs), sf_dir).select("doc_id").collect()
    groups = ngram_join.near_copies(docs, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT).select("component_id").distinct().collect()
    assert sorted(once) == sorted(groups)


def test_one_repeated_row_keeps_its_links(spark):
    """Sets of 97 and 97, overlap 94: a set sent twice as large loses the link."""
    a = [f"a{i}" for i in range(100)]
    rows = [(1, " ".join(a)), (2, " ".join([*a[:97], "x", "y", "z"])), (1, " ".join(a))]
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 97, 1), (1, 97, 1), (2, 97, 1)]


def test_texts_under_one_id_stay_apart(spark, sf_dir):
    texts = [" ".join(f"{c}{i}" for i in range(100)) for c in "pqr"]
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[2] + " end"), (3, texts[2]), (2, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.near_copies(docs).collect())
    assert got == [(1, 97, 1), (2, 97, 1), (2, 97, 2), (2, 98, 2), (3, 97, 2)]
    kept = sorted(tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect())
    assert kept == sorted([rows[0], rows[1], rows[2]])


def test_bpe_gives_memory_back_after_each_batch(monkeypatch):
    import pyarrow as pa

    from folioforge.llm import bpe

    class Pool:
        released = 0

        def release_unused(self):
            self.released += 1

    pool = Pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    seen = [(b, pool.released) for b in bpe.released(iter("xyz"))]
    assert seen == [("x", 1), ("y", 2), ("z", 3)] and pool.released == 4
