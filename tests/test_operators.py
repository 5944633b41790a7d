from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge.functions import stems
from folioforge.operators import index as I
from folioforge.operators import search as S
from folioforge.operators.components import connected_components
from folioforge.operators.facets import facet_counts
from folioforge.operators.lineage import chains
from folioforge.plans import search as plans
from folioforge.plans.catalog import stored_index, vocab
from folioforge.functions import text as X


def labels_of(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_on_chains_stars_and_noise(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(60)]
    frame = spark.createDataFrame([*edges, (5, 5), (None, 9)], "src long, dst long")
    found = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert found == {k: v for k, v in labels_of([e for e in edges if e[0] != e[1]]).items()}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_chains_of_any_length(spark):
    rng = random.Random(6)
    parent = {i: i - 1 for i in range(1, 70)} | {100: None, 101: 100, 102: 100, 103: 102, 200: 999} | {0: None}
    rows = list(parent.items())
    rng.shuffle(rows)
    got = {r["node"]: (r["root"], r["depth"]) for r in chains(spark.createDataFrame([*rows, (None, 3)], "node long, parent long")).collect()}

    def walk(n, depth=0):
        up = parent[n]
        return walk(up, depth + 1) if up in parent else (n, depth)

    assert got == {n: walk(n) for n in parent}
    assert chains(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_a_circle_of_links_is_an_error(spark, monkeypatch):
    monkeypatch.setattr("folioforge.operators.lineage.ROUNDS", 4)
    with pytest.raises(ValueError, match="circle"):
        chains(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"))


def indexed(spark, rows):
    return I.create(spark.createDataFrame(rows, "doc_id long, col string, text string"), buckets=4)


def typed_of(spark, *words):
    return spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "query_id long, term_ix int, term string")


def test_phrase_and_near(spark):
    index = indexed(spark, [(1, "body", "The red fox and the red hen"), (2, "body", "red " + "x " * 12 + "fox"), (3, "title", "fox red fox red fox")])
    typed = typed_of(spark, "red", "fox")
    assert sorted(tuple(r) for r in S.phrase_hits(typed, index.postings(typed), index.words()).collect()) == [(1, 1, "body", 1), (1, 3, "title", 2)]
    assert sorted(tuple(r) for r in S.near_hits(typed, index.postings(typed)).collect()) == [(1, 1), (1, 3)]
    unknown = typed_of(spark, "red", "never")
    assert S.phrase_hits(unknown, index.postings(unknown), index.words()).count() == 0
    alone = typed_of(spark, "fox")
    assert sorted(tuple(r) for r in S.phrase_hits(alone, index.postings(alone), index.words()).collect()) == [(1, 1, "body", 1), (1, 2, "body", 1), (1, 3, "title", 3)]


def ranked_ids(spark, index, *words, level=S.FORMS, others=None):
    typed = typed_of(spark, *words)
    found = S.matches(S.expand(typed, index.words(), index.grams(), others, level), index.postings())
    ranked = S.tiers(found, typed, S.near_hits(typed, index.postings(typed)), index.sizes())
    return [(r["doc_id"], r["tier"]) for r in ranked.orderBy("rank", "doc_id").collect()]


def test_description_beats_text_and_word_beats_compound(spark):
    index = indexed(spark, [(1, "body", "vertrag x"), (2, "title", "vertrag"), (2, "body", "y"), (3, "body", "mietvertrag z"), (4, "tags", "vertraege")])
    assert ranked_ids(spark, index, "vertrag") == [(2, 0), (4, 1), (1, 3), (3, 4)]


def test_forms_of_words(spark):
    texts = ["Gärten am See", "ein Garten", "Gartenbau", "Kleingartenverein", "Kleingartens", "Gartenzwergmuseum hier", "Fahrt ins Grüne", "Obstgärten"]
    index = indexed(spark, [(i, "body", t) for i, t in enumerate(texts)])
    # By stem, as a beginning, as an end with an ending, with its plural; six letters may also stand inside.
    assert {d for d, _ in ranked_ids(spark, index, "garten")} == {0, 1, 2, 3, 4, 5, 7}
    assert ranked_ids(spark, index, "garten", level=S.LITERAL) and {d for d, _ in ranked_ids(spark, index, "garten", level=S.LITERAL)} == {1, 2, 5}
    assert {d for d, t in ranked_ids(spark, index, "wiese", level=S.RELATED, others=spark.createDataFrame([("wiese", "fahrt")], "term string, other string")) if t == 5} == {6}
    assert {d for d, t in ranked_ids(spark, index, "gatren", level=S.SIMILAR) if t == 6} == {1}


def test_stems_equal_the_statement(spark, sf_dir):
    words = vocab(spark, sf_dir).where("term rlike '^[a-z]+$'").select(F.col("term").alias("w"))
    made = ["abenteuerlichkeiten", "bedeutungen", "befestigten", "ergebnisses", "gueltigkeit", "systeme", "systemen", "lieferanteln", "lehrerinnen", "quallen", "bauern", "yacht", "traeumerei", "einigung", "leidend", "koestlich", "fest", "haetten", "i", ""]
    both = words.unionByName(spark.createDataFrame([(w,) for w in made], "w string"))
    got = {r["w"]: r["stem"] for r in stems.with_stem(both, "w").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest($1) AS w", [list(got)])
    assert got == dict(con.execute(f"WITH {stems.stem_sql('t', 'w')} SELECT word, stem FROM stems").fetchall())
    assert got["befestigten"] == "befestigt" and got["bauern"] == "bau" and got["ergebnisses"] == "ergebnis" and got["systemen"] == "system"


def test_similar_spellings_against_the_plain_function(spark, sf_dir):
    words = vocab(spark, sf_dir).select(F.col("term").alias("word"))
    typed = plans.searches(spark, sf_dir).where("query_id % 7 = 0")
    got = {(r["term"], r["word"]): r["edits"] for r in S.similar_words(typed, words).collect()}
    every = [r["word"] for r in words.collect() if r["word"].isalpha()]
    want = {}
    for term in {r["term"] for r in typed.collect()}:
        most = 0 if len(term) < 5 else 1 if len(term) < 9 else 2
        if most and term.isalpha():
            for w in every:
                if w[:2] == term[:2] and w != term and abs(len(w) - len(term)) <= 2 * most and (d := X.spelling_distance(term, w, most)) <= most:
                    want[term, w] = d
    assert got == want


def content(index):
    rows = sorted(tuple(r) for r in index.postings().select("doc_id", "col", "term", "n", "places").collect())
    words = sorted((r["term"], r["docs"], r["stem"]) for r in index.words().collect())
    sizes = sorted((r["doc_id"], r["dl"], r["n_docs"], round(r["avg_dl"], 6)) for r in index.sizes().collect())
    grams = sorted(tuple(r) for r in index.grams().select("gram", "at", "word").collect())
    return rows, words, sizes, grams


def test_index_upkeep_equals_a_new_index(spark):
    rng = random.Random(8)
    words = ["apfel", "birne", "kirsche", "apfelbaum", "kirschgarten", "2024", "x"]
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(0, 9)))
    now = {(d, c): text() for d in range(30) for c in ("title", "body")}
    frame = lambda rows: spark.createDataFrame([(d, c, t) for (d, c), t in rows.items()], "doc_id long, col string, text string")
    index = I.create(frame(now), buckets=4)
    for _ in range(3):
        docs = rng.sample(range(36), 6)
        changed = {(d, c): text() for d in docs[:4] for c in ("title", "body")}
        now = {k: v for k, v in now.items() if k[0] not in docs} | changed
        index = I.update(index, frame(changed), spark.createDataFrame([(d,) for d in docs[4:]], "doc_id long"))
    new = I.create(frame(now), buckets=4)
    want = content(new)
    assert content(index) == want
    assert content(I.merge(index)) == want
    some = spark.createDataFrame([("birne",), ("never",)], "term string")
    assert sorted(tuple(r) for r in index.postings(some).select("doc_id", "col", "n").collect()) == sorted((d, c, n) for d, c, t, n, _ in want[0] if t == "birne")


def test_a_search_reads_only_its_buckets(spark, sf_dir):
    index = stored_index(spark, sf_dir)
    one = spark.createDataFrame([("license",)], "term string")
    plan = index.postings(one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_empty_index(spark):
    index = indexed(spark, [])
    assert index.words().count() == 0 and index.postings(typed_of(spark, "a")).count() == 0 and index.sizes().count() == 0


def test_facets_ignore_nulls_and_own_group(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), (None, "x")], "s string, t string")
    groups = {"s": F.col("s") == "a", "t": F.col("t") == "x"}
    values = {"s": F.array("s"), "t": F.array("t")}
    got = {(r["facet"], r["value"]): r["n"] for r in facet_counts(docs, groups, values).collect()}
    assert got == {("s", "a"): 1, ("s", "b"): 1, ("t", "x"): 1}


def test_close_letters_sends_nothing_through_the_driver(spark, sf_dir):
    from folioforge.plans import registry

    assert "Broadcast" not in registry.queries()["close_letters"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_matches_are_summed_where_a_document_lies(spark):
    docs = spark.createDataFrame([(1, "title", "rote blume"), (1, "body", "blume am haus haus"), (2, "body", "haus")], "doc_id long, col string, text string")
    index = I.create(docs, 2)
    sought = spark.createDataFrame([(7, 0, "blume", 0), (7, 1, "haus", 0), (7, 1, "blume", 2)], "query_id long, term_ix int, word string, level int")
    found = S.matches(sought, index.postings(), sized=index.sizes())
    assert "hashpartitioning(query_id" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["doc_id"], r["term_ix"], r["level"], r["title_level"], r["tf0"], r["tf2"], r["dl"], r["n_docs"]) for r in found.collect())
    assert got == [(1, 0, 0, 0, 11.0, 11.0, 6, 2), (1, 1, 0, 2, 2.0, 13.0, 6, 2), (2, 1, 0, None, 1.0, 1.0, 1, 2)]


def test_postings_are_grouped_where_texts_lie(spark, monkeypatch):
    """A document's columns cut over several steps, and a column that comes in two rows, against plain counting."""
    from folioforge.functions import words as W

    monkeypatch.setattr(W, "TOGETHER", 5)
    rows = [(i, c, t) for i in range(9) for c, t in (("title", f"alpha beta w{i}"), ("body", f"beta gamma beta {'delta ' * i} w{i}"), ("notes", "" if i % 2 else None))]
    for more in ([], [(3, "body", "beta omega"), (3, "body", "beta")]):
        made = I.create(spark.createDataFrame(rows + more, "doc_id long, col string, text string").repartition(3), buckets=4)
        want = {}
        for i, c, t in rows + more:
            for pos, w in enumerate((t or "").split()):
                want.setdefault((i, c, w), []).append(pos)
        got = {(r.doc_id, r.col, r.term): (r.n, sorted(r.places)) for r in made.postings().collect()}
        assert made.postings().count() == len(got)
        assert got == {k: (len(v), sorted(v)) for k, v in want.items()}
        docs = {}
        for i, _, w in want:
            docs.setdefault(w, set()).add(i)
        assert {r.term: r.docs for r in made.words().collect()} == {w: len(d) for w, d in docs.items()}
        assert {r.doc_id: r.dl for r in made.sizes().collect()} == {i: sum(len(v) for k, v in want.items() if k[0] == i) for i in range(9)}


def test_no_row_per_word_is_shuffled_for_the_index(spark):
    """What is dealt to the buckets is packed: fewer rows than postings by far (before: one each, after one per word)."""
    texts = spark.createDataFrame([(i, "body", " ".join(f"w{j}" for j in range(200))) for i in range(200)], "doc_id long, col string, text string").coalesce(1)
    packed = I._packed(texts, 8)
    assert packed.count() <= 8 * I.FILES
    assert I._unpacked(packed).count() == 200 * 200


def test_telling_words_with_few_sent(spark, monkeypatch):
    """Words beyond the frequent ones meet their counts in a join; against plain Python."""
    import math
    import random

    from pyspark.sql import functions as F

    from folioforge.functions import words as W

    draw = random.Random(5)
    docs = {i: [f"w{int(draw.paretovariate(0.6)) % 300}" for _ in range(draw.randrange(0, 60))] for i in range(60)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, words array<string>")
    totals = W.word_totals(table)
    df = {}
    for t in docs.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    assert {r.term: (r.docs, r.cnt) for r in totals.collect()} == {w: (n, sum(t.count(w) for t in docs.values())) for w, n in df.items()}
    n = sum(1 for t in docs.values() if t)
    want = set()
    for i, t in docs.items():
        each = sorted((-round(math.sqrt(t.count(w)) * math.log(n / df[w]), 9), w) for w in set(t) if 2 <= df[w] <= n / 2)
        want |= {(i, w) for _, w in each[:4]}
    for sent in (7, 1 << 18):
        monkeypatch.setattr(W, "FREQUENT", sent)
        monkeypatch.setattr(W, "TOGETHER", 100)
        rows = W.telling_candidates(table, totals, n, n / 2, 4).collect()
        got = {(r.doc_id, r.term) for r in rows}
        assert len(rows) == len(got) and want <= got
        assert all(r.df == df[r.term] and r.tf == docs[r.doc_id].count(r.term) and 2 <= r.df <= n / 2 for r in rows)
        weight = F.round(F.sqrt("tf") * F.ln(F.lit(n) / F.col("df")), 9)
        assert all(r.w >= 0 for r in W.telling_candidates(table, totals, n, n / 2, 4).select(weight.alias("w")).collect())


def test_a_term_of_many_searches_meets_the_words_once(spark):
    typed = spark.createDataFrame([(q, 0, "hausx") for q in range(30)] + [(1, 1, "baumx")], "query_id long, term_ix int, term string")
    words = spark.createDataFrame([("haus", 5), ("hausy", 9), ("maus", 99), ("hau", 9), ("baum", 1)], "term string, docs long")
    found = plans.closest_words(typed, words)
    assert sorted(tuple(r) for r in found.collect()) == sorted([(q, 0, "hausx", "hausy") for q in range(30)] + [(1, 1, "baumx", "baum")])
    # Terms are made distinct below the edit distance.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [term" in plan[plan.index("levenshtein") :]
