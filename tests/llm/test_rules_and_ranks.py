"""Quality rules and ranked search against plain recomputation."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

from folioforge.llm import quality_rules as Q
from folioforge.llm import queries, ranked_search

DOCS = "doc_id long, text string, n long, terms string, score string, rank int, ratio string, reason int, item_id string"


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", "s", 2, "r", 3, "i") for r in rows], DOCS)


def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + k for places in where.values() if len(places) > 1 for i in places for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def plain_verdict(text):
    data, squeeze = text.encode(), zstandard.ZstdCompressor(level=3)

    def side(part):
        low, high = [(low, high) for limit, low, high in Q.BANDS if len(part) < limit][0]
        r = len(squeeze.compress(part)) / len(part)
        return "low" if r < low else "high" if r > high else ""

    parts = [data[i : i + 2048] for i in range(0, len(data), 2048)]
    return not side(data) and all(3 * sum(len(p) for p in parts if side(p) == s) <= len(data) for s in ("low", "high"))


TEXTS = [
    (None, "no id " * 3), (1, None), (2, ""), (3, " \n\t "), (4, "a b c a b c"), (5, "same line\nsame line\n \nother é\n same line"), (6, "x y z w " * 30), (7, "\n".join(f"row {i} of it # $" for i in range(400))),
    (8, "word joined   wide " * 20), (9, "" + "".join(chr(33 + (i * i * 7 + i // 3) % 90) + (" " if i % 9 == 0 else "") for i in range(6000))), (9, "twice"), (9, "twice"), (10, "go " * 60_000),
]


def check_rules(rows, texts):
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts, strict=True):
        text = text or ""
        want = plain_counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and plain_verdict(text))
        assert (r["reason"] is None) == r["kept"]


def test_rules_on_given_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op12_quality_rules(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    check_rules(rows, [texts[r["doc_id"]] for r in rows])
    assert 0 < sum(r["kept"] for r in rows) < len(rows)


def test_rules_on_made_rows(spark):
    rows = Q.judge_documents(made(spark, TEXTS)).collect()
    assert [r["doc_id"] for r in rows] == [i for i, _ in TEXTS]
    check_rules(rows, [t for _, t in TEXTS])


def test_bands():
    rng = random.Random(4)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(900))
    noise = " ".join("".join(chr(rng.randrange(0x21, 0x7F)) for _ in range(9)) for _ in range(900))
    squeeze = zstandard.ZstdCompressor(level=3)
    reason = lambda t: Q._judge(t, squeeze, Q.BANDS, Q.CHUNK)[-1]
    assert reason(prose) is None
    assert reason(noise) == "incompressible"
    # A repeated passage of 150 words is no repeated window of the base rule's share once it is a third of the text.
    assert reason(prose + " " + "0123456789 " * 1500) in ("windows", "repetitive", "repetitive chunks")
    varied = " ".join(f"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa{i}" for i in range(400))
    assert reason(varied) == "repetitive"
    assert reason(prose + " " + varied[:9000]) in ("repetitive", "repetitive chunks")


def test_many_distinct_words():
    words = [b"%d" % i for i in range(50)] * 2
    assert Q.repeated_words(words) == 100
    assert Q.repeated_words(words[:50]) == 0 and Q.repeated_words([b"a"] * 3) == 0 and Q.repeated_words([b"a"] * 4) == 4


def test_empty_tables(spark):
    assert Q.judge_documents(made(spark, [])).collect() == []
    none, one = made(spark, []), made(spark, [(1, "alpha beta")])
    items = spark.createDataFrame([(1, "alpha", "x")], "item_id long, text string, doc_id string")
    assert ranked_search.rank(none, items).collect() == []
    assert ranked_search.rank(one, items.limit(0)).collect() == []
    assert ranked_search.rank(made(spark, [(1, None), (2, "?!")]), items).collect() == []


def plain_ranks(docs, items, k=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(split(t)), len(split(t))) for i, t in docs if split(t)]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scores = []
        for i, c, n in held:
            m = 10 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(split(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def made_search(seed, n_docs, n_items, most):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "ÉA", "a1b", "日本"]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(n)))
    docs = [(rng.choice([None, *range(20)]) if rng.random() < 0.1 else i, rng.choice([None, "", "?"]) if rng.random() < 0.1 else text(30)) for i in range(n_docs)]
    docs += [docs[3]] * 15
    items = [(i // 2, text(most)) for i in range(n_items)] + [(None, "w1 w2"), (3, None), (None, "w1 w2")]
    return docs, items


@pytest.mark.parametrize(("seed", "most", "slice_bytes"), [(1, 8, 1 << 20), (2, 400, 1 << 20), (3, 12, 100)])
def test_ranks_on_made_rows(spark, seed, most, slice_bytes):
    docs, items = made_search(seed, 300, 12, most)
    table = spark.createDataFrame([(*i, "q", 1) for i in items], "item_id long, text string, doc_id string, score int")
    got = ranked_search.rank(made(spark, docs).repartition(5), table, slice_bytes=slice_bytes).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=repr) == plain_ranks(docs, items)


def test_ranks_on_given_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op13_ranked_search(spark, sf_dir).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=repr) == plain_ranks(docs, items)


def test_more_terms_than_a_mask_word(spark):
    words = [f"t{i}" for i in range(150)]
    docs = [(i, " ".join(words[i : i + 40])) for i in range(120)]
    items = [(1, " ".join(words)), (2, " ".join(words[60:140]))]
    got = ranked_search.rank(made(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=repr) == plain_ranks(docs, items)


def test_groups_below_the_floor_are_left():
    """One document holds all terms; of the others, whose masks promise less, only the first groups are scored."""
    n, width = 2000, 6
    ids = [np.arange(width) if i < 12 else np.array([i % width]) for i in range(n)]
    block = ranked_search.Block([10] * n, np.array([len(x) for x in ids]), np.concatenate(ids), np.ones(sum(map(len, ids)), np.int64), (n, 10 * n), width)
    best = ranked_search.Best(10)
    assert block.search(np.arange(width), np.full(width, 500), best, list(range(n))) == 12
    assert [d for _, d in best.rows] == list(range(10))
