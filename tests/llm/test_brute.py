"""The dealt operators against brute force on the smallest tables and on made-up rows."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioforge.llm import bpe, embedding_dedup, line_dedup, mixing, mtree_search, ngram_join, pseudonyms, queries, secrets, shingles, substring_dedup, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_base_secrets(docs, texts):
    kinds = {
        "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    for r in secrets.scan_secrets(docs).collect():
        found = []
        for rank, (kind, (pattern, good)) in enumerate(kinds.items()):
            found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, texts[r["doc_id"]], re.ASCII) if good(m)]
        assert r["base"] == ",".join(f for _, _, f in sorted(found))
        assert set(r["base"].split(",")) <= set(r["spans"].split(","))


def test_a_failing_match_consumes_what_follows():
    assert secrets.base_spans("secret=token: abcdefgh") == []
    assert secrets.base_spans("toKen=abcdefgh tOkEn=abcdefgh") == [(15, 29, 0)]


def test_parts_count_only_together(spark):
    rows = [(1, "user=bob pw: hunter2 host=db.example.com:5432"), (2, "pw: hunter2 only"), (3, "login: carol\n\npass=zzzzzz"), (4, "login: carol " + "x" * 300 + " pass=zzzzzz")]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "id:0:8,secret:9:20,endpoint:21:45", 2: "", 3: "", 4: ""}


def test_parts_with_prefixed_names_and_in_urls(spark):
    rows = [
        (1, "DB_USER=admin\nDB_PASS=hunter2\nDB_HOST=db.internal"),
        (2, "https://h/v1?client_id=abc&sig=xyz123"),
        (3, "aws_access_key_id=abcdef db_pwd: s3cr"),
        (4, "PGUSER=bob PGHOST=h.internal"),
        (5, "user=bob AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEX"),
        (6, "https://h/v1?client_id=abc&token=abcdefgh"),
        (7, "https://h/v1?q=abc"),
    ]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        1: "id:3:13,secret:17:29,endpoint:33:49",
        2: "endpoint:0:37,id:13:26,secret:27:37",
        3: "id:4:24,secret:28:37",
        4: "",
        5: "id:0:8,secret:13:63",
        6: "endpoint:0:41,id:13:26,assign:27:41",
        7: "",
    }


def test_linking_against_pairs(spark, docs, texts):
    """Which parts count, by comparing all parts of a scope with each other."""
    rng = np.random.default_rng(6)
    words = ["user=bob", "pw: hunter2", "host=db.internal", "https://h/v1?client_id=abc&sig=xyz123", "token=abcdefgh", "x" * 90, "plain", "Ab3" * 8, "login: carol", "\n\n"]
    made = {-i: " ".join(rng.choice(words, rng.integers(2, 14))) for i in range(1, 121)}
    every = texts | made
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(made.items()), "doc_id long, text string"))).collect()}
    kept = collections.Counter()
    for i, text in every.items():
        base = secrets.base_spans(text)
        breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
        parts = [(a, k, b, sum(x <= a for x in breaks)) for a, b, k in {*base, *secrets.weak_spans(text, base)}]
        parts = [(a, k, b, scope) for a, k, b, scope in parts]

        def near(p, kinds):
            return any(q is not p and q[3] == p[3] and q[1] in kinds and (q[0] - p[2] <= secrets.WINDOW if (q[0], q[1], q[2]) > (p[0], p[1], p[2]) else p[0] - q[2] <= secrets.WINDOW) for q in parts)

        want = [p for p in parts if p[1] < 3 or (p[1] == 3 and near(p, (0, 2, 4))) or (p[1] == 4 and near(p, (1, 3))) or (p[1] == 5 and near(p, (1, 3)) and near(p, (0, 2, 4)))]
        kept.update(p[1] for p in want)
        assert got[i] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in sorted(want)), (i, text[:300])
    assert all(kept[k] for k in (0, 3, 4, 5))


def naive_numbers(text):
    """Places of valid cards and account numbers, by trying every stretch between other characters."""
    alnum = lambda c: c.isascii() and c.isalnum()
    out = {}
    for a in range(len(text)):
        if not alnum(text[a]) or (a and alnum(text[a - 1])):
            continue
        for b in range(min(len(text), a + 68), a + 12, -1):
            if b < len(text) and alnum(text[b]) or not alnum(text[b - 1]):
                continue
            own = text[a:b]
            digits = own.replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and digits.isascii() and digits.isdigit() and not re.search(r"[ -]{2}", own) and len(set(digits)) > 1:
                total = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits)))
                if total % 10 == 0:
                    out[a] = ("card", b)
                    break
            account = own.replace(" ", "")
            if re.fullmatch(r"[A-Z]{2}\d\d[A-Z0-9]+", account, re.ASCII) and "  " not in own and len(account) == int(pseudonyms.IBAN_LENGTHS.get(account[:2], 0)):
                if int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1:
                    out[a] = ("iban", b)
                    break
    return out


def test_pseudonyms_against_every_stretch(spark, docs, texts):
    """Over all documents: valid cards and account numbers are replaced as such unless a longer find holds them, nothing else changes, and equal values stay equal."""
    found, kinds = {}, collections.Counter()
    made = ["Pay 4111 1111 1111 1111 123", "BE68 5390 0754 7034 PAID", "DE89370400440532013000 or DE89 3704 0044 0532 0130 00.", "12 4111-1111-1111-1111", "4111111111111112 and DE88 3704 0044 0532 0130 00", "a4111111111111111"]
    made = {-1 - i: t for i, t in enumerate(made)}
    texts = texts | made
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(made.items()), "doc_id long, text string"))
    for r in pseudonyms.pseudonymise(docs, b"k").collect():
        text, spans = texts[r["doc_id"]], [(f["start"], f["stop"], f["kind"], f["pseudonym"]) for f in r["found"]]
        at, parts = 0, []
        for a, b, kind, new in spans:
            parts += [text[at:a], new]
            at = b
            kinds[kind] += 1
            assert new != text[a:b] and re.sub(r"[A-Za-z0-9]", "x", new) == re.sub(r"[A-Za-z0-9]", "x", text[a:b]) or kind == "ip"
            value = (kind, re.sub(r"[^A-Za-z0-9]", "", text[a:b])) if kind in ("card", "iban") else (kind, text[a:b])
            same = re.sub(r"[^A-Za-z0-9]", "", new) if kind in ("card", "iban") else new
            assert found.setdefault(value, same) == same
        assert r["text"] == "".join([*parts, text[at:]]) and r["n_found"] == len(spans)
        held = {a: (kind, b) for a, b, kind, _ in spans}
        for a, (kind, b) in naive_numbers(text).items():
            assert held.get(a) == (kind, b) or any(x < b and a < y for x, y, _, _ in spans), (r["doc_id"], kind, text[a:b])
    assert len(set(found.values())) == len(found) and kinds["card"] > 2 and kinds["iban"] == 3


def test_line_chunks_survive_an_insertion(spark):
    body = "\n".join(f"line {i} of a long block" for i in range(40))
    rows = [(1, body), (2, "new first line\n" + body)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == body and got[1]["n_removed_lines"] == 0
    assert got[2]["n_removed_lines"] >= 36 and got[2]["text"].startswith("new first line")


def test_line_passages_between_other_lines(spark):
    """Passages of 3 to 8 lines in two documents each: what share of their lines goes, and nothing else does."""
    rng = np.random.default_rng(4)
    line = lambda: " ".join(f"w{rng.integers(10**6)}" for _ in range(9))
    rows, passages = [], {}
    for k in range(240):
        own = [line() for _ in range(3 + k % 6)]
        for d in (2 * k, 2 * k + 1):
            rows.append((d, "\n".join([*(line() for _ in range(rng.integers(1, 6))), *own, *(line() for _ in range(rng.integers(1, 6)))])))
            passages[d] = own
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = collections.Counter()
    for d, text in rows:
        left = got[d]["text"].split("\n")
        gone = [x for x in text.split("\n") if x not in left]
        assert set(gone) <= set(passages[d]) and (d % 2 or not gone)
        lost[len(passages[d])] += len(gone)
    share = {n: lost[n] / (40 * n) for n in range(3, 9)}
    assert share[3] > 0.35 and share[5] > 0.7 and share[8] > 0.8, share


def test_lines_that_repeat_one_line(spark):
    """A run of one line is cut every so many lines, whatever stands before it."""
    rows = [(1, "\n".join(["a", *["same"] * 40])), (2, "\n".join(["b", "c", *["same"] * 40]))]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["text"].startswith("b\nc") and got[2]["n_removed_lines"] >= 24
    assert got[1]["text"].startswith("a\nsame")


def brute_spans(texts):
    """The sentences of each text that a later occurrence of a run covers, one run at a time."""
    pieces = {i: re.split(r"(?<=[.!?]\s)(?=\S)|(?<=\n)(?=\S)", t) for i, t in texts.items()}
    places = collections.defaultdict(set)
    for i, own in pieces.items():
        trimmed = [p.strip(" \t\n\r\x0b\x0c") for p in own]
        runs = set()
        for a in range(len(own)):
            runs |= {(a, a + n) for n, least in ((2, 150), (1, 250)) if a + n <= len(own) and len(" ".join(trimmed[a : a + n])) >= least}
            runs |= {(a, b) for b in [next((b for b in range(a + 3, len(own) + 1) if len(" ".join(trimmed[a:b])) >= 90), None)] if b}
            runs |= {(c, a + 1) for c in [next((c for c in range(a - 2, -1, -1) if len(" ".join(trimmed[c : a + 1])) >= 90), None)] if c is not None}
        for a, b in runs:
            places[tuple(trimmed[a:b])].add((i, a, b))
    lost = collections.defaultdict(set)
    for found in places.values():
        first = min(found)[:2]
        for i, a, b in found:
            if (i, a) != first:
                lost[i].update(range(a, b))
    return pieces, lost


def test_spans_against_brute_force(spark, docs, texts):
    rng = np.random.default_rng(8)
    short = "\n".join(" ".join(f"w{rng.integers(10**6)}" for _ in range(4)) for _ in range(20))
    made = {-i: f"Own sentence {rng.integers(10**9)}.\nAnother of {rng.integers(10**9)}.\n{short}\nAnd the end {rng.integers(10**9)}." for i in (1, 2)}
    every = texts | made
    pieces, lost = brute_spans(every)
    assert sum(map(len, lost.values())) > 0 and lost[-1] >= set(range(2, 22))
    for r in substring_dedup.dedup_spans(docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(made.items()), "doc_id long, text string"))).collect():
        own = pieces[r["doc_id"]]
        assert r["text"] == "".join(p for k, p in enumerate(own) if k not in lost[r["doc_id"]])
        assert r["n_removed_sentences"] == len(lost[r["doc_id"]])


def components(sets, percent):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingled(text, n):
    w = text.encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(docs, texts, n, percent):
    sets = {i: shingled(t, n) for i, t in texts.items()}
    got = {r["doc_id"]: r for r in ngram_join.near_copies(docs, n, percent).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == components(sets, percent)


def test_ngram_join_of_a_large_family(spark, monkeypatch):
    """Tiles and columns with many rows, forced by small limits."""
    monkeypatch.setattr(ngram_join, "FEW", 4)
    monkeypatch.setattr(ngram_join, "TILE", 500)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        own = list(base)
        for at in rng.integers(0, 90, rng.integers(0, 5)):
            own[at] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components({i: shingled(t, 4) for i, t in rows}, 85)


def test_product_links_against_pairs():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))) for _ in range(30)]
        links = ngram_join.product_links(sets, np.zeros(30, int), 60)
        want = components({i: set(s.tolist()) for i, s in enumerate(sets)}, 60)
        forest = ngram_join.Forest(30)
        for a, b in links:
            forest.join(a, b)
        assert forest.roots(np.arange(30)).tolist() == [want[i] for i in range(30)]
        assert len(links) == 30 - len(set(want.values()))


def test_shingles_of_short_texts():
    assert len(shingles.shingle_set("a b c", 4)) == 1 and len(shingles.shingle_set(" \t\n", 4)) == 0 and len(shingles.shingle_set(None, 4)) == 0
    assert shingles.shingle_set("A b C d", 4).tolist() == shingles.shingle_set("a  B\x0bc\rd", 4).tolist()
    assert shingles.shingle_set("a b", 4).tolist() != shingles.shingle_set("b a", 4).tolist()


def test_embedding_recall(spark):
    rng = np.random.default_rng(0)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    base = unit(rng.normal(size=(600, 64)))
    side = rng.normal(size=base.shape)
    side = unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    rows = np.concatenate([base, 0.955 * base + np.sqrt(1 - 0.955**2) * side, 3 * base[:50], unit(base[:1] + 0.02 * rng.normal(size=(700, 64)))])
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(frame).toPandas().sort_values("vec_id")
    near = unit(rows) @ unit(rows).T >= 0.95
    want = near.sum(axis=1) - 1
    assert (got["n_links"].to_numpy() <= want).all()
    assert got["n_links"].sum() >= 0.9 * want.sum()
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


@pytest.mark.parametrize("dim", [8, 64, 768])
def test_sketches_keep_every_linked_pair(dim):
    rng = np.random.default_rng(dim)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 4000, dim)))
    b = b - (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    apart = np.unpackbits(embedding_dedup.sketches(a) ^ embedding_dedup.sketches(b), axis=1).sum(axis=1)
    assert (apart <= embedding_dedup.most_apart(0.95)).all()
    both = np.concatenate([embedding_dedup.sketches(a[:300]), embedding_dedup.sketches(b[:300])])
    assert embedding_dedup.partnered(both, np.zeros(600, int), embedding_dedup.most_apart(0.95)).all()
    if dim == 768:
        assert embedding_dedup.partnered(embedding_dedup.sketches(a[:300]), np.zeros(300, int), embedding_dedup.most_apart(0.95)).mean() < 0.05


def test_top_k_against_brute_force(spark, sf_dir, monkeypatch):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = frame.toPandas()
    ints, ids = np.floor(1024 * np.stack(rows["embedding"]).astype(float)), rows["vec_id"].to_numpy()
    want = []
    for i in np.flatnonzero(ids % 100 == 0):
        score = ints @ ints[i]
        score[ids == ids[i]] = -np.inf
        want += [(int(ids[i]), n + 1, int(ids[j]), int(score[j])) for n, j in enumerate(np.lexsort((ids, -score))[:10])]
    monkeypatch.setattr(mtree_search, "PAGE", 8)
    monkeypatch.setattr(mtree_search, "NODE_PAGES", 2)
    monkeypatch.setattr(mtree_search, "SEARCHING", 2)
    got = mtree_search.top_k(frame).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_scores_that_do_not_fit():
    with pytest.raises(OverflowError):
        mtree_search.scaled([[1e30, 1.0]])
    with pytest.raises(OverflowError):
        mtree_search.scores(np.full((1, 2), 1 << 40), np.full(2, 1 << 40))


def test_top_k_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    rows = np.floor(1000 * np.repeat(rng.normal(size=(20, 8)), 50, axis=0) + 20 * rng.normal(size=(1000, 8))).astype(np.int64)
    top2 = float((rows.astype(float) ** 2).sum(axis=1).max())
    pages = []
    for a in range(0, 1000, 50):
        p = mtree_search.make_page(np.arange(a, a + 50), rows[a : a + 50], None, top2)
        own = {"route": 0, "up": 0.0, "radius": p["radius"], "ids": np.frombuffer(p["ids"], np.int64), "away": np.frombuffer(p["away"]), "vecs": np.frombuffer(p["vecs"], np.int64).reshape(-1, 8), "point": mtree_search.lifted(np.frombuffer(p["centre"], np.int64)[None], top2)}
        pages.append(own)
    best = mtree_search.search(pages, 3, rows[3], -np.inf, None, top2, 5)
    score = rows @ rows[3]
    order = [i for i in np.lexsort((np.arange(1000), -score)) if i != 3][:5]
    assert best.ids.tolist() == order and best.scores.tolist() == score[order].tolist()


def test_top_k_searches_few_nodes_of_clustered_vectors(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(100, 32))
    rows = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), 200, axis=0) + 0.4 * rng.normal(size=(20_000, 32)) / np.sqrt(32)
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    ids = rng.permutation(20_000)
    monkeypatch.setattr(mtree_search, "PAGE", 32)
    monkeypatch.setattr(mtree_search, "NODE_PAGES", 4)
    asked, nodes, real = [], [], mtree_search._searched

    def counted(wanted, queries, pages, *rest):
        asked.append(wanted.count())
        nodes.append(pages.select("node").distinct().count())
        return real(wanted, queries, pages, *rest)

    monkeypatch.setattr(mtree_search, "_searched", counted)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": rows.tolist()}), "vec_id long, embedding array<double>")
    got = mtree_search.top_k(frame).select("query_id", "rank", "vec_id", "score").collect()
    ints, want = np.floor(1024 * rows), []
    for i in np.flatnonzero(ids % 100 == 0):
        score = ints @ ints[i]
        score[i] = -np.inf
        want += [(int(ids[i]), n + 1, int(ids[j]), int(score[j])) for n, j in enumerate(np.lexsort((ids, -score))[:10])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(asked) <= 0.1 * 200 * nodes[0], (asked, nodes)


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    names = sorted(set(source.values()))
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    total, weight, level = sum(size.values()), {s: 1 + i % 3 for i, s in enumerate(names)}, {}
    share = {s: total * weight[s] / sum(weight.values()) for s in names}
    while over := [s for s in names if s not in level and share[s] > 3 * size[s]]:
        level |= {s: 3.0 * size[s] for s in over}
        rest = [s for s in names if s not in level]
        share = {s: (total - sum(level.values())) * weight[s] / sum(weight[x] for x in rest) for s in rest}
    for s in names:
        assert target[s] == pytest.approx(level.get(s, share.get(s)))
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS
    texts = mixing.mixed_documents(docs).collect()
    words = collections.Counter()
    for r in texts:
        words[r["doc_id"]] += len(r["text"].split())
    assert {i: n for i, n in words.items() if n} == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}


def test_shards_draw_their_sources(docs):
    """Counts add up to the sources' totals, scatter as multinomial draws do, and number the slots that the mix takes."""
    _, pieces, slots = mixing.plan(docs, block_words=4, shard_slots=512)
    rows = slots.collect()
    counts = collections.Counter((r["shard"], r["sid"]) for r in rows)
    shards, totals = 1 + max(s for s, _ in counts), collections.Counter(r["sid"] for r in rows)
    assert shards > 20
    for sid, total in totals.items():
        assert sorted(r["slot"] for r in rows if r["sid"] == sid) == list(range(total))
        expected = total / shards
        chi = sum((counts[s, sid] - expected) ** 2 / expected for s in range(shards))
        assert 0.4 * shards < chi < 2 * shards, (sid, chi)
    by = sorted(((r["sid"], r["slot"], r["shard"]) for r in rows))
    assert all(a[0] != b[0] or a[2] <= b[2] for a, b in zip(by, by[1:]))
    times = collections.Counter((r["sid"], r["block"]) for r in rows)
    got = {(r["sid"], r["block"]): r["times"] for r in pieces.select("sid", "block", "times").collect()}
    assert got == {key: n for key, n in times.items() if key in got} and max(times.values()) <= 3


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 7, 64, 1000):
        got = spark.range(n).select(mixing._feistel(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long"))).collect()
        assert sorted(r[0] for r in got) == list(range(n))


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe(spark, sf_dir, texts, reference):
    for r in queries.op8_bpe(spark, sf_dir).collect():
        ids = reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("text", ["", " ", "  a", "a\n \nb", "a \n b ", "don't we'll", "x<|endoftext|> y", "ab" * 3000, "²½Ⅷ 中文 🙂́", "a b　c \x1c d", "\U000323b0 new", "tab\t\tend \t"])
def test_bpe_odd_texts(reference, text):
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        codec = bpe.Codec(bpe.Vocabulary(f.read()), None)
    n, ids, decoded = codec.code(pa.array(["before 's", text, None, "after"]))
    want = reference.encode(text, add_special_tokens=False).ids
    assert n[1].as_py() == len(want) and list(memoryview(ids[1].as_py()).cast("I")) == want
    assert decoded[1].as_py() == reference.decode(want, skip_special_tokens=False)
    assert decoded.to_pylist()[::2] == ["before 's", ""] and decoded[3].as_py() == "after"
    assert codec.code(pa.array([text])[:0])[0].to_pylist() == []


def test_bpe_random_texts(reference):
    """Texts of few kinds of characters, so that every neighbourhood of spaces, quotes and letters occurs."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("  \n'\u3000srevlxß7²!\x1c"), rng.integers(0, 30))) for _ in range(4000)]
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        codec = bpe.Codec(bpe.Vocabulary(f.read()), None)
    got = codec.code(pa.array(texts))[1].to_pylist()
    for text, ids in zip(texts, got, strict=True):
        assert list(memoryview(ids).cast("I")) == reference.encode(text, add_special_tokens=False).ids, text


def test_bpe_long_text_without_spaces(reference):
    text = "".join(np.random.default_rng(1).choice(list("abcXYZ019/+"), 1_000_000))
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        codec = bpe.Codec(bpe.Vocabulary(f.read()), None)
    n, ids, decoded = codec.code(pa.array([text]))
    assert decoded[0].as_py() == text and n[0].as_py() == len(reference.encode(text, add_special_tokens=False).ids)


def test_lexicon_round_trip(tmp_path):
    words = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["a", "ab", "abc", "b", "bc", " the", " them", "ing", "ring", "string"])}
    flat = bpe.Lexicon.compile(words.items())
    (tmp_path / "x.fst").write_bytes(flat)
    lexicon = bpe.Lexicon(str(tmp_path / "x.fst"))
    at = lexicon.find(pa.array([w.decode() for w in words]))
    assert [lexicon.ids[lexicon.starts[i] : lexicon.starts[i + 1]].tolist() for i in at] == list(words.values())
    assert lexicon.find(pa.array(["", "abcd", "rin", " th", "z", "a"])).tolist()[:5] == [-1] * 5
    many = [(f"{stem}ing".encode(), [k]) for k, stem in enumerate(map(str, range(100, 400)))]
    states = np.frombuffer(bpe.Lexicon.compile(many)[:56], np.int64)[6]
    assert states < 150  # endings are shared


def test_pseudonyms_keep_their_format():
    permute = pseudonyms.Permutation(b"k")
    for n in (1, 2, 3, 26, 97, 1000):
        found = [permute.other(i, n, "x") for i in range(n)]
        assert sorted(found) == list(range(n)) and (n == 1 or all(a != b for a, b in enumerate(found)))
    text = "Pay 4111 1111 1111 1111 or 4111-1111-1111-1111, not 4111111111111112. IBAN DE89 3704 0044 0532 0130 00, born 1990-02-28 or 28.02.1990, ssn 123-45-6789, call +1 (743) 555-3824, mail jo.doe7@example.com from 10.1.2.3, bad 999.1.1.1 and 2023-02-30."
    new, found = pseudonyms.pseudonymise_text(text, permute)
    by = collections.defaultdict(list)
    for _, _, kind, value in found:
        by[kind].append(value)
    assert {k: len(v) for k, v in by.items()} == {"card": 2, "iban": 1, "date": 2, "ssn": 1, "phone": 1, "email": 1, "ip": 1}
    digits = [re.sub(r"\D", "", c) for c in by["card"]]
    assert digits[0] == digits[1] != "4111111111111111" and pseudonyms.luhn(digits[0][:-1]) == int(digits[0][-1])
    assert pseudonyms._mod97(by["iban"][0].replace(" ", "")) == 1
    day, month, year = by["date"][1].split(".")
    assert by["date"][0] == f"{year}-{month}-{day}" and by["date"][0] != "1990-02-28"
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", by["phone"][0]) and by["email"][0].endswith("@example.com")
    assert "4111111111111112" in new and "999.1.1.1" in new and "2023-02-30" in new and "jo.doe7" not in new
    assert pseudonyms.pseudonymise_text("no numbers here", permute) == ("no numbers here", [])


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(found) > 500 and ((found["predicted"] == 1) == (found["score"] >= 0.5)).all()
    assert (found["predicted"] == found["toxic"]).mean() >= 0.97
    assert found[found["toxic"] == 0]["predicted"].mean() <= 0.01
