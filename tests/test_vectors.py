"""Search by meaning against plain recomputation, with owners larger than a tile."""

from __future__ import annotations

import numpy as np
import pytest

from folioforge.operators import vectors as V

SCHEMA = "owner long, kind int, embedding array<double>, lang string, clash int"


def plain(searches, chunks, question, by_lang=False):
    out = {}
    for query_id, vector, lang in searches:
        if vector is None or not np.any(vector):
            continue
        q = np.array(vector) / np.linalg.norm(vector)
        seen = {}
        for owner, kind, e, has, _ in chunks:
            if owner is None or e is None or len(e) != len(q) or not all(x is not None and np.isfinite(x) for x in e) or not np.any(e) or (by_lang and lang and lang != has):
                continue
            slot = seen.setdefault(owner, [-9.0, -9.0])
            slot[kind == 2] = max(slot[kind == 2], float(np.array(e) @ q / np.linalg.norm(e)))
        for owner, (large, small) in seen.items():
            out[query_id, owner] = small if large == -9 else large if small == -9 or not question else (large + small) / 2
    return out


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    # Owner 0 has a third of all rows; owner 90 repeats one vector.
    chunks = [(0 if i % 3 == 0 else int(i % 41) + 1, int(rng.integers(3)), rng.normal(size=6).tolist(), "de" if i % 2 else "en", 1) for i in range(600)]
    chunks += [(90, 1, [1.0] * 6, "de", 1)] * 3 + [(91, 2, [1.0] * 6, None, 1), (92, 1, [0.0] * 6, "de", 1), (93, 1, None, "de", 1), (None, 1, [1.0] * 6, "de", 1), (94, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0], "de", 1), (95, 0, [2.0, 1.0], "de", 1)]
    searches = [(i, rng.normal(size=6).tolist(), [None, "de", "en"][i % 3]) for i in range(25)] + [(50, [1.0] * 6, None), (51, [0.0] * 6, None), (52, None, None), (53, [1.0, 0.0], None)]
    return searches, chunks, spark.createDataFrame(searches, "query_id long, vector array<double>, lang string"), spark.createDataFrame(chunks, SCHEMA)


@pytest.fixture(params=[4096, 50])
def tiles(request, monkeypatch):
    monkeypatch.setattr(V, "TILE", request.param)
    monkeypatch.setattr(V, "BLOCK", request.param // 5)


@pytest.mark.parametrize("question", [False, True])
@pytest.mark.parametrize("by_lang", [False, True])
def test_best_and_nearest(made, tiles, question, by_lang):
    searches, chunks, q, c = made
    want = plain(searches, chunks, question, by_lang)
    filters = ("lang",) if by_lang else ()
    got = {(r["query_id"], r["owner"]): r["sim"] for r in V.best_per_owner(q, c, question, filters).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    ranks = {}
    for (query, owner), sim in sorted(want.items(), key=lambda x: (x[0][0], -round(x[1], 6), x[0][1])):
        ranks.setdefault(query, []).append(owner)
    rows = V.nearest(q, c, 5, question, filters).collect()
    assert {(r["query_id"], r["place"]): r["owner"] for r in rows} == {(query, i + 1): o for query, owners in ranks.items() for i, o in enumerate(owners[:5])}


def test_near_enough(made, tiles):
    searches, chunks, q, c = made
    want = plain(searches, chunks, False)
    passed = set()
    for query in {k[0] for k in want}:
        own = {o: s for (i, o), s in want.items() if i == query}
        values = np.array(list(own.values()))
        far = max(2.0, np.sqrt(2 * np.log(len(own))) - 0.8)
        for o, s in own.items():
            z = (s - values.mean()) / values.std() if values.std() > 0 else 0.0
            if (s >= 0.5 or len(own) >= 10 and z >= far and s >= 0.35) and s >= values.max() - V.SPAN:
                passed.add((query, o))
    assert {(r["query_id"], r["owner"]) for r in V.near_enough(q, c, 0.5).collect()} == passed


def test_no_rows(made):
    _, _, q, c = made
    assert V.nearest(q, c.limit(0), 3).collect() == [] and V.near_enough(q.limit(0), c).collect() == []


def test_upkeep(spark):
    def pieces(rows):
        return V.pieces_of(spark.createDataFrame(rows, "doc_id long, title string, body string"))

    long = " ".join(f"w{i}" for i in range(600))
    old, new = pieces([(1, "a", long), (2, "b", "x"), (3, "c", None), (5, None, "")]), pieces([(1, "a", long + " more"), (2, "B", "x"), (4, "d", "y")])
    states = {(r["doc_id"], r["kind"], r["piece"]): r["state"] for r in V.upkeep(old, new).collect()}
    assert states[1, 0, 0] == states[1, 1, 0] == states[2, 1, 0] == "kept" and states[2, 0, 0] == "changed"
    assert states[3, 0, 0] == "gone" and states[4, 1, 0] == "new" and (5, 0, 0) not in states
    assert [s for k, s in sorted(states.items()) if k[:2] == (1, 2)].count("changed") == 1
