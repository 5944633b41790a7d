"""Search by meaning: similarity of chunks, best chunk per owner, cut-off, fusion of rankings.

A stated set of searches meets all chunks as blocks of one matrix product. An owner's
chunks lie in one tile, so a tile knows the owner's value and passes on only what can
still matter: its own best ``k``, or the moments and the owners near its top. Owners
with more chunks than a tile holds are spread over all tiles; each passes on its
maxima for them, which are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators.search import top

#: Chunks in a tile and searches in a block.
TILE, BLOCK = 4096, 1024
#: Least similarity, floor of the relative rule, distance from the best, and the weights (k, w) of fusion.
LEAST, FLOOR, SPAN, WORDS, QUESTION = 0.22, 0.7, 0.15, (60, 0.5), (5, 2.0)
#: Characters of large and small pieces.
LARGE, SMALL = 1200, 600
#: Similarities are ranked and reported with six places.
PLACES = 1e6

PARTIAL = "query_id long, owner long, sim double, large double, small double, n long, mean double, m2 double, top double"
NAMES = [c.split()[0] for c in PARTIAL.split(", ")]


def packed(v: Column) -> Column:
    """Eight-bit whole numbers and their scale: the largest component becomes 127."""
    scale = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / 127
    return F.struct(F.when(scale > 0, F.transform(v, lambda x: F.bround(x.cast("double") / scale).cast("int"))).alias("codes"), scale.alias("scale"))


def _directions(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have a direction (finite, not zero), and these as unit rows."""
    rows = np.stack([np.asarray(v, np.float64) for v in column])
    largest = np.abs(rows).max(axis=1)
    good = np.isfinite(largest) & (largest > 0)
    rows = rows[good] / largest[good, None]
    return good, rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _combined(large: np.ndarray, small: np.ndarray, question: bool) -> np.ndarray:
    """An owner's value: its best large piece, or small one if it has no large; for a question the mean of both. -inf where nothing counts."""
    mixed = (large + small) / 2 if question else large
    return np.where(np.isneginf(large), small, np.where(np.isneginf(small), large, mixed))


def _values(searches: pd.DataFrame, chunks: pd.DataFrame, filters: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``query_id``, ``owner``, ``split`` and the best large and small similarity (owners x searches) of one tile and one block."""
    good, q = _directions(searches["vector"])
    searches = searches[good]
    chunks = chunks.sort_values("owner", kind="stable")
    good, c = _directions(chunks["embedding"])
    chunks = chunks[good]
    sims = c @ q.T
    for name in filters:
        wanted, has = searches[f"of_{name}"].to_numpy(object), chunks[f"has_{name}"].to_numpy(object)
        sims[~(pd.isna(wanted)[None, :] | (has[:, None] == wanted[None, :]))] = -np.inf
    owner, first = np.unique(chunks["owner"].to_numpy(), return_index=True)
    is_large = (chunks["kind"].to_numpy() < 2)[:, None]
    if not len(owner):
        return searches["query_id"].to_numpy(), owner, np.empty(0, bool), sims, sims
    large, small = (np.maximum.reduceat(np.where(of, sims, -np.inf), first, axis=0) for of in (is_large, ~is_large))
    return searches["query_id"].to_numpy(), owner, chunks["split"].to_numpy()[first], large, small


Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _best(k: int) -> Keep:
    """Of each search its ``k`` best owners, equal ones by number."""

    def keep(value: np.ndarray, owner: np.ndarray) -> np.ndarray:
        kept = np.zeros(value.shape, bool)
        shown = np.where(np.isneginf(value), -np.inf, np.round(value * PLACES))
        for j in range(value.shape[1]):
            kept[np.lexsort((owner, -shown[:, j]))[:k], j] = True
        return kept

    return keep


def _standing_out(least: float) -> Keep:
    """What neither threshold nor the distance from the best can rule out yet."""

    def keep(value: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return (value >= FLOOR * least) & (value >= value.max(axis=0, initial=-np.inf)[None, :] - SPAN)

    return keep


def _everything(value: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return np.ones(value.shape, bool)


def _partials(searches: DataFrame, chunks: DataFrame, keep: Keep, question: bool, filters: tuple[str, ...], moments: bool = False) -> DataFrame:
    """Rows of whole owners that ``keep`` lets through (``sim``), maxima of split owners (``large, small``) and, if asked for, moments of whole ones (``n, mean, m2, top``)."""
    total = max(1, -(-chunks.count() // TILE))
    blocks = max(1, -(-searches.count() // BLOCK))
    crowded = chunks.groupBy("owner").agg(F.count("*").alias("pieces")).where(F.col("pieces") > TILE).select("owner", F.lit(True).alias("split"))
    c = chunks.where("owner is not null and size(embedding) > 0").select(F.col("owner").cast("long").alias("owner"), "kind", "embedding", *[F.col(f).alias(f"has_{f}") for f in filters])
    c = c.join(crowded, "owner", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    # Equal pieces of a crowded owner have one maximum, and would all fall into one tile.
    c = c.where("not split").unionByName(c.where("split").dropDuplicates())
    spot = F.when(F.col("split"), F.xxhash64("owner", "embedding")).otherwise(F.xxhash64("owner"))
    c = c.select("*", F.size("embedding").alias("dim"), F.pmod(spot, F.lit(total)).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    q = searches.where("query_id is not null and size(vector) > 0").select(F.col("query_id").cast("long").alias("query_id"), "vector", *[F.col(f).alias(f"of_{f}") for f in filters])
    q = q.select("*", F.size("vector").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("tile"))

    def meet(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(columns=NAMES)
        if not len(own) or not len(found):
            return out
        query, owner, split, large, small = _values(own, found, filters)
        rows, cols = np.nonzero(split[:, None] & ~(np.isneginf(large) & np.isneginf(small)))
        parts = [pd.DataFrame({"query_id": query[cols], "owner": owner[rows], "large": large[rows, cols], "small": small[rows, cols]})]
        owner, value = owner[~split], _combined(large[~split], small[~split], question)
        counts = ~np.isneginf(value)
        rows, cols = np.nonzero(counts & keep(value, owner))
        parts.append(pd.DataFrame({"query_id": query[cols], "owner": owner[rows], "sim": value[rows, cols]}))
        if moments:
            n = counts.sum(axis=0)
            mean = np.where(counts, value, 0).sum(axis=0) / np.maximum(n, 1)
            m2 = (np.where(counts, value - mean, 0) ** 2).sum(axis=0)
            parts.append(pd.DataFrame({"query_id": query, "n": n, "mean": mean, "m2": m2, "top": value.max(axis=0, initial=-np.inf)})[n > 0])
        return pd.concat([p for p in parts if len(p)] or [out]).reindex(columns=NAMES).astype({"owner": "Int64", "n": "Int64"})

    by = ["dim", "tile", "block"]
    return q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(meet, PARTIAL)


def _owners(partials: DataFrame, question: bool) -> DataFrame:
    """``query_id, owner, sim``: whole owners as they are, split ones put together."""
    none = F.lit(float("-inf"))
    split = partials.where("large is not null").groupBy("query_id", "owner").agg(F.max("large").alias("large"), F.max("small").alias("small"))
    mixed = (F.col("large") + F.col("small")) / 2 if question else F.col("large")
    value = F.when(F.col("large") == none, F.col("small")).when(F.col("small") == none, F.col("large")).otherwise(mixed)
    return partials.where("sim is not null").select("query_id", "owner", "sim").unionByName(split.select("query_id", "owner", value.alias("sim")))


def best_per_owner(searches: DataFrame, chunks: DataFrame, question: bool = False, filters: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, owner, sim`` of ``searches(query_id, vector)`` and ``chunks(owner, kind, embedding)``: every owner's value.

    An owner's value is its best large piece (kinds 0 and 1), or its best small one if it
    has no large; for a question the mean of the best large and the best small piece.
    ``filters`` name columns of both tables: where a search has a value, only chunks with
    the same count. Null, empty and zero vectors, those with a null or non-finite
    component, and rows without an id or owner take no part; vectors of unlike dimensions do not meet.
    """
    return _owners(_partials(searches, chunks, _everything, question, filters), question)


def nearest(searches: DataFrame, chunks: DataFrame, k: int, question: bool = False, filters: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, owner, sim, place``: the ``k`` best owners of each search; ties go to the smaller owner. See :func:`best_per_owner`."""
    best = _owners(_partials(searches, chunks, _best(k), question, filters), question)
    return top(best.withColumn("sim", F.round("sim", 6)), k, F.col("sim").desc(), F.col("owner"))


def near_enough(searches: DataFrame, chunks: DataFrame, least: float = LEAST, question: bool = False, filters: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, owner, sim`` of owners that stand out. See :func:`best_per_owner`.

    They are over the absolute threshold, or far above the mean and over its floor; none
    far below the best. Fewer than ten owners: the absolute rule alone.
    """
    partials = _partials(searches, chunks, _standing_out(least), question, filters, moments=True)
    best = _owners(partials, question)
    split = _owners(partials.where("large is not null"), question).select("query_id", F.lit(1).cast("long").alias("n"), F.col("sim").alias("mean"), F.lit(0.0).alias("m2"), F.col("sim").alias("top"))
    each = partials.where("n is not null").select("query_id", "n", "mean", "m2", "top").unionByName(split)
    stats = each.groupBy("query_id").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum(F.col("m2") + F.col("n") * F.col("mean") ** 2).alias("squares"), F.sum("n").alias("n"), F.max("top").alias("top"))
    std = F.sqrt(F.greatest(F.col("squares") / F.col("n") - F.col("mean") ** 2, F.lit(0.0)))
    z = F.when(std > 0, (F.col("sim") - F.col("mean")) / std).otherwise(0.0)
    far = z >= F.greatest(F.lit(2.0), F.sqrt(2 * F.ln("n")) - 0.8)
    ok = (F.col("sim") >= least) | ((F.col("n") >= 10) & far & (F.col("sim") >= FLOOR * least))
    return best.join(stats, "query_id").where(ok & (F.col("sim") >= F.col("top") - SPAN)).select("query_id", "owner", "sim")


def fuse(words: DataFrame, meaning: DataFrame, question: bool = False) -> DataFrame:
    """Two rankings ``(query_id, doc_id, place)`` as one: sums of weighted reciprocal places; ties keep the order of the words."""
    k, w = QUESTION if question else WORDS
    left, right = words.withColumnRenamed("place", "p1"), meaning.withColumnRenamed("place", "p2")
    both = left.join(right, ["query_id", "doc_id"], "full_outer")
    score = F.coalesce(1.0 / (60 + F.col("p1")), F.lit(0.0)) + F.coalesce(w / (k + F.col("p2")), F.lit(0.0))
    return both.withColumn("score", F.round(score, 9))


def pieces_of(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, piece, hash`` of ``docs(doc_id, title, body)``: the title as description (kind 0), large pieces (1) and, of texts longer than one, small pieces (2).

    Whole texts, however many pieces they make. Null texts have no pieces but the title;
    a null title has none.
    """
    body = F.trim(F.regexp_replace("body", r"[\t\n\f\r ]+", " "))

    def numbered(kind: int, texts: Column) -> Column:
        return F.transform(texts, lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("piece"), F.sha2(t, 256).alias("hash")))

    none = F.array().cast("array<string>")
    small = F.when(F.length(body) > SMALL, X.pieces(body, SMALL)).otherwise(none)
    each = F.concat(numbered(0, F.array("title")), numbered(1, F.coalesce(X.pieces(body, LARGE), none)), numbered(2, F.coalesce(small, none)))
    return docs.select("doc_id", F.inline(each)).where("hash is not null")


def upkeep(stored: DataFrame, present: DataFrame) -> DataFrame:
    """``doc_id, kind, piece, hash, state`` for each piece that is stored or present: kept, changed, new or gone."""
    both = stored.withColumnRenamed("hash", "old").join(present, ["doc_id", "kind", "piece"], "full_outer")
    state = F.when(F.col("old").isNull(), "new").when(F.col("hash").isNull(), "gone").when(F.col("old") == F.col("hash"), "kept").otherwise("changed")
    return both.select("doc_id", "kind", "piece", F.coalesce("hash", "old").alias("hash"), state.alias("state"))
