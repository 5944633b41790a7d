"""Ranked lexical search of all documents for a stated set of items, by presence masks.

One pass over the texts keeps, per document, its length and the counts of the words
that any item names: narrow postings, in the order of the input. Corpus figures come
from them. A second pass scores blocks of documents where they lie. For an item, each
of its terms sets a bit in the masks of the documents that hold it; documents of one
mask form a group, whose best possible score is the sum of its terms' best parts in the
block. Groups are scored exactly in descending order of that bound, until the bound
falls below the item's tenth best score so far in the task. Only these few rows are
shuffled, so the exchange grows with items times tasks, not with matches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioforge.session import materialise

#: What an item's rank is made of: fixed values.
SCALE, TF_SCALE, LENGTH_SCALE, LENGTH_SHARE = 1000, 10**9, 8, 90
#: Documents of a block, and the texts of items (bytes) that are searched in one go.
BLOCK, SLICE_BYTES = 10_000, 16 << 20
#: Letters, digits and everything beyond ASCII make up terms; only A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(data: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return data.translate(_TABLE).split()


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of the documents with at least one term; ``terms`` are places in the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value.get
        for batch in batches:
            kept, sizes, ids, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                words = terms(text.as_py() or b"")
                if not words:
                    continue
                found = Counter(map(place, words))
                found.pop(None, None)
                kept.append(i)
                sizes.append(len(words))
                ids.extend(found.keys())
                tfs.extend(found.values())
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((ids, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


class Best:
    """The ``k`` best (score, id) so far: highest score first, then smallest id, null last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        """A score below it can no longer enter; one equal to it can, by its id."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, docs: np.ndarray, ids: list) -> None:
        new = [(int(scores[i]), ids[docs[i]]) for i in np.flatnonzero(scores >= self.floor)]
        self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[: self.k]


class Block:
    """Postings of some documents by term, with each posting's part of a score."""

    def __init__(self, n: list[int], sizes: np.ndarray, ids: np.ndarray, tf: np.ndarray, corpus: tuple[int, int], width: int) -> None:
        docs, total = corpus
        m = np.array([100 - LENGTH_SHARE + (LENGTH_SHARE * x * docs) // total for x in n], np.int64)
        order = np.argsort(ids, kind="stable")
        self.docs = len(n)
        self.rows = np.repeat(np.arange(self.docs), sizes)[order]
        tf = tf[order]
        self.part = (TF_SCALE * tf) // (SCALE * tf + LENGTH_SCALE * m[self.rows])
        self.at = np.searchsorted(ids[order], np.arange(width + 1))
        self.most = np.zeros(width, np.int64)
        held = np.flatnonzero(np.diff(self.at))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.part, self.at[held])

    def holders(self, term: int) -> np.ndarray:
        return self.rows[self.at[term] : self.at[term + 1]]

    def masks(self, words: np.ndarray) -> np.ndarray:
        """One row of 64-bit words for each document: bit ``i`` is set where it holds term ``i``."""
        bits = np.zeros((self.docs, -(-len(words) // 64)), np.uint64)
        for i, term in enumerate(words):
            bits[self.holders(term), i >> 6] |= np.uint64(1 << (i & 63))
        return bits

    def exact(self, docs: np.ndarray, bits: np.ndarray, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of some documents with these masks."""
        score = np.zeros(len(docs), np.int64)
        for i, term in enumerate(words):
            has = np.flatnonzero(bits[:, i >> 6] & np.uint64(1 << (i & 63)))
            if len(has):
                score[has] += weights[i] * self.part[self.at[term] + np.searchsorted(self.holders(term), docs[has])]
        return score

    def search(self, words: np.ndarray, weights: np.ndarray, best: Best, doc_ids: list) -> int:
        """Brings ``best`` up to date; returns how many documents were scored."""
        bound = weights * self.most[words]
        if bound.sum() < best.floor:
            return 0
        bits = self.masks(words)
        some = np.flatnonzero(bits.any(axis=1))
        if not len(some):
            return 0
        bits = bits[some]
        keys = bits[:, 0] if bits.shape[1] == 1 else np.ascontiguousarray(bits).view(f"V{8 * bits.shape[1]}")[:, 0]
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        distinct = bits[first]
        tops = np.zeros(len(first), np.int64)
        for i, b in enumerate(bound):
            tops += np.where(distinct[:, i >> 6] & np.uint64(1 << (i & 63)), b, 0)
        # Groups by descending bound, and the documents in the order of their groups.
        rank = np.argsort(-tops, kind="stable")
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        by_group = np.argsort(place[group], kind="stable")
        ends = np.cumsum(np.bincount(place[group], minlength=len(rank)))
        tops, done, scored, step = tops[rank], 0, 0, 1
        while done < len(rank) and tops[done] >= best.floor:
            upto = min(done + step, len(rank))
            chosen = by_group[scored : ends[upto - 1]]
            best.add(self.exact(some[chosen], bits[chosen], words, weights), some[chosen], doc_ids)
            scored, done, step = int(ends[upto - 1]), upto, 2 * step
        return scored


def _rank_slice(docs: DataFrame, rows: list, kind: T.DataType, k: int) -> DataFrame:
    spark = docs.sparkSession
    named = [(r["item_id"], sorted(set(terms((r["text"] or "").encode())))) for r in rows]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in named for w in words}))}
    postings = materialise(_postings(docs, vocabulary), "ranked-postings")
    count, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most one row for each word of the slice.
    df = {r["term"]: r["df"] for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weight = {i: math.floor(SCALE * math.log((2 * count + 2) / (2 * n + 1))) for i, n in df.items()}
    items = []
    for number, (item, words) in enumerate(named):
        ids = np.array([i for i in (vocabulary[w] for w in words) if weight.get(i, 0) > 0], np.int64)
        if len(ids):
            items.append((number, item, ids, np.array([weight[i] for i in ids], np.int64)))
    sent = spark.sparkContext.broadcast(items)
    width, corpus = len(vocabulary), (count, total)
    schema = T.StructType().add("number", T.IntegerType()).add("item_id", kind).add("doc_id", docs.schema["doc_id"].dataType).add("score", T.LongType())
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in sent.value]
        for large in batches:
            for at in range(0, len(large), BLOCK):
                batch = large.slice(at, BLOCK)
                lists = batch.column("terms")
                block = Block(batch.column("n").to_pylist(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy(), corpus, width)
                doc_ids = batch.column("doc_id").to_pylist()
                for b, (_, _, words, weights) in zip(best, sent.value, strict=True):
                    block.search(words, weights, b, doc_ids)
        found = [(number, item, doc, s) for b, (number, item, _, _) in zip(best, sent.value, strict=True) for s, doc in b.rows]
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in found], schema=arrow)

    near = postings.mapInArrow(score, schema)
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of ``docs(doc_id, text)`` that score highest for each of ``items(item_id, text)``.

    Only scores above 0 count; equal ones go by ascending ``doc_id``, null last. A null
    text has no terms and neither is found nor finds. Repeated rows of ``docs`` are
    documents of their own; repeated rows of ``items`` are one item, rows of one
    ``item_id`` with different texts are different items. Other columns are ignored.
    Items beyond ``slice_bytes`` of text are searched slice by slice, each against all
    documents. Without documents or items there are no rows.
    """
    items = items.select("item_id", "text").distinct()
    kind = items.schema["item_id"].dataType
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-size // slice_bytes) or 1
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    found = [_rank_slice(docs, items.where(share == s).collect(), kind, k) for s in range(slices)]
    return reduce(DataFrame.unionByName, found)
