"""The words of rows counted where the rows lie: Arrow functions over lists of words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import materialise

#: Words that are looked at together, if a single row has not more.
TOGETHER = 1_000_000


class Counted(NamedTuple):
    """The distinct words of some rows, row by row: their row, their code in ``words``, and where their ``places`` begin (one more at the end)."""

    row: np.ndarray
    code: np.ndarray
    begin: np.ndarray
    places: np.ndarray
    words: pa.Array


def counted(lists: pa.Array) -> Iterator[Counted]:
    """Lists of words in steps of a bounded number of words; places count from 0 and ascend. Null lists have no words."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        before = ends[a] - sizes[a]
        b = max(a + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
        n = sizes[a:b]
        if n.sum():
            coded = lists.slice(a, b - a).flatten().dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(a, b), n)
            place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
            key = (row - a) * len(coded.dictionary) + code
            order = np.argsort(key, kind="stable")
            key = key[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            first = order[begin]
            yield Counted(row[first], code[first], np.append(begin, len(key)), place[order].astype(np.int32), coded.dictionary)
        a = b


def word_totals(docs: DataFrame) -> DataFrame:
    """``term, docs, cnt`` of ``docs(words)``: how many rows have a word, and how often; summed in the tasks before anything is shuffled."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in counted(batch.column("words")):
                size = len(c.words)
                rows = np.bincount(c.code, minlength=size)
                times = np.bincount(c.code, weights=np.diff(c.begin), minlength=size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([c.words, pa.array(rows), pa.array(times)], ["term", "docs", "cnt"])

    each = docs.where("size(words) > 0").select("words").mapInArrow(total, "term string, docs long, cnt long")
    return each.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("cnt").alias("cnt"))


#: Words whose number of documents is sent to all tasks; the rest meet theirs in a join.
FREQUENT = 1 << 18
#: Weights are compared in tasks with so much room, and exactly by the caller.
ROOM = 1e-6


def telling_candidates(docs: DataFrame, totals: DataFrame, n: int, most: float, k: int) -> DataFrame:
    """``doc_id, term, tf, df`` of ``docs(doc_id, words)``: all words that may be among the ``k`` of a document with the highest ``sqrt(tf) * ln(n / df)``.

    Words on one document alone and on more than ``most`` do not count. ``totals(term, docs)``
    are all words. Of the most frequent ones a task knows the number of documents, so
    that only a document's best leave it; the other words of documents meet ``totals``.
    """
    named = totals.where("docs >= 2").select("term", F.col("docs").alias("df"))
    # At most FREQUENT rows.
    rows = named.orderBy(F.col("df").desc(), "term").limit(FREQUENT).collect()
    all_sent = len(rows) < FREQUENT
    sent = docs.sparkSession.sparkContext.broadcast(([r["term"] for r in rows], np.array([r["df"] for r in rows], np.int64)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df_of = pa.array(sent.value[0], pa.string()), sent.value[1]
        for batch in batches:
            for c in counted(batch.column("words")):
                at = pc.fill_null(pc.index_in(c.words, value_set=terms), -1).to_numpy().astype(np.int64)
                df = np.where(at >= 0, df_of[np.maximum(at, 0)], 0)[c.code] if len(df_of) else np.zeros(len(c.code), np.int64)
                tf = np.diff(c.begin)
                used = df <= most
                weight = np.where(df > 0, np.sqrt(tf) * np.log(n / np.maximum(df, 1)), -np.inf)
                weight[~used] = -np.inf
                # The k-th best of each row, from the rows' weights in descending order.
                order = np.lexsort((-weight, c.row))
                rows_, start = np.unique(c.row[order], return_index=True)
                size = np.diff(np.append(start, len(order)))
                least = np.where(size >= k, weight[order][start + np.minimum(size, k) - 1], -np.inf)
                floor = np.repeat(least, size)
                ahead = np.empty(len(order), bool)
                ahead[order] = weight[order] >= floor - ROOM
                keep = used & np.where(df > 0, ahead, not all_sent)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(c.row[keep])), c.words.take(pa.array(c.code[keep])), pa.array(tf[keep]), pa.array(df[keep])], ["doc_id", "term", "tf", "df"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = materialise(docs.where("size(words) > 0").mapInArrow(weigh, f"doc_id {kind}, term string, tf long, df long"), "telling-words")
    known = each.where("df > 0")
    if all_sent:
        return known
    # Words that are not so frequent as any that is sent; those sent have met.
    others = each.where("df = 0").drop("df").hint("merge").join(named.where(F.col("df") <= int(rows[-1]["df"])), "term").where(F.col("df") <= most)
    return known.unionByName(others)
