"""A stored index of words: postings in buckets of terms, kept up by delta segments.

A segment is what one change of the documents adds: ``postings(doc_id, col, term, n,
places)`` in folders by bucket of the term, so that a search reads the buckets of its
words alone; ``sizes(doc_id, dl)``; ``dead(doc_id)``, the documents of earlier segments
that it replaces or removes; and ``words(term, docs)``, by how much it changes each
word's count of documents. Nothing that is stored is ever changed: an update writes one
more segment, a merge writes one segment for all, and an index is the list of its
segments, so readers of the old one are not disturbed and a lost writer leaves no trace.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import stems
from folioforge.functions import text as X
from folioforge.functions.words import counted
from folioforge.session import materialise, shared_dir

#: Folders of postings by term, and the files of a folder, for words that are in most documents.
BUCKETS, FILES = 64, 4
#: Rows of packed postings that are taken apart together.
PACKED = 1_000
GRAM = 4
#: Ids of dead documents are sent to all tasks up to so many.
FEW = 400_000
SCHEMAS = {
    "postings": "doc_id {kind}, col string, term string, n long, places array<int>, bucket int",
    "sizes": "doc_id {kind}, dl long",
    "dead": "doc_id {kind}",
    "words": "term string, docs long, stem string",
    "grams": "word string, at int, gram string",
}


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def _packed(columns: DataFrame, buckets: int) -> DataFrame:
    """Postings of ``columns(doc_id, col, text)`` as few rows, one for each bucket, file, column and step of a task.

    Words are joined by spaces; each is ``held`` by so many of ``docs``, which give their
    ``sizes`` places each. A document has a word ``fresh`` once in a ``run``, the step
    that looks at its columns together. No row per word leaves a task.
    """

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 32
        for batch in batches:
            file = batch.column("file").to_numpy()
            col, doc = batch.column("col").dictionary_encode(), batch.column("doc_id").dictionary_encode()
            col_of, doc_of = [pc.fill_null(x.indices, -1).to_numpy().astype(np.int64) + 1 for x in (col, doc)]
            for c in counted(batch.column("words")):
                run += 1
                size = len(c.words)
                number = np.array([zlib.crc32(w.encode()) % buckets for w in c.words.to_pylist()], np.int64)[c.code]
                fresh = np.zeros(len(c.code), bool)
                fresh[np.unique(doc_of[c.row] * size + c.code, return_index=True)[1]] = True
                key = (((file[c.row] * (len(col.dictionary) + 1) + col_of[c.row]) * buckets) + number) * size + c.code
                order = np.argsort(key, kind="stable")
                key = key[order]
                cut = lambda k: np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                word, row = cut(key), cut(key // size)
                upto = np.append(row, len(key)).astype(np.int32)
                at_word = np.append(np.searchsorted(word, row), len(word)).astype(np.int32)
                lists = lambda begin, values: pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), values)
                n = np.diff(c.begin)[order]
                ends = np.concatenate([[0], np.cumsum(n)])
                place = np.repeat(c.begin[:-1][order] - ends[:-1], n) + np.arange(ends[-1])
                first = order[row]
                out = {
                    "bucket": pa.array(number[first].astype(np.int32)), "file": pa.array(file[c.row[first]]), "run": pa.array(np.full(len(row), run)), "col": batch.column("col").take(pa.array(c.row[first])),
                    "terms": pc.binary_join(lists(at_word, c.words.take(pa.array(c.code[order[word]]))), " "), "held": lists(at_word, pa.array(np.diff(np.append(word, len(key))).astype(np.int32))),
                    "docs": lists(upto, batch.column("doc_id").take(pa.array(c.row[order]))), "sizes": lists(upto, pa.array(n.astype(np.int32))), "fresh": lists(upto, pa.array(fresh[order])), "places": lists(ends[upto], pa.array(c.places[place])),
                }
                yield pa.RecordBatch.from_pydict(out)

    kind = columns.schema["doc_id"].dataType.simpleString()
    each = columns.select("doc_id", "col", F.pmod(F.xxhash64("doc_id"), F.lit(FILES)).alias("file"), X.tokens(F.col("text")).alias("words"))
    return each.mapInArrow(group, f"bucket int, file long, run long, col string, terms string, held array<int>, docs array<{kind}>, sizes array<int>, fresh array<boolean>, places array<int>")


def _unpacked(packed: DataFrame) -> DataFrame:
    """``doc_id, col, term, n, places, run, fresh, bucket``: a row for each word of a column."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PACKED):
                part = batch.slice(a, PACKED)
                flat = {name: part.column(name).flatten() for name in ("held", "docs", "sizes", "fresh", "places")}
                row = pa.array(np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("docs")).to_numpy()))
                word = pa.array(np.repeat(np.arange(len(flat["held"])), flat["held"].to_numpy()))
                n = flat["sizes"].to_numpy().astype(np.int64)
                places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat["places"])
                col, run, bucket = [part.column(name).take(row) for name in ("col", "run", "bucket")]
                term = pc.split_pattern(part.column("terms"), " ").flatten().take(word)
                yield pa.RecordBatch.from_arrays([flat["docs"], col, term, pa.array(n), places, run, flat["fresh"], bucket], ["doc_id", "col", "term", "n", "places", "run", "fresh", "bucket"])

    kind = packed.schema["docs"].dataType.elementType.simpleString()
    return packed.mapInArrow(each, f"doc_id {kind}, col string, term string, n long, places array<int>, run long, fresh boolean, bucket int")


def postings_of(columns: DataFrame) -> DataFrame:
    """``doc_id, col, term, n, places`` of ``columns(doc_id, col, text)``; places count from 0.

    A column that comes in several rows has postings of each; see :func:`_put_together`.
    """
    return _unpacked(_packed(columns, 1)).drop("run", "fresh", "bucket")


def _put_together(rows: DataFrame) -> DataFrame | None:
    """Postings with one row for each document, column and word; none if ``rows`` are so already.

    The first place of a column is on one row, unless the column came in several rows.
    """
    first = rows.where("places[0] = 0").groupBy("doc_id", "col").agg(F.count("*").alias("n"))
    if first.where("n > 1").isEmpty():
        return None
    return rows.groupBy("doc_id", "col", "term").agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))


@dataclass(frozen=True)
class Index:
    """The segments of an index, the oldest first."""

    root: str
    segments: tuple[str, ...]
    buckets: int
    #: The type of document ids.
    kind: str
    spark: SparkSession

    def stored(self, segment: str, what: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[what].format(kind=self.kind)).parquet(f"{segment}/{what}")

    def _read(self, what: str) -> DataFrame:
        parts = [self.stored(s, what).withColumn("age", F.lit(i)) for i, s in enumerate(self.segments)]
        return reduce(DataFrame.unionByName, parts)

    def _live(self, df: DataFrame) -> DataFrame:
        """Rows of documents that no later segment has replaced."""
        if len(self.segments) == 1:
            return df.drop("age")
        # Few documents are dead: their ids go to the rows, not the rows to them.
        gone = materialise(self._read("dead").groupBy("doc_id").agg(F.max("age").alias("until")), "index-gone")
        gone = F.broadcast(gone) if gone.count() <= FEW else gone
        held = df.join(gone.withColumnRenamed("doc_id", "gone"), F.col("doc_id") == F.col("gone"), "left")
        return held.where("until is null or age >= until").drop("gone", "until", "age")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """``doc_id, col, term, n, places``; with ``terms(term)`` those of these words, read from their buckets."""
        rows = self._read("postings")
        if terms is None:
            return self._live(rows).drop("bucket")
        wanted = terms.select("term").distinct()
        # At most as many rows as there are buckets.
        numbers = [r[0] for r in wanted.select(bucket(F.col("term"), self.buckets).alias("b")).distinct().collect()]
        if len(numbers) < self.buckets:
            rows = rows.where(F.col("bucket").isin(numbers))
        return self._live(rows.join(wanted, "term", "left_semi")).drop("bucket")

    def coded(self, codes: DataFrame, but: DataFrame | None = None) -> DataFrame:
        """``doc_id, col, n, places`` and the columns of ``codes(term, ...)``: the postings of its words, from their buckets; those of ``but(term)`` are dropped first."""
        # At most as many rows as there are buckets.
        numbers = [r[0] for r in codes.select(bucket(F.col("term"), self.buckets).alias("b")).distinct().collect()]
        rows = self._read("postings")
        if len(numbers) < self.buckets:
            rows = rows.where(F.col("bucket").isin(numbers))
        if but is not None:
            rows = rows.join(but.select("term"), "term", "left_anti")
        return self._live(rows.join(codes, "term")).drop("bucket", "term")

    def of_documents(self, docs: DataFrame) -> DataFrame:
        """All postings of ``docs(doc_id)``."""
        return self._live(self._read("postings").join(docs, "doc_id", "left_semi")).drop("bucket")

    def lengths(self) -> DataFrame:
        """``doc_id, dl``: how many words each document has."""
        return self._live(self._read("sizes"))

    def sizes(self) -> DataFrame:
        """``doc_id, dl``, and the corpus figures ``n_docs, avg_dl`` in each row."""
        per = self.lengths()
        total = per.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
        return per.join(F.broadcast(total))  # one row

    def words(self) -> DataFrame:
        """``term, docs, stem``: every word of the index, in how many documents it is, and its stem (words of letters only)."""
        counted = self._read("words").groupBy("term").agg(F.sum("docs").alias("docs"), F.first("stem").alias("stem"))
        return counted.where("docs > 0")

    def grams(self) -> DataFrame:
        """``gram, at, word``: what stands inside the words, from their second letter on."""
        if len(self.segments) == 1:
            return self.stored(self.segments[0], "grams")
        return self._read("grams").select("gram", "at", "word").distinct().join(self.words().select(F.col("term").alias("word")), "word", "left_semi")


def grams_of(words: DataFrame) -> DataFrame:
    """The pieces of four letters of ``words(term)`` that are letters only, with their places from 1 on."""
    inner = words.where(F.col("term").rlike(r"^\p{L}+$") & (F.length("term") > GRAM)).select(F.col("term").alias("word"))
    return inner.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - GRAM)).alias("at")).withColumn("gram", F.expr(f"substring(word, at + 1, {GRAM})"))


def _docs_of_words(dealt: DataFrame) -> DataFrame:
    """``term, docs``: fresh words, but of the few documents whose columns lay in several steps each word once."""
    several = dealt.where("places[0] = 0").groupBy("doc_id").agg(F.count_distinct("run").alias("n")).where("n > 1")
    several = materialise(several.select(F.col("doc_id").alias("cut")), "index-cut")
    met = F.col("doc_id").eqNullSafe(F.col("cut"))
    alone = dealt.where("fresh").select("doc_id", "term").join(several, met, "left_anti")
    again = dealt.select("doc_id", "term").join(several, met, "left_semi").distinct()
    return alone.unionByName(again).groupBy("term").agg(F.count("*").alias("docs"))


def _deal(index: Index, rows: DataFrame) -> DataFrame:
    """Postings, dealt to the files of their bucket."""
    rows = rows.withColumn("bucket", bucket(F.col("term"), index.buckets))
    return rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(FILES)))


def _store(rows: DataFrame, at: str) -> None:
    """Writes a segment's postings, dealt by bucket."""
    rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/postings")


def _write(index: Index, columns: DataFrame, dead: DataFrame, lost: DataFrame | None) -> str:
    """Writes a segment; ``lost(term, docs)`` are the counts that its dead documents take with them."""
    at = f"{index.root}/segment-{uuid.uuid4().hex}"
    _store(_unpacked(_packed(columns, index.buckets).repartition("bucket", "file")), at)
    # What only this function reads: which step a document's columns were in, and its words counted there.
    dealt = index.spark.read.schema(SCHEMAS["postings"].format(kind=index.kind) + ", run long, fresh boolean").parquet(f"{at}/postings")
    whole = _put_together(dealt.drop("bucket"))
    words = _docs_of_words(dealt)
    if whole is not None:
        at = f"{index.root}/segment-{uuid.uuid4().hex}"
        _store(_deal(index, whole), at)
    stored = index.stored(at, "postings")
    stored.groupBy("doc_id").agg(F.sum("n").alias("dl")).write.parquet(f"{at}/sizes")
    dead.select("doc_id").write.parquet(f"{at}/dead")
    if lost is not None:
        words = words.unionByName(lost.select("term", (-F.col("docs")).alias("docs"))).groupBy("term").agg(F.sum("docs").alias("docs"))
    letters = F.when(F.col("term").rlike(r"^\p{L}+$"), F.col("term"))
    stems.with_stem(words.withColumn("letters", letters), "letters").drop("letters").write.parquet(f"{at}/words")
    grams_of(index.stored(at, "words").where("docs > 0")).write.parquet(f"{at}/grams")
    return at


def create(columns: DataFrame, buckets: int = BUCKETS) -> Index:
    """An index of ``columns(doc_id, col, text)``, in the shared folder. Null and empty texts have no words."""
    spark = columns.sparkSession
    index = Index(f"{shared_dir(spark)}/folioforge/index-{uuid.uuid4().hex}", (), buckets, columns.schema["doc_id"].dataType.simpleString(), spark)
    none = columns.select("doc_id").limit(0)
    return replace(index, segments=(_write(index, columns, none, None),))


def update(index: Index, changed: DataFrame, removed: DataFrame) -> Index:
    """The index after ``changed(doc_id, col, text)``, all columns of documents that are new or different, and ``removed(doc_id)``."""
    # Stored, as few documents are dead: their ids go to the postings, not the postings to them.
    dead = materialise(changed.select("doc_id").unionByName(removed.select("doc_id")).distinct(), "index-dead")
    lost = index.postings().select("term", "doc_id").join(dead, "doc_id", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("docs"))
    return replace(index, segments=(*index.segments, _write(index, changed, dead, lost)))


def merge(index: Index) -> Index:
    """The same index in one segment, without what is dead."""
    at = f"{index.root}/segment-{uuid.uuid4().hex}"
    _store(_deal(index, index.postings()), at)
    index.sizes().select("doc_id", "dl").write.parquet(f"{at}/sizes")
    index.words().write.parquet(f"{at}/words")
    grams_of(index.stored(at, "words")).write.parquet(f"{at}/grams")
    index._read("dead").select("doc_id").limit(0).write.parquet(f"{at}/dead")
    return replace(index, segments=(at,))


def exists(spark: SparkSession, paths: Iterable[str]) -> bool:
    """Whether stored folders are still there."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(conf).exists(at):
            return False
    return True
