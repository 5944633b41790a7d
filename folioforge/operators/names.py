"""Names of a dictionary in whole texts, and what a document's sender follows from them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as X

#: Characters of a dictionary that each task may hold as an automaton; a larger one is joined.
MOST_HELD = 1 << 25


def _held(texts: DataFrame, keys: list[str]) -> DataFrame:
    """One automaton of all names, built once a task, reads each text once."""
    sent = texts.sparkSession.sparkContext.broadcast(keys)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for key in sent.value:
            automaton.add_word(f" {key} ", key)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                first: dict[str, int] = {}
                for end, key in automaton.iter(text):
                    first.setdefault(key, end - len(key))
                out += [(doc_id, key, at) for key, at in first.items()]
            yield pd.DataFrame(out, columns=["doc_id", "key", "first_at"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInPandas(find, f"doc_id {kind}, key string, first_at int")


def _joined(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Runs of as many words as some name has meet the names by their hashes; the run's own text decides."""
    # As many numbers as names have different lengths.
    lengths = [r["n"] for r in keys.select(F.size(F.split("key", " ")).alias("n")).distinct().collect()]
    words = F.split(F.trim("text"), " ")
    t = texts.select("doc_id", words.alias("words"), F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).where("size(words) >= n")
    runs = t.select("doc_id", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.struct(F.array_join(F.slice("words", i, F.col("n")), " ").alias("key"), F.length(F.array_join(F.slice("words", 1, i - 1), " ")).alias("before")))).alias("i", "run"))
    starts = runs.select("doc_id", "run.key", F.xxhash64("run.key").alias("hash"), F.when(F.col("i") == 0, 1).otherwise(F.col("run.before") + 2).alias("first_at"))
    starts = starts.groupBy("doc_id", "key", "hash").agg(F.min("first_at").cast("int").alias("first_at"))
    return starts.join(keys.withColumn("hash", F.xxhash64("key")).hint("merge"), ["hash", "key"]).select("doc_id", "key", "first_at")


def names_found(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``doc_id, name_id, key, first_at``: names of ``names(name_id, name)`` in ``docs(doc_id, text)``, on word boundaries.

    Both are compared by their folded words; ``first_at`` is the first place among these, in
    characters from 1. Names that fold to the same words are all reported, names without
    words never; null texts hold none. Names may overlap. A dictionary within ``MOST_HELD``
    is held by each task, a larger one is joined; the rows are the same.
    """
    spaced = docs.where("text is not null").select("doc_id", F.concat(F.lit(" "), X.normal_name(F.col("text")), F.lit(" ")).alias("text"))
    named = names.select("name_id", X.normal_name(F.col("name")).alias("key")).where("key <> ''")
    keys = named.select("key").distinct()
    size = keys.agg(F.coalesce(F.sum(F.length("key") + 2), F.lit(0)).alias("n")).first()["n"]
    if size <= MOST_HELD:
        found = _held(spaced, [r["key"] for r in keys.collect()])
    else:
        found = _joined(spaced, keys)
    return found.join(named, "key").select("doc_id", "name_id", "key", "first_at")


def proposals(docs: DataFrame, found: DataFrame, locked: DataFrame) -> DataFrame:
    """``doc_id, sender, n_names, state`` for every document: what its names say about its sender.

    The longest name is proposed, the earlier one of equal lengths, then the one that
    sorts first. It is applied if no other name is as long, and else suggested; documents
    in ``locked(doc_id)`` keep what they have, those without a name get none.
    """
    each = found.select("doc_id", "key", "first_at").distinct().withColumn("length", F.length("key"))
    best = Window.partitionBy("doc_id").orderBy(F.col("length").desc(), "first_at", "key")
    first = each.withColumn("place", F.row_number().over(best)).where("place = 1").select("doc_id", F.col("key").alias("sender"), F.col("length").alias("longest"))
    counts = each.groupBy("doc_id", "length").agg(F.count("*").alias("n"))
    counts = counts.groupBy("doc_id").agg(F.sum("n").alias("n_names"), F.max_by("n", "length").alias("rivals"))
    per = docs.select("doc_id").join(first, "doc_id", "left").join(counts, "doc_id", "left").join(locked.select("doc_id", F.lit(True).alias("locked")).distinct(), "doc_id", "left")
    state = F.when(F.col("locked"), "locked").when(F.col("sender").isNull(), "none").when(F.col("rivals") > 1, "suggested").otherwise("applied")
    return per.select("doc_id", F.when(state != "locked", F.col("sender")).alias("sender"), F.coalesce("n_names", F.lit(0)).alias("n_names"), state.alias("state"))
