"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from labelled documents: words and word beginnings that stand
out in toxic ones. Every text then becomes a short vector of densities: lexicon
words, beginnings, both behind an obfuscated spelling, their closeness to the
second person, capitals, punctuation, obfuscation. Spark ML's boosted trees score
it, and an isotonic fit on labelled documents that the trees have not seen turns
scores into probabilities.

Fitting uses at most about ``MOST_LABELLED`` labelled rows, chosen by hash (a
documented bound); every document is scored, over its whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import materialise

MOST_LABELLED, LEXICON, BEGINNINGS = 20_000, 400, (4, 5, 6, 7)
#: A term joins the lexicon from so many toxic documents on, and if so many times as frequent in them.
LEAST_TOXIC, LEAST_RATIO, LEAST_SHARE = 5, 6.0, 0.004
#: Second-person pronouns of the corpus languages, and look-alikes of letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch ihr sie tu te toi ton ta tes vous votre vos usted ustedes ti tú tus vosotros".split())
LOOKALIKE = str.maketrans("013457@$!|8", "oieastasilb")
PUNCTUATION = "!?.,;:\"'()[]{}<>*_-~#…«»¿¡“”„‘’"
NEAR, HELD, ROWS_AT_ONCE = 6, 200_000, 1000
FEATURES = (
    "word_density", "word_count", "begin_density", "begin_count", "disguised_density", "disguised_count", "any_hit",
    "person_density", "near_person", "capital_words", "capital_letters", "exclamations", "questions", "repeated_marks", "obfuscated", "log_words", "mean_length",
)
WORD, BEGIN, DISGUISED, PERSON, CAPITAL, REPEATED, ODD = (1 << i for i in range(7))


def bare(token: str) -> str:
    return token.strip(PUNCTUATION).lower()


def undisguised(word: str) -> str:
    """Look-alikes read as letters, separators between letters dropped, long repeats cut to two."""
    read = "".join(c for c in word.translate(LOOKALIKE) if c.isalpha())
    out = [c for i, c in enumerate(read) if i < 2 or not c == read[i - 1] == read[i - 2]]
    return "".join(out)


class Reader(dict):
    """What each token means, as bits, with its capitals (28 bits) and length (27) above them; worked out once per token."""

    def __init__(self, words: frozenset[str], begins: frozenset[str]) -> None:
        super().__init__()
        self.words, self.begins = words, begins

    def _hit(self, word: str) -> int:
        return (WORD if word in self.words else 0) | (BEGIN if any(word[:n] in self.begins for n in BEGINNINGS if len(word) >= n) else 0)

    def __missing__(self, token: str) -> int:
        if len(self) > HELD:
            self.clear()
        word = bare(token)
        bits = self._hit(word)
        if not word.isalpha() or len(word) > 3:
            other = undisguised(word)
            if other != word and len(other) > 2 and not bits:
                bits |= DISGUISED if self._hit(other) else 0
        if not word.isalpha() and any(c.isalpha() for c in word) and any(c in "013457@$!|*" for c in word[1:]):
            bits |= ODD
        bits |= PERSON if word in SECOND_PERSON else 0
        capitals = sum(c.isupper() for c in token)
        bits |= CAPITAL if capitals > 1 and capitals >= 0.8 * len(word) else 0
        bits |= REPEATED if "!!" in token or "??" in token or "!?" in token else 0
        value = self[token] = bits | capitals << 8 | len(token) << 36
        return value

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        n = max(1, len(tokens))
        packed = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        bits, letters = packed & 255, max(1, int((packed >> 36).sum()))
        word, begin, disguised, person, capital, repeated, odd = (int(((bits & b) > 0).sum()) for b in (WORD, BEGIN, DISGUISED, PERSON, CAPITAL, REPEATED, ODD))
        hits, persons = np.flatnonzero(bits & (WORD | BEGIN | DISGUISED)), np.flatnonzero(bits & PERSON)
        near = 0
        if len(hits) and len(persons):
            at = np.searchsorted(persons, hits)
            after, before = persons[np.minimum(at, len(persons) - 1)], persons[np.maximum(at - 1, 0)]
            near = int((np.minimum(np.abs(after - hits), np.abs(hits - before)) <= NEAR).sum())
        return [
            100 * word / n, math.log1p(word), 100 * begin / n, math.log1p(begin), 100 * disguised / n, math.log1p(disguised), float(len(hits) > 0),
            100 * person / n, 100 * near / n, 100 * capital / n, 100 * int((packed >> 8 & (1 << 28) - 1).sum()) / letters, 1000 * text.count("!") / letters, 1000 * text.count("?") / letters, 100 * repeated / n, 100 * odd / n, math.log1p(len(tokens)), letters / n,
        ]


def _terms(labelled: DataFrame) -> DataFrame:
    """``term, toxic, clean``: in how many documents of each kind a word (``=word``) or beginning occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                words = {bare(t) for t in set((text or "").split())}
                counts[int(label)].update({"=" + w for w in words if len(w) > 2} | {w[:n] for w in words for n in BEGINNINGS if len(w) >= n})
            keys = list(counts[0].keys() | counts[1].keys())
            yield pd.DataFrame({"term": keys, "toxic": [counts[1][k] for k in keys], "clean": [counts[0][k] for k in keys]})

    return labelled.select("text", "toxic").mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(labelled: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """At most LEXICON words and as many beginnings, from ``labelled(text, toxic)``."""
    size = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = int(size["toxic"]), int(size["n"] - size["toxic"])
    if not toxic or not clean:
        return frozenset(), frozenset()
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    terms = _terms(labelled).where(F.col("toxic") >= max(LEAST_TOXIC, LEAST_SHARE * toxic)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    weight = F.log("ratio") * F.sqrt("toxic")
    out = []
    for of in (F.col("term").startswith("="), ~F.col("term").startswith("=")):
        rows = terms.where(of).orderBy(weight.desc(), "term").limit(LEXICON).collect()
        out.append(frozenset(r["term"].removeprefix("=") for r in rows))
    return out[0], out[1]


def featured(docs: DataFrame, lexicon: tuple[frozenset[str], frozenset[str]], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``features``, an array in the order of FEATURES."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*sent.value)
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                found = pa.array([reader.features(t or "") for t in part.column("text").to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], found], [*keep, "features"])

    names = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*names).mapInArrow(run, f"{fields}, features array<double>")


class Model:
    """A fitted scorer. Without both labels among the rows to learn from, every score is the share of toxic ones."""

    def __init__(self, lexicon: tuple, trees: GBTClassificationModel | None, curve: IsotonicRegressionModel | None, share: float) -> None:
        self.lexicon, self.trees, self.curve, self.share = lexicon, trees, curve, share

    def score(self, docs: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
        """The columns ``keep`` and the score, as ``name``."""
        # Own names for the columns kept, as those of the steps between must not meet them.
        own = {c: f"kept{i}" for i, c in enumerate(keep)}
        text = [] if "text" in own else [F.col("text")]
        renamed = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else k) for c, k in own.items()], *text)
        ready = featured(renamed, self.lexicon, ["text" if c == "text" else k for c, k in own.items()])
        back = [F.col("text" if c == "text" else k).alias(c) for c, k in own.items()]
        if self.trees is None:
            return ready.select(*back, F.lit(self.share).alias(name))
        scored = _raw(self.trees, ready)
        scored = self.curve.transform(scored) if self.curve else scored.withColumn("prediction", F.col("raw"))
        value = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
        return scored.select(*back, value.alias(name))


def _raw(trees: GBTClassificationModel, ready: DataFrame) -> DataFrame:
    scored = trees.transform(ready.withColumn("vector", array_to_vector("features")))
    return scored.withColumn("raw", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Learns from rows of ``labels(doc_id, toxic)`` that are not held out; about ``most`` of them at most."""
    usable = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = usable.count()
    share = min(1.0, most / total) if total else 1.0
    lot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1_000_000))
    chosen = usable.where(lot < int(share * 1_000_000))
    # Bounded by ``most``, so it may be broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    chosen = materialise(chosen, "toxic-chosen")
    tenth = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(10))
    learn, calibrate = chosen.where(tenth < 7), chosen.where(tenth >= 7)
    lexicon = learn_lexicon(learn)
    counts = [d.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first() for d in (learn, calibrate)]
    if not 0 < counts[0][1] < counts[0][0]:
        n, toxic = (counts[0][i] + counts[1][i] for i in (0, 1))
        return Model(lexicon, None, None, float(toxic / n) if n else 0.0)
    ready = materialise(featured(learn, lexicon, ["toxic"]).coalesce(4), "toxic-learn").withColumn("vector", array_to_vector("features"))
    trees = GBTClassifier(labelCol="toxic", featuresCol="vector", maxDepth=3, maxIter=20, stepSize=0.2, seed=11).fit(ready)
    curve = None
    if 0 < counts[1][1] < counts[1][0]:
        seen = _raw(trees, featured(calibrate, lexicon, ["toxic"])).withColumn("toxic", F.col("toxic").cast("double"))
        curve = IsotonicRegression(labelCol="toxic", featuresCol="raw").fit(seen)
    return Model(lexicon, trees, curve, 0.0)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    A null or empty text has the score of a text without words. A row with a null
    ``doc_id`` is scored and not held out. Repeated rows get equal scores; of several
    labels of a document the higher counts. Other columns are ignored. Without usable labels the score
    is 0.
    """
    scored = fit(docs, labels).score(docs, ["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
