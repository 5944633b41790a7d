"""From raw documents to token ids: five stages, each over all that the one before kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from folioforge.llm.queries import tokenizer_path
from folioforge.session import materialise, table

#: Words in a shingle and least similarity (in a hundred) of near copies.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = "toxicity_" + "_".join(docs.columns)  # longer than any of theirs
    return model.score(docs, docs.columns, name).where(F.col(f"`{name}`") < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; so do documents of which nothing else is left."""
    rest = [c for c in docs.columns if c in line_dedup.ADDED]
    if rest:  # kept in a struct meanwhile
        held = line_dedup.dedup_lines(docs.select(*[c for c in docs.columns if c not in rest], F.struct(*rest).alias("_".join(docs.columns))))
    else:
        held = line_dedup.dedup_lines(docs)
    done = held.where("n_removed_lines = 0 or n_removed_lines < n_lines").withColumn("n_chars", F.length("text").cast("long"))
    own = {c: F.col("_".join(docs.columns))[c].alias(c) for c in rest}
    return done.select(*[own.get(c, F.col(f"`{c}`")) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (then text hash) of each group of near copies stays, once; rows with a null id stay."""
    found = ngram_join.grouped(docs, SHINGLE, PERCENT).where("doc_id is not null")
    first = F.min(F.struct("doc_id", "tag")).alias("first")
    kept = found.where("node is not null").groupBy("node").agg(first).select("first.*")
    kept = kept.unionByName(found.where("node is null").select("doc_id", "tag")).distinct()
    kept = materialise(kept.select(F.col("doc_id").alias("id"), F.col("tag").alias("of")), "kept-ids")
    keyed = docs.where("doc_id is not null").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = keyed.select("row", F.col("row.doc_id").alias("key"), F.xxhash64("row.text").alias("hash"))
    once = keyed.join(kept.hint("merge"), (F.col("key") == F.col("id")) & (F.col("hash") == F.col("of")), "left_semi")
    # Rows that agree in id and text may differ elsewhere; which of them stays depends on their values only.
    once = once.groupBy("key", "hash").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.select("row.*").unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as rows: one for each pass over a document, with the words that the pass takes."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), and the digest of the text that they decode to."""
    coded = bpe.encode_documents(docs, tokenizer_path())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Boosted trees, keyed permutations and BPE have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
