"""Mixing sources to target weights.

Every source is one long stream of words: its documents in a fixed pseudorandom
order, cut into blocks of ``block_words`` words. The mix is a set of output slots
of one block each, in output shards. Each shard first draws its source counts: a
multinomial draw given the fixed totals per source, which hold every source to its
target. The slots of a source are then numbered shard by shard from these counts.
Slot ``j`` of a source maps to block ``perm(j mod n_blocks)`` of pass
``j div n_blocks``, where ``perm`` is a keyed Feistel permutation of the block
indices; slots and blocks join by index.

Only DataFrame functions are used. Running offsets are sums over a tree of 256 x
256 buckets per source, so a source that holds a third of all rows is as evenly
spread as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.arrays import let
from folioforge.session import materialise

#: Words as the mix counts them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, SHARD_SLOTS, MAX_PASSES, FANOUT, SLOT_CHUNK = 256, 4096, 3, 256, 4096
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = MAX_PASSES) -> DataFrame:
    """One row per source of ``sized(source, size)``: ``sid, source, source_size, target``.

    Sources by code point, null last, take ``weights`` in turn. A target stops at
    ``passes`` times its source's size; what is over goes to the others by weight.
    That is a water level: in order of cap over weight, the sources that the level
    covers are a prefix.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    total = total.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    total = total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(passes)))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "sid")
    before, onward, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    total = total.withColumn("level", level)
    open_level = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    total = total.withColumn("final", F.first(open_level, ignorenulls=True).over(everything))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return total.select("sid", "source", "source_size", target.alias("target"))


def _feistel(x: Column, size: Column, key: Column, rounds: int = 4, walks: int = 64) -> Column:
    """A keyed permutation of ``[0, size)``: an unbalanced Feistel network, walked until it lands inside."""
    bits = F.greatest(F.length(F.bin(size - 1)), F.lit(2))
    low_bits = F.floor((bits + 1) / 2).cast("int")
    low, high = F.call_function("shiftleft", F.lit(1).cast("long"), low_bits), F.call_function("shiftleft", F.lit(1).cast("long"), bits - low_bits)

    def once(v: Column) -> Column:
        hi, lo = F.floor(v / low).cast("long"), v % low
        for r in range(rounds):
            if r % 2:
                lo = (lo + F.pmod(F.xxhash64(hi, key, F.lit(r)), low)) % low
            else:
                hi = (hi + F.pmod(F.xxhash64(lo, key, F.lit(r)), high)) % high
        return hi * low + lo

    def walk(state: Column, _: Column) -> Column:
        return F.when(state < size, state).otherwise(once(state))

    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), once(x), walk)


def _placed(docs: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """``docs(doc_id, source, size, tag)`` with ``sid, source_size, target, start``: where each begins in its source's stream."""
    keyed = sources.select("sid", "source_size", "target", F.col("source").alias("of"))
    placed = docs.join(F.broadcast(keyed) if few else keyed, docs["source"].eqNullSafe(keyed["of"])).drop("of")
    at = F.xxhash64("doc_id", "tag")
    placed = placed.withColumn("b1", F.pmod(at, F.lit(FANOUT))).withColumn("b2", F.pmod(F.floor(at / FANOUT), F.lit(FANOUT)))
    leaf = Window.partitionBy("sid", "b1", "b2").orderBy("doc_id", "tag")
    placed = placed.withColumn("start0", F.sum("size").over(leaf.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    lower = placed.groupBy("sid", "b1", "b2").agg(F.sum("size").alias("part"))
    upper = lower.groupBy("sid", "b1").agg(F.sum("part").alias("part"))
    upper = upper.select("sid", "b1", (F.sum("part").over(Window.partitionBy("sid").orderBy("b1").rowsBetween(Window.unboundedPreceding, 0)) - F.col("part")).alias("start1"))
    lower = lower.select("sid", "b1", "b2", (F.sum("part").over(Window.partitionBy("sid", "b1").orderBy("b2").rowsBetween(Window.unboundedPreceding, 0)) - F.col("part")).alias("start2"))
    placed = placed.join(lower.join(upper, ["sid", "b1"]), ["sid", "b1", "b2"])
    return placed.withColumn("start", F.col("start0") + F.col("start1") + F.col("start2")).drop("b1", "b2", "start0", "start1", "start2")


def shard_draws(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """``shard, sid, n_blocks, n``: the source counts that each output shard draws.

    A source's total is its target in whole blocks. Each of these falls into a shard by
    a keyed hash of its number, so a source's counts over the shards are multinomial,
    and so is a shard's draw over the sources, given the totals.
    """
    sized = sources.where("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
    drawn = F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"), F.col("n_blocks") * MAX_PASSES)
    sized = sized.withColumn("n_slots", drawn).where("n_slots > 0")
    shards = F.greatest(F.lit(1), F.ceil(F.sum("n_slots").over(Window.partitionBy(F.lit(0))) / shard_slots))
    chunks = sized.withColumn("n_shards", shards).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / SLOT_CHUNK))))
    # With a stated number, as the adaptive planner would put these few short rows into one task, which then makes all draws.
    chunks = chunks.repartition(_parts(sources), "sid", "chunk")
    each = chunks.withColumn("at", F.explode(F.sequence(F.col("chunk") * SLOT_CHUNK, F.least((F.col("chunk") + 1) * SLOT_CHUNK, F.col("n_slots")) - 1)))
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("sid"), F.col("at")), F.col("n_shards"))
    return each.groupBy(shard.alias("shard"), "sid", "n_blocks").agg(F.count("*").alias("n"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slots(draws: DataFrame, seed: int = 7) -> DataFrame:
    """Every output slot: ``shard, sid, slot, pass, block``, from the draws of the shards."""
    group = F.floor(F.col("shard") / FANOUT)
    upper = draws.groupBy("sid", group.alias("group")).agg(F.sum("n").alias("part"))
    before = Window.partitionBy("sid").orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    upper = upper.select("sid", "group", (F.sum("part").over(before) - F.col("part")).alias("base"))
    within = Window.partitionBy("sid", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    first = draws.withColumn("group", group).withColumn("own", F.sum("n").over(within) - F.col("n")).join(upper, ["sid", "group"])
    first = first.withColumn("first", F.col("base") + F.col("own")).repartition(_parts(draws), "shard", "sid")
    each = first.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    each = each.withColumn("pass", F.floor(F.col("slot") / F.col("n_blocks")))
    key = F.xxhash64(F.lit(seed), F.col("sid"), F.col("pass"))
    return each.select("shard", "sid", "slot", "pass", _feistel(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), key).alias("block"))


def plan(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with their places, their pieces with how often each is taken, and the slots of the output shards.

    Places: ``doc_id, tag, size, sid, source_size, target, start``. Pieces: the same
    with ``sid, block, from_word, n_words, times``. Slots: ``shard, sid, slot, pass, block``,
    which join the pieces by ``sid, block`` into the output shards. ``tag`` is the text's hash, which tells rows
    that share a ``doc_id`` apart.

    A null text has no words. A null ``doc_id`` or ``source`` is a value like any
    other. Repeated rows are separate stretches of the stream. Other columns are
    ignored, and an empty table gives empty results.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tag"))
    sized = materialise(sized, "mix-sized")
    sources = materialise(source_targets(sized), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES
    placed = materialise(_placed(sized, sources, few), "mix-placed")
    end = F.col("start") + F.col("size")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))))
    cut = cut.withColumn("from_word", F.greatest(F.col("start"), F.col("block") * block_words) - F.col("start"))
    cut = cut.withColumn("n_words", F.least(end, (F.col("block") + 1) * block_words) - F.col("start") - F.col("from_word"))
    draws = materialise(shard_draws(sources, block_words, shard_slots), "mix-draws")
    every = slots(draws)
    taken = every.groupBy("sid", "block").agg(F.count("*").alias("times"))
    # The planner takes the slots for as short as the few rows that they are exploded from.
    return placed, cut.join(taken.hint("merge"), ["sid", "block"]), every


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``; see :func:`plan`."""
    placed, pieces, _ = plan(docs, block_words)
    keys = ["doc_id", "tag", "size", "sid", "start", "source_size", "target"]
    rows = placed.select(*keys, F.lit(0).cast("long").alias("got"))
    rows = rows.unionByName(pieces.select(*keys, (F.col("n_words") * F.col("times")).alias("got")))
    full = rows.where("size > 0").groupBy(*keys).agg(F.sum("got").alias("taken"))
    none = rows.where("size = 0").withColumnRenamed("got", "taken")
    return full.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as rows with the columns of ``docs``: one for each pass over a document.

    Pass ``k`` of a document holds its words from the blocks taken at least ``k``
    times, joined by single spaces; if that is the whole document, its text stays
    as it is. Rows that agree in id, text and source may differ elsewhere; all their
    passes have the other columns of one of them. ``n_chars``, if there, is counted again. Documents of which nothing
    is taken are left out.
    """
    _, pieces, _ = plan(docs, block_words)
    span = F.struct("from_word", "n_words", "times")
    per_doc = pieces.groupBy("doc_id", "tag", "source", "start", "size").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    per_doc = per_doc.withColumn("copy", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("spans", lambda s: s["times"])).cast("int"))))
    per_doc = per_doc.withColumn("spans", F.filter("spans", lambda s: s["times"] >= F.col("copy")))
    per_doc = per_doc.withColumn("whole", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"]) == F.col("size"))
    per_doc = per_doc.select(F.col("doc_id").alias("id"), F.col("tag").alias("of"), F.col("source").alias("by"), "spans", "whole")
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    texts = texts.groupBy(F.col("row.doc_id").alias("key"), F.xxhash64("row.text").alias("hash"), F.col("row.source").alias("from")).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    joined = texts.join(per_doc.hint("merge"), F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of")) & F.col("from").eqNullSafe(F.col("by")))

    def some(words: Column) -> Column:
        return F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["from_word"] + 1).cast("int"), s["n_words"].cast("int")))), " ")

    words = F.split(F.regexp_replace("row.text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    joined = joined.withColumn("new", F.when(F.col("whole"), F.col("row.text")).otherwise(let(words, some)))
    changed = {"text": F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
