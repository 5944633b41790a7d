"""Substring dedup by sliding runs of consecutive sentences.

Every run of three consecutive sentences is hashed, as are runs of two or of one
that are long enough to hold as much text. Where three sentences are short, the run
goes on until it holds as much: forwards from each start, and backwards from each
end, so that a repeated passage is covered up to its last sentence. A run that occurs more than once stays
where it occurs first (by document id, then text hash, then place); sentences
that any later occurrence covers are removed.

Runs travel as two hashes (88 bits together, of their sentences' hashes) and a place,
never as text. Hot runs
are counted by partial aggregation, and the joins back start at exchanges that
the adaptive planner may split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrays import let
from folioforge.session import materialise

#: (sentences, least characters) of the runs that are compared. The first kind grows beyond its sentences until it has its characters.
RUNS = ((3, 90), (2, 150), (1, 250))
#: Sentences that a growing run looks at first.
FEW_MORE = 4
#: A sentence starts after a mark and white space, or after a line's end.
BORDER = r"(?<=[.!?]\s)(?=\S)|(?<=\n)(?=\S)"
SPACE = " \t\n\r\x0b\x0c"
ADDED = ("n_sentences", "n_removed_sentences", "n_removed_chars")


def sentences(text: Column) -> Column:
    """The pieces of a text; joined without separator they give it back. Null text: none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, BORDER, -1))


def run_hashes(text: Column, runs: tuple[tuple[int, int], ...] = RUNS) -> Column:
    """An array of ``(key, mark)`` for every run; ``mark`` packs place, sentences and a second hash."""

    def of(trimmed: Column) -> Column:
        return let(F.transform(trimmed, lambda s: F.length(s)), lambda lengths: let(F.transform(trimmed, lambda s: F.xxhash64(s)), lambda hashes: found(lengths, hashes)))

    def found(lengths: Column, hashes: Column) -> Column:
        count = F.size(lengths)
        none = F.array().cast("array<bigint>")

        def chars(i: Column, n: int) -> Column:
            return sum((F.get(lengths, i - 1 + k) for k in range(1, n)), F.get(lengths, i - 1)) + (n - 1)

        def starts(n: int, each: Callable[[Column], Column]) -> Column:
            return F.when(count >= n, F.transform(F.sequence(F.lit(1), count - (n - 1)), each))

        # A run is its place times 256 plus its sentences, as only arrays of numbers are made distinct by hashing.
        def fixed(n: int, least: int) -> Column:
            return F.coalesce(F.array_compact(starts(n, lambda i: F.when(chars(i, n) >= least, i.cast("long") * 256 + n))), none)

        def grown(n: int, least: int) -> Column:
            """From each start, and up to each end, where ``n`` sentences are short: as many more as it takes, if there are."""

            def taken(some: Column) -> Column:
                # Sentences and characters so far, until there are enough; then the number, negative, stays.
                start = F.lit(0).cast("long")
                enough = lambda a: ((a % 256) >= n) & (F.shiftright(a, 8) + (a % 256) - 1 >= least)
                step = lambda a, x: F.when(a < 0, a).otherwise(let(a + x.cast("long") * 256 + 1, lambda b: F.when(enough(b), -(b % 256)).otherwise(b)))
                return F.aggregate(some, start, step, lambda a: F.when(a < 0, -a))

            # A few more sentences nearly always do; so many as ``least`` more always, as each has a character.
            def first_enough(start: Callable[[int], Column], some: Column) -> Column:
                steps = F
                for k in range(n + 1, n + 1 + FEW_MORE):
                    steps = steps.when(chars(start(k), k) >= least, F.lit(k).cast("long"))
                return steps.otherwise(taken(some))

            def forwards(i: Column) -> Column:
                return i.cast("long") * 256 + first_enough(lambda k: i, F.slice(lengths, i, F.lit(n + least)))

            def backwards(i: Column) -> Column:
                last = i + (n - 1)
                first = F.greatest(F.lit(1), last - (n + least - 1))
                number = first_enough(lambda k: last - (k - 1), F.reverse(F.slice(lengths, first, last - first + 1)))
                return let(number, lambda k: (last - k + 1).cast("long") * 256 + k)

            every = starts(n, lambda i: F.when(chars(i, n) >= least, F.array(i.cast("long") * 256 + n)).otherwise(F.array(forwards(i), backwards(i))))
            return F.coalesce(F.array_compact(F.flatten(every)), none)

        def packed(run: Column) -> Column:
            first, n = F.shiftright(run, 8), run % 256

            def marked(own: Column) -> Column:
                second = F.pmod(F.hash(own), F.lit(1 << 24)).cast("long")
                return F.struct(F.xxhash64(own).alias("key"), (first * (1 << 32) + second * 256 + n).alias("mark"))

            return let(F.slice(hashes, first.cast("int"), n.cast("int")), marked)

        return F.transform(F.array_distinct(F.concat(grown(*runs[0]), *[fixed(n, least) for n, least in runs[1:]])), packed)

    return let(F.transform(sentences(text), lambda s: F.trim(s, F.lit(SPACE))), of)


def covered(docs: DataFrame, runs: tuple[tuple[int, int], ...] = RUNS) -> DataFrame:
    """``doc_id, tag, spans``: the repeated spans ``(first, n)`` in sentences that each row of ``docs(doc_id, tag, text)`` loses."""
    each = materialise(docs.select("doc_id", "tag", F.inline(run_hashes(F.col("text"), runs))), "span-runs")
    many = materialise(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "span-keys")
    hits = each.join(many.hint("merge"), "key", "left_semi").withColumn("check", F.col("mark") % (1 << 32)).withColumn("first", F.floor(F.col("mark") / (1 << 32)).cast("int"))
    hits = materialise(hits.drop("mark"), "span-hits")
    place = F.struct("doc_id", "tag", "first")
    keep = materialise(hits.groupBy("key", "check").agg(F.min(place).alias("keep")), "span-first")
    both = hits.alias("x").join(keep.hint("merge").alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.check") == F.col("y.check")))
    later = both.where(~F.struct("x.doc_id", "x.tag", "x.first").eqNullSafe(F.col("y.keep")))
    later = later.select("x.doc_id", "x.tag", F.struct(F.col("x.first"), (F.col("x.check") % 256).cast("int").alias("n")).alias("span"))
    return later.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def dedup_spans(docs: DataFrame, runs: tuple[tuple[int, int], ...] = RUNS) -> DataFrame:
    """``docs`` with its text cleaned, plus ``n_sentences, n_removed_sentences, n_removed_chars``.

    ``docs`` needs ``doc_id`` and ``text``; other columns pass through, but for any
    that has one of the three names. A null text stays null and an empty one empty.
    A null ``doc_id`` sorts first. Rows that agree in ``doc_id`` and text are one
    document and do not repeat each other. A document whose every sentence occurred
    before ends with an empty text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row).withColumn("tag", F.xxhash64("row.text"))
    gone = covered(keyed.select("row.doc_id", "tag", "row.text"), runs)
    gone = materialise(gone.select(F.col("doc_id").alias("id"), F.col("tag").alias("of"), "spans"), "span-gone")
    joined = keyed.join(gone.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("of")), "left")

    def rest(pieces: Column) -> Column:
        def by(lost: Column) -> Column:
            left = F.array_except(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(pieces))), lost)
            kept = F.transform(left, lambda i: F.get(pieces, i - 1))
            return F.struct(F.array_join(kept, "").alias("text"), F.size(pieces).cast("long").alias("n"), F.size(lost).cast("long").alias("lost"))

        empty = F.array().cast("array<int>")
        spans = F.coalesce(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)), F.array(empty))
        return let(F.array_distinct(F.flatten(spans)), by)

    done = joined.withColumn("new", let(sentences(F.col("row.text")), rest))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.col("new.text"))
    cells = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    n_chars = F.coalesce(F.length("row.text") - F.length(text), F.lit(0)).cast("long")
    return done.select(*cells, F.col("new.n").alias("n_sentences"), F.col("new.lost").alias("n_removed_sentences"), n_chars.alias("n_removed_chars"))
