"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last one or two lines picks chunk boundaries,
so an inserted or deleted line moves only the boundaries next to it. A text is cut
several times, by each rule of ``CUTS``: a passage of a few lines that stands
between different lines then holds whole chunks of some cut with high probability
(see the README for the measured recall). A chunk has ``MIN_LINES`` lines at least
to count; one that would have more than ``MOST_LINES``, as in a run of one repeated
line, is cut every so many lines from its start.

A chunk that occurs more than once in the corpus stays where it occurs first (by
document id, then text hash, then place). Its lines are removed elsewhere, once its
bytes have been compared: hashes only select the chunks worth comparing, the groups
are keyed by the chunk's text. A line always stays at its first place: the chunk
that removes it stands earlier as a whole.

Only DataFrame functions are used. Line hashes are 31 bits of MD5, so that another
SQL engine can reproduce the boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrays import let
from folioforge.session import materialise

#: (lines that the rolling hash spans, power of two whose multiples are looked at, value, whether the cut is before the line): a line with
#: ``rolled div power mod 2 = value`` starts or ends a chunk. Both values of a bit are used, one to start and one to end chunks.
CUTS = ((1, 1, 0, False), (1, 1, 1, True), (1, 2, 0, False), (1, 2, 1, True), (1, 4, 0, False), (1, 4, 1, True), (2, 1, 0, False), (2, 1, 1, True))
#: Multiplier and modulus of the rolling hash; lines of a chunk.
ROLL, MODULUS, MIN_LINES, MOST_LINES = 31, 2147483647, 2, 16
ADDED = ("n_lines", "n_removed_lines", "n_removed_chunks")
BLANKS = " \t\r"


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long") % F.lit(MODULUS)


def chunk_places(text: Column, min_lines: int = MIN_LINES) -> Column:
    """The chunks of a text that count, over all cuts: an array of ``(start, n, key)``, lines from 1. Null text: none."""

    def cut(lines: Column) -> Column:
        def places(h: Column) -> Column:
            total = F.size(h)

            def one(rule: tuple[int, int, int, bool]) -> Column:
                span, power, value, before = rule

                def anchor(p: Column) -> Column:
                    rolled = F.get(h, p - 1) if span == 1 else (F.coalesce(F.get(h, p - 2), F.lit(0).cast("long")) * ROLL + F.get(h, p - 1)) % MODULUS
                    return F.floor(rolled / power) % 2 == value

                ends = F.filter(F.sequence(F.lit(1), total), lambda p: (p == total) | anchor(p + 1 if before else p))

                def pieces(e: Column) -> Column:
                    def split(end: Column, i: Column) -> Column:
                        start = F.coalesce(F.get(e, i - 1), F.lit(0))
                        some = F.sequence(F.lit(0), F.floor((end - start - 1) / MOST_LINES).cast("int"))
                        return F.transform(some, lambda k: (start + k * MOST_LINES + 1).cast("long") * 256 + F.least(F.lit(MOST_LINES), end - start - k * MOST_LINES))

                    return F.flatten(F.transform(e, split))

                return F.filter(let(ends, pieces), lambda c: c % 256 >= min_lines)

            def keyed_one(c: Column) -> Column:
                start, n = F.shiftright(c, 8).cast("int"), (c % 256).cast("int")
                return F.struct(start.alias("start"), n.alias("n"), F.xxhash64(F.slice(h, start, n)).alias("key"))

            # Start and number of lines in one number, as only arrays of such are made distinct by hashing.
            keyed = F.transform(F.array_distinct(F.flatten(F.array(*[one(rule) for rule in CUTS]))), keyed_one)
            return F.filter(keyed, lambda c: F.exists(F.slice(lines, c["start"], c["n"]), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0))

        return let(F.transform(lines, _line_hash), places)

    none = F.array().cast("array<struct<start:int,n:int,key:bigint>>")
    return F.when(F.instr(text, "\n") > 0, let(F.split(text, "\n", -1), cut)).otherwise(none)


def removals(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``doc_id, tag, spans``: the chunks ``(start, n)`` that each row of ``docs(doc_id, tag, text)`` loses."""
    each = docs.select("doc_id", "tag", F.inline(chunk_places(F.col("text"), min_lines)))
    place = F.struct("doc_id", "tag", "start")
    repeated = each.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("not (a <=> b)").select("key")
    repeated = materialise(repeated, "line-keys")
    hits = each.join(repeated.hint("merge"), "key", "left_semi").groupBy(F.col("doc_id").alias("id"), F.col("tag").alias("of"))
    hits = materialise(hits.agg(F.collect_set(F.struct("start", "n", "key")).alias("spans")), "line-hits")
    held = docs.where(F.instr("text", "\n") > 0).join(hits.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("of")))

    def bodies(lines: Column) -> Column:
        return F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), s["key"].alias("key"), F.array_join(F.slice(lines, s["start"], s["n"]), "\n").alias("body")))

    hits = materialise(held.select("doc_id", "tag", F.inline(let(F.split("text", "\n", -1), bodies))), "line-bodies")
    first = materialise(hits.groupBy("key", "body").agg(F.min(place).alias("keep")), "line-first")
    both = hits.alias("x").join(first.hint("merge").alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.body") == F.col("y.body")))
    gone = both.where(~F.struct("x.doc_id", "x.tag", "x.start").eqNullSafe(F.col("y.keep")))
    return gone.groupBy("x.doc_id", "x.tag").agg(F.collect_set(F.struct("x.start", "x.n")).alias("spans"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with its text cleaned, plus ``n_lines, n_removed_lines, n_removed_chunks``.

    ``docs`` needs ``doc_id`` and ``text``; its other columns pass through, but for any
    that has one of these three names. A null text stays null; an empty
    one has a single empty line and keeps it. A null ``doc_id`` sorts first. Rows
    that agree in ``doc_id`` and text are one document: they get the same text, and
    do not count as repeats of each other. Chunks of white space only are kept.
    Removed chunks may overlap; each removed line counts once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row).withColumn("tag", F.md5(F.coalesce("row.text", F.lit(""))))
    gone = removals(keyed.select("row.doc_id", "tag", "row.text"), min_lines)
    gone = materialise(gone.select(F.col("doc_id").alias("id"), F.col("tag").alias("of"), "spans"), "line-gone")
    joined = keyed.join(gone.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("of")), "left")

    def rest(lines: Column) -> Column:
        def left(lost: Column) -> Column:
            kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), lost), lambda i: F.element_at(lines, i))
            return F.struct(F.array_join(kept, "\n").alias("text"), F.size(lost).cast("long").alias("n"))

        return let(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))), left)

    # Only rows that lose a chunk are cut up again.
    same = F.struct(F.col("row.text").alias("text"), F.lit(0).cast("long").alias("n"))
    done = joined.withColumn("new", F.when(F.col("spans").isNotNull(), let(F.split("row.text", "\n", -1), rest)).otherwise(same))
    cells = [F.col("new.text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    n_lines = F.coalesce(F.length("row.text") - F.length(F.translate("row.text", "\n", "")) + 1, F.lit(0)).cast("long")
    return done.select(*cells, n_lines.alias("n_lines"), F.col("new.n").alias("n_removed_lines"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_removed_chunks"))
