"""Exact Jaccard join of documents by n-grams: a blocked sparse matrix product.

The matrix has a row for each distinct set of shingles and a column for each
shingle; the product with its transpose holds all overlap counts. Size bounds say
which entries can reach the threshold, so that only some are worked out:

1. Rows with equal sets are one class.
2. In an order of all columns with frequent ones last, two linked rows share one of
   the first ``n - ceil(t n) + 1`` columns of each. A column that only one class has
   there leads nowhere and is dropped.
3. A column with few classes counts, for each pair of them, the first columns that
   they share: ``shared + max(rest of either row)`` bounds the overlap, and pairs that
   cannot reach the threshold go (frequent columns count as shared, being left out
   here). The pairs left meet in blocks, named after the smallest partner.
4. The classes of a column with many meet in a block as they are. A block above a
   size is cut into tiles; every pair of tiles is one small product.
5. A product goes through its rows by size, looks up candidates in the first
   columns, leaves out those outside the size bounds and those connected already,
   accumulates the overlaps of the rest over all columns and keeps exact links.

A product returns a spanning forest of its links, never all pairs, and what it
returns does not depend on tiles or order as far as components go.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.shingles import shingle_set, shingle_sets, slices
from folioforge.operators.components import connected_components
from folioforge.session import materialise

SHINGLE, PERCENT = 4, 85
#: A column is marked as frequent when tasks have seen it so many times, single sightings left out; bits of the marks.
FREQUENT, BITS, SEGMENT = 4, 28, 16
#: Classes of a column that are compared pair by pair; columns with more go to blocks.
FEW = 32
#: Shingles that a task counts at a time.
COUNTED = 2_000_000
#: Shingles in a tile: at least, at most; tiles of a block before they grow beyond the least.
TILE, TILE_MOST, TILES = 40_000, 2_000_000, 16
#: Shingles in one row that is sent, so that Arrow batches stay small.
SENT = 1024


def first_columns(n: int, percent: int) -> int:
    """``n - ceil(t n) + 1``."""
    return n - -(-percent * n // 100) + 1


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """A row per document: ``doc_id, tag, n, sig``; and rows ``column, times`` with what each task counted. ``tag`` is the text's hash, which tells rows that share a ``doc_id`` apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                found, begins = shingle_sets(texts, shingle)
                sigs = [_signature(found[a:b]) if b > a else None for a, b in itertools.pairwise(begins.tolist())]
                none = pa.nulls(len(texts), pa.int64())
                own = [batch.column(c).slice(at, len(texts)) for c in ("doc_id", "tag")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(begins)), pa.array(sigs, pa.binary()), none, none], names)
                held.append(found)
                if sum(map(len, held)) > COUNTED:
                    yield from counted(held, batch.schema.field("doc_id").type)
                    held = []
        if held:
            yield from counted(held, batch.schema.field("doc_id").type)

    def counted(held: list[np.ndarray], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        column, times = np.unique(np.concatenate(held), return_counts=True)
        column, times = column[times > 1], times[times > 1]
        none = [pa.nulls(len(column), t) for t in (id_type, pa.int64(), pa.int64(), pa.binary())]
        whole = pa.RecordBatch.from_arrays([*none, pa.array(column), pa.array(times)], names)
        for at in range(0, len(column), 100_000):
            yield whole.slice(at, 100_000)

    names = ["doc_id", "tag", "n", "sig", "column", "times"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(describe, f"doc_id {kind}, tag long, n long, sig binary, column long, times long")


def _signature(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _frequent(described: DataFrame) -> np.ndarray:
    """A bit for each column by the low bits of its hash: whether it is frequent.

    The marks have a fixed size (32 MB), however large the corpus. They only order
    the columns, the same way for every row, so a bit that two columns share, or a
    column that no task saw twice, costs time and never a link.
    """
    marks = described.where("times is not null").groupBy("column").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT)
    bit = F.pmod(F.col("column"), F.lit(1 << BITS))
    marks = marks.select(F.shiftright(bit, SEGMENT).cast("int").alias("segment"), (bit % (1 << SEGMENT)).cast("int").alias("bit")).distinct()

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << SEGMENT, np.uint8)
        bits[own["bit"].to_numpy()] = 1
        return pd.DataFrame({"segment": own["segment"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(1 << (BITS - 3), np.uint8)
    width = 1 << (SEGMENT - 3)
    for row in marks.groupBy("segment").applyInPandas(pack, "segment int, bits binary").collect():
        out[row["segment"] * width : (row["segment"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def _keys(docs: DataFrame, frequent: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """``key, node, n``: the first columns of each set."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        seen: set[bytes] = set()
        for batch in batches:
            for _, texts in slices(batch.column("text")):
                found, begins = shingle_sets(texts, shingle)
                size = np.diff(begins)
                node = np.zeros(len(size), np.int64)
                for i in np.flatnonzero(size):
                    sig = _signature(found[begins[i] : begins[i + 1]])
                    node[i] = int.from_bytes(sig[:8], "big", signed=True)
                    if sig in seen:
                        size[i] = 0
                    seen.add(sig)
                if len(seen) > 500_000:
                    seen.clear()
                owner = np.repeat(np.arange(len(size)), np.diff(begins))
                low = found & ((1 << BITS) - 1)
                often = marks[low >> 3] >> (low & 7).astype(np.uint8) & 1
                ordered = found[np.argsort(2 * owner + often, kind="stable")]
                most = size - -(-percent * size // 100) + 1
                first = (np.arange(len(found)) - begins[owner] < most[owner]) & (size[owner] > 0)
                rows = owner[first]
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(ordered[first]), pa.array(node[rows]), pa.array(size[rows])], ["key", "node", "n"])

    return docs.select("text").mapInArrow(keys, "key long, node long, n long")


class Forest:
    """Union-find with path halving."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.up
        at = up[at]
        while (up[at] != at).any():
            at = up[at]
        return at

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.roots(np.array([a]))[0]), int(self.roots(np.array([b]))[0])
        self.up[max(a, b)] = min(a, b)
        return a != b


def product_links(sets: list[np.ndarray], tile: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``sets``; with two tiles, of those across."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, tile = [sets[i] for i in order], tile[order]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    by_rarity = np.lexsort((column, times[column], owner))
    column, often = column[by_rarity], times[column[by_rarity]]
    starts = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(len(column)) - starts[owner]
    first = place < np.array([first_columns(n, percent) for n in size.tolist()])[owner]
    shared = often > 1

    def postings(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = owner[mask], column[mask]
        at = np.lexsort((rows, cols))
        return rows[at], np.concatenate([[0], np.cumsum(np.bincount(cols, minlength=len(times)))])

    lead_rows, lead_at = postings(first & shared)
    all_rows, all_at = postings(shared)
    forest, links, across = Forest(len(sets)), [], len(np.unique(tile)) > 1
    for i in range(1, len(sets)):
        own = column[starts[i] : starts[i + 1]][(first & shared)[starts[i] : starts[i + 1]]]
        if not len(own):
            continue
        near = np.unique(np.concatenate([lead_rows[lead_at[c] : lead_at[c + 1]] for c in own]))
        near = near[(near < i) & (100 * size[np.minimum(near, i)] >= percent * size[i])]
        if across:
            near = near[tile[near] != tile[i]]
        if len(near):
            near = near[forest.roots(near) != forest.roots(np.array([i]))[0]]
        if not len(near):
            continue
        every = column[starts[i] : starts[i + 1]][shared[starts[i] : starts[i + 1]]]
        overlap = np.bincount(np.concatenate([all_rows[all_at[c] : all_at[c + 1]] for c in every]), minlength=len(sets))[near]
        for j in near[100 * overlap >= percent * (size[i] + size[near] - overlap)]:
            if forest.join(i, int(j)):
                links.append((int(order[i]), int(order[j])))
    return links


def _products(placed: DataFrame, percent: int) -> DataFrame:
    """Edges ``src, dst`` from rows ``block, a, b, tile, node, piece, part`` that stand together by product."""

    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        # A repeated row may send its set again: each piece counts once.
        by_node: dict[int, dict[int, bytes]] = {}
        tile = {}
        for node, own, piece, part in rows:
            by_node.setdefault(node, {})[piece] = part
            tile[node] = own
        if len(by_node) < 2:
            return []
        nodes = list(by_node)
        sets = [np.frombuffer(b"".join(by_node[n].values()), np.int64) for n in nodes]
        return [(nodes[i], nodes[j]) for i, j in product_links(sets, np.array([tile[n] for n in nodes]), percent)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows = None, []
        for batch in batches:
            out = []
            for block, a, b, tile, node, piece, part in batch.itertuples(index=False, name=None):
                if (block, a, b) != at:
                    out += flush(rows)
                    at, rows = (block, a, b), []
                rows.append((node, tile, piece, part))
            yield pd.DataFrame(out, columns=["src", "dst"], dtype="int64")
        yield pd.DataFrame(flush(rows), columns=["src", "dst"], dtype="int64")

    return placed.select("block", "a", "b", "tile", "node", "piece", "part").mapInPandas(run, "src long, dst long")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``visits, node, piece, part``: the sets of the rows ``visits, node, text``, in pieces; of rows of a node that follow each other, the first's."""
    visits = texts.schema["visits"].dataType.simpleString()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = []
                for v, node, text in batch.iloc[at : at + 500].itertuples(index=False, name=None):
                    if node != last:
                        last, found = node, shingle_set(text, shingle)
                        rows += [(v, node, k // SENT, found[k : k + SENT].tobytes()) for k in range(0, len(found), SENT)]
                yield pd.DataFrame(rows, columns=["visits", "node", "piece", "part"])

    return texts.select("visits", "node", "text").mapInPandas(sets, f"visits {visits}, node long, piece int, part binary")


def _near_pairs(few: DataFrame, many: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of classes with enough of their first columns in common to reach the threshold."""
    left, right = few.select("key", F.col("node").alias("a"), F.col("n").alias("na")), few.select("key", F.col("node").alias("b"), F.col("n").alias("nb"))
    sizes = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("a") < F.col("b"))
    # A column here has at most FEW classes, so a row meets at most as many others.
    pairs = left.join(right.hint("merge"), "key").where(sizes).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    often = materialise(many.groupBy("node").agg(F.count("*").alias("often")), "ngram-often")
    pairs = pairs.join(often.select(F.col("node").alias("a"), F.col("often").alias("oa")), "a", "left").join(often.select(F.col("node").alias("b"), F.col("often").alias("ob")), "b", "left")
    rest = F.ceil(F.greatest("na", "nb") * percent / 100) - 1
    most = F.col("shared") + F.least(F.coalesce("oa", F.lit(0)), F.coalesce("ob", F.lit(0))) + rest
    return pairs.where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _visits(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``node, rep, tag, visits``: the products that each class goes to, as ``(block, a, b, tile)``."""
    sizes = materialise(shared.groupBy("key").agg(F.count("*").alias("size")), "ngram-sizes")
    sized = materialise(shared.join(sizes.hint("merge"), "key"), "ngram-sized")
    few, many = sized.where(F.col("size") <= FEW), sized.where(F.col("size") > FEW)
    pairs = materialise(_near_pairs(few, many, percent), "ngram-pairs")
    ends = pairs.select(F.col("a").alias("node"), F.col("a").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    lead = materialise(ends.groupBy("node").agg(F.min("other").alias("lead")), "ngram-leads")
    of = [lead.select(F.col("node").alias(c), F.col("lead").alias("l" + c)) for c in ("a", "b")]
    led = pairs.join(of[0].hint("merge"), "a").join(of[1].hint("merge"), "b").select(F.least("la", "lb").alias("block"), F.explode(F.array("a", "b")).alias("node"))
    member = led.unionByName(many.select(F.col("center").alias("block"), "node")).distinct()
    member = materialise(member, "ngram-members").join(classes.select("node", "rep", "tag", "n").hint("merge"), "node")
    member = materialise(member, "ngram-placed")
    blocks = materialise(member.groupBy("block").agg(F.sum("n").alias("total"), F.count("*").alias("rows")).where("rows > 1"), "ngram-blocks")
    # A block that fills more than a tile is cut by size into ranges so wide that links stay within neighbours, and each range by hash into tiles.
    wide = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    member = member.join(blocks.hint("merge"), "block").withColumn("range", F.when(F.col("total") <= TILE, 0).otherwise(F.floor(F.log("n") / wide)).cast("long"))
    ranges = member.groupBy("block", "range", "total").agg(F.sum("n").alias("held"))
    limit = F.greatest(F.lit(TILE), F.least(F.lit(TILE_MOST), F.col("total") / TILES))
    ranges = ranges.select("block", "range", F.ceil(F.col("held") / limit).cast("int").alias("tiles"))
    by_size = Window.partitionBy("block").orderBy("range")
    beside = [F.when(f("range").over(by_size) == F.col("range") + step, f("tiles").over(by_size)).otherwise(0) for f, step in ((F.lag, -1), (F.lead, 1))]
    ranges = materialise(ranges.select("block", "range", "tiles", beside[0].alias("under"), beside[1].alias("over")), "ngram-ranges")
    member = member.join(ranges.hint("merge"), ["block", "range"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("long"))

    def name(size_range: Column, tile: Column) -> Column:
        return size_range * (1 << 32) + tile

    def towards(step: int, tiles: str) -> Column:
        none = F.array().cast("array<long>")
        return F.when(F.col(tiles) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(tiles), F.lit(1)) - 1), lambda t: name(F.col("range") + step, t))).otherwise(none)

    member = member.withColumn("tile", name(F.col("range"), F.col("own")))
    visit = F.transform(F.concat(towards(-1, "under"), towards(0, "tiles"), towards(1, "over")), lambda t: F.struct(F.col("block").alias("block"), F.least(t, F.col("tile")).alias("a"), F.greatest(t, F.col("tile")).alias("b"), F.col("tile").alias("tile")))
    return member.groupBy("node", "rep", "tag").agg(F.flatten(F.collect_list(visit)).alias("visits"))


def classes_and_links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``described(doc_id, tag, n, sig)``, ``classes(sig, rep, tag, n, node)`` and a forest of links ``(src, dst)`` between the classes' nodes.

    A class has the smallest ``doc_id`` of its rows as ``rep``, and of these rows' texts one by its ``tag``.
    """
    described = materialise(_described(docs, shingle), "ngram-described")
    rows = described.where("times is null").select("doc_id", "tag", "n", "sig")
    classes = rows.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.max("n").alias("n"))
    classes = classes.select("sig", F.col("first.doc_id").cast("long").alias("rep"), "first.tag", "n", node_of("sig").alias("node"))
    classes = materialise(classes, "ngram-classes")
    keys = _keys(docs, _frequent(described), shingle, percent)
    found = keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last"))
    found = materialise(found.where("center <> last").select("key", "center"), "ngram-keys")
    # Copies of a set that were read by several tasks stand here once.
    shared = materialise(keys.join(found.hint("merge"), "key").distinct(), "ngram-shared")
    visits = materialise(_visits(shared, classes, percent), "ngram-visits")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("tag"), "text").join(visits.hint("merge"), ["rep", "tag"])
    sets = _sets(texts, shingle).select(F.explode("visits").alias("v"), "node", "piece", "part").select("v.*", "node", "piece", "part")
    placed = sets.repartition("block", "a", "b").sortWithinPartitions("block", "a", "b", "node")
    return rows, classes, materialise(_products(placed, percent), "ngram-links")


def node_of(sig: str) -> Column:
    """The first eight bytes of a signature as a signed number, as the Python side reads them."""
    high, low = [F.conv(F.hex(F.substring(sig, start, 4)), 16, 10).cast("long") for start in (1, 5)]
    return F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high) * F.lit(1 << 32) + low


def grouped(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, tag, n, sig, node, component_id`` for every row of ``docs(doc_id, text)``; see :func:`near_copies`.

    ``node`` is the same within a group and null for rows that link with nothing by
    rule. ``tag`` is ``xxhash64(text)``.
    """
    rows, classes, links = classes_and_links(docs, shingle, percent)
    found = materialise(connected_components(links), "ngram-found")
    named = found.join(classes.select("node", "rep").hint("merge"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialise(named, "ngram-named")
    found = materialise(found.join(named.hint("merge"), "component"), "ngram-linked")
    linked = classes.select("sig", "rep", "node").join(found.hint("merge"), "node", "left")
    linked = linked.select("sig", F.coalesce("component", "node").alias("node"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = materialise(linked, "ngram-components")
    kind = docs.schema["doc_id"].dataType
    joined = rows.join(linked.hint("merge"), "sig", "left")
    known = F.col("doc_id").isNotNull()
    component = F.when(known, F.coalesce("component_id", F.col("doc_id").cast("long"))).cast(kind)
    return joined.select("doc_id", "tag", "n", "sig", F.when(known, F.col("node")).alias("node"), component.alias("component_id"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    Two documents link when their sets' Jaccard similarity is at least ``percent``
    in a hundred, in whole numbers. Texts that are null or without words have empty
    sets and link with nothing. A null ``doc_id`` links with nothing and has a null
    component. Repeated rows count as one document; rows that share a ``doc_id`` and
    differ in their sets are documents of their own, which link each by its own text.
    A component is named after its smallest ``doc_id``. Other columns are ignored.
    """
    return grouped(docs, shingle, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
