"""Near duplicates of embeddings through a pivot-permutation index.

A bounded sample of the vectors serves as pivots. A vector is described by its
``PREFIX`` nearest pivots, in order. Inverted lists lead from pivots to vectors;
two vectors are candidates when their prefixes share ``SHARED`` pivots, and then
their cosine decides. The lists are keyed by the pairs of pivots of a prefix, which
is the same as counting shared pivots but never touches vectors that share one.
A pair that shares more is verified under its two smallest pivots only, so that
links can be counted where they are found and no pair is emitted.

The number of pivots follows the square root of the number of vectors up to 8,192
(reached at 67 million vectors), where there are up to 33 million lists; every
vector is indexed. A long list (many near copies) is cut into tiles, and each pair
of tiles is one small product. Lists and tiles are planned on ids and sketches of
``SKETCH`` bits (signs of fixed random projections): only a vector that has a partner
in its tile whose sketch is near enough travels to the products, in its table's own
width. A linked pair's sketches differ in more bits than admitted with a probability
below 1e-9 (``SIGMAS`` standard deviations over the expected number).
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from folioforge.llm.ngram_join import Forest, node_of
from folioforge.llm.vectors import finite_rows
from folioforge.operators.components import connected_components
from folioforge.session import materialise

COSINE, PREFIX, SHARED = 0.95, 5, 2
PIVOTS_LEAST, PIVOTS_MOST = 64, 8192
#: Vectors in the sample for each pivot wanted, and the cosine that two pivots stay below.
SAMPLED, APART = 4, 0.5
#: Vectors in a tile: at least, at most; tiles of a list before they grow beyond the least.
TILE, TILE_MOST, TILES = 512, 8192, 4
ROWS_AT_ONCE = 512
SKETCH, SIGMAS = 128, 7


def _unit(row: np.ndarray) -> np.ndarray:
    row = row.astype(np.float64)
    row = row / np.abs(row).max()  # squares then neither overflow nor vanish
    return row / np.sqrt(row @ row)


def _width(vectors: DataFrame) -> str:
    """The number type in which vectors travel: that of their table, if it is a floating one."""
    kind = getattr(vectors.schema["embedding"].dataType, "elementType", None)
    return "<f4" if isinstance(kind, FloatType) else "<f8"


def _prepared(vectors: DataFrame) -> DataFrame:
    """``vec_id, sig, vec``: signature of the direction and the vector's bytes, null for vectors that take no part."""
    kind, width = vectors.schema["vec_id"].dataType.simpleString(), _width(vectors)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, rows = finite_rows(batch.column("embedding").to_pandas())
            sig, vec = [None] * len(batch), [None] * len(batch)
            for at, row in zip(np.flatnonzero(good), rows, strict=True):
                if row.any():
                    vec[at] = row.astype(width).tobytes()
                    sig[at] = hashlib.blake2b((_unit(row) + 0.0).tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sig, pa.binary()), pa.array(vec, pa.binary())], ["vec_id", "sig", "vec"])

    return vectors.select("vec_id", "embedding").mapInArrow(prepare, f"vec_id {kind}, sig binary, vec binary")


def sketches(units: np.ndarray) -> np.ndarray:
    """Signs of projections that depend on the dimension alone, eight to a byte."""
    planes = np.random.default_rng(units.shape[1]).normal(size=(units.shape[1], SKETCH))
    return np.packbits(units @ planes > 0, axis=1)


def most_apart(cosine: float) -> float:
    """In how many bits the sketches of a linked pair may differ."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return SKETCH * p + SIGMAS * math.sqrt(SKETCH * p * (1 - p)) + 1


def _pivots(classes: DataFrame, width: str) -> dict[int, np.ndarray]:
    """By dimension: at most PIVOTS_MOST vectors of a sample, by hash, of SAMPLED times as many.

    Pivots lie apart. In a large group of near copies a plain sample would put many
    pivots side by side, and which of those are nearest to a member is chance.
    """
    total = classes.count()
    want = min(PIVOTS_MOST, max(PIVOTS_LEAST, math.isqrt(total)))
    rows = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLED * want).collect()
    out: dict[int, np.ndarray] = {}
    held: dict[int, int] = {}
    for row in rows:
        unit = _unit(np.frombuffer(row["vec"], width))
        kept = out.setdefault(len(unit), np.empty((want, len(unit))))
        n = held.get(len(unit), 0)
        if n < want and (not n or (kept[:n] @ unit).max() < APART):
            kept[n], held[len(unit)] = unit, n + 1
    return {dim: kept[: held[dim]] for dim, kept in out.items()}


def _listed(classes: DataFrame, pivots: dict[int, np.ndarray], width: str) -> DataFrame:
    """``node, size, vec, sketch, prefix, lists``: the nearest pivots in order, and the lists ``p * PIVOTS_MOST + q`` that hold the vector.

    Vectors of a dimension that no pivot has go to a list of their own dimension.
    """
    sent = classes.sparkSession.sparkContext.broadcast(pivots)

    def keys(dim: int, near: list[int]) -> list[int]:
        if len(near) < SHARED:
            return [-dim]
        return [dim * PIVOTS_MOST**SHARED + sum(p * PIVOTS_MOST**i for i, p in enumerate(reversed(ps))) for ps in itertools.combinations(sorted(near), SHARED)]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, part in batch.groupby(batch["vec"].str.len()):
                units = np.stack([_unit(np.frombuffer(v, width)) for v in part["vec"]])
                dim = units.shape[1]
                near = np.argsort(-(units @ sent.value.get(dim, np.empty((0, dim))).T), axis=1, kind="stable")[:, :PREFIX].tolist()
                bits = [s.tobytes() for s in sketches(units)]
                yield pd.DataFrame({"node": part["node"], "size": part["size"], "vec": part["vec"], "sketch": bits, "prefix": near, "lists": [keys(dim, n) for n in near]})

    return classes.select("node", "size", "vec").mapInPandas(describe, "node long, size long, vec binary, sketch binary, prefix array<int>, lists array<long>")


def partnered(bits: np.ndarray, tile: np.ndarray, apart: float) -> np.ndarray:
    """Which entries of a tile or pair of tiles have another whose sketch is near enough."""
    signs = np.where(np.unpackbits(bits, axis=1), np.float32(1), np.float32(-1))
    across, some = len(np.unique(tile)) > 1, np.zeros(len(signs), bool)
    for at in range(0, len(signs), ROWS_AT_ONCE):
        stop = min(len(signs), at + ROWS_AT_ONCE)
        near = (SKETCH - signs[at:stop] @ signs.T) / 2 <= apart
        near[np.arange(stop - at), np.arange(at, stop)] = False
        if across:
            near &= tile[at:stop, None] != tile[None, :]
        some[at:stop] = near.any(axis=1)
    return some


def _possible(tiled: DataFrame, cosine: float) -> DataFrame:
    """``list, a, b, tile, node``: the visits of ``tiled`` whose sketch has a partner there."""
    names, apart = ["list", "a", "b", "tile", "node"], most_apart(cosine)

    def left(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        some = partnered(np.stack([np.frombuffer(r[5], np.uint8) for r in rows]), np.array([r[3] for r in rows]), apart)
        return [rows[i][:5] for i in np.flatnonzero(some)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if rows and row[:3] != rows[0][:3]:
                    out += left(rows)
                    rows = []
                rows.append(row)
            yield pd.DataFrame(out, columns=names, dtype="int64")
        yield pd.DataFrame(left(rows), columns=names, dtype="int64")

    return tiled.select(*names, "sketch").mapInPandas(run, "list long, a int, b int, tile int, node long")


def list_links(list_id: int, reps: np.ndarray, sizes: np.ndarray, units: np.ndarray, prefixes: np.ndarray, tile: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """How many vectors each entry links with that this list answers for, and a forest of the links."""
    n = len(reps)
    counts, forest, edges = np.zeros(n, np.int64), Forest(n), []
    across = len(np.unique(tile)) > 1
    earlier = None
    if list_id >= 0:
        last = list_id % PIVOTS_MOST
        own = [list_id // PIVOTS_MOST**i % PIVOTS_MOST for i in range(SHARED)]
        member = np.zeros((n, last + 1), np.float32)
        rows, cols = np.nonzero(prefixes <= last)
        member[rows, prefixes[rows, cols]] = 1
        member[:, own] = 0
        earlier = member[:, member.any(axis=0)]
    for at in range(0, n, ROWS_AT_ONCE):
        stop = min(n, at + ROWS_AT_ONCE)
        near = units[at:stop] @ units.T >= cosine
        near[np.arange(stop - at), np.arange(at, stop)] = False
        if earlier is not None and earlier.shape[1]:
            near &= earlier[at:stop] @ earlier.T == 0
        if across:
            near &= tile[at:stop, None] != tile[None, :]
        counts[at:stop] += near @ sizes
        for i, j in zip(*np.nonzero(near), strict=True) if near.sum() < 4 * n else _sparse(near, forest, at):
            if forest.join(at + int(i), int(j)):
                edges.append((int(reps[at + i]), int(reps[j])))
    return counts, edges


def _sparse(near: np.ndarray, forest: Forest, at: int) -> Iterator[tuple[int, int]]:
    """Entries of a full block that still connect something."""
    for i in range(len(near)):
        hit = np.flatnonzero(near[i])
        while len(hit := hit[forest.roots(hit) != forest.roots(np.array([at + i]))[0]]):
            yield i, int(hit[0])


def _verified(tiled: DataFrame, cosine: float, width: str) -> DataFrame:
    """``node, links, other``: link counts (``other`` is the node itself), and edges ``node, other`` (``links`` is 0)."""

    def flush(key: tuple, rows: list[tuple]) -> tuple[list, list]:
        if len(rows) < 2:
            return [], []
        reps, sizes = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        units = np.stack([_unit(np.frombuffer(r[2], width)) for r in rows])
        prefixes = np.stack([np.asarray(r[3], np.int64) for r in rows])
        counts, edges = list_links(key[0], reps, sizes, units, prefixes, np.array([r[4] for r in rows]), cosine)
        some = np.flatnonzero(counts)
        return list(zip(reps[some].tolist(), counts[some].tolist(), strict=True)), edges

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []

        def out(counts: list, edges: list) -> pd.DataFrame:
            # No nulls, as integers beside nulls would become doubles.
            return pd.DataFrame([(r, c, r) for r, c in counts] + [(a, 0, b) for a, b in edges], columns=["node", "links", "other"], dtype="int64")

        for batch in batches:
            counts, edges = [], []
            for list_id, a, b, tile, rep, size, vec, prefix in batch.itertuples(index=False, name=None):
                if (list_id, a, b) != key:
                    more = flush(key, rows)
                    counts, edges = counts + more[0], edges + more[1]
                    key, rows = (list_id, a, b), []
                rows.append((rep, size, vec, prefix, tile))
            yield out(counts, edges)
        yield out(*flush(key, rows))

    return tiled.select("list", "a", "b", "tile", "node", "size", "vec", "prefix").mapInPandas(run, "node long, links long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``.

    Links are found with the recall of the index (1 for equal vectors; measured in
    the tests for others) and are exact: cosine in double precision at least
    ``cosine``. A vector that is null, empty or zero, or has a null or non-finite
    component, links with nothing and is a component of its own; so does a row with
    a null ``vec_id``, whose component is null. Repeated rows link with each other.
    Vectors of unlike dimensions do not link. Other columns are ignored.
    """
    width = _width(vectors)
    prepared = materialise(_prepared(vectors), "vec-prepared")
    valid = prepared.where("sig is not null and vec_id is not null")
    classes = valid.groupBy("sig").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("size"), F.min("vec").alias("vec"))
    classes = materialise(classes.withColumn("node", node_of("sig")), "vec-classes")
    listed = materialise(_listed(classes, _pivots(classes, width), width), "vec-listed")
    entries = listed.select("node", "sketch", F.explode("lists").alias("list"))
    lengths = entries.groupBy("list").agg(F.count("*").alias("length")).where("length > 1")
    tiles = F.least(F.ceil(F.col("length") / TILE), F.greatest(F.lit(TILES), F.ceil(F.col("length") / TILE_MOST)))
    lengths = materialise(lengths.select("list", tiles.cast("int").alias("tiles")), "vec-lengths")
    entries = entries.join(lengths.hint("merge"), "list").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # The same pair stands in tile pairs (a, a) once and (a, b) once, never in both.
    to = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.col("list").alias("list"), F.least(t, F.col("tile")).alias("a"), F.greatest(t, F.col("tile")).alias("b"), F.col("tile").alias("tile")))
    place = ["list", "a", "b"]
    sketched = entries.select("node", "sketch", F.inline(to)).repartition(*place).sortWithinPartitions(*place, "node")
    possible = materialise(_possible(sketched, cosine), "vec-possible")
    rows = possible.join(listed.select("node", "size", "vec", "prefix").hint("merge"), "node")
    tiled = rows.repartition(*place).sortWithinPartitions(*place, "node")
    found = materialise(_verified(tiled, cosine, width), "vec-links")
    counts = found.where("other = node").groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other <> node").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    parts = materialise(parts, "vec-parts")
    named = parts.join(classes.select("node", "rep").hint("merge"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    parts = parts.join(materialise(named, "vec-named").hint("merge"), "component").select("node", "component_id")
    per_class = classes.select("sig", "node", "rep", "size").join(counts, "node", "left").join(parts, "node", "left")
    per_class = per_class.select("sig", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component_id", "rep").alias("component"))
    per_class = materialise(per_class, "vec-result")
    key = F.when(F.col("vec_id").isNotNull(), F.col("sig"))
    joined = prepared.select("vec_id", key.alias("sig")).join(per_class.hint("merge"), "sig", "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
