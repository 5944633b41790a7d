"""Exact top-k by inner product: best-first search of a paged M-tree.

With M the largest norm, a vector x becomes the point (x, sqrt(M^2 - |x|^2)) and a
query q the point (q, 0); the nearest points then have the largest inner products,
so a metric tree gives exact answers. The tree has four levels: routing objects, as
far apart as a bounded sample allows, with covering radii; nodes of ``NODE_PAGES``
pages; pages of at most ``PAGE`` vectors; and the entries of a page. All vectors are
ordered by their three nearest routing objects and the distance from the first, so
that neighbours in this order lie in one small cell, and cut into pages by Spark.
Nodes and pages store a centre, a covering radius and the distance from their routing
object; an entry stores its distance from the page's centre.

A query first gets the k-th best score of its own page. It searches the best node of
the routing object whose bound is best, and with the score found there asks all
routing objects and the nodes below them: a list of (query, node), with no vectors but
the nodes' centres. Pages travel only to the queries that ask for them. In a node, a
query opens pages in the order of their bounds until none can hold a better entry;
stored distances are tried before a distance is computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.vectors import finite_rows
from folioforge.session import materialise

SCALE, TOP, EVERY = 1024, 10, 100
PAGE, NODE_PAGES = 256, 32
#: Routing objects: the square root of the number of vectors, within these; and vectors in the sample for each.
ROUTES_LEAST, ROUTES_MOST, SAMPLED = 64, 1_024, 4
#: Queries that meet the nodes of a routing object at once, and that search a node at once.
ASKING, SEARCHING = 2_048, 2_048
#: Sums below this are exact in double precision; sums from this on might not fit a score.
EXACT, TOO_LARGE = float(2**52), float(2**62)


def scaled(column: pd.Series) -> tuple[np.ndarray, list[bytes]]:
    """Which entries take part, and ``floor(SCALE * x)`` of those, as int64 bytes."""
    good, rows = finite_rows(column)
    if any(np.abs(r).max() * SCALE >= TOO_LARGE for r in rows):
        raise OverflowError("a component is too large for an integer score of 64 bits")
    return good, [np.floor(SCALE * r).astype(np.int64).tobytes() for r in rows]


def _points(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, norm2, vec`` of the vectors that take part."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, rows = scaled(batch.column("embedding").to_pandas())
            ints = [np.frombuffer(r, np.int64).astype(float) for r in rows]
            columns = [batch.column("vec_id").filter(pa.array(good)), pa.array([len(r) for r in ints], pa.int32()), pa.array([float(r @ r) for r in ints], pa.float64()), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "norm2", "vec"])

    return vectors.where("vec_id is not null").select("vec_id", "embedding").mapInArrow(scale, f"vec_id {kind}, dim int, norm2 double, vec binary")


def scores(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Exact inner products of int64 rows with one row."""
    a, b = many.astype(np.float64), one.astype(np.float64)
    most = np.abs(a).sum(axis=1).max(initial=0) * np.abs(b).max(initial=0)
    if most >= TOO_LARGE:
        raise OverflowError("an inner product may be too large for an integer score of 64 bits")
    return (a @ b).astype(np.int64) if most < EXACT else many @ one


def lifted(rows: np.ndarray, top2: float) -> np.ndarray:
    rows = rows.astype(np.float64)
    return np.hstack([rows, np.sqrt(np.maximum(top2 - (rows * rows).sum(axis=1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def far_apart(rows: np.ndarray, want: int, top2: float) -> np.ndarray:
    """At most ``want`` of the rows, each the farthest from those before it."""
    points = lifted(rows, top2)
    chosen, away = [0], _distances(points, points[:1])[:, 0]
    while len(chosen) < want and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _distances(points, points[chosen[-1:]])[:, 0])
        away[chosen] = 0
    return rows[chosen]


def _routed(points: DataFrame, tops: dict[int, float], routes: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``route``, ``second`` and ``third``, the nearest routing objects of the same dimension, and ``away``, the distance from the first."""
    sent = points.sparkSession.sparkContext.broadcast((tops, routes))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, objects = sent.value
        for batch in batches:
            out = batch.assign(route=0, second=0, third=0, away=0.0)
            for dim, part in batch.groupby("dim"):
                if dim in objects:
                    own = lifted(np.stack([np.frombuffer(v, np.int64) for v in part["vec"]]), top[dim])
                    far = _distances(own, lifted(objects[dim], top[dim]))
                    out.loc[part.index, "away"] = far.min(axis=1)
                    for name in ("route", "second", "third")[: far.shape[1]]:
                        near = far.argmin(axis=1)
                        out.loc[part.index, name] = near
                        far[np.arange(len(far)), near] = np.inf
            yield out

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(route, f"{kinds}, route int, second int, third int, away double")


def make_page(ids: np.ndarray, rows: np.ndarray, parent: np.ndarray | None, top2: float) -> dict:
    own = lifted(rows, top2)
    mean = own.mean(axis=0, keepdims=True)
    centre = int(_distances(own, mean)[:, 0].argmin())
    away = _distances(own, own[centre : centre + 1])[:, 0]
    order = np.argsort(away, kind="stable")
    up = 0.0 if parent is None else float(_distances(own[centre : centre + 1], lifted(parent[None], top2))[0, 0])
    return {"n": len(ids), "centre": rows[centre].tobytes(), "radius": float(away.max()), "up": up, "ids": ids[order].tobytes(), "vecs": rows[order].tobytes(), "away": away[order].tobytes()}


PAGE_COLUMNS = "node long, dim int, route int, n int, centre binary, radius double, up double, ids binary, vecs binary, away binary, seeds array<struct<id:long,floor:long,vec:binary>>, node_centre binary, cover double, node_up double"


def _pages(routed: DataFrame, tops: dict[int, float], routes: dict[int, np.ndarray], every: int, k: int) -> DataFrame:
    """Pages from rows sorted by routing objects and distance; ``seeds`` are a page's own queries with a score that their k-th best reaches.

    The first page of a node also holds the node: its centre (the mean, as a point), its
    covering radius and its distance from the routing object. A node is held until it is full.
    """
    sent = routed.sparkSession.sparkContext.broadcast((tops, routes))

    def page(node: int, dim: int, route: int, ids: list[int], vecs: list[bytes]) -> dict:
        top, objects = sent.value
        own, rows = np.array(ids, np.int64), np.stack([np.frombuffer(v, np.int64) for v in vecs])
        seeds = []
        for i in np.flatnonzero(own % every == 0):
            others = scores(rows[own != own[i]], rows[i])
            least = int(np.partition(others, -k)[-k]) if len(others) >= k else None
            seeds.append({"id": int(own[i]), "floor": least, "vec": rows[i].tobytes()})
        parent = objects[dim][route] if dim in objects else None
        return {"node": node, "dim": dim, "route": route, **make_page(own, rows, parent, top[dim]), "seeds": seeds}

    def whole(held: list[dict]) -> pd.DataFrame:
        if held:
            top, objects = sent.value
            dim, route = held[0]["dim"], held[0]["route"]
            points = [lifted(np.frombuffer(p["vecs"], np.int64).reshape(-1, dim), top[dim]) for p in held]
            centre = sum(p.sum(axis=0) for p in points)[None] / sum(map(len, points))
            held[0]["node_centre"] = centre.tobytes()
            held[0]["cover"] = max(float(_distances(p, centre).max()) for p in points)
            held[0]["node_up"] = float(_distances(centre, lifted(objects[dim][route][None], top[dim]))[0, 0]) if dim in objects else 0.0
        return pd.DataFrame(held).reindex(columns=names)

    names = [c.split()[0] for c in PAGE_COLUMNS.replace(",floor:long,vec:binary", "").split(", ")]

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, vecs, held, node = None, [], [], [], TaskContext.get().partitionId() << 32
        for batch in batches:
            for dim, route, vec_id, vec in batch.itertuples(index=False, name=None):
                if (dim, route) != at or len(ids) == PAGE:
                    if ids:
                        held.append(page(node, *at, ids, vecs))
                    if held and ((dim, route) != at or len(held) == NODE_PAGES):
                        yield whole(held)
                        held, node = [], node + 1
                    at, ids, vecs = (dim, route), [], []
                ids.append(vec_id)
                vecs.append(vec)
        yield whole(held + ([page(node, *at, ids, vecs)] if ids else []))

    return routed.select("dim", "route", "vec_id", "vec").mapInPandas(pages, PAGE_COLUMNS)


class Best:
    """The k best (score, smaller id first) so far."""

    def __init__(self, k: int, floor: float) -> None:
        self.k, self.floor = k, floor
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.scores, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.scores, self.ids = score[order], ids[order]
        if len(order) == self.k:
            self.floor = max(self.floor, float(self.scores[-1]))


def search(pages: list[dict], query: int, vec: np.ndarray, floor: float, routes: np.ndarray | None, top2: float, k: int) -> Best:
    """Best-first over pages of the query's dimension; ``centres`` and ``lifted`` of a page are made once."""
    q2 = float(vec.astype(float) @ vec.astype(float))
    point = np.append(vec.astype(np.float64), 0.0)[None]

    def reach(distance: np.ndarray) -> np.ndarray:
        return _reach(q2, top2, distance)

    best = Best(k, floor)
    routed = _distances(point, lifted(routes, top2))[0] if routes is not None else np.zeros(1)
    route, up, radius = (np.array([p[c] for p in pages]) for c in ("route", "up", "radius"))
    bound = np.abs(routed[route] - up) - radius if routes is not None else np.full(len(pages), -np.inf)
    for i in np.argsort(bound, kind="stable"):
        if reach(bound[i]) < best.floor:
            break
        page = pages[i]
        centre = float(_distances(point, page["point"])[0, 0])
        if reach(np.array(centre - page["radius"])) < best.floor:
            continue
        keep = (reach(np.abs(centre - page["away"])) >= best.floor) & (page["ids"] != query)
        if keep.any():
            score = scores(page["vecs"][keep], vec)
            good = score >= best.floor
            best.add(score[good], page["ids"][keep][good])
    return best


def _reach(q2: np.ndarray, top2: float, distance: np.ndarray) -> np.ndarray:
    """The largest inner product that a point at least so far from the query may have."""
    # Distances near zero are off by up to the root of a double's precision.
    return (q2 + top2 - np.maximum(distance, 0) ** 2) / 2 + 1e-7 * (q2 + top2) + 1.0


def _below(score: Column | str) -> Column:
    """A double that is not above the score, whatever the rounding."""
    value = F.col(score) if isinstance(score, str) else score
    return value.cast("double") - F.abs(value.cast("double")) * 2.0**-50


def _admitted(queries: DataFrame, nodes: DataFrame, n_queries: int, tops: dict[int, float], routes: dict[int, np.ndarray], best: bool = False) -> DataFrame:
    """``key, node, floor``: the nodes that may hold an entry as good as a query's ``floor``; or only the best one of its best routing object."""
    spark = queries.sparkSession
    radii = {(r["dim"], r["route"]): r["radius"] for r in nodes.groupBy("dim", "route").agg(F.max(F.col("up") + F.col("cover")).alias("radius")).collect()}
    sent = spark.sparkContext.broadcast((tops, routes, radii))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, objects, radius = sent.value
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                vec = np.stack([np.frombuffer(v, np.int64) for v in part["vec"]]).astype(np.float64)
                q2, floor = (vec * vec).sum(axis=1)[:, None], part["floor"].fillna(-np.inf).to_numpy()[:, None]
                own = np.array([r for d, r in radius if d == dim])
                away = np.zeros((len(part), len(own)))
                if dim in objects:
                    away = _distances(np.hstack([vec, np.zeros((len(vec), 1))]), lifted(objects[dim][own], top[dim])) - np.array([radius[dim, r] for r in own])
                reach = _reach(q2, top[dim], away)
                good = np.arange(len(own)) == reach.argmax(axis=1)[:, None] if best else reach >= floor
                rows, cols = np.nonzero(good)
                yield pd.DataFrame({"dim": dim, "route": own[cols], "key": part["key"].to_numpy()[rows], "floor": floor[rows, 0], "vec": part["vec"].to_numpy()[rows]})

    asked = queries.select("dim", "key", "vec", "floor").mapInPandas(ask, "dim int, route int, key long, floor double, vec binary")
    blocks = max(1, -(-n_queries // ASKING))
    asked = asked.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    offered = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def compare(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        top, objects, _ = sent.value
        names, out = ["key", "node", "floor"], []
        if not len(own) or not len(found):
            return pd.DataFrame(out, columns=names)
        dim = int(found["dim"].iloc[0])
        centres = np.stack([np.frombuffer(c, np.float64) for c in found["centre"]])
        node, cover, key = found["node"].to_numpy(), found["cover"].to_numpy(), own["key"].to_numpy()
        for at in range(0, len(own), 256):
            part = own.iloc[at : at + 256]
            vec = np.stack([np.frombuffer(v, np.int64) for v in part["vec"]]).astype(np.float64)
            q2 = (vec * vec).sum(axis=1)[:, None]
            reach = _reach(q2, top[dim], _distances(np.hstack([vec, np.zeros((len(vec), 1))]), centres) - cover)
            floor = part["floor"].to_numpy()
            rows, cols = np.nonzero(np.arange(len(node)) == reach.argmax(axis=1)[:, None] if best else reach >= floor[:, None])
            out.append(pd.DataFrame({"key": key[at + rows], "node": node[cols], "floor": floor[rows]}))
        return pd.concat(out)

    by = ["dim", "route", "block"]
    return asked.groupBy(*by).cogroup(offered.groupBy(*by)).applyInPandas(compare, "key long, node long, floor double")


def _searched(wanted: DataFrame, queries: DataFrame, pages: DataFrame, tops: dict[int, float], routes: dict[int, np.ndarray], k: int) -> DataFrame:
    """``key, vec_id, score``: the ``k`` best of each node for each query of ``wanted(key, node, floor)``, none below the floor."""
    sent = pages.sparkSession.sparkContext.broadcast((tops, routes))
    demand = wanted.groupBy("node").agg(F.ceil(F.count("*") / SEARCHING).cast("int").alias("blocks"))
    demand = materialise(demand, "mtree-demand")
    left = wanted.join(demand.hint("merge"), "node").withColumn("block", F.pmod("key", F.col("blocks")).cast("int")).drop("blocks")
    left = left.join(queries.select("key", "id", "vec").hint("merge"), "key")
    right = pages.drop("seeds", "node_centre", "cover", "node_up").join(demand.hint("merge"), "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def meet(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        top, objects = sent.value
        out = []
        if len(own) and len(found):
            # All pages of a node have one routing object.
            dim, route = int(found["dim"].iloc[0]), int(found["route"].iloc[0])
            parent = objects[dim][[route]] if dim in objects else None
            held = [
                {
                    "route": 0, "up": p.up, "radius": p.radius, "ids": np.frombuffer(p.ids, np.int64), "away": np.frombuffer(p.away, np.float64),
                    "vecs": np.frombuffer(p.vecs, np.int64).reshape(p.n, dim), "point": lifted(np.frombuffer(p.centre, np.int64)[None], top[dim]),
                }
                for p in found.itertuples()
            ]
            for q in own.itertuples():
                best = search(held, q.id, np.frombuffer(q.vec, np.int64), q.floor, parent, top[dim], k)
                out += [(q.key, int(i), int(s)) for i, s in zip(best.ids, best.scores, strict=True)]
        return pd.DataFrame(out, columns=["key", "vec_id", "score"])

    return left.groupBy("node", "block").cogroup(right.groupBy("node", "block")).applyInPandas(meet, "key long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose ``vec_id`` is divisible by ``every``, its ``k`` best others.

    Components become ``floor(1024 x)``; the score is their exact inner product, ties
    go to the smaller ``vec_id``. A vector that is null or empty, or has a null or
    non-finite component, takes no part, nor does a row with a null ``vec_id``;
    vectors of another dimension are no candidates. Rows that repeat a query's
    ``vec_id`` are its own; a query that occurs more than once gives one result if
    its rows agree, one for each vector otherwise. Other columns are ignored. Vectors
    whose scores might not fit 64 bits raise an OverflowError.
    """
    spark = vectors.sparkSession
    points = materialise(_points(vectors), "mtree-points")
    tops = {r["dim"]: float(np.nextafter(r["top"], np.inf)) for r in points.groupBy("dim").agg(F.max("norm2").alias("top")).collect()}
    want = min(ROUTES_MOST, max(ROUTES_LEAST, math.isqrt(points.count())))
    sample = points.select("dim", "vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLED * want).collect()
    routes: dict[int, np.ndarray] = {}
    for dim in tops:
        own = [np.frombuffer(r["vec"], np.int64) for r in sample if r["dim"] == dim]
        if own:
            routes[dim] = far_apart(np.stack(own), want, tops[dim])
    routed = materialise(_routed(points, tops, routes), "mtree-routed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["dim", "route", "second", "third", "away", "vec_id"]
    ordered = routed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    pages = materialise(_pages(ordered, tops, routes, every, k), "mtree-pages")
    queries = pages.select("dim", F.inline("seeds")).dropDuplicates(["id", "vec"]).withColumn("key", F.xxhash64("id", "vec"))
    queries = materialise(queries.withColumn("floor", _below("floor")), "mtree-queries")
    nodes = pages.where("node_centre is not null").select("node", "dim", "route", F.col("node_centre").alias("centre"), "cover", F.col("node_up").alias("up"))
    nodes, n = materialise(nodes, "mtree-nodes"), queries.count()
    best = materialise(_admitted(queries, nodes, n, tops, routes, best=True), "mtree-best")
    first = materialise(_searched(best, queries, pages, tops, routes, k), "mtree-first")
    # A query's best node is one group, so at most k scores.
    found = first.groupBy("key").agg(F.sort_array(F.collect_list("score"), False).alias("scores"))
    risen = queries.join(found.hint("merge"), "key", "left").withColumn("floor", F.greatest("floor", _below(F.get("scores", F.lit(k - 1))))).drop("scores")
    rest = _admitted(materialise(risen, "mtree-risen"), nodes, n, tops, routes).join(best.select("key", F.col("node").alias("done")).hint("merge"), "key").where("node <> done")
    rest = materialise(rest.select("key", "node", "floor"), "mtree-rest")
    hits = first.unionByName(_searched(rest, queries, pages, tops, routes, k))
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(queries.select("key", F.col("id").alias("query_id")).hint("merge"), "key").select("query_id", "rank", "vec_id", "score")
