"""Exact top-k search by inner product over M-trees.

Inner products become distances: a candidate x gets one more component,
sqrt(M^2 - |x|^2) with M the largest norm, a query 0. Then
d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the nearest are those of highest product,
and the triangle inequality holds.

Candidates go to the nearest of a bounded number of pivots; large cells are
salted, and each (pivot, salt) is an M-tree of its own: paged nodes whose
entries hold their covering radius and the distance to their parent. A query
first searches the tree of its nearest pivot. The score it has then rules out
every cell, node and entry whose bound is worse, mostly by stored distances
alone; the rest is searched best first, by blocks of queries that walk a tree
together. Bounds are loosened by a relative 1e-9
against rounding, scores are exact integers, and equal bounds are followed, so
ties go to the smaller id.

Equal vectors are one entry with their k + 1 smallest ids; no more can be
among k results. Queries meet trees in blocks of bounded size on both sides.

Defined results: vectors that are null or hold null or non-finite components
take no part, as queries or candidates; neither do rows with a null id. Only vectors of one length are
compared. Rows that repeat an id and a vector count once; rows that share the
query's id are its own; an id with several vectors as queries gets one list of
all their products. Fewer than k candidates give fewer rows. Products must
stay below 2^53 for the bounds; where the largest norm allows more, every
entry is computed in 64-bit integers. Other columns are ignored; empty tables
give empty results.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import written

#: Bounds of the pivots, of a tree, of a node, of the queries that meet a tree in one task, and of
#: those that walk it together.
MAX_PIVOTS = 1024
ROWS_PER_PIVOT = 1024
TREE_ROWS = 8192
PAGE = 256
QUERY_BLOCK = 32_768
QUERIES_AT_ONCE = 2048
SLACK = 1e-9
EXACT_BELOW = float(1 << 52)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))


class Node:
    """A page: vectors of its entries, distances to the parent, radii and children of inner entries."""

    __slots__ = ("vectors", "to_parent", "radii", "children", "rows")

    def __init__(self, vectors, to_parent, radii=None, children=None, rows=None):
        self.vectors, self.to_parent = vectors, to_parent
        self.radii, self.children, self.rows = radii, children, rows

    def __getstate__(self):
        return [getattr(self, s) for s in self.__slots__]

    def __setstate__(self, state):
        for s, v in zip(self.__slots__, state, strict=True):
            setattr(self, s, v)


def lift(vectors: np.ndarray, largest: float) -> np.ndarray:
    """The vectors as points with the component that makes all norms ``sqrt(largest)``."""
    rest = np.sqrt(np.maximum(largest - (vectors * vectors).sum(axis=1), 0.0))
    return np.column_stack([vectors, rest])


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def build_tree(points: np.ndarray, rows: np.ndarray, centre: np.ndarray) -> Node:
    """Bulk load: routing objects spread over the distances from the centre, each point to the nearest."""
    to_centre = _distances(points, centre)
    if len(points) <= PAGE:
        return Node(points, to_centre, rows=rows)
    ways = min(16, 2 * -(-len(points) // PAGE))  # children are about half full
    spread = np.argsort(to_centre, kind="stable")[np.linspace(0, len(points) - 1, ways).astype(int)]
    routes = points[spread]
    between = np.stack([_distances(points, r) for r in routes], axis=1)
    nearest = between.argmin(axis=1)
    used = np.unique(nearest)
    if len(used) == 1:  # no direction separates them: cut by order
        nearest = np.arange(len(points)) * ways // len(points)
        used = np.unique(nearest)
    parts = [np.flatnonzero(nearest == u) for u in used]
    radii = np.array([between[p, u].max() for p, u in zip(parts, used, strict=True)])
    children = [build_tree(points[p], rows[p], routes[u]) for p, u in zip(parts, used, strict=True)]
    return Node(routes[used], to_centre[spread[used]], radii, children)


def search_tree(tree: Node, centre: np.ndarray, ids: list, queries: np.ndarray, own: np.ndarray, k: int,
                largest: float, worst: np.ndarray) -> list[list[tuple[int, int]]]:
    """Best (score, id) pairs of a tree for each query: those that can be among its first k.

    ``tree`` holds lifted points, ``queries`` are lifted with 0, ``worst`` is the least
    score that counts for each. The queries walk the tree together: the page that is
    nearest to any of them comes first, with the queries whose bounds still reach it.
    What the stored distances leave of a page is one product of matrices.
    """
    square = (queries * queries).sum(axis=1) + largest
    slack = SLACK * (square + 1.0)

    def reach(scores, at):
        return np.sqrt(np.maximum(square[at] - 2 * scores, 0.0) + slack[at]) * (1 + SLACK)

    best: list[list[tuple[int, int]]] = [[] for _ in queries]  # heaps: worst first, of (score, -id)
    floor = np.array(worst, np.float64)
    limit = np.full(len(queries), np.inf)
    known = np.isfinite(floor)
    limit[known] = reach(floor[known], known)
    every = np.arange(len(queries))
    queue: list[tuple] = [(0.0, 0, tree, every, np.zeros(len(queries)), _between(queries, centre[None])[:, 0])]
    pushed = 0
    while queue:
        _, _, node, at, low, to_parent = heapq.heappop(queue)
        reached = low <= limit[at]
        at, to_parent = at[reached], to_parent[reached]
        if not len(at):
            continue
        # the stored parent distances rule entries out before any computation
        gap = np.abs(node.to_parent - to_parent[:, None])
        if node.rows is not None:
            near = gap <= limit[at][:, None]
            used = np.flatnonzero(near.any(axis=0))
            scores = queries[at] @ node.vectors[used].T
            able = near[:, used] & (scores >= floor[at][:, None] - 0.5)
            for i in np.flatnonzero(able.any(axis=1)):
                _keep(best[at[i]], scores[i], np.flatnonzero(able[i]), node.rows[used], ids, own[at[i]], k, floor[at[i]])
                if len(best[at[i]]) == k:
                    floor[at[i]] = max(floor[at[i]], best[at[i]][0][0])
            full = np.isfinite(floor[at])
            limit[at[full]] = np.minimum(limit[at[full]], reach(floor[at[full]], at[full]))
        else:
            open_ = gap - node.radii <= limit[at][:, None]
            used = np.flatnonzero(open_.any(axis=0))
            away = _between(queries[at], node.vectors[used])
            low = np.maximum(away - node.radii[used], 0.0)
            open_ = open_[:, used] & (low <= limit[at][:, None])
            for j in np.flatnonzero(open_.any(axis=0)):
                some = open_[:, j]
                pushed += 1
                heapq.heappush(queue, (float(low[some, j].min()), pushed, node.children[used[j]], at[some],
                                       low[some, j], away[some, j]))
    return [[(s, -i) for s, i in held] for held in best]


def _between(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of queries and points, without the cancellation of expanded squares."""
    out = np.empty((len(queries), len(points)))
    for j, point in enumerate(points):
        out[:, j] = _distances(queries, point)
    return out


def _keep(best: list, scores: np.ndarray, able: np.ndarray, rows: np.ndarray, ids: list, own: int, k: int,
          floor: float) -> None:
    """Put what can still be among the first k of one query into its heap, best first."""
    for i in able[np.argsort(-scores[able], kind="stable")]:
        score = round(float(scores[i]))
        if score < floor or len(best) == k and score < best[0][0]:
            break
        for one in ids[rows[i]]:
            if one == own:
                continue
            if len(best) < k:
                heapq.heappush(best, (score, -one))
            elif (score, -one) > best[0]:
                heapq.heapreplace(best, (score, -one))


def _all_scores(vectors: np.ndarray, ids: list, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """Without bounds, in 64-bit integers."""
    scores = (vectors * query).sum(axis=1)
    every = [(int(s), one) for s, row in zip(scores, ids, strict=True) for one in row if one != own]
    return sorted(every, key=lambda e: (-e[0], e[1]))[:k]


def top_products(rows: DataFrame, k: int, is_query: Column) -> DataFrame:
    """``query_id, rank, vec_id, score`` for rows of ``id`` (long) and ``v`` (array of long)."""
    spark = rows.sparkSession
    rows = written(rows.filter("id IS NOT NULL").select("id", "v", is_query.alias("query"))
                   .dropDuplicates(["id", "v"]), "search-rows")
    first = Window.partitionBy("v").orderBy("id")
    distinct = written(
        rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("dim", F.size("v"))
        .withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))),
        "search-distinct")
    total, largest = distinct.agg(F.count("*"), F.max("norm")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not total:
        return empty
    exact = largest < EXACT_BELOW
    wanted = min(MAX_PIVOTS, -(-total // ROWS_PER_PIVOT))
    chosen = distinct.orderBy(F.xxhash64("v"), "v").limit(wanted).select("dim", "v").collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in sorted({r["dim"] for r in chosen}):
        held = [r["v"] for r in chosen if r["dim"] == dim]
        pivots[dim] = lift(np.array(held, np.float64).reshape(len(held), dim), largest)
    shared = spark.sparkContext.broadcast((pivots, largest))

    def assign(batches):
        cells, most = shared.value
        for batch in batches:
            cell = np.full(len(batch), -1, np.int64)
            away = np.zeros(len(batch))
            for dim in batch["dim"].unique():
                if dim in cells:
                    at = np.flatnonzero(batch["dim"] == dim)
                    points = lift(np.array(batch["v"].iloc[at].tolist(), np.float64).reshape(len(at), dim), most)
                    square = (points ** 2).sum(1)[:, None] + (cells[dim] ** 2).sum(1) - 2 * points @ cells[dim].T
                    cell[at] = square.argmin(axis=1)
                    away[at] = np.sqrt(((points - cells[dim][cell[at]]) ** 2).sum(axis=1))
            out = batch[["v", "ids", "dim"]].copy()
            out["cell"], out["away"] = cell, away
            yield out

    placed = written(distinct.mapInPandas(assign, "v array<long>, ids array<long>, dim int, cell long, away double"),
                     "search-placed")
    # a row per pivot, and one per length that no pivot has
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    cells = sizes.select("dim", "cell", "radius", F.ceil(F.col("n") / TREE_ROWS).cast("long").alias("salts"))

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v", key=lambda s: s.map(tuple))
        dim, cell = int(group["dim"].iloc[0]), int(group["cell"].iloc[0])
        raw = np.array(group["v"].tolist(), np.int64).reshape(len(group), dim)
        ids = [list(map(int, i)) for i in group["ids"]]
        held, most = shared.value
        if exact:
            points = lift(raw.astype(np.float64), most)
            centre = held[dim][cell] if cell >= 0 else points[0]
            tree = (build_tree(points, np.arange(len(points)), centre), centre, ids)
        else:
            tree = (raw, ids)
        return pd.DataFrame({"dim": [dim], "cell": [cell], "salt": [int(group["salt"].iloc[0])],
                             "tree": [pickle.dumps(tree)]})

    salted = placed.join(F.broadcast(cells.select("dim", "cell", "salts")), ["dim", "cell"]) \
        .withColumn("salt", F.pmod(F.xxhash64("v", F.lit(1)), F.col("salts")))
    trees = written(salted.groupBy("dim", "cell", "salt").applyInPandas(
        plant, "dim int, cell long, salt long, tree binary"), "search-trees")
    bounds = spark.sparkContext.broadcast(
        {(r["dim"], r["cell"]): float("inf") if r["cell"] < 0 else r["radius"] for r in cells.collect()})

    def search(key, queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held):
            most = shared.value[1]
            tree = pickle.loads(held["tree"].iloc[0])
            for start in range(0, len(queries), QUERIES_AT_ONCE):
                part = queries.iloc[start : start + QUERIES_AT_ONCE]
                own = part["id"].to_numpy()
                vectors = np.array(part["v"].tolist(), np.int64).reshape(len(part), key[0])
                if exact:
                    lifted = np.column_stack([vectors.astype(np.float64), np.zeros(len(part))])
                    found = search_tree(*tree, lifted, own, k, most, part["worst"].to_numpy())
                else:
                    found = [_all_scores(tree[0], tree[1], v, i, k) for v, i in zip(vectors, own, strict=True)]
                out.extend((i, one, score) for i, held_by in zip(own, found, strict=True) for score, one in held_by)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    def route(far: bool):
        """(query, cell) rows: the nearest cell, or the others that the score so far does not rule out."""
        def run(batches):
            held, most = shared.value
            radius = bounds.value
            for batch in batches:
                for dim in sorted(batch["dim"].unique()):
                    mine = np.array(sorted(c for d, c in radius if d == dim), np.int64)
                    if not len(mine):
                        continue
                    part = batch[batch["dim"] == dim]
                    queries = np.column_stack([np.array(part["v"].tolist(), np.float64).reshape(len(part), dim),
                                               np.zeros(len(part))])
                    away = np.zeros((len(part), len(mine)))
                    if mine[0] >= 0:  # else the one cell of a length without pivots
                        away = _between(queries, held[dim][mine])
                    nearest = away.argmin(axis=1)
                    if not far:
                        yield part.assign(worst=-np.inf, cell=mine[nearest])
                        continue
                    worst = part["worst"].to_numpy()
                    square = (queries * queries).sum(axis=1) + most
                    limit = np.full(len(part), np.inf)
                    if exact:
                        known = np.isfinite(worst)
                        limit[known] = np.sqrt(np.maximum(square - 2 * worst, 0.0)[known]
                                               + (SLACK * (square + 1))[known]) * (1 + SLACK)
                    reached = away - np.array([radius[dim, c] for c in mine]) <= limit[:, None]
                    reached[np.arange(len(part)), nearest] = False
                    for j in np.flatnonzero(reached.any(axis=0)):
                        yield part[reached[:, j]].assign(cell=mine[j])
        return run

    asked = rows.filter("query").select("id", "v", F.size("v").alias("dim"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))

    def searched(routed: DataFrame) -> DataFrame:
        keys = ["dim", "cell", "salt", "block"]
        spread = routed.join(F.broadcast(cells.select("dim", "cell", "salts")), ["dim", "cell"]) \
            .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        copies = trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return spread.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(
            search, "query_id long, vec_id long, score long")

    form = "id long, v array<long>, dim int, block long, worst double, cell long"
    near = written(searched(asked.withColumn("worst", F.lit(float("-inf"))).mapInPandas(route(False), form)), "search-near")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k) \
        .select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("worst"))
    bounded = asked.join(kth, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))
    rest = searched(bounded.mapInPandas(route(True), form))
    return near.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
