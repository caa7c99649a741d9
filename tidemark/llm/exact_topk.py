"""Exact top-k by inner product: a dual-tree search over cover trees.

A cover tree is built level by level: the centres of a level are rows, every row lies within
the level's radius of one, no two are nearer to each other than that, and each centre stays a
centre below itself.  A level halves the radius; where that would take more centres than
a share of the rows, as among vectors without clusters, the node keeps its rows as a leaf.

1. The top of the tree is found on a bounded sample; its leaves are the table's groups.  Every
   row, of candidates and of queries, goes to the group of its nearest centre, and a group's
   covering radius is the largest distance of all its rows, not only of sampled ones.
2. Each group of queries is held against the group of candidates nearest to it, which gives
   every query a k-th score to begin with.
3. Pairs of groups whose bound is below the worst k-th score of the group of queries are
   pruned, before a row of them is shuffled.  The others meet, in blocks of bounded size.

With centres q, c and covering radii r_q, r_c no inner product between two nodes exceeds

    <q, c> + r_q |c| + r_c |q| + r_q r_c .

Inside a task the same bound prunes node pairs of the two blocks' trees; the queries' tree goes
down to a few rows, and where two leaves meet each query is held against the candidates' centre
by itself, <q, c> + r_c |q| against its own k-th score.  A candidate is sent to as many tasks as
there are blocks of queries that may want it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, small_batches

#: Vectors of one block of candidates, and of one block of queries.
BLOCK, QUERY_BLOCK = 8192, 8192
#: Rows that the top of the tree is found on, at most, and groups that it makes, at most.
SAMPLE, GROUPS = 4096, 512
#: Rows of a node that is not divided, of candidates and of queries; one row in so many may become a centre of the next level.
LEAF, SPREAD = 64, 16
QUERY_LEAF, QUERY_SPREAD = 4, 2
#: Rows of queries and of candidates that are multiplied at once.
TILE_Q, TILE_C = 256, 1024
SCALE = 256
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Node:
    """A centre, the radius that covers all rows below, and children or the rows themselves."""

    __slots__ = ("centre", "children", "norm", "radius", "rows", "worst")

    def __init__(self, centre: np.ndarray, rows: np.ndarray, radius: float) -> None:
        self.centre, self.rows, self.radius = centre, rows, radius
        self.norm = float(np.sqrt(centre @ centre))
        self.children: list[Node] = []
        self.worst = -math.inf


def _away(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - centre) ** 2).sum(1), 0))


def cover_tree(points: np.ndarray, leaf: int = LEAF, most: int = 1 << 30, spread: int = SPREAD) -> Node:
    """The tree of all points, with at most `most` leaves."""
    left = [most - 1]

    def grow(rows: np.ndarray, first: int, away: np.ndarray) -> Node:
        """rows: all below; first: the place among them of the node's own point; away: distances to it."""
        own = points[rows]
        node = Node(own[first], rows, float(away.max()))
        if len(rows) <= leaf or node.radius == 0:
            return node
        # A net of half the radius: the node's own point first, then whatever is not covered yet.
        level, centres, nearest, owner = node.radius / 2, [first], away.copy(), np.zeros(len(rows), np.int64)
        while nearest.max() > level:
            if len(centres) > min(left[0], 8 + len(rows) // spread):
                return node
            far = int(nearest.argmax())
            to = _away(own, own[far])
            owner[to < nearest] = len(centres)
            nearest = np.minimum(nearest, to)
            centres.append(far)
        left[0] -= len(centres) - 1
        for k, c in enumerate(centres):
            mine = np.flatnonzero(owner == k)
            node.children.append(grow(rows[mine], int(np.flatnonzero(mine == c)[0]), nearest[mine]))
        return node

    away = _away(points, points[0])
    return grow(np.arange(len(points)), 0, away)


def leaves(node: Node) -> list[Node]:
    return [x for child in node.children for x in leaves(child)] or [node]


def _bound(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """The largest inner product that any two rows of groups a and b can have."""
    na, nb = (np.sqrt((x**2).sum(1)) for x in (a, b))
    most = a @ b.T + ra[:, None] * nb + na[:, None] * rb + ra[:, None] * rb
    return most + 1e-9 * np.maximum(1.0, np.abs(most))


class Search:
    """The k best candidates of every query of a pair of blocks, ties to the smaller id.

    floor: scores that the queries have k candidates of already.
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        order = np.argsort(ids, kind="stable")
        self.q, self.c, self.qi, self.ci, self.k = queries, candidates[order], query_ids, ids[order], k
        most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(candidates.astype(float)).max(initial=0)) * max(1, queries.shape[1])
        # Doubles are exact, and fast, while all sums stay below 2^53; whole numbers of any size are always exact.
        self.kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
        self.qk, self.ck = self.q.astype(self.kind), self.c.astype(self.kind)
        self.slack = 1e-9 * max(1.0, most)
        self.size = np.sqrt((self.q.astype(np.float64) ** 2).sum(1))
        self.floor = np.full(len(queries), -math.inf) if floor is None else floor.astype(float)
        # For each query its best so far: scores and ids, best first.
        self.best: list[list[tuple]] = [[] for _ in range(len(queries))]
        self.scored = 0

    def run(self) -> None:
        if len(self.q) and len(self.c):
            queries = cover_tree(self.q.astype(np.float64), QUERY_LEAF, spread=QUERY_SPREAD)
            self._begin(queries)
            self._descend(queries, cover_tree(self.c.astype(np.float64)))

    def _begin(self, a: Node) -> None:
        a.worst = float(self.floor[a.rows].min())
        for child in a.children:
            self._begin(child)

    def _most(self, a: Node, b: Node) -> float:
        return float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius + self.slack

    def _descend(self, a: Node, b: Node) -> None:
        if self._most(a, b) < a.worst:
            return
        if not a.children and not b.children:
            self._leaves(a, b)
            return
        # Queries first, unless they are much nearer together: candidates of all kinds would set their k-th scores.
        if a.children and (not b.children or a.radius >= b.radius / 2):
            for child in a.children:
                child.worst = max(child.worst, a.worst)
                self._descend(child, b)
            a.worst = max(a.worst, min(child.worst for child in a.children))
        else:
            # The most promising candidates first, so that later ones are pruned.
            for child in sorted(b.children, key=lambda x: -self._most(a, x)):
                self._descend(a, child)

    def _leaves(self, a: Node, b: Node) -> None:
        candidates = np.sort(b.rows)
        rows = a.rows[self.q[a.rows].astype(np.float64) @ b.centre + b.radius * self.size[a.rows] + self.slack >= self.floor[a.rows]]
        for qs in (rows[x : x + TILE_Q] for x in range(0, len(rows), TILE_Q)):
            for cs in (candidates[x : x + TILE_C] for x in range(0, len(candidates), TILE_C)):
                self._tile(qs, cs)
        a.worst = float(self.floor[a.rows].min())

    def _tile(self, qs: np.ndarray, cs: np.ndarray) -> None:
        scores = self.qk[qs] @ self.ck[cs].T
        if self.kind is object:  # saturated, as in the result
            scores = np.clip(scores, _LOW, _HIGH).astype(np.int64)
        self.scored += scores.size
        own = self.qi[qs][:, None] == self.ci[cs]
        kth = self.floor[qs]
        if self.kind is np.float64:
            scores[own] = -np.inf
            if len(cs) > self.k:  # nothing below the tile's own k-th score can stay
                kth = np.maximum(kth, np.partition(scores, len(cs) - self.k, axis=1)[:, len(cs) - self.k])
            fine = scores >= kth[:, None]
        else:
            # Rounding to doubles keeps the order, so what is below the floor there is below it.
            fine = scores.astype(float) >= kth[:, None]
        fine &= ~own
        at, which = np.nonzero(fine)
        starts = np.searchsorted(at, np.arange(len(qs) + 1))
        for row in np.flatnonzero(np.diff(starts)):
            q, cols = int(qs[row]), which[starts[row] : starts[row + 1]]
            found = zip([-int(x) for x in scores[row, cols]], self.ci[cs[cols]].tolist(), strict=True)
            self.best[q] = best = sorted([*self.best[q], *found])[: self.k]
            if len(best) == self.k:
                self.floor[q] = max(self.floor[q], float(-best[-1][0]))

    def result(self) -> tuple[list[int], list[int], list[int]]:
        """Query places, candidate ids and scores."""
        rows = [(q, i, -s) for q, best in enumerate(self.best) for s, i in best]
        return tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [])


def _clean(vectors: DataFrame, asks: Column) -> DataFrame:
    """vec_id, asks, v: floor(256 x) of each component; without vectors that are null or hold null, NaN or infinity."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", asks.alias("asks")).where(fine)
    return whole.select("vec_id", "asks", F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length; a shorter vector counts as followed by zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int64)
    out = np.zeros((len(lists), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass(frozen=True)
class Groups:
    """The leaves of the top of the tree, and what all rows of the table make of them."""

    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    asked: np.ndarray
    asked_radii: np.ndarray

    def bounds(self) -> np.ndarray:
        """For each group of queries and of candidates, the largest score between them; -inf if either is empty."""
        most = _bound(self.centres, self.asked_radii, self.centres, self.radii)
        most[self.asked == 0] = -np.inf
        most[:, self.sizes == 0] = -np.inf
        return most

    def seeds(self, k: int) -> np.ndarray:
        """Pairs of groups to begin with: for each group of queries the nearest groups that hold over k rows."""
        most, out = self.bounds(), np.zeros((len(self.sizes), len(self.sizes)), bool)
        near = np.where(np.isfinite(most), self.centres @ self.centres.T, -np.inf)
        for a in np.flatnonzero(self.asked):
            order = np.argsort(-near[a], kind="stable")
            out[a, order[: int(np.searchsorted(np.cumsum(self.sizes[order]), k + 1)) + 1]] = True
        return out & np.isfinite(most)

    def survivors(self, worst: np.ndarray) -> np.ndarray:
        """Pairs of groups whose bound reaches the worst k-th score of the group of queries."""
        most = self.bounds()
        return np.isfinite(most) & (most >= worst[:, None])


def _top(rows: DataFrame, total: int) -> np.ndarray:
    """Centres of the leaves of a tree over at most SAMPLE rows, those of the smallest hash of id and vector."""
    place = F.xxhash64("vec_id", "v").cast("double") / 2.0**64 + 0.5
    taken = rows.where(place * total <= 4.0 * SAMPLE).orderBy(place, "vec_id").select("v").limit(SAMPLE).toArrow()
    points = _matrix(taken["v"]).astype(np.float64)
    if not len(points):
        return np.zeros((1, points.shape[1]))
    return np.array([x.centre for x in leaves(cover_tree(points, most=GROUPS))])


def _fit(points: np.ndarray, wide: int) -> np.ndarray:
    return np.pad(points, ((0, 0), (0, max(0, wide - points.shape[1]))))


def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, asks, v, and of the nearest centre its number and distance."""
    told = rows.sparkSession.sparkContext.broadcast(centres)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            points = _matrix(b.column(2)).astype(np.float64)
            wide = max(points.shape[1], told.value.shape[1])
            points, c = _fit(points, wide), _fit(told.value, wide)
            squares = (points**2).sum(1)[:, None] - 2 * (points @ c.T) + (c**2).sum(1)
            group = squares.argmin(1)
            away = np.sqrt(((points - c[group]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(group.astype(np.int32)), pa.array(away)], names=["vec_id", "asks", "v", "grp", "away"])

    return rows.select("vec_id", "asks", "v").mapInArrow(made, "vec_id long, asks boolean, v array<bigint>, grp int, away double")


def _measure(placed: DataFrame, centres: np.ndarray) -> Groups:
    n = len(centres)
    sizes, radii, asked, asked_radii = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
    away = F.when(F.col("asks"), F.col("away"))
    for r in placed.groupBy("grp").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.count(away).alias("m"), F.max(away).alias("s")).collect():  # a row a group
        sizes[r.grp], radii[r.grp], asked[r.grp], asked_radii[r.grp] = r.n, r.r, r.m, r.s or 0.0
    return Groups(centres, sizes, radii, asked, asked_radii)


def _meet(placed: DataFrame, queries: DataFrame, pairs: np.ndarray, groups: Groups, k: int, block: int, query_block: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query among the groups it is paired with.

    queries: query_id, query, grp, floor.  A group's rows fall into blocks by hash, and so do the
    queries of all groups that are paired with it; each pair of blocks is a task's work.
    """
    spark = placed.sparkSession
    blocks = np.maximum(1, -(-groups.sizes // block))
    slots = np.maximum(1, -(-(pairs * groups.asked[:, None]).sum(0) // query_block))
    wanted = np.flatnonzero(pairs.any(0))
    targets = spark.createDataFrame([(int(c), int(blocks[c]), int(slots[c])) for c in wanted], "cgrp int, blocks int, slots int")
    links = spark.createDataFrame([(int(a), int(c)) for a, c in zip(*np.nonzero(pairs), strict=True)], "grp int, cgrp int")  # GROUPS^2 at most
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = F.pmod(F.xxhash64("query_id"), F.col("slots")).cast("int")
    asked = queries.join(F.broadcast(links), "grp").join(F.broadcast(targets), "cgrp").withColumn("slot", slot).withColumn("block", upto("blocks"))
    there = placed.select("vec_id", "v", F.col("grp").alias("cgrp")).join(F.broadcast(targets), "cgrp")
    there = there.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")).withColumn("slot", upto("slots"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = _matrix(left["query"]), _matrix(right["v"])
        wide = max(q.shape[1], c.shape[1])
        ids = left["query_id"].to_numpy()
        s = Search(_fit(q, wide), ids, _fit(c, wide), right["vec_id"].to_numpy(), k, left["floor"].to_numpy())
        s.run()
        at, found, scores = s.result()
        return pa.table({"query_id": pa.array(ids[at], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.int64())})

    grid = ["cgrp", "block", "slot"]
    asked, there = asked.select(*grid, "query_id", "query", "floor"), there.select(*grid, "vec_id", "v")
    return asked.groupBy(*grid).cogroup(there.groupBy(*grid)).applyInArrow(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query, ties to the smaller id.

    A query never finds rows of its own id.  Vectors that are null or hold a null or non-finite
    component take no part, null ids neither; further columns are no matter; an empty table
    gives an empty one.  An id asks once: rows that repeat an id and a vector are one query, rows of one
    id and different vectors give the k best of all these vectors; as candidates all rows count.  Components and scores
    beyond 64 bits count as the largest, or the smallest, that fits.
    """
    rows = _clean(vectors, is_query)
    centres = _top(rows, rows.count())
    placed = materialize(_assigned(rows, centres), "placed")
    groups = _measure(placed, centres)
    asked = placed.where("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"), "grp").dropDuplicates(["query_id", "query"])
    pairs = groups.seeds(k)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    first = materialize(best(_meet(placed, asked.withColumn("floor", F.lit(-math.inf)), pairs, groups, k, block, query_block)), "first")
    floors = asked.join(first.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor")), "query_id", "left").fillna(-math.inf, ["floor"])
    worst = np.full(len(centres), np.inf)
    for r in floors.groupBy("grp").agg(F.min("floor").alias("worst")).collect():  # a row a group
        worst[r.grp] = r.worst
    pairs = groups.survivors(worst) & ~pairs
    if not pairs.any():
        return first
    return best(first.drop("rank").unionByName(_meet(placed, floors, pairs, groups, k, block, query_block)))


#: The same rows by comparing every query with every row, for DuckDB.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
