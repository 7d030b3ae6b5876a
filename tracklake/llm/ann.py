"""Nearest neighbours by inner product with a vantage-point tree per shard.

Vectors are dealt into shards of bounded size, queries into blocks of bounded size; a task searches one
shard for one block. Within a shard, equal vectors become one and vectors of similar norm a band with a
tree of its own. In a band, vectors are divided by the largest norm and get one more component that makes
all norms one; queries are scaled to norm one, which keeps their ranking. So the largest inner product is
the smallest distance, whatever the norms. A tree splits by the median distance from a vantage point. A
branch whose distances from the vantage point put it beyond ``factor`` times the k-th best distance so far,
in this band or one of larger norms, is not entered: at factor one the triangle inequality makes the search
exact, below one it may miss neighbours. Where more vectors than a search keeps lie at the border of the k
best, all up to that distance are read from the trees, since any of them may have the smallest id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.columns import dots, usable_vector, vectors_of

SHARD_ROWS = 8192
BLOCK_ROWS = 4096
LEAF_ROWS = 128
FACTOR = 1.0
#: How many more than k vectors a search keeps; where ties reach beyond them, all are read.
SPARE = 8
#: Of the product of norms: scores that differ by less may be equal.
TIE = 1e-12
PAIRS_AT_ONCE = 1 << 20
#: A band's norms are above this share of its largest.
BAND = 0.8
#: Room for rounding: a distance of unit vectors near zero is known to about the root of a double's last place.
ROOM = 1e-7


class Tree:
    """A vantage-point tree over the rows of a matrix, of norm one; leaves hold up to ``LEAF_ROWS`` of them."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> tuple:
        if len(rows) <= LEAF_ROWS:
            return (rows,)
        centre = rows[len(rows) // 2]
        away = np.linalg.norm(self.points[rows] - self.points[centre], axis=1)
        order = np.argsort(away, kind="stable")
        half = len(rows) // 2
        sides = []
        for part in (order[:half], order[half:]):
            sides.append((away[part].min(), away[part].max(), self._build(rows[part])))
        return centre, sides

    def search(self, queries: np.ndarray, k: int, factor: float, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the k nearest points found for each query and their squared distances, in no order.

        Points beyond a query's squared distance in ``most`` need not be found.
        """
        self.queries, self.k, self.factor, self.most = queries, k, factor, most
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        self.query_norms = np.einsum("ij,ij->i", queries, queries)
        self.found = np.full((len(queries), k), -1)
        self.near = np.full((len(queries), k), np.inf)
        everyone = np.arange(len(queries))
        home = np.full(len(queries), -1)
        self._descend(self.root, everyone, home)
        self._visit(self.root, everyone, home)
        return self.found, self.near

    def _squares(self, who: np.ndarray, rows: np.ndarray) -> np.ndarray:
        inner = self.queries[who] @ self.points[rows].T
        return np.maximum(self.query_norms[who, None] + self.norms[rows] - 2 * inner, 0)

    def _scan(self, rows: np.ndarray, who: np.ndarray) -> None:
        """Merges a leaf's points into the best of some queries."""
        near = np.concatenate([self.near[who], self._squares(who, rows)], 1)
        found = np.concatenate([self.found[who], np.broadcast_to(rows, (len(who), len(rows)))], 1)
        best = np.argpartition(near, self.k - 1, axis=1)[:, : self.k]
        self.near[who] = np.take_along_axis(near, best, 1)
        self.found[who] = np.take_along_axis(found, best, 1)

    def _descend(self, node: tuple, who: np.ndarray, home: np.ndarray) -> None:
        """Each query's first leaf, on the nearer side of every vantage point, sets its first bound."""
        if len(node) == 1:
            self._scan(node[0], who)
            home[who] = id(node)
            return
        centre, (inner, outer) = node
        away = np.sqrt(self._squares(who, np.array([centre]))[:, 0])
        inside = away < (inner[1] + outer[0]) / 2
        for side, part in ((inner, who[inside]), (outer, who[~inside])):
            if len(part):
                self._descend(side[2], part, home)

    def _visit(self, node: tuple, who: np.ndarray, home: np.ndarray) -> None:
        if len(node) == 1:
            who = who[home[who] != id(node)]
            if len(who):
                self._scan(node[0], who)
            return
        centre, sides = node
        away = np.sqrt(self._squares(who, np.array([centre]))[:, 0])
        for low, high, child in sides:
            least = np.maximum(np.maximum(away - high, low - away), 0)
            limit = np.minimum(self.near[who].max(axis=1), self.most[who])
            part = who[least <= self.factor * np.sqrt(limit) + ROOM]
            if len(part):
                self._visit(child, part, home)


    def within(self, queries: np.ndarray, squares: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, row) whose squared distance is at most the query's, branches pruned as in ``search``."""
        self.queries, self.norms = queries, np.einsum("ij,ij->i", self.points, self.points)
        self.query_norms = np.einsum("ij,ij->i", queries, queries)
        reach, pairs = factor * np.sqrt(squares) + ROOM, []
        open_nodes = [(self.root, np.arange(len(queries)))]
        while open_nodes:
            node, who = open_nodes.pop()
            if len(node) == 1:
                i, j = np.nonzero(self._squares(who, node[0]) <= squares[who, None])
                pairs.append((who[i], node[0][j]))
                continue
            away = np.sqrt(self._squares(who, np.array([node[0]]))[:, 0])
            for low, high, child in node[1]:
                part = who[np.maximum(away - high, low - away) <= reach[who]]
                if len(part):
                    open_nodes.append((child, part))
        who, rows = zip(*pairs) if pairs else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        return np.concatenate(who), np.concatenate(rows)


def bands(norms: np.ndarray) -> list[np.ndarray]:
    """The rows of each band, by falling norm."""
    order = np.argsort(-norms, kind="stable")
    falling, cuts, at = -norms[order], [], 0
    while at < len(order):
        at = max(at + 1, int(np.searchsorted(falling, BAND * falling[at], "right")))
        cuts.append(at)
    return np.split(order, cuts[:-1])


class Bands:
    """Trees over vectors of similar norm, built when a search first reaches them."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.norms = np.linalg.norm(vectors, axis=1)
        self.rows = bands(self.norms)
        self.trees: dict[int, Tree] = {}

    def _tree(self, band: int) -> tuple[Tree, np.ndarray, float]:
        rows = self.rows[band]
        most = self.norms[rows[0]]
        if band not in self.trees:
            extra = np.sqrt(np.maximum(1 - (self.norms[rows] / most) ** 2, 0))
            self.trees[band] = Tree(np.concatenate([self.vectors[rows] / most, extra[:, None]], 1))
        return self.trees[band], rows, most

    def search(self, queries: np.ndarray, k: int, factor: float) -> np.ndarray:
        """The rows of the k largest inner products found for each query, in no order; -1 where there is none."""
        flat = directions(queries)
        best, found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
        for band in range(len(self.rows)):
            most = self.norms[self.rows[band][0]]
            # The least of the k best cosines with a vector of the band's largest norm, as a squared distance.
            limit = 2 - 2 * best.min(axis=1) / most
            who = np.flatnonzero(limit >= -ROOM)
            if not len(who):
                break
            tree, rows, _ = self._tree(band)
            own, near = tree.search(flat[who], min(k, len(rows)), factor, np.maximum(limit[who], 0))
            scores = np.concatenate([best[who], np.where(own >= 0, (1 - near / 2) * most, -np.inf)], 1)
            names = np.concatenate([found[who], np.where(own >= 0, rows[own], -1)], 1)
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            best[who], found[who] = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)
        return found

    def at_least(self, queries: np.ndarray, cosines: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, row) found whose inner product is at least the query's share of its norm."""
        flat, pairs = directions(queries), []
        for band in range(len(self.rows)):
            tree, rows, most = self._tree(band)
            squares = 2 - 2 * cosines / most
            who = np.flatnonzero(squares >= 0)
            i, j = tree.within(flat[who], squares[who], factor)
            pairs.append((who[i], rows[j]))
        who, rows = zip(*pairs)
        return np.concatenate(who), np.concatenate(rows)


def directions(queries: np.ndarray) -> np.ndarray:
    """Queries of norm one, with the component that their vectors have in addition."""
    lengths = np.linalg.norm(queries, axis=1)
    return np.concatenate([queries / lengths[:, None], np.zeros((len(queries), 1))], 1)


def scored(queries: np.ndarray, vectors: np.ndarray, who: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs, a bounded number of pairs at once."""
    parts = [slice(at, at + PAIRS_AT_ONCE // 16) for at in range(0, len(who), PAIRS_AT_ONCE // 16)]
    return np.concatenate([np.zeros(0), *(dots(queries[who[p]], vectors[rows[p]]) for p in parts)])


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k best found for each query within a shard; ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    distinct, group = np.unique(vectors, axis=0, return_inverse=True)
    group = group.ravel()
    members = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[members], np.arange(len(distinct) + 1))
    held = Bands(distinct)

    def best(who: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Of equal vectors no more than the k + 1 smallest ids can be among the k nearest of another row.
        each = np.minimum(starts[rows + 1] - starts[rows], k + 1)
        places = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[rows], each)
        who, scores, near = np.repeat(who, each), np.repeat(scores, each), ids[members[places]]
        others = near != query_ids[who]
        who, scores, near = who[others], scores[others], near[others]
        order = np.lexsort((near, -scores, who))
        who, scores, near = who[order], scores[order], near[order]
        first = np.arange(len(who)) - np.searchsorted(who, who) < k
        return query_ids[who[first]], near[first], scores[first]

    wanted = min(k + 1 + SPARE, len(distinct))
    found = held.search(queries, wanted, factor)
    who, rows = np.repeat(np.arange(len(queries)), wanted), found.ravel()
    who, rows = who[rows >= 0], rows[rows >= 0]
    scores = scored(queries, distinct, who, rows)
    kept = np.full(found.shape, -np.inf)
    kept[found >= 0] = scores
    kept = -np.sort(-kept, axis=1)
    lengths = np.linalg.norm(queries, axis=1)
    border, room = kept[:, min(k, wanted - 1)], TIE * lengths * held.norms.max()
    # One of the k + 1 best may be the query itself, so k others are at least as good as the border.
    unsure = (kept[:, -1] >= border - room) if wanted < len(distinct) else np.zeros(len(queries), bool)
    sure = ~unsure[who]
    results = [best(who[sure], rows[sure], scores[sure])]
    left = np.flatnonzero(unsure)
    step = max(1, PAIRS_AT_ONCE // len(distinct))
    for part in (left[at : at + step] for at in range(0, len(left), step)):
        i, j = held.at_least(queries[part], (border[part] - room[part]) / lengths[part], factor)
        results.append(best(part[i], j, scored(queries, distinct, part[i], j)))
    return tuple(np.concatenate(column) for column in zip(*results))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    factor: float = FACTOR,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each query the k vectors found nearest: query_id, rank (from 1), ``key``, score.

    The score is the inner product in double precision; ties go to the smaller key; a query's own key is
    no candidate. With fewer than k candidates all are returned. Null vectors and keys, zero vectors and
    vectors with null or non-finite components take no part; vectors are compared with those of their own
    length. Equal rows count once. Empty tables give an empty result; other columns are ignored.
    Queries times vectors is the amount of work at worst: each block meets each shard once.
    """
    held = vectors.filter(F.col(key).isNotNull() & usable_vector(vector)).select(key, vector).distinct()
    asked = queries.filter(F.col(key).isNotNull() & usable_vector(vector)).select(key, vector).distinct()
    shards = max(1, math.ceil(held.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / block_rows))
    length = F.size(vector).alias("_length")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.select(length, F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("_shard"), every(blocks).alias("_block"), key, vector)
    right = asked.select(length, every(shards).alias("_shard"), F.pmod(F.xxhash64(key, F.lit(7)), F.lit(blocks)).cast("int").alias("_block"), key, vector)

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if shard.num_rows and block.num_rows:
            (ids, own), (query_ids, wanted) = [
                (t.column(key).to_numpy(), vectors_of(t.column(vector).combine_chunks())) for t in (shard, block)
            ]
            columns = search_shard(ids, own, query_ids, wanted, k, factor)
        return pa.table(dict(zip(("query_id", key, "score"), map(pa.array, columns))))

    at = ["_length", "_shard", "_block"]
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(search, f"query_id long, `{key}` long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", key, "score")
