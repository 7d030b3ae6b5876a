"""Connected components of a graph given by its edges, without a whole component in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.session import materialize

#: Rows of a forest, two numbers each, that one task may join; a larger one takes rounds of shuffles.
FEW_EDGES = 200_000
#: Edges that a task gathers before it reduces them to a forest.
FOREST_ROWS = 1_000_000


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges, ascending, and for each the smallest node that the edges join it to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, (a, b) = np.arange(len(nodes)), np.split(at, 2)
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, above := up[up]):
            up = above
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[up]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (a, b) reduced to a spanning forest of as many components: each node and its smallest."""
    parts, rows = [np.zeros((2, 0), np.int64)], 0
    for batch in batches:
        parts.append(np.stack([batch.column(k).to_numpy() for k in (0, 1)]))
        rows += batch.num_rows
        if rows > FOREST_ROWS:
            parts, rows = [np.stack(spanning(*np.concatenate(parts, axis=1)))], 0
    nodes, lowest = spanning(*np.concatenate(parts, axis=1))
    yield pa.record_batch([pa.array(nodes), pa.array(lowest)], names=["a", "b"])


def _point_to(edges: DataFrame, nearest: DataFrame, condition: str) -> DataFrame:
    """Replaces each edge (a, b) by (b, the smallest neighbour of a) where ``condition`` holds."""
    moved = edges.join(nearest, "a").filter(condition).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(node, component) for every node of an edge; a component is named by its smallest node.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to its smallest
    neighbour, then its smaller ones and itself are. Both are a minimum per node, which is combined before
    the shuffle, and a join back, so a node may have any number of neighbours; the number of rounds grows
    with the logarithm of the number of nodes. Each round is a written table. Null ends are ignored.

    Edges of long numbers are first reduced to a spanning forest by each task that reads them, and forests of
    ``FEW_EDGES`` rows together at most are joined in one task, since rounds take as long for few rows as for many.
    """
    a, b = F.col(first), F.col(second)
    ends = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    numbers = {kind for _, kind in ends.dtypes} == {"bigint"}
    # A forest has a row for each root too, which the rounds need not see.
    now = materialize(ends.mapInArrow(_forest, "a long, b long").filter("a <> b") if numbers else ends.distinct())
    before = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if numbers and found[0] <= FEW_EDGES:
            return now.coalesce(1).mapInArrow(_forest, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("component"))
        if tuple(found) == before:
            break
        before = tuple(found)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = materialize(_point_to(both, nearest, "b > a").select("a", "b"))
        # Now a > b in every row. The smallest neighbour of a node takes over the node's other smaller ones.
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _point_to(large, nearest, "b <> m").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = materialize(small.union(nearest.select("a", F.col("m").alias("b"))).distinct())
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
