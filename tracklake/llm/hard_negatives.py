"""Hard negatives by bounds along a spanning tree of anchors.

Components are scaled to integers, so scores are exact. Anchors are dealt into blocks, rows into shards, and
a task meets one block with one shard. In a block the anchors are joined by a minimum spanning tree of their
distances. At its root all rows are scored; from a parent to its child a row's score moves by no more than
the edge's length times the row's norm, which bounds it there. Only rows whose bounds overlap what an anchor
looks for are scored again. That happens twice: for the nearest rows of the anchor's own label, where the
window opens at the best lower bounds, and for rows of other labels within the windows of its positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracklake.session import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: Negatives score at least and at most so many hundredths of the positive.
LOW, HIGH = 30, 90
SHARD_ROWS = 4096
BLOCK_ROWS = 1024
#: Doubles hold integers up to this exactly; beyond it scores are added up as Python's integers.
EXACT = 1 << 52


def scaled(vector: str) -> Column:
    """Components times the scale, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def spanning_tree(points: np.ndarray) -> list[tuple[int, int, float]]:
    """(child, parent, length) of a minimum spanning tree, parents first; the root, row 0, has itself as parent."""
    n = len(points)
    squares = np.einsum("ij,ij->i", points, points)
    away, parent = np.full(n, np.inf), np.zeros(n, np.int64)
    inside = np.zeros(n, bool)
    edges, now = [(0, 0, 0.0)], 0
    inside[0] = True
    for _ in range(n - 1):
        near = np.maximum(squares + squares[now] - 2 * (points @ points[now]), 0)
        closer = ~inside & (near < away)
        away[closer], parent[closer] = near[closer], now
        now = int(np.where(inside, np.inf, away).argmin())
        inside[now] = True
        edges.append((now, int(parent[now]), float(np.linalg.norm(points[now] - points[parent[now]]))))
    return edges


def integers(*matrices: np.ndarray) -> list[np.ndarray]:
    """The matrices as doubles where all their products and sums are exact in them, else as Python's integers."""
    most = 1
    for m in matrices:
        most *= max((abs(int(v)) for v in (m.max(initial=0), m.min(initial=0))), default=0) + 1
    if most * 100 * max(1, matrices[0].shape[1]) < EXACT:
        return [m.astype(np.float64) for m in matrices]
    return [m.astype(object) for m in matrices]


class Bounds:
    """Scores of rows at the anchors of a tree, as bounds; ``rescored`` counts the rows scored exactly."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray):
        self.anchors, self.rows = integers(anchors, rows)
        flat, own = anchors.astype(np.float64), rows.astype(np.float64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", own, own))
        self.tree = spanning_tree(flat)
        # Room for rounding in distances, norms and the bounds themselves.
        self.room = 1 + 1e-6 * float(self.norms.max(initial=0)) * float(np.sqrt(np.einsum("ij,ij->i", flat, flat)).max(initial=0))
        self.rescored = 0

    def walk(self, wanted):
        """Yields per anchor (anchor, rows, their exact scores) of the rows that ``wanted(anchor, low, high)`` names."""
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        last = {parent: step for step, (_, parent, _) in enumerate(self.tree)}
        for step, (child, parent, length) in enumerate(self.tree):
            if step == 0:
                own = np.arange(len(self.rows))
                scores = self.rows @ self.anchors[child]
                low = high = scores.astype(np.float64)
            else:
                reach = length * self.norms + self.room
                low, high = bounds[parent][0] - reach, bounds[parent][1] + reach
                own = wanted(child, low, high)
                scores = self.rows[own] @ self.anchors[child]
                low[own] = high[own] = scores.astype(np.float64)
            self.rescored += len(own)
            yield child, own, scores
            bounds[child] = low, high
            # A parent whose children are done is needed no more.
            for done in {parent, child}:
                if last.get(done, -1) <= step:
                    bounds.pop(done, None)


def best_first(scores: np.ndarray, ids: np.ndarray, names: np.ndarray, most: int) -> np.ndarray:
    """The first so many places by falling score, then ascending id and name."""
    return np.lexsort((names, ids, -scores))[:most]


def nearest_in_shard(anchors: tuple, rows: tuple, k: int) -> list[tuple[int, int, int]]:
    """(anchor, row, score) of each anchor's k best rows other than itself."""
    (anchor_names, points), (names, ids, vectors) = anchors, rows
    bounds = Bounds(points, vectors)

    def wanted(anchor: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        # One more for the anchor itself. A row whose score is exact here has equal bounds, within the room.
        most = min(k + 1, len(low))
        return np.flatnonzero(high >= np.partition(low, len(low) - most)[len(low) - most])

    found = []
    for anchor, own, scores in bounds.walk(wanted):
        others = names[own] != anchor_names[anchor]
        own, scores = own[others], scores[others]
        found += [(anchor, int(own[p]), int(scores[p])) for p in best_first(scores, ids[own], names[own], k)]
    return found


def windows_of(scores: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """The least and largest integer score of a negative, for each positive score."""
    return [(-(-low * int(p) // 100), high * int(p) // 100) for p in scores]


def negatives_in_shard(anchors: tuple, rows: tuple, k: int, low: int, high: int) -> list[tuple[int, int, int, int]]:
    """(anchor, positive, row, score) of the k best rows of other labels in each positive's window."""
    (labels, points, positives), (names, ids, vectors, row_labels) = anchors, rows
    spans = [windows_of(p, low, high) for p in positives]
    bounds = Bounds(points, vectors)

    def wanted(anchor: int, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(least), bool)
        for a, b in set(spans[anchor]):
            if a <= b:
                inside |= (most >= a) & (least <= b)
        return np.flatnonzero(inside & (row_labels != labels[anchor]))

    found = []
    for anchor, own, scores in bounds.walk(wanted):
        other = row_labels[own] != labels[anchor]
        own, scores = own[other], scores[other]
        order = best_first(scores, ids[own], names[own], len(own))
        ranked = scores[order]
        for place, (a, b) in enumerate(spans[anchor]):
            if a <= b and len(ranked):
                fit = order[(ranked >= a) & (ranked <= b)][:k]
                found += [(anchor, place, int(own[p]), int(scores[p])) for p in fit]
    return found


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("_v").combine_chunks().flatten().to_numpy()
    return flat.reshape(table.num_rows, -1)


def _dealt(rows: DataFrame, most: int, seed: int, by: list[str]) -> DataFrame:
    """Deals rows out in parts of about ``most``: adds _part and _parts, per value of ``by``."""
    parts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts"))
    return rows.join(parts, by).withColumn("_part", F.pmod(F.xxhash64("_name", F.lit(seed)), F.col("_parts")).cast("int"))


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(256 x); a score is the integer inner product with the anchor, higher ones
    come first, ties by the smaller key. The rows for which the condition ``anchors`` holds are anchors. An
    anchor's positives are its ``positives`` first other rows of the same label; for each, the ``negatives``
    first rows of other labels follow that score from ``low`` to ``high`` hundredths of the positive.

    Rows with a null key, label or vector or a null or non-finite component take no part; vectors meet those
    of their own length; zero vectors take part. Equal rows count once; different rows of one key are rows
    of their own, after its smaller ones in an order of their contents. An anchor without positives, or a
    positive without negatives, gives no rows; an empty table gives none. Other columns are ignored. Scaled
    components and scores must fit 64 bits; no intermediate result needs to.

    Anchors are a stated set of queries, so work grows with anchors times rows; a task holds about
    ``block_rows`` of the one and ``shard_rows`` of the other.
    """
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(usable & finite & (F.size(vector) > 0)).withColumn("_anchor", F.coalesce(anchors, F.lit(False)))
    rows = rows.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("long").alias("_label"), F.col(vector).alias("_raw"), scaled(vector).alias("_v"), "_anchor")
    rows = rows.distinct().withColumn("_size", F.size("_v"))
    content = F.md5(F.concat_ws(",", F.col("_raw").cast("array<string>")).cast("binary"))
    rows = materialize(rows.withColumn("_name", F.concat_ws(":", "_id", "_label", content)).drop("_raw"))
    chosen = rows.filter("_anchor").drop("_anchor")
    rows = rows.drop("_anchor")

    def met(left: DataFrame, right: DataFrame, by: list[str], search, schema: str, extra: list[str]) -> DataFrame:
        """Runs ``search`` on every block of anchors and every shard of rows that agree in ``by``."""
        blocks, shards = _dealt(left, block_rows, 1, by), _dealt(right, shard_rows, 2, by)
        counts = blocks.select(*by, F.col("_parts").alias("_blocks")).distinct().join(shards.select(*by, F.col("_parts").alias("_shards")).distinct(), by)
        counts = materialize(counts)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        row = ["_name", "_id", "_label", "_v"]
        one = blocks.join(counts, by).select(*row, *extra, *by[:1], F.col("_part").alias("_i"), every("_shards").alias("_j"))
        other = shards.join(counts, by).select(*[F.col(c).alias(c) for c in row], F.col("_size").alias("_size"), every("_blocks").alias("_i"), F.col("_part").alias("_j"))
        at = ["_size", "_i", "_j"]
        if "_label" in by:
            at.append("_label")

        def search_pair(block: pa.Table, shard: pa.Table) -> pa.Table:
            names = [f.strip().rsplit(" ", 1)[0] for f in schema.split(",")]
            found = search(block, shard) if block.num_rows and shard.num_rows else []
            columns = list(zip(*found)) if found else [()] * len(names)
            kinds = [pa.string() if f.strip().endswith("string") else pa.int64() for f in schema.split(",")]
            return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

        return one.groupBy(*at).cogroup(other.groupBy(*at)).applyInArrow(search_pair, schema)

    def find_positives(block: pa.Table, shard: pa.Table) -> list[tuple]:
        anchor_names, names = (np.array(t.column("_name").to_pylist(), object) for t in (block, shard))
        ids = shard.column("_id").to_numpy()
        found = nearest_in_shard((anchor_names, _matrix(block)), (names, ids, _matrix(shard)), positives)
        return [(anchor_names[a], names[r], int(ids[r]), s) for a, r, s in found]

    near = met(chosen, rows, ["_size", "_label"], find_positives, "anchor string, positive string, positive_id long, positive_score long", [])
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    near = materialize(near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives))
    listed = near.groupBy(F.col("anchor").alias("_name")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("_positives"))
    asked = materialize(chosen.join(listed, "_name"))

    def find_negatives(block: pa.Table, shard: pa.Table) -> list[tuple]:
        held = block.column("_positives").to_pylist()
        anchor_names, anchor_ids = block.column("_name").to_pylist(), block.column("_id").to_pylist()
        names, ids = np.array(shard.column("_name").to_pylist(), object), shard.column("_id").to_numpy()
        own = (block.column("_label").to_numpy(), _matrix(block), [[p["positive_score"] for p in ps] for ps in held])
        found = negatives_in_shard(own, (names, ids, _matrix(shard), shard.column("_label").to_numpy()), negatives, low, high)
        out = []
        for a, p, r, s in found:
            positive = held[a][p]
            out.append((anchor_names[a], positive["place"], anchor_ids[a], positive["positive_id"], positive["positive_score"], names[r], int(ids[r]), s))
        return out

    schema = "anchor string, place long, anchor_id long, positive_id long, positive_score long, negative string, negative_id long, negative_score long"
    hard = met(asked, rows, ["_size"], find_negatives, schema, ["_positives"])
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "negative")
    ranked = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """The query's result in SQL, every anchor against every row."""
    return f"""WITH good AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
    scores AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
        FROM good a JOIN good r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
    ranked AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
        FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
            AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {NEGATIVES}"""
