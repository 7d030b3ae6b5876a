"""Near copies among vectors by a subspace pigeonhole join.

Unit vectors are rotated and cut into blocks of a few dimensions. The squared distance of two vectors is
the sum over their blocks, so vectors within a squared distance lie, in one block at least, within the
block's proportional share of it. Vectors are dealt once, by a grid over the first rotated dimensions, into
groups and these into parts of bounded size; a tile is two parts of groups that a link may join. A tile tests
each of its pairs in all blocks under their shares, so a vector is sent to as many tiles as there are parts,
not once more for each block. What a block finds is verified exactly, on the vectors as they are given. Equal
vectors are one class throughout, and a tile hands on counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.columns import dots, usable_vector, vectors_of
from tracklake.llm.components import components
from tracklake.session import materialize

BLOCK_DIMENSIONS = 16
GRID_DIMENSIONS = 2
CELL = 0.25
#: Rows of a part: a table's share of ``PARTS``, within these bounds. So a vector is sent to about PARTS tiles
#: whatever the number of vectors, up to PARTS * MOST_TILE_ROWS of them.
TILE_ROWS, MOST_TILE_ROWS, PARTS = 4096, 32768, 16
SIEVE_ROWS, SIEVE_COLUMNS = 512, 2048
PAIRS_AT_ONCE = 40_000
#: Room for rounding in the single-precision sieve.
SIEVE_ROOM = 1e-4


def rotation(dimensions: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dimensions).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their components near one, which leaves every cosine as it is."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Rotated unit vectors."""
    return (vectors / np.sqrt(dots(vectors, vectors))[:, None]) @ rotation(vectors.shape[1]).T


def unpacked(column: pa.Array, kind: str, dimensions: int) -> np.ndarray:
    """Vectors of doubles, scaled, from the bytes of the given ones."""
    return scaled(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dimensions).astype(np.float64))


def block_edges(dimensions: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK_DIMENSIONS, dimensions)) for a in range(0, dimensions, BLOCK_DIMENSIONS)]


def shares(dimensions: int, square: float) -> np.ndarray:
    return np.array([square * (e - s) / dimensions for s, e in block_edges(dimensions)])


class Forest:
    """Which rows of a tile hang together, and the links that first joined them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        label = self.label
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            p, q = self._find(x), self._find(y)
            if p != q:
                self.label[max(p, q)] = min(p, q)
                self.links.append((x, y))
        while (self.label[self.label] != self.label).any():
            self.label = self.label[self.label]


def sieve(own: np.ndarray, others: np.ndarray, share: np.ndarray, both: bool):
    """Places (i, j) of pairs within a block's share in one block at least; with ``both`` those with i < j.

    Columns are prepared so that a product of matrices gives a block's squared distances.
    """
    one = lambda x: np.ones((len(x), 1), np.float32)
    blocks = []
    for start, end in block_edges(own.shape[1]):
        a, b = own[:, start:end].astype(np.float32), others[:, start:end].astype(np.float32)
        a = np.concatenate([-2 * a, (a * a).sum(1, keepdims=True), one(a)], 1)
        blocks.append((a, np.concatenate([b, one(b), (b * b).sum(1, keepdims=True)], 1).T.copy()))
    for row in range(0, len(own), SIEVE_ROWS):
        for column in range(row // SIEVE_COLUMNS * SIEVE_COLUMNS if both else 0, len(others), SIEVE_COLUMNS):
            near = None
            for (a, b), most in zip(blocks, share):
                within = a[row : row + SIEVE_ROWS] @ b[:, column : column + SIEVE_COLUMNS] <= most + SIEVE_ROOM
                near = within if near is None else near | within
            i, j = np.nonzero(near)
            i, j = i + row, j + column
            if both:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), PAIRS_AT_ONCE):
                yield i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]


def join_tile(square: float, cosine: float, home: tuple, other: tuple | None) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links of a tile: per class the number of vectors it links with, and joining links between classes.

    ``home`` and ``other`` are (classes, sizes, vectors) of parts without a class in common; without ``other``
    the pairs within ``home`` are meant.
    """
    both = other is None
    (ids, sizes, given), (other_ids, other_sizes, others_given) = home, home if both else other
    own = rotated(given)
    others = own if both else rotated(others_given)
    squares, other_squares = dots(given, given), dots(others_given, others_given)
    names = ids if both else np.concatenate([ids, other_ids])
    shift = 0 if both else len(ids)
    counts, forest = np.zeros(len(names), np.int64), Forest(len(names))
    for x, y in sieve(own, others, shares(own.shape[1], square), both):
        link = dots(given[x], others_given[y]) / np.sqrt(squares[x] * other_squares[y]) >= cosine
        x, y = x[link], y[link]
        np.add.at(counts, x, other_sizes[y])
        np.add.at(counts, shift + y, sizes[x])
        forest.add(x, shift + y)
    found = {int(names[k]): int(counts[k]) for k in np.flatnonzero(counts)}
    return found, [(int(names[x]), int(names[y])) for x, y in forest.links]


def groups(cells: list[tuple[int, int, int]], most: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Cells (x, y, rows) as groups, each a list of cells and its number of parts of about ``most`` rows.

    Neighbouring cells are put together while they fit into one part.
    """
    out, now, filled = [], [], 0
    for x, y, n in sorted(cells):
        if now and filled + n > most:
            out.append((now, -(-filled // most)))
            now, filled = [], 0
        now, filled = [*now, (x, y)], filled + n
    return [*out, (now, -(-filled // most))] if now else out


def apart(a: list[tuple[int, int]], b: list[tuple[int, int]], square: float) -> bool:
    """No link can join the two groups, as the grid's dimensions alone keep all their cells further apart."""
    gap = lambda p, q: max(abs(p - q) - 1, 0) * CELL
    return min(gap(p[0], q[0]) ** 2 + gap(p[1], q[1]) ** 2 for p in a for q in b) > square + SIEVE_ROOM


def near_vectors(vectors: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: ``key``, n_links, component_id (smallest key reachable by links), kept.

    Two vectors link when their cosine is at least ``cosine``; every link counts. Null and zero vectors
    and those with null or non-finite components link with nothing, nor do vectors of different lengths or
    with a null key, whose component is null. Equal rows are vectors of their own. An empty table gives an
    empty result; other columns are ignored.
    """
    text = F.concat_ws(",", F.col(vector).cast("array<string>"))
    valid = F.col(key).isNotNull() & usable_vector(vector)
    named = vectors.select(key, F.when(valid, F.md5(text.cast("binary"))).alias("name"), F.when(valid, F.col(vector)).alias("_vector"))
    named = materialize(named.withColumnRenamed(key, "_key"))
    classes = named.filter("name is not null").groupBy("name").agg(
        F.min("_key").alias("class"), F.count(F.lit(1)).alias("size"), F.min("_vector").alias("_vector")
    )
    classes = materialize(classes.withColumn("_length", F.size("_vector")))
    square = 2 - 2 * cosine
    counts = edges = None
    # As many rounds as there are lengths of vectors; a table has one.
    for (dimensions,) in classes.select("_length").distinct().orderBy("_length").collect():
        found = materialize(_links(classes.filter(F.col("_length") == dimensions), dimensions, square, cosine))
        own = found.filter("other is null").select("class", "n")
        joined = found.filter("other is not null").select("class", "other")
        counts, edges = (own, joined) if counts is None else (counts.union(own), edges.union(joined))
    result = named.select("_key", "name").join(classes.select("name", "class", "size"), "name", "left")
    if counts is None:
        result = result.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("_key")})
    else:
        links = counts.groupBy("class").agg(F.sum("n").alias("_n"))
        whole = components(edges, "class", "other").withColumnRenamed("node", "class")
        per_class = classes.select("class").join(links, "class", "left").join(whole, "class", "left")
        result = result.join(per_class, "class", "left").select(
            "_key",
            F.coalesce(F.col("size") - 1 + F.coalesce("_n", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "class", "_key").alias("component_id"),
        )
    return result.select(F.col("_key").alias(key), "n_links", "component_id", F.coalesce(F.col("_key") == F.col("component_id"), F.lit(False)).alias("kept"))


TILE = ["a", "b", "i", "j"]


def tiles(classes: DataFrame, kind: str, square: float) -> tuple[DataFrame, DataFrame]:
    """The rows of all tiles, at home and other: a, b (groups), i, j (their parts), class, size, given.

    The tile of a part with itself has no other rows.
    """
    spark = classes.sparkSession

    def pack(batches):
        for batch in batches:
            given = vectors_of(batch.column(2)).astype(kind)
            grid = np.zeros((len(given), 2), np.int32)
            at = rotated(scaled(given.astype(np.float64)))[:, :GRID_DIMENSIONS]
            grid[:, : at.shape[1]] = np.floor(at / CELL)
            columns = [pa.array([g.tobytes() for g in given], pa.binary()), pa.array(grid[:, 0]), pa.array(grid[:, 1])]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["class", "size", "given", "x", "y"])

    packed = materialize(classes.select("class", "size", "_vector").mapInArrow(pack, "class long, size long, given binary, x int, y int"))
    # The grid has a fixed number of cells, since no component exceeds one.
    cells = [tuple(r) for r in packed.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()]
    most = min(MOST_TILE_ROWS, max(TILE_ROWS, -(-sum(n for *_, n in cells) // PARTS)))
    dealt = groups(cells, most)
    named = [(x, y, g, parts) for g, (own, parts) in enumerate(dealt) for x, y in own]
    met = [
        (a, b, n)
        for a, (own, _) in enumerate(dealt)
        for b, (others, n) in enumerate(dealt)
        if not apart(own, others, square)
    ]
    named = spark.createDataFrame(named, "x int, y int, a int, parts int")
    met = F.broadcast(spark.createDataFrame(met, "a int, b int, others int"))
    part = F.pmod(F.xxhash64("class", F.lit(3)), F.col("parts")).cast("int")
    placed = packed.join(F.broadcast(named), ["x", "y"]).withColumn("own", part).join(met, "a")
    # A pair of parts is met once: the one of the earlier group, in a group the earlier part, is at home.
    every = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    spread = placed.select("class", "size", "given", "a", "b", "own", every.alias("at"))
    tile = lambda *names: [F.col(c).alias(n) for c, n in zip(names, TILE)]
    row = [F.col(c).alias(c) for c in ("class", "size", "given")]
    left = spread.filter("a < b or (a = b and own <= at)").select(*tile("a", "b", "own", "at"), *row)
    right = spread.filter("a > b or (a = b and own > at)").select(*tile("b", "a", "at", "own"), *row)
    return left, right


def _links(classes: DataFrame, dimensions: int, square: float, cosine: float) -> DataFrame:
    """Rows (class, null, n) with numbers of links and (class, other, null) that join classes."""
    kind = "f4" if classes.schema["_vector"].dataType.elementType.simpleString() == "float" else "f8"

    def join(key: tuple, home: pa.Table, other: pa.Table) -> pa.Table:
        a, b, i, j = (k.as_py() for k in key)
        within, counts, links = (a, i) == (b, j), {}, []
        if home.num_rows and (other.num_rows or within):
            side = lambda t: (t.column("class").to_numpy(), t.column("size").to_numpy(), unpacked(t.column("given"), kind, dimensions))
            counts, links = join_tile(square, cosine, side(home), None if within else side(other))
        return pa.table(
            {
                "class": pa.array([*counts, *(a for a, _ in links)], pa.int64()),
                "other": pa.array([None] * len(counts) + [b for _, b in links], pa.int64()),
                "n": pa.array([*counts.values()] + [None] * len(links), pa.int64()),
            }
        )

    left, right = tiles(classes, kind, square)
    return left.groupBy(*TILE).cogroup(right.groupBy(*TILE)).applyInArrow(join, "class long, other long, n long")
