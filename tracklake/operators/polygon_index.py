"""Joining points with polygons of many vertices, by an index of their edges.

A polygon's box is cut into slabs of longitude and these into bands of latitude, about four cells a vertex in
all. An edge is tested in the cells it may meet only. Whatever else lies on the ray from a point, which goes
towards larger latitudes, is carried in from outside the cell: edges above it that cross the whole slab turn
the cell's parity, and where one ends within the slab, the longitude of that end does so for points behind it.
Two edges above a cell cancel at the vertex they share, so such ends remain only next to edges in the cell.

A ring that runs across its longitudes a few times only needs no index: few of its edges are above or below any
point, and they are found by sorting (``polygon_tiles``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracklake.functions.geometry import _is_odd_crossing, checked_ring, directed_edges, edges_total
from tracklake.operators.keys import broadcast_if_small
from tracklake.operators.polygon_tiles import BOX, before, few_at_once, points_in_rings, vertices
from tracklake.operators.polygons import points_in_polygons
from tracklake.session import materialize

CELLS_PER_VERTEX = 4
#: Cells are no smaller than this, in degrees, so that rounding stays far below their size.
LEAST_CELL = 1e-9
#: Rings that run across their longitudes more often are indexed.
MOST_TURNS = 16
#: Points that a task holds, about, and edges that are tested with points at once.
PART_POINTS, TESTS_AT_ONCE = 50_000, 60_000
FRAME = ["_ring", "_minlat", "_minlon", "_slabs", "_bands", "_slab", "_band"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the size and box of each ring, and how often it runs across its extent."""
    for batch in few_at_once(batches):
        lat, lon, starts = vertices(batch.column("ring"))
        (low, high, rises), (left, right, turns) = (_across(v, starts) for v in (lat, lon))
        measured = [pa.array(np.diff(starts), pa.int32())]
        measured += [pa.array(v, pa.float64(), from_pandas=True) for v in (low, high, left, right)]
        measured += [pa.array(v, pa.float64()) for v in (rises, turns)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *measured], [*batch.schema.names, "_size", *BOX, "_rises", "_turns"])


def _across(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least and greatest value of each ring, and how often the ring runs from one to the other."""
    low, high = (f.reduceat(values, starts[:-1]) for f in (np.fmin, np.fmax))
    way = np.add.reduceat(np.abs(values - before(values, starts)), starts[:-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        turns = np.where(high > low, way / (high - low), 1.0)
    return low, high, np.fmax(turns, 1.0)


def frames(polygons: DataFrame) -> DataFrame:
    """Stored rings with the grid of each: slabs and bands, more of them where the ring turns more often."""
    c = F.col
    dealt_out = polygons.repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt_out.select("polygon_id", checked_ring(c("ring")).alias("ring"), F.monotonically_increasing_id().alias("_ring"))
    measures = "_size int, " + ", ".join(f"{n} double" for n in (*BOX, "_rises", "_turns"))
    measured = T.StructType([*rows.schema, *T.StructType.fromDDL(measures)])
    # Written once, since rings are most of the work folder.
    boxed = materialize(rows.mapInArrow(_measure, measured))
    height, width = c("_maxlat") - c("_minlat"), c("_maxlon") - c("_minlon")
    cells = c("_size") * CELLS_PER_VERTEX
    # An edge meets about one slab for each crossing of a slab's bounds, so fewer slabs where it turns along them.
    wanted = F.round(F.sqrt(cells * c("_rises") / c("_turns")))
    fit = lambda n, extent: F.greatest(F.least(n, cells, F.floor(extent / LEAST_CELL)), F.lit(1)).cast("int")
    cut = boxed.withColumn("_slabs", fit(wanted, width))
    cut = cut.withColumn("_bands", fit(F.ceil(cells / c("_slabs")), height))
    step = lambda extent, n: F.when(extent > 0, extent / c(n)).otherwise(F.lit(1.0))
    return cut.withColumns({"_slab": step(width, "_slabs"), "_band": step(height, "_bands")})


def _place(value: Column, low: str, step: str, count: str) -> Column:
    """The slab or band of a value; never falls as the value rises, so ranges of places hold all between."""
    at = F.floor((value - F.col(low)) / F.col(step))
    return F.greatest(F.least(at, F.col(count) - 1), F.lit(0)).cast("int")


def slab_of(lon: Column) -> Column:
    return _place(lon, "_minlon", "_slab", "_slabs")


def band_of(lat: Column) -> Column:
    return _place(lat, "_minlat", "_band", "_bands")


def _bands(e: Column, slab: Column) -> tuple[Column, Column]:
    """The first and last band that an edge may meet within a slab."""
    start = F.col("_minlon") + slab * F.col("_slab")
    room = F.col("_slab") * 1e-3
    slope = F.try_divide(e.qx - e.px, e.qy - e.py)
    at = lambda lon: e.px + slope * (lon - e.py)
    one, other = at(F.greatest(e.py, start - room)), at(F.least(e.qy, start + F.col("_slab") + room))
    low, high = band_of(e.min_x), band_of(e.max_x)
    whole = slab_of(e.py) == slab_of(e.qy)
    first = F.when(whole, low).otherwise(F.greatest(low, band_of(F.least(one, other)) - 1))
    last = F.when(whole, high).otherwise(F.least(high, band_of(F.greatest(one, other)) + 1))
    return first, last


def edge_cells(framed: DataFrame) -> DataFrame:
    """The index: _ring, _i (slab), _j (band), parity, ends (longitudes), edges.

    Cells that no point is inside of are left out, so a point without a cell is outside.
    """
    edges = directed_edges(F.col("ring"))
    # The edge that ends at each vertex and the one that starts there.
    turned = F.concat(F.slice(edges, 2, F.size(edges)), F.slice(edges, 1, 1))
    ends = F.transform(F.col("ring"), lambda c: c.lon)
    pairs = F.arrays_zip(edges.alias("e"), turned.alias("f"), ends.alias("lon"))
    rows = materialize(framed.select(*FRAME, F.inline(pairs)))

    e, f, i = F.col("e"), F.col("f"), F.col("_i")
    met = rows.select(*FRAME, "e", F.explode(F.sequence(slab_of(e.py), slab_of(e.qy))).alias("_i"))
    first, last = _bands(e, i)
    met = met.select("_ring", "_i", "e", (slab_of(e.py) < i).alias("_enters"), first.alias("_first"), last.alias("_last"))
    no_end, no_edge = F.lit(None).cast("double"), F.lit(None).cast(met.schema["e"].dataType)
    cell = lambda parity, end, edge: [parity.alias("parity"), end.alias("end"), edge.alias("edge")]
    near = met.select("_ring", "_i", F.explode(F.sequence("_first", "_last")).alias("_j"), *cell(F.lit(0), no_end, e))

    # Below an edge that enters the slab from the one before, the ray crosses it: counted from the top down.
    over = met.filter("_enters and _first > 0").groupBy("_ring", "_i", "_first").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("_ring", "_i").orderBy(F.desc("_first"))
    over = over.select("_ring", "_i", (F.sum("n").over(down) % 2).alias("odd"), "_first", F.coalesce(F.lead("_first").over(down), F.lit(0)).alias("_next"))
    turns = over.filter("odd = 1").select("_ring", "_i", F.explode(F.sequence("_next", F.col("_first") - 1)).alias("_j"), *cell(F.lit(1), no_end, no_edge))

    vertices = rows.withColumn("_i", slab_of(F.col("lon")))
    vertices = vertices.select("_ring", "_i", "lon", _bands(e, i)[0].alias("_a"), _bands(f, i)[0].alias("_b")).filter("_a <> _b")
    between = F.sequence(F.least("_a", "_b"), F.greatest("_a", "_b") - 1)
    stops = vertices.select("_ring", "_i", F.explode(between).alias("_j"), *cell(F.lit(0), F.col("lon"), no_edge))

    gathered = near.union(turns).union(stops).groupBy("_ring", "_i", "_j")
    return materialize(gathered.agg(F.max("parity").alias("parity"), F.collect_list("end").alias("ends"), F.collect_list("edge").alias("edges")))


def points_in_large_polygons(
    points: DataFrame, polygons: DataFrame, cell: float = 0.01, max_broadcast_edges: int = 250_000, returned: list[str] | None = None
) -> DataFrame:
    """Every (point, polygon) pair with the point in the polygon's interior, for rings of any length.

    As :func:`points_in_polygons`, which tests all edges of each polygon whose box a point is in; here a
    pair meets few of them. Rings that run across their longitudes ``MOST_TURNS`` times at most meet the points in tiles
    (``polygon_tiles``), and each point the edges at its longitude. For other rings boxes are joined first, on a grid as
    wide as ``cell``; the pairs meet the index, broadcast if it holds at most ``max_broadcast_edges``
    edges and ends, else both are shuffled by cell; a pair meets the edges of one cell, on average as many for
    a ring of a hundred vertices as for one of ten thousand. Where several edges crowd into one cell, as many
    are tested there; a ring that runs to and fro across its whole extent in both directions has more to test,
    by about the root of its length.
    """
    names = points.columns if returned is None else returned
    framed = frames(polygons)
    few = F.coalesce(F.col("_turns") <= MOST_TURNS, F.lit(False))
    often, plain = framed.where(~few), framed.where(few)
    by_tile = lambda rings: points_in_rings(points, rings.withColumn("_is_box", F.lit(False)), ["_ring"], names, PART_POINTS, TESTS_AT_ONCE)
    if often.isEmpty():
        return by_tile(framed)
    indexed = _met_by_cell(points, often, cell, max_broadcast_edges).select(*names, "polygon_id")
    return indexed if plain.isEmpty() else indexed.union(by_tile(plain))


def _in_boxes(points: DataFrame, framed: DataFrame, cell: float) -> DataFrame:
    """The points with the ``_ring`` whose box they are in."""
    corner = lambda lat, lon: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    corners = [corner(a, b) for a, b in (("_minlat", "_minlon"), ("_maxlat", "_minlon"), ("_maxlat", "_maxlon"), ("_minlat", "_maxlon"))]
    boxes = framed.select(F.col("_ring").alias("polygon_id"), F.array(*corners).alias("ring"))
    return points_in_polygons(points, boxes, cell).withColumnRenamed("polygon_id", "_ring")


def _met_by_cell(points: DataFrame, framed: DataFrame, cell: float, max_broadcast_edges: int) -> DataFrame:
    """The pairs inside, by the index of edges."""
    pairs = _in_boxes(points, framed, cell)
    known = broadcast_if_small(materialize(framed.select("polygon_id", *FRAME)))
    placed = pairs.join(known, "_ring").withColumns({"_i": slab_of(F.col("lon")), "_j": band_of(F.col("lat"))})
    index = edge_cells(framed)
    held = index.agg(F.sum(F.size("edges") + F.size("ends") + 1)).first()[0] or 0
    met = placed.join(F.broadcast(index) if held <= max_broadcast_edges else index, ["_ring", "_i", "_j"])
    behind = F.size(F.filter("ends", lambda end: end <= F.col("lon")))
    total = edges_total(F.col("lat"), F.col("lon"), F.col("edges")) + F.col("parity") + behind
    return met.where(_is_odd_crossing(total)).select(*points.columns, "polygon_id")
