"""Joining points with a table of polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions.geometry import (
    Ring,
    checked_ring,
    directed_edges,
    edge_arrays,
    inside_edge_arrays,
    point_in_polygon,
    ring_edges,
)
from tracklake.operators.polygon_tiles import BOX, box_columns, points_in_rings

#: Beyond so many polygons points are not compared with each by a broadcast.
MOST_BROADCAST = 64
#: Points that a task holds, about, and edges that are tested with points at once.
PART_POINTS, TESTS_AT_ONCE = 50_000, 60_000


def points_inside(points: DataFrame, ring: Ring) -> DataFrame:
    """The points in the interior of one ring; its box reaches the scan as pushed filters."""
    return points.where(point_in_polygon(F.col("lat"), F.col("lon"), ring))


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """Rings as edge rows in order: (polygon_id, pos, lat1, lon1, lat2, lon2)."""
    exploded = polygons.select("polygon_id", F.posexplode(ring_edges(F.col("ring"))).alias("pos", "_e"))
    return exploded.select("polygon_id", F.col("pos").cast("long").alias("pos"), "_e.*")


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / size)


def _gridded(polygons: DataFrame, cell: float) -> DataFrame:
    """Edges and box of each polygon, with the grid level whose cells are as large as its box."""
    ring = F.col("ring")
    boxed = polygons.select("polygon_id", "ring", directed_edges(ring).alias("_edges")).withColumns(box_columns(ring))
    extent = F.greatest(F.col("_maxlat") - F.col("_minlat"), F.col("_maxlon") - F.col("_minlon"))
    # Cells at least half as large as the box, so that it meets three of them at most in each direction.
    level = F.ceil(F.log2(F.greatest(extent / F.lit(2 * cell), F.lit(1.0)))).cast("int")
    columns = {"_level": level, "_is_box": _is_box(), "_arrays": edge_arrays(F.col("_edges"))}
    return boxed.withColumns(columns).drop("ring", "_edges")


def _boxed(polygons: DataFrame) -> DataFrame:
    """Rings with their boxes, and whether a ring is its box."""
    ring = checked_ring(F.col("ring"))
    boxed = polygons.select("polygon_id", ring.alias("ring")).withColumns(box_columns(F.col("ring")))
    upright = boxed.withColumn("_edges", directed_edges(F.col("ring"))).withColumn("_is_box", _is_box())
    return upright.select("polygon_id", "ring", *BOX, "_is_box")


def _is_box() -> Column:
    """The ring is an upright rectangle, for which the box test is the whole test."""
    at_corner = lambda c: (
        c.lat.isin(F.col("_minlat"), F.col("_maxlat")) & c.lon.isin(F.col("_minlon"), F.col("_maxlon"))
    )
    upright = lambda e: (e.px == e.qx) | (e.py == e.qy)
    return (
        (F.size("ring") == 4)
        & (F.size(F.array_distinct("ring")) == 4)
        & F.forall("ring", at_corner)
        & F.forall("_edges", upright)
    )


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    cell: float = 0.01,
    max_broadcast_vertices: int = 250_000,
    returned: list[str] | None = None,
) -> DataFrame:
    """Every (point, polygon) pair with the point in the polygon's interior.

    Adds ``polygon_id`` to the point columns, or to those named in ``returned``. The polygon table is measured first.
    Up to ``MOST_BROADCAST`` polygons of together ``max_broadcast_vertices`` are broadcast, and the points are only dealt
    out evenly, since a few points may stand for most of the work: an equi join on grid cells, then the box, then the
    exact test. A polygon goes to the grid level that fits its size and so into nine cells at most, however large it
    is; a point goes into one cell of each level in use. More polygons meet the points in tiles (``polygon_tiles``).
    """
    names = points.columns if returned is None else returned
    grid = _gridded(polygons, cell)
    # A row per doubling from the cell to the globe, whatever the number of polygons.
    used = (
        grid.groupBy("_level")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.size("_arrays.px")).alias("vertices"),
            F.max(F.size("_arrays.px")).alias("most"),
        )
        .orderBy("_level")
        .collect()
    )
    if sum(r.vertices for r in used) > max_broadcast_vertices or sum(r.n for r in used) > MOST_BROADCAST:
        dealt_out = polygons.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return points_in_rings(points, _boxed(dealt_out), ["polygon_id", "ring"], names, PART_POINTS, TESTS_AT_ONCE)
    most = max((r.most for r in used), default=0)

    def size(level: Column) -> Column:
        return F.lit(cell) * F.pow(F.lit(2.0), level)

    span = lambda low, high: F.explode(
        F.sequence(_cell(F.col(low), size(F.col("_level"))), _cell(F.col(high), size(F.col("_level"))))
    )
    cells = grid.withColumn("_x", span("_minlat", "_maxlat")).withColumn(
        "_y", span("_minlon", "_maxlon")
    )
    levels = F.array(*[F.lit(r["_level"]) for r in used]).cast("array<int>")
    # However few files the points come in.
    dealt_out = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = (
        dealt_out.withColumn("_level", F.explode(levels))
        .withColumn("_x", _cell(F.col("lat"), size(F.col("_level"))))
        .withColumn("_y", _cell(F.col("lon"), size(F.col("_level"))))
    )
    lat, lon = F.col("lat"), F.col("lon")
    in_box = (
        (lat > F.col("_minlat"))
        & (lat < F.col("_maxlat"))
        & (lon > F.col("_minlon"))
        & (lon < F.col("_maxlon"))
    )
    return (
        placed.join(F.broadcast(cells), ["_level", "_x", "_y"])
        .where(in_box & (F.col("_is_box") | inside_edge_arrays(lat, lon, F.col("_arrays"), most)))
        .select(*names, "polygon_id")
    )
