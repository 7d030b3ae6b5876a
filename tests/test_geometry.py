import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tracklake import schemas
from tracklake.functions import geometry
from tracklake.operators.polygons import points_in_polygons, polygon_edges


def inside_exactly(x, y, ring):
    """Even-odd rule in rational arithmetic; points on an edge are outside."""
    x, y = Fraction(x), Fraction(y)
    odd = False
    for (ax, ay), (bx, by) in zip(ring[-1:] + ring[:-1], ring):
        ax, ay, bx, by = map(Fraction, (ax, ay, bx, by))
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return False
        if (ay > y) != (by > y):
            odd ^= x < ax + (bx - ax) * (y - ay) / (by - ay)
    return odd


def flags(spark, points, ring):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lat double, lon double")
    flag = geometry.point_in_polygon(F.col("lat"), F.col("lon"), ring)
    return [r[0] for r in df.orderBy("i").select(flag).collect()]


SHAPES = {
    "rectangle": [(1, 1), (1, 5), (7, 5), (7, 1)],
    "triangle": [(0, 0), (8, 1), (3, 7)],
    "concave": [(0, 0), (8, 0), (8, 3), (4, 3), (4, 8), (0, 8)],
    "comb": [(0, 0), (8, 0), (8, 8), (6, 2), (5, 8), (4, 2), (3, 8), (2, 2), (1, 8)],
    "crossing": [(0, 0), (8, 8), (8, 0), (0, 8)],
    "closed": [(0, 0), (8, 1), (3, 7), (0, 0)],
    "repeated": [(0, 0), (0, 0), (8, 1), (8, 1), (3, 7)],
    "flat": [(0, 0), (4, 4), (8, 8)],
    "peak on a level edge": [(0, 0), (4, 4), (8, 0), (8, 4), (4, 8), (0, 4)],
}


@pytest.mark.parametrize("limit", [geometry.UNROLLED_EDGES, 0])
@pytest.mark.parametrize("name", SHAPES)
def test_all_grid_points(spark, monkeypatch, name, limit):
    monkeypatch.setattr(geometry, "UNROLLED_EDGES", limit)
    points = [(x / 2, y / 2) for x in range(-1, 18) for y in range(-1, 18)]
    ring = SHAPES[name]
    assert flags(spark, points, ring) == [inside_exactly(x, y, ring) for x, y in points]


def test_points_within_rounding_of_an_edge(spark):
    rng = random.Random(3)
    ring = [(38.1234567, -9.7654321), (38.9876543, -9.1111117), (38.3333333, -9.0000001)]
    points = []
    for _ in range(300):
        i, t = rng.randrange(3), rng.random()
        (ax, ay), (bx, by) = ring[i - 1], ring[i]
        points.append((ax + (bx - ax) * t, ay + (by - ay) * t))
    assert flags(spark, points, ring) == [rounded_inside(x, y, ring) for x, y in points]


def rounded_inside(x, y, ring):
    """As inside_exactly, but on the rounded differences to the point, which is what is defined."""
    moved = [(vx - x, vy - y) for vx, vy in ring]
    return inside_exactly(0, 0, moved)


def test_ring_of_two_vertices(spark):
    with pytest.raises(ValueError):
        geometry.point_in_polygon(F.col("lat"), F.col("lon"), [(0, 0), (1, 1)])
    short = spark.createDataFrame([("p", [(0.0, 0.0), (1.0, 1.0)])], schemas.POLYGONS)
    with pytest.raises(Exception, match="at least 3 vertices"):
        polygon_edges(short).collect()


def test_edges_close_the_ring(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    edges = polygon_edges(spark.createDataFrame([("p", ring)], schemas.POLYGONS)).orderBy("pos")
    assert [tuple(r)[2:] for r in edges.collect()] == [
        (0.0, 1.0, 0.0, 0.0),
        (0.0, 0.0, 1.0, 0.0),
        (1.0, 0.0, 0.0, 1.0),
    ]


def test_polygon_text(spark):
    df = spark.createDataFrame([("p", [(1.0, 2.5), (-3.0, 4.0), (1e-7, 0.0)])], schemas.POLYGONS)
    assert df.select(geometry.polygon_text(F.col("ring"))).first()[0] == "1.0 2.5 -3.0 4.0 1.0E-7 0.0"


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_many_polygons_against_brute_force(spark, broadcast):
    rng = random.Random(5)
    rings = []
    for i in range(60):
        x, y, size = rng.uniform(-5, 5), rng.uniform(-5, 5), 2.0 ** rng.randrange(-5, 4)
        corners = [(x + rng.uniform(0, size), y + rng.uniform(0, size)) for _ in range(rng.randrange(3, 8))]
        rings.append((str(i), corners))
    rings.append(("grid", [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]))
    points = [(i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(500)]
    points += [(1000 + i, 0.5, 0.5) for i in range(250)]  # a third of the points in one place
    points += [(2000 + i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (0.5, 0.0), (1.0, 1.0)])]
    result = points_in_polygons(
        spark.createDataFrame(points, "id long, lat double, lon double"),
        spark.createDataFrame(rings, schemas.POLYGONS),
        cell=0.1,
        max_broadcast_vertices=broadcast,
    )
    found = sorted((r.id, r.polygon_id) for r in result.collect())
    expected = sorted(
        (i, name) for i, x, y in points for name, ring in rings if rounded_inside(x, y, ring)
    )
    assert found == expected


def test_no_polygons(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lat double, lon double")
    none = spark.createDataFrame([], schemas.POLYGONS)
    assert points_in_polygons(points, none).isEmpty()


def test_large_polygon_in_a_table(spark):
    rng = random.Random(8)
    ring = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(80)]
    points = [(i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(200)]
    points += [(1000 + i, *v) for i, v in enumerate(ring)]
    result = points_in_polygons(
        spark.createDataFrame(points, "id long, lat double, lon double"),
        spark.createDataFrame([("p", ring)], schemas.POLYGONS),
    )
    wanted = sorted(i for i, x, y in points if rounded_inside(x, y, ring))
    assert sorted(r.id for r in result.collect()) == wanted
    flag = flags(spark, [p[1:] for p in points], ring)
    assert sorted(p[0] for p, f in zip(points, flag) if f) == wanted


def test_points_in_one_file_are_dealt_out(spark):
    """The join of a few points with many polygons is not the work of one task."""
    points = spark.createDataFrame([(1, 0.5, 0.5)], "id long, lat double, lon double").coalesce(1)
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    table = spark.createDataFrame([("a", ring)], "polygon_id string, ring array<struct<lat:double,lon:double>>")
    found = points_in_polygons(points, table, 0.1)
    assert found.rdd.getNumPartitions() > 1 and [tuple(r) for r in found.collect()] == [(1, 0.5, 0.5, "a")]
