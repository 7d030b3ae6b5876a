import math
import random

from pyspark.sql import functions as F
from test_geometry import SHAPES, inside_exactly

from tracklake.operators import polygon_index
from tracklake.operators.polygon_index import points_in_large_polygons

SCHEMA = "polygon_id string, ring array<struct<lat:double,lon:double>>"
POINTS = "id long, lat double, lon double"


def comb(n):
    """Teeth across the whole extent, one above the other."""
    return [(float(k), 0.0 if k % 4 in (0, 3) else 50.0) for k in range(n)] + [(float(n), -1.0), (0.0, -1.0)]


def star(draw, n, lat=0.0, lon=0.0, size=10.0):
    turns = [2 * math.pi * k / n for k in range(n)]
    return [(lat + r * math.cos(t), lon + r * math.sin(t)) for t in turns for r in [size * draw.uniform(0.4, 1)]]


def test_against_exact_arithmetic(spark):
    draw = random.Random(1)
    rings = {name: [tuple(map(float, p)) for p in ring] for name, ring in SHAPES.items()}
    rings |= {"star": star(draw, 300), "comb": comb(120), "wild": [(draw.randrange(20) / 1.0, draw.randrange(20) / 1.0) for _ in range(60)]}
    rings["long"] = [(draw.uniform(0, 20), draw.uniform(0, 20)) for _ in range(40)] + star(draw, 200, 5, 5, 3)
    rings["level"] = [(draw.randrange(5) / 1.0, 3.0) for _ in range(6)]
    rings["tiny"] = [(7 + 1e-10, 7.0), (7.0, 7 + 2e-10), (7 - 1e-10, 7 - 1e-10)]
    points = [(draw.uniform(-12, 60), draw.uniform(-12, 55)) for _ in range(150)]
    points += [(float(a), float(b)) for a in range(0, 21, 2) for b in range(0, 21, 3)] + [(a / 2, b / 2) for a in range(5, 16) for b in range(6, 17)]
    for ring in rings.values():
        points += draw.sample(ring, min(len(ring), 6))
        k = draw.randrange(len(ring))
        points.append(((ring[k][0] + ring[k - 1][0]) / 2, (ring[k][1] + ring[k - 1][1]) / 2))
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], POINTS)
    table = spark.createDataFrame(list(rings.items()), SCHEMA)
    expected = {(k, name) for name, ring in rings.items() for k, (a, b) in enumerate(points) if inside_exactly(a, b, ring)}
    for limit in (250_000, 0):
        got = [(r.id, r.polygon_id) for r in points_in_large_polygons(frame, table, 5.0, limit).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_rings_of_one_name_are_apart(spark):
    box = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    table = spark.createDataFrame([("a", box), ("a", box), ("a", [(x + 1, y) for x, y in box])], SCHEMA)
    frame = spark.createDataFrame([(1, 1.5, 1.0), (2, 0.5, 1.0), (3, None, 1.0)], POINTS)
    got = sorted((r.id, r.polygon_id) for r in points_in_large_polygons(frame, table).collect())
    assert got == [(1, "a")] * 3 + [(2, "a")] * 2
    assert points_in_large_polygons(frame, table.limit(0)).count() == 0


def test_edges_tested_stay_flat(spark):
    draw = random.Random(2)
    points = spark.createDataFrame([(k, draw.uniform(-10, 10), draw.uniform(-10, 10)) for k in range(2000)], POINTS)
    tested = {}
    for n in (100, 10_000):
        turns = [2 * math.pi * k / n for k in range(n)]
        ring = [((7 + 2 * math.sin(9 * t)) * math.cos(t), (7 + 2 * math.sin(9 * t)) * math.sin(t)) for t in turns]
        framed = polygon_index.frames(spark.createDataFrame([("s", ring)], SCHEMA))
        cells = polygon_index.edge_cells(framed)
        at = points.crossJoin(framed.select(*polygon_index.FRAME))
        at = at.withColumns({"_i": polygon_index.slab_of(F.col("lon")), "_j": polygon_index.band_of(F.col("lat"))})
        met = at.join(cells, ["_ring", "_i", "_j"], "left")
        tested[n] = met.agg(F.avg(F.coalesce(F.size("edges") + F.size("ends"), F.lit(0)))).first()[0]
        assert cells.agg(F.sum(F.size("edges") + F.size("ends") + 1)).first()[0] < 10 * n
    assert tested[10_000] < tested[100] + 1


def test_rings_that_seldom_turn_need_no_index(spark, monkeypatch):
    """They meet their points ring by ring, in several parts, with ties at vertices and on edges decided exactly."""
    monkeypatch.setattr(polygon_index, "edge_cells", None)
    monkeypatch.setattr(polygon_index, "PART_POINTS", 100)
    monkeypatch.setattr(polygon_index, "TESTS_AT_ONCE", 70)
    draw = random.Random(5)
    zigzag = [(float(40 + t % 2 * 20), float(t)) for t in range(30)] + [(float(-40 - t % 3 * 10), float(t)) for t in reversed(range(30))]
    rings = {"zigzag": zigzag, "star": star(draw, 50, 0.0, 10.0, 30.0), "box": [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)]}
    points = [(float(draw.randrange(-70, 70)), draw.randrange(0, 60) / 2) for _ in range(600)] + zigzag + rings["star"]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(9999, None, 1.0)], POINTS)
    expected = sorted((k, name) for name, ring in rings.items() for k, (a, b) in enumerate(points) if inside_exactly(a, b, ring))
    got = points_in_large_polygons(frame, spark.createDataFrame(list(rings.items()), SCHEMA), 5.0).collect()
    assert sorted((r.id, r.polygon_id) for r in got) == expected
