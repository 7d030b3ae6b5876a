import random
import re

import numpy as np
import pyarrow as pa
import pytest
from test_geometry import SHAPES, rounded_inside

from tracklake.operators import polygon_tiles, polygons
from tracklake.operators.polygon_index import points_in_large_polygons
from tracklake.operators.polygons import points_in_polygons

SCHEMA = "polygon_id string, ring array<struct<lat:double,lon:double>>"
POINTS = "id long, lat double, lon double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(polygons, "PART_POINTS", 60)
    monkeypatch.setattr(polygons, "TESTS_AT_ONCE", 50)
    monkeypatch.setattr(polygon_tiles, "DEALT_AT_ONCE", 70)


def test_many_polygons_meet_points_in_tiles(spark, small_tiles):
    """A third of the points at one longitude, which is a bound of several slabs; polygons and points that come twice."""
    draw = random.Random(4)
    rings = [(name, [tuple(map(float, v)) for v in ring]) for name, ring in SHAPES.items()] * 2
    for i in range(70):
        x, y, size = draw.randrange(-3, 9), draw.randrange(-3, 9), draw.choice([1, 2, 6])
        box = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
        rings.append((None if i % 7 == 0 else str(i), [tuple(map(float, v)) for v in (box if i % 2 else [box[0], (x + size, y + 1), box[2]])]))
    points = [(i, draw.randrange(-8, 24) / 2, draw.randrange(-8, 24) / 2) for i in range(400)]
    points += [(1000 + i, draw.uniform(-4, 10), 3.5) for i in range(200)] + [(7, 1.5, 1.5)] * 2
    points += [(i, *draw.choice(ring)) for i, (_, ring) in enumerate(rings)]
    expected = sorted((i, name or "") for i, x, y in points for name, ring in rings if rounded_inside(x, y, ring))
    frame = spark.createDataFrame([*points, (5000, None, 1.0), (5001, 1.0, None)], POINTS)
    found = points_in_polygons(frame, spark.createDataFrame(rings, SCHEMA), 0.1)
    assert "Join" not in plan(found) and found.columns == ["id", "lat", "lon", "polygon_id"]
    assert sorted((r.id, r.polygon_id or "") for r in found.collect()) == expected
    ids = points_in_polygons(frame, spark.createDataFrame(rings, SCHEMA), 0.1, returned=["id"])
    assert ids.columns == ["id", "polygon_id"] and sorted((r.id, r.polygon_id or "") for r in ids.collect()) == expected


def test_pairs_are_not_shuffled(spark):
    """Nothing is shuffled behind the pairs, for long rings and for many polygons."""
    draw = random.Random(6)
    points = spark.createDataFrame([(k, draw.uniform(0, 9), draw.uniform(0, 9)) for k in range(500)], POINTS)
    ring = [(float(t % 2), t / 10) for t in range(100)] + [(9.0 - t % 3, t / 10) for t in reversed(range(100))]
    table = spark.createDataFrame([(str(k), ring) for k in range(100)], SCHEMA)
    for found in (points_in_large_polygons(points, table, 1.0), points_in_polygons(points, table, 1.0)):
        text = plan(found)
        assert not re.search("Join|CoGroup", text)
        assert "MapInArrow" in text.split("Exchange", 1)[0] and found.count() > 25_000


def test_polygons_without_a_box_hold_nothing(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0)], POINTS)
    bare = [(str(k), [(None, None)] * 3) for k in range(80)]
    assert points_in_polygons(points, spark.createDataFrame(bare, SCHEMA)).count() == 0
    box = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    found = points_in_polygons(points, spark.createDataFrame([*bare, ("a", box)], SCHEMA))
    assert [tuple(r) for r in found.collect()] == [(1, 1.0, 1.0, "a")]
    short = spark.createDataFrame([*bare, ("b", box[:2])], SCHEMA)
    with pytest.raises(Exception, match="at least 3 vertices"):
        points_in_polygons(points, short).collect()


def test_ties_are_decided_exactly():
    draw = np.random.default_rng(9)
    a = np.concatenate([draw.uniform(-2000, 2000, 500), draw.integers(-9, 9, 500) / 4, draw.uniform(-1e-9, 1e-9, 200), [0.0, 3000.0, -2048.0, np.inf]])
    n = len(a)
    b, c, d = (draw.permutation(a) for _ in range(3))
    c[:n // 2], d[:n // 2] = b[:n // 2], a[:n // 2]  # the same products
    d[:n // 4] = np.nextafter(d[:n // 4], 0)

    def fixed(v):
        return int(v * 2.0**52) if abs(v) != np.inf and -(2.0**63) <= v * 2.0**52 < 2.0**63 else None

    expected = []
    for row in zip(a, b, c, d):
        p, q, r, s = (fixed(float(v)) for v in row)
        expected.append(0 if None in (p, q, r, s) else (p * q > r * s) - (p * q < r * s))
    assert polygon_tiles.exact_sides(a, b, c, d).tolist() == expected and set(expected) == {-1, 0, 1}


def test_rings_of_a_batch_are_dealt_out_in_pieces(monkeypatch):
    """A batch may hold millions of vertices, of which many more numbers are computed."""
    monkeypatch.setattr(polygon_tiles, "DEALT_AT_ONCE", 10)
    kind = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))
    rings = [[{"lat": float(k), "lon": float(n)} for k in range(size)] for n, size in enumerate([3, 4, 5, 30, 3, 3, 3])]
    batch = pa.record_batch({"n": pa.array(range(7)), "ring": pa.array(rings, kind)})
    pieces = list(polygon_tiles.few_at_once(iter([batch, batch.slice(0, 0)])))
    assert [p.column("n").to_pylist() for p in pieces] == [[0, 1, 2], [3], [4, 5, 6]]
    lat, lon, starts = polygon_tiles.vertices(pieces[1].column("ring"))
    assert lat.tolist() == list(map(float, range(30))) and set(lon) == {3.0} and starts.tolist() == [0, 30]
