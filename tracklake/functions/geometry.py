"""Polygon expressions over latitude / longitude columns.

A ring is an open list of vertices; the closing edge runs from the last vertex to the first. A point
is inside when a ray crosses the ring an odd number of times and the point lies on no edge, so the
boundary does not count as inside. Rings over the antimeridian are not treated specially.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = Sequence[tuple[float, float]]

SEMICIRCLE = 180.0 / 2**31
# Above this the edges are looped over as an array instead of being one expression each.
UNROLLED_EDGES = 64
EDGE_FIELDS = ("px", "py", "qx", "qy", "min_x", "max_x")
_ON_EDGE = 1 << 32
# Fixed-point scale: exact for coordinates of a degree or more, 1e-11 metres below that.
_FIXED_POINT = float(2**52)


def semi_to_deg(semicircles: Column) -> Column:
    """Device semicircles (signed 32 bit) as degrees."""
    return semicircles * F.lit(SEMICIRCLE)


def check_ring(ring: Ring) -> list[tuple[float, float]]:
    vertices = [(float(lat), float(lon)) for lat, lon in ring]
    if len(vertices) < 3:
        raise ValueError(f"a ring needs at least 3 vertices, got {len(vertices)}")
    return vertices


def ring_bounds(ring: Ring) -> tuple[float, float, float, float]:
    """(minlat, minlon, maxlat, maxlon) of the vertices."""
    lats, lons = zip(*ring)
    return min(lats), min(lons), max(lats), max(lons)


def _is_rectangle(vertices: list[tuple[float, float]]) -> bool:
    if len(vertices) != 4 or len(set(vertices)) != 4:
        return False
    minlat, minlon, maxlat, maxlon = ring_bounds(vertices)
    corners = {(minlat, minlon), (minlat, maxlon), (maxlat, minlon), (maxlat, maxlon)}
    pairs = zip(vertices, vertices[1:] + vertices[:1])
    return set(vertices) == corners and all(a == c or b == d for (a, b), (c, d) in pairs)


def _fixed_point(x: Column) -> Column:
    return (x * F.lit(_FIXED_POINT)).try_cast("long").cast("decimal(19,0)")


def _edge_code(x: Column, y: Column, e: Column) -> Column:
    """1 where the ray from (x, y) crosses the edge, _ON_EDGE where the point is on it, else 0.

    The edge runs from its lower end p to its upper end q (py <= qy). Rounding keeps the order of the
    two products, so only equal ones are compared again, as fixed-point numbers of full length.
    """
    ax, by, bx, ay = e.px - x, e.qy - y, e.qx - x, e.py - y
    left, right = ax * by, bx * ay
    exact_left = _fixed_point(ax) * _fixed_point(by)
    exact_right = _fixed_point(bx) * _fixed_point(ay)
    crossed = F.when(y < e.qy, F.lit(1)).otherwise(F.lit(0))
    # The range of x matters for level edges only.
    on_edge = F.when(x.between(e.min_x, e.max_x), F.lit(_ON_EDGE)).otherwise(F.lit(0))
    return (
        F.when((y < e.py) | (y > e.qy) | (left < right), F.lit(0))
        .when(left > right, crossed)
        .when(exact_left < exact_right, F.lit(0))
        .when(exact_left > exact_right, crossed)
        .otherwise(on_edge)
        .cast("long")
    )


def _is_odd_crossing(total: Column) -> Column:
    return (total < F.lit(_ON_EDGE)) & (total.bitwiseAND(F.lit(1)) == 1)


def _add_balanced(terms: list[Column]) -> Column:
    while len(terms) > 1:
        paired = [a + b for a, b in zip(terms[::2], terms[1::2])]
        terms = paired + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def in_bounds(lat: Column, lon: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Strictly inside a box: plain comparisons, which reach the Parquet scan as pushed filters."""
    minlat, minlon, maxlat, maxlon = bounds
    return (
        (lat > F.lit(minlat)) & (lat < F.lit(maxlat)) & (lon > F.lit(minlon)) & (lon < F.lit(maxlon))
    )


def point_in_polygon(lat: Column, lon: Column, ring: Ring) -> Column:
    """True where the point is in the interior of the ring."""
    vertices = check_ring(ring)
    box = in_bounds(lat, lon, ring_bounds(vertices))
    if _is_rectangle(vertices):
        return box
    edges = []
    for (ax, ay), (bx, by) in zip(vertices[-1:] + vertices[:-1], vertices):
        (low_y, low_x), (high_y, high_x) = sorted([(ay, ax), (by, bx)])
        if (ax, ay) != (bx, by):
            edges.append((low_x, low_y, high_x, high_y, min(ax, bx), max(ax, bx)))
    if not edges:
        return F.lit(False)
    literal = F.array(
        *[F.struct(*[F.lit(v).alias(n) for n, v in zip(EDGE_FIELDS, e)]) for e in edges]
    )
    exact = inside_edges(lat, lon, literal)
    if len(edges) > UNROLLED_EDGES:
        return box & exact
    quick = _add_balanced(_quick_codes(lat, lon, edges))
    return box & F.when(quick < F.lit(_ON_EDGE), _is_odd_crossing(quick)).otherwise(exact)


def _side_code(x: Column, y: Column, px: Column, py: Column, qx: Column, qy: Column) -> Column:
    """1 left of the edge's line, 0 right of it, _ON_EDGE within rounding of it."""
    side = F.signum((px - x) * (qy - y) - (qx - x) * (py - y))
    by_side = F.array(*[F.lit(v).cast("long") for v in (0, _ON_EDGE, 1)])
    return F.get(by_side, (side + 1).cast("int"))


def _quick_codes(x: Column, y: Column, edges: list[tuple[float, ...]]) -> list[Column]:
    """Per edge 1 for a crossing, 0 for none, and _ON_EDGE where only the exact test can tell.

    Kept short, with each coordinate named few times, so that the generated code stays small.
    """
    none = F.lit(0).cast("long")
    unclear = lambda condition: F.when(condition, F.lit(_ON_EDGE)).otherwise(none)
    codes, tops, covered = [], set(), set()
    for px, py, qx, qy, min_x, max_x in edges:
        if py == qy:
            codes.append(unclear((y == F.lit(py)) & x.between(min_x, max_x)))
            covered |= {(px, py), (qx, qy)}
            continue
        side = _side_code(x, y, *map(F.lit, (px, py, qx, qy)))
        codes.append(F.when((y >= F.lit(py)) & (y < F.lit(qy)), side).otherwise(none))
        covered.add((px, py))
        tops.add((qx, qy))
    # The upper end is left out of an edge, so peaks are looked at on their own.
    codes += [unclear((x == F.lit(px)) & (y == F.lit(py))) for px, py in sorted(tops - covered)]
    return codes


def edges_total(lat: Column, lon: Column, edges: Column) -> Column:
    return F.aggregate(edges, F.lit(0).cast("long"), lambda acc, e: acc + _edge_code(lat, lon, e))


def inside_edges(lat: Column, lon: Column, edges: Column) -> Column:
    """Interior test against an edge array made by :func:`directed_edges`."""
    return _is_odd_crossing(edges_total(lat, lon, edges))


def inside_edge_arrays(lat: Column, lon: Column, arrays: Column, most: int) -> Column:
    """The same against a struct of arrays, one per edge field, with at most ``most`` edges.

    Few edges are tested by generated code; the loop over them, which Spark interprets, runs only for
    points that may lie on an edge.
    """
    exact = inside_edges(lat, lon, F.arrays_zip(*[arrays[name] for name in EDGE_FIELDS]))
    if not 0 < most <= UNROLLED_EDGES // 2:
        return exact
    codes = []
    for i in range(most):
        px, py, qx, qy, min_x, max_x = (F.get(arrays[name], F.lit(i)) for name in EDGE_FIELDS)
        codes.append(
            F.when((lon >= py) & (lon < qy), _side_code(lat, lon, px, py, qx, qy))
            .when((lon == qy) & lat.between(min_x, max_x), F.lit(_ON_EDGE))
            .otherwise(F.lit(0).cast("long"))
        )
    quick = _add_balanced(codes)
    return F.when(quick < F.lit(_ON_EDGE), _is_odd_crossing(quick)).otherwise(exact)


def checked_ring(ring: Column) -> Column:
    """The ring column; fails at run time on fewer than 3 vertices."""
    message = F.lit("a ring needs at least 3 vertices")
    return F.when(F.size(ring) >= 3, ring).otherwise(F.raise_error(message))


def close_ring(ring: Column) -> Column:
    """The ring with its last vertex also put in front."""
    ring = checked_ring(ring)
    return F.concat(F.array(F.element_at(ring, -1)), ring)


def ring_edges(ring: Column) -> Column:
    """The ring's edges in order: array of (lat1, lon1, lat2, lon2), the closing edge first."""
    closed = close_ring(ring)
    return F.zip_with(
        F.slice(closed, 1, F.size(closed) - 1),
        ring,
        lambda a, b: F.struct(
            a.lat.alias("lat1"), a.lon.alias("lon1"), b.lat.alias("lat2"), b.lon.alias("lon2")
        ),
    )


def edge_arrays(edges: Column) -> Column:
    """Edges as a struct of arrays of numbers, one per field."""
    field = lambda name: F.transform(edges, lambda e: e[name]).alias(name)
    return F.struct(*[field(name) for name in EDGE_FIELDS])


def directed_edges(ring: Column) -> Column:
    """Edges from their lower to their upper end, with their latitude range."""

    def direct(e: Column) -> Column:
        up = e.lon1 <= e.lon2
        return F.struct(
            F.when(up, e.lat1).otherwise(e.lat2).alias("px"),
            F.least(e.lon1, e.lon2).alias("py"),
            F.when(up, e.lat2).otherwise(e.lat1).alias("qx"),
            F.greatest(e.lon1, e.lon2).alias("qy"),
            F.least(e.lat1, e.lat2).alias("min_x"),
            F.greatest(e.lat1, e.lat2).alias("max_x"),
        )

    return F.transform(ring_edges(ring), direct)


def polygon_text(ring: Column) -> Column:
    """The vertices as "lat lon lat lon ..."."""
    vertex = lambda c: F.concat_ws(" ", c.lat.cast("string"), c.lon.cast("string"))
    return F.array_join(F.transform(ring, vertex), " ")
