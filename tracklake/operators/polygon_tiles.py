"""Points meet rings in tiles, without a shuffle of the pairs.

The points are cut into slabs of longitude with about as many each, and a slab into parts where many points share a
longitude. A ring sends to each slab the edges that meet it, since whether a point is inside depends on the edges
at its longitude only. So what is shuffled grows with points and edges, not with the pairs: one task holds the points
of a tile, sorted by longitude, and lets rings pass by, each of which finds the points in its box and tests them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.functions.geometry import _FIXED_POINT

#: Slabs, and points or vertices that are dealt out at once, about.
MOST_SLABS, DEALT_AT_ONCE = 1000, 200_000
#: Edges that the rings of one task have, about, and tasks for each shuffle partition at least.
TASK_EDGES, TASKS_EACH = 2_000_000, 3
BOX = ["_minlat", "_maxlat", "_minlon", "_maxlon"]
RINGS = "_first int, _parts int, _bucket int, _kind int, _rows binary, _box binary, _is_box boolean"


def box_columns(ring: Column) -> dict[str, Column]:
    lats, lons = F.transform(ring, lambda c: c.lat), F.transform(ring, lambda c: c.lon)
    return dict(zip(BOX, (F.array_min(lats), F.array_max(lats), F.array_min(lons), F.array_max(lons))))


def _floats(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def vertices(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latitudes and longitudes of a batch of rings, and where each ring starts; missing values are nan."""
    sizes = rings.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rings.flatten()
    lat, lon = (_floats(pc.struct_field(flat, name)) for name in ("lat", "lon"))
    return lat, lon, np.concatenate([[0], np.cumsum(sizes)])


def few_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rings in batches of so few vertices that what is computed from them stays small."""
    for batch in batches:
        sizes = batch.column("ring").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        runs = (np.cumsum(sizes) - sizes) // DEALT_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def before(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The value of each vertex's predecessor in its ring."""
    shifted = np.roll(values, 1)
    shifted[starts[:-1]] = values[starts[1:] - 1]
    return shifted


def _wide(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of 64-bit numbers in full, as upper and lower halves."""
    mask, half = np.int64(0xFFFFFFFF), np.int64(32)
    a_low, a_high, b_low, b_high = a & mask, a >> half, b & mask, b >> half
    low = a_low.astype(np.uint64) * b_low.astype(np.uint64)
    first = a_high * b_low + (low >> np.uint64(32)).astype(np.int64)
    second = a_low * b_high + (first & mask)
    high = a_high * b_high + (first >> half) + (second >> half)
    return high, ((second & mask).astype(np.uint64) << np.uint64(32)) | (low & np.uint64(0xFFFFFFFF))


def exact_sides(ax: np.ndarray, by: np.ndarray, bx: np.ndarray, ay: np.ndarray) -> np.ndarray:
    """The signs of ax * by - bx * ay as fixed-point numbers of full length, 0 where they are out of range."""
    scaled = [v * _FIXED_POINT for v in (ax, by, bx, ay)]
    known = np.ones(len(ax), bool)
    for v in scaled:
        known &= (v >= -(2.0**63)) & (v < 2.0**63)
    a, b, c, d = (np.where(known, v, 0.0).astype(np.int64) for v in scaled)
    (left, left_low), (right, right_low) = _wide(a, b), _wide(c, d)
    more = (left > right) | ((left == right) & (left_low > right_low))
    less = (left < right) | ((left == right) & (left_low < right_low))
    return more.astype(np.int64) - less


def inside_edges(x: np.ndarray, y: np.ndarray, edges: np.ndarray, first: np.ndarray, met: np.ndarray, at_once: int) -> np.ndarray:
    """Which points are inside, by the same test as ``geometry.inside_edges``.

    ``edges`` are rows px, py, qx, qy, each from its lower to its upper end. An edge is tested with ``met`` points from
    the place ``first`` on, which are those at its longitudes; ``at_once`` tests or those of one edge are made together.
    """
    crossed, on_edge = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    runs = (np.cumsum(met) - met) // at_once
    cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(met)]
    for start, end in zip(cuts, cuts[1:]):
        n = met[start:end]
        p = np.arange(n.sum()) + np.repeat(first[start:end] - (np.cumsum(n) - n), n)
        px, py, qx, qy = (np.repeat(v[start:end], n) for v in edges)
        at_x, at_y = x[p], y[p]
        ax, by, bx, ay = px - at_x, qy - at_y, qx - at_x, py - at_y
        left, right = ax * by, bx * ay
        over = left > right
        ties = np.flatnonzero(left == right)
        if len(ties):
            side = exact_sides(ax[ties], by[ties], bx[ties], ay[ties])
            over[ties] = side > 0
            t = ties[side == 0]
            between = (np.minimum(px[t], qx[t]) <= at_x[t]) & (at_x[t] <= np.maximum(px[t], qx[t]))
            on_edge[p[t[between]]] = True
        crossed += np.bincount(p[over & (by > 0)], minlength=len(x))
    return (crossed % 2 == 1) & ~on_edge


def _deal_points(bounds: list[float], offsets: list[int], parts: list[int]):
    """Batches of points as rows of the tile each belongs to."""
    limits, first, several = np.array(bounds), np.array(offsets), np.array(parts)

    def dealt(gathered: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(gathered).combine_chunks()
        lat, lon = (_floats(table.column(n).combine_chunks()) for n in ("_lat", "_lon"))
        slab = np.searchsorted(limits, lon, "right")
        tile = first[slab]
        if "_dealt" in table.column_names:
            tile = tile + table.column("_dealt").to_numpy() % several[slab]
            table = table.drop_columns(["_dealt"])
        order = np.lexsort((lat, lon, tile))
        table, tile = table.take(pa.array(order)), tile[order]
        cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
        blobs = []
        for start, end in zip(cuts, cuts[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table.slice(start, end - start).combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        return pa.record_batch({"_tile": pa.array(tile[cuts[:-1]], pa.int32()), "_rows": pa.array(blobs, pa.binary())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            if batch.num_rows:
                gathered.append(batch)
                held += batch.num_rows
            if held >= DEALT_AT_ONCE:
                yield dealt(gathered)
                gathered, held = [], 0
        if gathered:
            yield dealt(gathered)

    return deal


def _deal_rings(bounds: list[float], offsets: list[int], parts: list[int]):
    """Batches of rings as a row for each slab that a ring meets, with its edges there."""
    limits, tiles, several = np.array(bounds), np.array(offsets, np.int32), np.array(parts, np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_once(batches):
            lat, lon, starts = vertices(batch.column("ring"))
            ring = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            before_lat, before_lon = before(lat, starts), before(lon, starts)
            up = before_lon <= lon
            px, qx = np.where(up, before_lat, lat), np.where(up, lat, before_lat)
            py, qy = np.minimum(before_lon, lon), np.maximum(before_lon, lon)
            # An edge that lacks a coordinate crosses nothing.
            known = np.flatnonzero(~np.isnan(px + py + qx + qy))
            low, high = np.searchsorted(limits, py[known], "right"), np.searchsorted(limits, qy[known], "right")
            n = high - low + 1
            edge = np.repeat(known, n)
            slab = np.arange(len(edge)) + np.repeat(low - (np.cumsum(n) - n), n)
            order = np.argsort(ring[edge] * len(tiles) + slab, kind="stable")
            edge, slab = edge[order], slab[order]
            of = ring[edge]
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(slab) != 0)) + 1
            cuts = np.concatenate([[0], cuts, [len(of)]]) if len(of) else np.array([0])
            px, py, qx, qy = px[edge], py[edge], qx[edge], qy[edge]
            blobs = [np.concatenate([v[a:b] for v in (px, py, qx, qy)]).tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            whose = of[cuts[:-1]] if len(of) else of
            where = slab[cuts[:-1]] if len(of) else slab
            boxes = np.stack([_floats(batch.column(name)) for name in BOX], axis=1)
            taken = pa.array(whose)
            columns = {
                "_first": pa.array(tiles[where]),
                "_parts": pa.array(several[where]),
                "_bucket": batch.column("_bucket").take(taken),
                "_kind": pa.array(np.ones(len(whose), np.int32)),
                "_rows": pa.array(blobs, pa.binary()),
                "_box": pa.array([boxes[r].tobytes() for r in whose.tolist()], pa.binary()),
                "_is_box": batch.column("_is_box").take(taken),
                "polygon_id": batch.column("polygon_id").take(taken),
            }
            yield pa.record_batch(columns)

    return deal


class _Tile:
    """The points of a tile in order of their longitude."""

    def __init__(self, blobs: list[bytes]) -> None:
        table = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]).combine_chunks()
        lat, lon = (_floats(table.column(n).combine_chunks()) for n in ("_lat", "_lon"))
        order = np.argsort(lon, kind="stable")
        self.x, self.y = lat[order], lon[order]
        rows = table.drop_columns(["_lat", "_lon"]).take(pa.array(order)).combine_chunks()
        self.rows = rows.to_batches()[0]

    def found(self, batch: pa.RecordBatch, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of points inside, and of the ring in the batch for each."""
        x, y = self.x, self.y
        box = np.stack([np.frombuffer(b.as_buffer(), np.float64) for b in batch.column("_box")], axis=1)
        start, end = np.searchsorted(y, box[2], "right"), np.searchsorted(y, box[3], "left")
        is_box, blobs = batch.column("_is_box").to_pylist(), batch.column("_rows")
        boxed, sizes, edges, firsts, mets, whose, held, tests = [], [], [], [], [], [], 0, 0
        for r in np.flatnonzero(end > start).tolist():
            a, b = int(start[r]), int(end[r])
            near = np.flatnonzero((x[a:b] > box[0, r]) & (x[a:b] < box[1, r]))
            if not len(near):
                continue
            near += a
            if is_box[r]:
                yield near, np.full(len(near), r)
                continue
            own = np.frombuffer(blobs[r].as_buffer(), np.float64).reshape(4, -1)
            lon = y[near]
            first = np.searchsorted(lon, own[1], "left")
            met = np.maximum(np.searchsorted(lon, own[3], "right") - first, 0)
            boxed.append(near)
            sizes.append(len(near))
            edges.append(own)
            firsts.append(first + held)
            mets.append(met)
            whose.append(r)
            held, tests = held + len(near), tests + int(met.sum())
            if tests >= at_once or held >= at_once:
                yield self._tested(boxed, sizes, edges, firsts, mets, whose, at_once)
                boxed, sizes, edges, firsts, mets, whose, held, tests = [], [], [], [], [], [], 0, 0
        if boxed:
            yield self._tested(boxed, sizes, edges, firsts, mets, whose, at_once)

    def _tested(self, boxed, sizes, edges, firsts, mets, whose, at_once) -> tuple[np.ndarray, np.ndarray]:
        near = np.concatenate(boxed)
        inside = inside_edges(self.x[near], self.y[near], np.concatenate(edges, axis=1), np.concatenate(firsts), np.concatenate(mets), at_once)
        return near[inside], np.repeat(whose, sizes)[inside]


def _meet(returned: list[str], at_once: int):
    """Batches of rows in order of their group, its points before its rings, as the pairs inside."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blobs, tile = None, [], None
        for batch in batches:
            groups = batch.column("_group").to_numpy()
            kinds = batch.column("_kind").to_numpy()
            cuts = np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0)) + 1
            cuts = [0, *cuts.tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if groups[start] != group:
                    group, blobs, tile = groups[start], [], None
                if kinds[start] == 0:
                    blobs += batch.column("_rows").slice(start, end - start).to_pylist()
                    continue
                if blobs:
                    tile, blobs = _Tile(blobs), []
                if tile is None:
                    continue
                some = batch.slice(start, end - start)
                for points, rings in tile.found(some, at_once):
                    if len(points):
                        rows = tile.rows.take(pa.array(points))
                        identifiers = some.column("polygon_id").take(pa.array(rings))
                        yield pa.RecordBatch.from_arrays([*rows.columns, identifiers], [*returned, "polygon_id"])

    return meet


def _slabs(points: DataFrame, part_points: int) -> tuple[list[float], list[int], list[int]]:
    """Bounds between slabs of longitude, the first tile of each slab and how many it has."""
    steps = [k / MOST_SLABS for k in range(1, MOST_SLABS)]
    count, at = points.agg(F.count(F.lit(1)), F.percentile_approx("_lon", steps, 10 * MOST_SLABS)).first()
    slabs = min(max(1, math.ceil(count / part_points)), MOST_SLABS)
    chosen = [at[round(k * MOST_SLABS / slabs) - 1] for k in range(1, slabs)] if count else []
    bounds = sorted(set(chosen))
    # A longitude that comes as several bounds has as many times the points of a slab.
    share = max(1, math.ceil(count / slabs / part_points))
    parts = [share, *(share * chosen.count(b) for b in bounds)]
    return bounds, [sum(parts[:k]) for k in range(len(parts))], parts


def points_in_rings(points: DataFrame, rings: DataFrame, key: list[str], returned: list[str], part_points: int, at_once: int) -> DataFrame:
    """The points within the rings: columns ``returned`` of the points and ``polygon_id``.

    ``rings`` has polygon_id, ring, the columns of ``BOX`` and ``_is_box``, true where the box is the whole ring; ``key``
    names columns by which the rings of a tile are dealt out to tasks. Both frames are read twice. A task holds
    about ``part_points`` points, and makes about ``at_once`` tests together.
    """
    spark = points.sparkSession
    schema = T.StructType([*(points.schema[n] for n in returned), rings.schema["polygon_id"]])
    size = F.sum(F.size("ring").cast("long"))
    count, edges, *box = rings.agg(F.count(F.lit(1)), size, *[(F.min if "min" in n else F.max)(n) for n in BOX]).first()
    if any(b is None for b in box):
        return spark.createDataFrame([], schema)
    lat, lon = F.col("_lat"), F.col("_lon")
    columns = [F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon")]
    near = points.where(
        (F.col("lat") > F.lit(box[0])) & (F.col("lat") < F.lit(box[1])) & (F.col("lon") > F.lit(box[2])) & (F.col("lon") < F.lit(box[3]))
    )
    bounds, offsets, parts = _slabs(near.select(columns[1]), part_points)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = sum(parts)
    buckets = max(1, min(count, max(math.ceil(TASKS_EACH * tasks / tiles), math.ceil(edges / tiles / TASK_EDGES))))

    if tiles > len(parts):
        columns.append(F.pmod(F.xxhash64(*points.columns), F.lit(1 << 31)).alias("_dealt"))
    dealt = near.select(*returned, *columns).mapInArrow(_deal_points(bounds, offsets, parts), "_tile int, _rows binary")
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    held = dealt.withColumn("_bucket", every).select(
        (F.col("_tile") * buckets + F.col("_bucket")).alias("_group"), F.lit(0).alias("_kind"), "_rows"
    )
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("_bucket")
    identifier = T.StructType.fromDDL(RINGS).add(rings.schema["polygon_id"])
    passing = rings.select("polygon_id", "ring", *[F.col(n).cast("double").alias(n) for n in BOX], "_is_box", bucket)
    passing = passing.where(" and ".join(f"{n} is not null" for n in BOX)).mapInArrow(_deal_rings(bounds, offsets, parts), identifier)
    tile = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_parts") - 1))
    passing = passing.withColumn("_tile", tile).select(
        (F.col("_tile") * buckets + F.col("_bucket")).alias("_group"), "_kind", "_rows", "_box", "_is_box", "polygon_id"
    )
    met = held.unionByName(passing, allowMissingColumns=True).repartitionById(tiles * buckets, F.col("_group"))
    return met.sortWithinPartitions("_group", "_kind").mapInArrow(_meet(returned, at_once), schema)
