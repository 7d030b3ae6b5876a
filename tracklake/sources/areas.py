"""Stored area results: per area its polygon, the ways found in it, and the fingerprint of its last export.

The areas are a small versioned table (``snapshots``), whose rows name the directory with their ways. The
ways are written first and count from the moment a version of the table names them, so a reader sees an
area's old result or its new one, and a writer that dies leaves nothing that is seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tracklake import schemas
from tracklake.functions.geometry import Ring
from tracklake.sources import snapshots

ROWS = "rows"


@dataclass(frozen=True)
class Area:
    """An area as stored; ``rows`` tells one result of it from the next."""

    area_id: str
    ring: Ring
    rows: str
    hash: str | None


def _table(path: str) -> str:
    return f"{path}/areas"


def _found(path: str) -> str:
    return f"{path}/found"


def load_areas(spark: SparkSession, path: str) -> DataFrame:
    """All areas: (area_id, ring, rows, hash), ``hash`` null where no export is known."""
    return snapshots.load_snapshot(spark, _table(path), schemas.AREAS)


def load_area(spark: SparkSession, path: str, area_id: str) -> Area | None:
    row = load_areas(spark, path).where(F.col("area_id") == area_id).head()
    return None if row is None else from_row(row)


def from_row(row: Row) -> Area:
    return Area(row.area_id, [(v.lat, v.lon) for v in row.ring], row.rows, row.hash)


def area_ways(spark: SparkSession, path: str) -> DataFrame:
    """The ways of all areas in long form: (area_id, way_id, pos, ref, lat, lon).

    Directories that no area names are pruned by the join.
    """
    areas = load_areas(spark, path).select("area_id", ROWS)
    if areas.isEmpty():
        return spark.createDataFrame([], schemas.AREA_WAYS)
    stored = spark.read.schema(schemas.FOUND_WAYS).parquet(_found(path))
    return stored.join(F.broadcast(areas), ROWS).select(*schemas.AREA_WAYS.fieldNames())


def save_area(resolved: DataFrame, path: str, area_id: str, ring: Ring) -> Area:
    """Replaces the area's polygon and ways (way_id, pos, ref, lat, lon) and clears its fingerprint.

    Of concurrent savers of one area the last counts; other areas stay as they are.
    """
    rows = uuid.uuid4().hex
    names = [n for n in schemas.FOUND_WAYS.fieldNames() if n != ROWS]
    resolved.select(*names).write.parquet(f"{_found(path)}/{ROWS}={rows}")
    area = Area(area_id, list(ring), rows, None)
    _change(resolved.sparkSession, path, lambda known: {**known, area_id: area})
    return area


def cache_hash(spark: SparkSession, path: str, area: Area, hash: str) -> bool:
    """Notes the fingerprint of an export of the area; False if the area has been replaced since."""
    noted = []

    def change(known: dict[str, Area]) -> dict[str, Area]:
        now = known.get(area.area_id)
        noted[:] = [now is not None and now.rows == area.rows]
        return {**known, area.area_id: Area(area.area_id, now.ring, now.rows, hash)} if noted[0] else known

    _change(spark, path, change)
    return noted[0]


def _change(spark: SparkSession, path: str, change: Callable[[dict[str, Area]], dict[str, Area]]) -> None:
    """Saves a changed table of areas; starts over from the newest version if someone else saved meanwhile.

    The areas are drawings with one row each; their ways stay in files.
    """
    while True:
        revision = snapshots.latest_revision(spark, _table(path))
        known = {r.area_id: from_row(r) for r in load_areas(spark, path).collect()}
        changed = change(known)
        if changed == known:
            return
        rows = [(a.area_id, list(a.ring), a.rows, a.hash) for a in changed.values()]
        try:
            snapshots.save_snapshot(spark.createDataFrame(rows, schemas.AREAS).coalesce(1), _table(path), revision)
            return
        except snapshots.RevisionConflict:
            continue
