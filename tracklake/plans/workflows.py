"""The three workflows the operators are made for."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions.geometry import Ring
from tracklake.operators.changes import GENERATED, REQUEST, artifact_freshness
from tracklake.operators.keys import key_set
from tracklake.operators.messages import fingerprint
from tracklake.operators.positions import to_positions
from tracklake.operators.runs import clip_tracks, nothing_to_export
from tracklake.operators.store import append_tracks, new_files
from tracklake.operators.ways import (
    distinct_refs,
    last_by_key,
    nodes_with_ids,
    of_ways,
    resolve_ways,
    ways_touching,
)
from tracklake.session import materialize
from tracklake.sources import areas
from tracklake.sources.osm import export_osm
from tracklake.sources.tracks import decode_tracks

if TYPE_CHECKING:
    import pandas as pd


def all_positions(
    tracks: DataFrame, decode: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
) -> DataFrame:
    """Positions of all stored tracks, decoded from their blobs.

    The decoded records are stored, so the decoder and the scan of the blobs run once.
    """
    return to_positions(materialize(decode_tracks(tracks.select("id", "data"), decode)))


def ingest_files(files: DataFrame, tracks: DataFrame, order: str) -> DataFrame:
    """Track rows to append for files (hash, data, ``order``) whose content is not stored yet."""
    fresh = new_files(files, tracks.select("hash"), order)
    return append_tracks(tracks, fresh, order)


def ways_in_polygon(
    way_nodes: DataFrame,
    nodes: DataFrame,
    way_tags: DataFrame,
    ring: Ring,
    key: str = "highway",
    value: str = "cycleway",
    way_fn: Callable[[Column], Column] | None = None,
    node_order: str | None = None,
) -> DataFrame:
    """The ways touching the polygon with the coordinates of all their nodes, in long form.

    With ``node_order`` (``doc_order`` of a map document) the last of several nodes with one id counts,
    for the polygon and for the coordinates; without it a repeated id is an error.
    The polygon's nodes, the ways, their references and node ids are computed and stored one after the
    other, so the table of references is searched once for either; as long as there are few keys, none of
    the tables is shuffled.
    """
    if node_order is not None:
        nodes = materialize(last_by_key(nodes, "id", node_order))
    ways = key_set(ways_touching(way_nodes, nodes, way_tags, ring, key, value))
    chosen = materialize(of_ways(way_nodes, ways))
    used = nodes_with_ids(nodes, distinct_refs(chosen))
    return resolve_ways(chosen, used, way_fn=way_fn)


def area_result(
    way_nodes: DataFrame,
    nodes: DataFrame,
    way_tags: DataFrame,
    ring: Ring,
    path: str,
    area_id: str,
    key: str = "highway",
    value: str = "cycleway",
    node_order: str | None = None,
) -> areas.Area:
    """Finds the ways of an area and stores them with its polygon, in place of its earlier result.

    What was known of the area's last export no longer holds.
    """
    found = ways_in_polygon(way_nodes, nodes, way_tags, ring, key, value, node_order=node_order)
    return areas.save_area(found, path, area_id, ring)


def clip_and_export(
    positions: DataFrame, ring: Ring, highway: str = "cycleway", selective: bool = False
) -> DataFrame | None:
    """Map elements of the runs in the polygon, or None when there are none."""
    runs = materialize(clip_tracks(positions, ring, selective=selective))
    return None if nothing_to_export(runs) else export_osm(runs, highway)


def elements_fingerprint(elements: DataFrame) -> DataFrame:
    """Content hash of an export for change detection: (fingerprint, n), row order aside."""
    return fingerprint(elements.select(F.to_json(F.struct("*")).alias("row")), "row")


def export_if_changed(
    positions: DataFrame, ring: Ring, known: tuple | None = None, highway: str = "cycleway", selective: bool = False
) -> tuple[DataFrame, tuple] | None:
    """The export and its fingerprint, or None if it is empty or has the fingerprint ``known``.

    The export is stored, so it is made once for the fingerprint and for the caller.
    """
    elements = clip_and_export(positions, ring, highway, selective)
    if elements is None:
        return None
    elements = materialize(elements)
    found = tuple(elements_fingerprint(elements).first())
    return None if found == known else (elements, found)


def answer_requests(
    requests: DataFrame, positions: DataFrame, path: str, highway: str = "cycleway", selective: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """Answers requests (area_id, order_no, hash) for exports of the stored areas.

    A request is up to date if its hash is that of the area's last export. For areas with any other
    request the tracks are clipped to the stored polygon and exported, once an area, and the new hash is
    stored unless the area has been replaced meanwhile. Requests for unknown areas are not answered, and
    an area without positions has no export.

    Returns the answers (area_id, order_no, hash, up_to_date) and the export elements with their area_id
    and hash, None if there are none.
    """
    spark = requests.sparkSession
    known = materialize(areas.load_areas(spark, path))
    requests = materialize(requests.select("area_id", "order_no", "hash").join(known.select("area_id"), "area_id", "left_semi"))
    lowest = requests.agg(F.min("order_no")).first()[0]
    # What is known of an area comes before all of its requests.
    cached = known.where("hash is not null").select("area_id", F.lit(lowest).cast("long") - 1, "hash", F.lit(GENERATED))
    log = requests.withColumn("kind", F.lit(REQUEST)).union(cached).withColumnRenamed("area_id", "artifact_id")
    answers = materialize(artifact_freshness(log).withColumnRenamed("artifact_id", "area_id"))
    stale = known.join(answers.where("not up_to_date"), "area_id", "left_semi")
    exports = None
    for row in stale.orderBy("area_id").collect():  # a row a drawing
        area = areas.from_row(row)
        made = export_if_changed(positions, area.ring, None, highway, selective)
        if made is None:
            continue
        elements, (total, n) = made
        found = f"{total:015x}-{n}"
        areas.cache_hash(spark, path, area, found)
        elements = elements.withColumns({"area_id": F.lit(area.area_id), "hash": F.lit(found)})
        exports = elements if exports is None else exports.unionByName(elements)
    return answers, exports
