"""Registered queries: each operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracklake import schemas
from tracklake.functions import geometry, scalar, tags
from tracklake.operators import changes, messages, polygon_index, polygons, positions, runs, store, ways
from tracklake.plans import fixtures, workflows
from tracklake.session import materialize, work_path
from tracklake.sources import areas, named_files, osm, snapshots, tracks
from tracklake.streaming import changes as streaming_changes
from tracklake.streaming import ingest as streaming_ingest

if TYPE_CHECKING:
    import pandas as pd

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SNAPSHOT_CUT = 5000
LOOKUP_ID = 7
FILE_STREAM = {"maxFilesPerTrigger": 1000}
#: Shares of a table after which the next part of it arrives in a stream.
ARRIVALS = [0.25, 0.5, 0.75]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "events")


def _arrive(
    spark: SparkSession, sf_dir: str, name: str, order: str, start: Callable[[DataFrame], StreamingQuery]
) -> DataFrame:
    """Lets a table arrive as files in parts, in order; after each the stream goes on from its checkpoint.

    Returns the stream as it stands at the end.
    """
    rows, path = fixtures.table(spark, sf_dir, name), work_path(spark, "arrivals")
    cuts = [None, *rows.approxQuantile(order, ARRIVALS, 0.01), None]
    for low, high in zip(cuts, cuts[1:]):
        part = rows if low is None else rows.where(F.col(order) > low)
        part = part if high is None else part.where(F.col(order) <= high)
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).options(**FILE_STREAM).parquet(path)
        start(stream).awaitTermination()
    return stream


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# Scans, sources, sinks


@query
def scan_track_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of three kinds of names, and an empty file for each language."""
    directories = [work_path(spark, "files") for _ in range(2)]
    documents = fixtures.table(spark, sf_dir, "documents")
    prefix = F.element_at(F.array(F.lit(""), F.lit("_"), F.lit(".")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    name = F.concat(prefix, F.lit("track "), F.col("doc_id").cast("string"))
    content = F.coalesce("text", F.lit("")).cast("binary")
    empty = documents.select(F.concat(F.lit("_empty-"), F.coalesce("lang", F.lit(""))).alias("name")).distinct()
    named_files.write_files(documents.select(name.alias("name"), content.alias("content")), directories[0])
    named_files.write_files(empty.withColumn("content", F.lit("").cast("binary")), directories[1])
    found = tracks.scan_track_files(spark, [*directories, work_path(spark, "missing")])
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "hash")


@query
def decode_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one_record_per_line(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = batch.assign(line=batch["data"].str.split("\n")).explode("line")
            seq = lines.groupby(level=0).cumcount()
            yield lines.assign(track_id=lines["id"], seq=seq)[["track_id", "seq", "line"]]

    blobs = fixtures.track_blobs(spark, sf_dir).select("id", "data")
    return tracks.decode_tracks(blobs, one_record_per_line, "track_id long, seq long, line string")


@query
def read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "records")
    fixtures.records(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return _naive(tracks.read_records(spark, path), "ts")


@query
def read_osm_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map tables, written as one document in parts and read back in parallel.

    Each way has a twin without tags and references. Every node stands behind a comment that holds a node,
    and every end of a way before a CDATA section that holds a way and the start of a comment.
    """
    path = work_path(spark, "map")
    nodes, all_ways = fixtures.nodes(spark, sf_dir), fixtures.ways(spark, sf_dir)
    box = positions.bounds(nodes)
    corners = [
        box.select(F.lit(pos).cast("long").alias("pos"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
        for pos, (lat, lon) in enumerate((("minlat", "minlon"), ("maxlat", "maxlon")))
    ]
    tables = ways.MapTables(
        nodes=nodes,
        ways=all_ways.unionByName(all_ways.select((-1 - F.col("way_id")).alias("way_id"))),
        way_nodes=fixtures.way_nodes(spark, sf_dir),
        way_tags=fixtures.way_tags(spark, sf_dir),
    )
    elements = ways.union_elements(
        *[corner.withColumn("kind", F.lit("bounds")) for corner in corners], osm.table_elements(tables)
    )
    line = F.col("line")
    behind = F.concat(F.lit('<!-- <node id="-1" lat="0" lon="0"/> ]]> -->'), line)
    before = F.concat(line, F.lit('<![CDATA[ <way id="-1"><tag k="x" v="y"/> <!-- ]]>'))
    sections = F.when(line.startswith("<node"), behind).when(line == "</way>", before).otherwise(line)
    osm.write_lines(osm.osm_lines(elements).withColumn("line", sections), path)
    read = osm.read_osm_xml(spark, path, splittable=True)
    return ways.union_elements(
        read.nodes.select(F.lit("node").alias("type"), "id", "lat", "lon"),
        read.way_nodes.select(F.lit("nd").alias("type"), F.col("way_id").alias("id"), "pos", "ref"),
        read.way_tags.select(F.lit("tag").alias("type"), F.col("way_id").alias("id"), "pos", "k", "v"),
        read.ways.select(F.lit("way").alias("type"), F.col("way_id").alias("id")),
    )


@query
def write_osm_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clipped runs as tables, written as a document and read back."""
    path = work_path(spark, "map")
    exported = materialize(export_osm(spark, sf_dir))
    osm.write_osm_xml(osm.export_tables(exported), path)
    read = osm.read_osm_xml(spark, path, splittable=True)
    return ways.resolve_ways(read.way_nodes, read.nodes).select("way_id", "pos", "ref", "lat", "lon")


@query
def read_osm_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "elements")
    node = fixtures.nodes(spark, sf_dir).select(F.lit("node").alias("type"), "id", "lat", "lon")
    refs = positions.collect_pieces(
        fixtures.dense_way_nodes(spark, sf_dir).withColumns({"lat": F.col("ref"), "lon": F.lit(None)}),
        "way_id",
        "pos",
    )
    # A way of more than one piece becomes several elements, told apart by the upper id bits.
    way = refs.select(
        F.lit("way").alias("type"),
        (F.col("way_id") + F.shiftleft("piece", 40)).alias("id"),
        F.transform("points", lambda p: p.lat).alias("nodes"),
    )
    elements = ways.union_elements(node, way)
    elements.select(F.array(F.struct("*")).alias("elements")).write.json(path)
    read = osm.read_osm_json(spark, path, multi_line=False)
    return ways.union_elements(
        read.nodes.select(F.lit("node").alias("type"), "id", "lat", "lon"),
        read.way_nodes.select(F.lit("nd").alias("type"), F.col("way_id").alias("id"), "pos", "ref"),
    )


@query
def scan_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.scan_tracks(fixtures.track_blobs(spark, sf_dir))


@query
def blob_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.blob_lookup(fixtures.track_blobs(spark, sf_dir), LOOKUP_ID)


@query
def append_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fixtures.known_blobs(spark, sf_dir)
    added = store.append_tracks(known, fixtures.new_blobs(spark, sf_dir), "id")
    return store.scan_tracks(known).unionByName(store.scan_tracks(added))


def _withdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.track_blobs(spark, sf_dir).where(F.col("source") == "src7").select("id")


@query
def delete_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store.delete_tracks(fixtures.track_blobs(spark, sf_dir), _withdrawn(spark, sf_dir))
    return store.scan_tracks(kept)


def _event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("user_id", "event_id", "event_type", "value")


@query
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event other than a purchase as the stored values, all purchases as updates."""
    values = _event_values(spark, sf_dir)
    base = store.last_by_key(values.where("event_type <> 'purchase'"), "user_id", "event_id")
    return store.upsert_latest(base, values.where("event_type = 'purchase'"), "user_id", "event_id")


@query
def save_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A versioned table, replaced once and read back."""
    path = work_path(spark, "tracks")
    first = fixtures.known_blobs(spark, sf_dir).select("id", "hash")
    snapshots.save_snapshot(first, path, expected=0)
    every = fixtures.track_blobs(spark, sf_dir).select("id", "hash")
    snapshots.save_snapshot(every, path, expected=1)
    return snapshots.load_snapshot(spark, path, first.schema)


@query
def save_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "drawings")
    snapshots.save_polygons(fixtures.part_polygons(spark, sf_dir), path, expected=0)
    return polygons.polygon_edges(snapshots.load_polygons(spark, path))


@query
def export_osm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.clip_and_export(fixtures.positions(spark, sf_dir), fixtures.RECT)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.changes(_events(spark, sf_dir))


@query
def encode_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.encode_message(_messages(spark, sf_dir).drop("payload"))


@query
def decode_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = messages.encode_message(_messages(spark, sf_dir))
    return messages.decode_message(texts, schemas.CHANGES)


# Projections, filters, predicates


@query
def valid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.valid_positions(fixtures.records(spark, sf_dir)).drop("ts")


@query
def semi_to_deg(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = positions.valid_positions(fixtures.records(spark, sf_dir))
    return records.select(
        "track_id",
        "seq",
        geometry.semi_to_deg(F.col("position_lat")).alias("lat"),
        geometry.semi_to_deg(F.col("position_long")).alias("lon"),
    )


@query
def to_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.to_positions(fixtures.records(spark, sf_dir))


@query
def close_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.polygon_edges(fixtures.part_polygons(spark, sf_dir))


@query
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fixtures.nodes(spark, sf_dir)
    flags = {
        name: geometry.point_in_polygon(F.col("lat"), F.col("lon"), ring)
        for name, ring in fixtures.DRAWN.items()
    }
    return nodes.select("id", *[flag.alias(f"in_{name}") for name, flag in flags.items()])


@query
def is_cycleway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways.is_cycleway(fixtures.way_tags(spark, sf_dir))


@query
def tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways.tag_values(fixtures.way_tags(spark, sf_dir))


@query
def way_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    subset = ways.way_subset(
        ways.MapTables(
            nodes=fixtures.nodes(spark, sf_dir),
            ways=fixtures.ways(spark, sf_dir),
            way_nodes=fixtures.way_nodes(spark, sf_dir),
            way_tags=fixtures.way_tags(spark, sf_dir),
        )
    )
    way_id = F.col("way_id").alias("id")
    return ways.union_elements(
        subset.nodes.select(F.lit("node").alias("type"), "id", "lat", "lon"),
        subset.ways.select(F.lit("way").alias("type"), way_id),
        subset.way_nodes.select(F.lit("nd").alias("type"), way_id, "pos", "ref"),
        subset.way_tags.select(F.lit("tag").alias("type"), way_id, "pos", "k", "v"),
    )


@query
def to_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = positions.to_polyline(fixtures.positions(spark, sf_dir))
    return positions.flatten_pieces(lines, "seq")


@query
def flatten_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    clipped = runs.clip_tracks(fixtures.positions(spark, sf_dir), fixtures.RECT)
    numbered = runs.sequential_ids(materialize(clipped)).select(
        F.col("way_id"), "pos", "lat", "lon"
    )
    points = runs.flatten_runs(ways.collect_path(numbered))
    place = F.shiftleft("piece", positions.PIECE_BITS) + F.col("pos")
    return points.select("way_id", place.alias("pos"), "lat", "lon")


@query
def polygon_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = fixtures.part_polygons(spark, sf_dir)
    return drawn.select("polygon_id", geometry.polygon_text(F.col("ring")).alias("text"))


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways.union_elements(
        fixtures.nodes(spark, sf_dir).select(F.lit("node").alias("type"), "id", "lat", "lon"),
        fixtures.ways(spark, sf_dir).select(F.lit("way").alias("type"), F.col("way_id").alias("id")),
    )


@query
def union_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir)


@query
def split_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, found_ways = ways.split_elements(_elements(spark, sf_dir))

    def count(df: DataFrame) -> DataFrame:
        return df.groupBy("type").agg(F.count("id").alias("n"), F.sum("id").alias("ids"))

    return count(nodes).unionByName(count(found_ways))


@query
def drop_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("kind"), "event_id", "user_id")
    return messages.drop_heartbeats(rows, "view")


@query
def highway_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.way_tags(spark, sf_dir)
    return rows.select("way_id", "pos", "v", tags.highway_class(F.col("v")).alias("class"))


@query
def rewrite_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("kind"), "event_id", "props")
    return messages.rewrite_by_kind(rows, "signup", "props", F.lit("x"))


# Joins


@query
def resolve_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways.resolve_ways(fixtures.way_nodes(spark, sf_dir), fixtures.nodes(spark, sf_dir))


@query
def resolve_ways_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caller's own forms of nodes and ways in the result."""
    resolved = ways.resolve_ways(
        fixtures.way_nodes(spark, sf_dir),
        fixtures.nodes(spark, sf_dir),
        node_fn=lambda node: F.concat_ws("/", F.lit("n"), node["id"].cast("string")),
        way_fn=lambda way_id: way_id * 2 + 1,
    )
    return resolved.select("way_id", "pos", "node", "way")


def _cycleways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways.is_cycleway(fixtures.way_tags(spark, sf_dir))


@query
def referenced_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways.referenced_nodes(
        fixtures.nodes(spark, sf_dir), fixtures.way_nodes(spark, sf_dir), _cycleways(spark, sf_dir)
    )


@query
def ways_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways.ways_touching(
        fixtures.way_nodes(spark, sf_dir),
        fixtures.nodes(spark, sf_dir),
        fixtures.way_tags(spark, sf_dir),
        fixtures.ELL,
    )


@query
def ways_with_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways.ways_with_nodes(
        fixtures.way_nodes(spark, sf_dir), fixtures.nodes(spark, sf_dir), ways_touching(spark, sf_dir)
    )


@query
def ways_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.ways_in_polygon(
        fixtures.way_nodes(spark, sf_dir),
        fixtures.nodes(spark, sf_dir),
        fixtures.way_tags(spark, sf_dir),
        fixtures.TRI,
    )


def _save_area(spark: SparkSession, sf_dir: str, path: str, area_id: str, ring: geometry.Ring) -> None:
    tables = [make(spark, sf_dir) for make in (fixtures.way_nodes, fixtures.nodes, fixtures.way_tags)]
    workflows.area_result(*tables, ring, path, area_id)


@query
def area_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways of two areas as stored, after one of them was drawn anew."""
    path = work_path(spark, "areas")
    for area_id, ring in (("north", fixtures.RECT), ("south", fixtures.ELL), ("north", fixtures.TRI)):
        _save_area(spark, sf_dir, path, area_id, ring)
    return areas.area_ways(spark, path)


@query
def gated_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three rounds of requests for two areas make: all, nothing, and the area drawn anew.

    The later rounds ask with the hashes of the exports before.
    """
    path, track = work_path(spark, "areas"), materialize(fixtures.positions(spark, sf_dir))
    for area_id, ring in (("north", fixtures.RECT), ("south", fixtures.SMALL)):
        _save_area(spark, sf_dir, path, area_id, ring)
    known: dict[str, str | None] = {"north": None, "south": None}
    made = None
    for asked in (1, 2, 3):
        if asked == 3:
            _save_area(spark, sf_dir, path, "north", fixtures.SMALL)
        rows = [(area_id, asked, found) for area_id, found in known.items()]
        exports = workflows.answer_requests(spark.createDataFrame(rows, schemas.AREA_REQUESTS), track, path)[1]
        if exports is not None:
            exports = exports.withColumn("asked", F.lit(asked).cast("long")).drop("hash")
            made = exports if made is None else made.unionByName(exports)
        known = {r.area_id: r.hash for r in areas.load_areas(spark, path).collect()}
    return made


@query
def ways_in_polygon_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 7th node is given twice, first somewhere else."""
    nodes = fixtures.nodes(spark, sf_dir).withColumn("doc_order", F.lit(1))
    earlier = nodes.where("id % 7 = 0").withColumns({"lat": F.col("lon"), "lon": F.col("lat"), "doc_order": F.lit(0)})
    return workflows.ways_in_polygon(
        fixtures.way_nodes(spark, sf_dir),
        nodes.unionByName(earlier),
        fixtures.way_tags(spark, sf_dir),
        fixtures.TRI,
        node_order="doc_order",
    )


@query
def offer_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = fixtures.track_blobs(spark, sf_dir).select("id", "hash")
    return store.offer_hashes(offers, fixtures.known_blobs(spark, sf_dir))


@query
def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixtures.track_blobs(spark, sf_dir).select("id", "hash")
    return store.new_files(files, fixtures.known_blobs(spark, sf_dir), "id")


@query
def accepted_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = offer_hashes(spark, sf_dir).where("answer = 'accept'")
    files = fixtures.track_blobs(spark, sf_dir).select("id", "hash")
    return store.accepted_uploads(answers, files, "id")


@query
def points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = fixtures.drawn_polygons(spark)
    return polygons.points_in_polygons(fixtures.nodes(spark, sf_dir), drawn).select("id", "polygon_id")


@query
def points_in_many_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = fixtures.supplier_polygons(spark, sf_dir)
    return polygons.points_in_polygons(fixtures.nodes(spark, sf_dir), drawn, cell=0.001, returned=["id"])


@query
def points_in_large_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = fixtures.supplier_rings(spark, sf_dir)
    return polygon_index.points_in_large_polygons(fixtures.half_nodes(spark, sf_dir), drawn, cell=100.0, returned=["id"])


# Aggregations


@query
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixtures.positions(spark, sf_dir)
    overall = positions.bounds(points).withColumn("track_id", F.lit(None).cast("long"))
    return positions.bounds(points, "track_id").unionByName(overall)


@query
def last_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways.last_by_key(_event_values(spark, sf_dir), "user_id", "event_id")


@query
def distinct_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways.distinct_refs(fixtures.way_nodes(spark, sf_dir), _cycleways(spark, sf_dir))


@query
def collect_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = ways.resolve_ways(fixtures.dense_way_nodes(spark, sf_dir), fixtures.nodes(spark, sf_dir))
    return positions.flatten_pieces(ways.collect_path(resolved), "pos")


@query
def known_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.known_hashes(fixtures.track_blobs(spark, sf_dir))


@query
def track_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.track_start(fixtures.positions(spark, sf_dir))


@query
def reassemble_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.reassemble_chunks(fixtures.chunks(spark, sf_dir))


@query
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.fingerprint(fixtures.table(spark, sf_dir, "documents"), "text")


# Windows


def _rect() -> Column:
    return geometry.point_in_polygon(F.col("lat"), F.col("lon"), fixtures.RECT)


def _halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.halo_keep(fixtures.positions(spark, sf_dir), _rect())


@query
def halo_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halo(spark, sf_dir).select("track_id", "seq", "keep")


@query
def segment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.segment_runs(_halo(spark, sf_dir)).select("track_id", "run", "seq")


@query
def clip_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.clip_tracks(fixtures.positions(spark, sf_dir), fixtures.RECT)


@query
def clip_tracks_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.clip_tracks(fixtures.positions(spark, sf_dir), fixtures.TRI, selective=True)


@query
def run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_order(clip_tracks(spark, sf_dir))


@query
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = runs.sequential_ids(materialize(clip_tracks(spark, sf_dir)))
    return numbered.select("track_id", "run", "seq", "pos", "node_id", "way_id")


# Sets


@query
def set_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fixtures.known_blobs(spark, sf_dir).select("hash")
    return store.set_add(known, fixtures.new_blobs(spark, sf_dir).select("hash"))


@query
def set_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fixtures.track_blobs(spark, sf_dir).select("id")
    return store.set_remove(ids, _withdrawn(spark, sf_dir))


@query
def removal_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.removal_messages(_withdrawn(spark, sf_dir))


# Scalar functions


@query
def md5_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixtures.table(spark, sf_dir, "pages")
    return pages.select("page_id", scalar.md5_upper(F.col("html")).alias("hash"))


@query
def ms_to_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions.track_start(fixtures.positions(spark, sf_dir))
    return _naive(rows.select("track_id", scalar.ms_to_ts(F.col("start_ms")).alias("start")), "start")


@query
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = scalar.text_to_long(scalar.json_field(F.col("props"), "$.k"))
    return _events(spark, sf_dir).select("event_id", value.alias("k"))


@query
def url_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "documents")
    return rows.select("doc_id", scalar.url_encode(F.col("text")).alias("encoded"))


# Changes and streams


@query
def track_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.track_set(_messages(spark, sf_dir))


@query
def snapshot_then_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.snapshot_then_changes(_messages(spark, sf_dir), SNAPSHOT_CUT)


@query
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.latest_value(_event_values(spark, sf_dir), "user_id", "event_id")


@query
def artifact_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.artifact_freshness(fixtures.artifact_log(_events(spark, sf_dir)))


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "ingest")

    def start(documents: DataFrame) -> StreamingQuery:
        stream = documents.select("doc_id", F.col("text").alias("data"))
        return streaming_ingest.stream_ingest(stream, f"{path}/store", f"{path}/checkpoint", "doc_id", interval=None)

    documents = _arrive(spark, sf_dir, "documents", "doc_id", start)
    return streaming_ingest.read_ingested(documents, f"{path}/store", "doc_id", "text").select("hash", "doc_id")


@query
def stream_track_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "track-set")

    def start(events: DataFrame) -> StreamingQuery:
        changes = fixtures.changes(events)
        return streaming_changes.stream_track_set(changes, f"{path}/store", f"{path}/checkpoint", interval=None)

    _arrive(spark, sf_dir, "events", "event_id", start)
    return streaming_changes.read_track_set(spark, f"{path}/store")


@query
def stream_latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "latest")
    columns = ["user_id", "event_id", "event_type", "value"]

    def start(events: DataFrame) -> StreamingQuery:
        return streaming_changes.stream_latest_value(
            events.select(*columns), "user_id", "event_id", f"{path}/store", f"{path}/checkpoint", interval=None
        )

    events = _arrive(spark, sf_dir, "events", "event_id", start)
    return streaming_changes.read_latest_value(spark, f"{path}/store", events.select(*columns).schema, "user_id")


@query
def stream_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "freshness")

    def start(events: DataFrame) -> StreamingQuery:
        log = fixtures.artifact_log(events)
        return streaming_changes.stream_freshness(log, f"{path}/store", f"{path}/checkpoint", interval=None)

    _arrive(spark, sf_dir, "events", "event_id", start)
    return streaming_changes.read_freshness(spark, f"{path}/store")
