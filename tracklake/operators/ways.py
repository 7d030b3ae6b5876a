"""Map data: nodes, the ways that refer to them, and tags.

Tables: nodes (id, lat, lon), way_nodes (way_id, pos, ref), way_tags (way_id, pos, k, v).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions.geometry import Ring
from tracklake.operators.keys import key_set
from tracklake.operators.polygons import points_inside
from tracklake.operators.positions import PIECE_BITS, collect_pieces


@dataclass(frozen=True)
class MapTables:
    nodes: DataFrame
    ways: DataFrame
    way_nodes: DataFrame
    way_tags: DataFrame
    relations: DataFrame | None = None


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one latest in the order. Reduces before the shuffle."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    latest = F.max_by(whole, order).alias("_row")
    return df.groupBy(F.col(key).alias("_key")).agg(latest).select("_row.*")


def one_per_id(nodes: DataFrame, order: str | None) -> DataFrame:
    """The last node of each id by ``order``; without an order a repeated id is an error."""
    if order is not None:
        return last_by_key(nodes, "id", order)
    repeated = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id").head()
    if repeated:
        raise ValueError(f"several nodes with id {repeated.id}; name their order in node_order")
    return nodes


def resolve_ways(
    way_nodes: DataFrame,
    nodes: DataFrame,
    on_missing: str = "error",
    node_order: str | None = None,
    node_fn: Callable[[Column], Column] | None = None,
    way_fn: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Way references with their node's coordinates: (way_id, pos, ref, lat, lon).

    Order and repeated references stay as they are. A reference without a node is an error, or the
    row is dropped with ``on_missing="drop"``. With ``node_order`` the last of several nodes with one
    id counts; without it node ids must be unique, which is checked first. ``node_fn`` maps a struct (id, lat, lon) and
    ``way_fn`` the way id to columns ``node`` and ``way`` that are added.
    """
    if on_missing not in ("error", "drop"):
        raise ValueError(f"on_missing must be 'error' or 'drop', got {on_missing!r}")
    nodes = one_per_id(nodes, node_order)
    strict = on_missing == "error"
    target = nodes.select(F.col("id").alias("_id"), "lat", "lon")
    joined = way_nodes.join(target, F.col("ref") == F.col("_id"), "left" if strict else "inner")
    if strict:
        # A filter, not a column: an unused column would be pruned and never fail.
        message = F.concat(F.lit("no node for reference "), F.col("ref").cast("string"))
        found = F.coalesce(F.col("_id"), F.raise_error(message).cast("long"))
        joined = joined.where(found.isNotNull())
    columns = [F.col(c) for c in ("way_id", "pos", "ref", "lat", "lon")]
    if node_fn is not None:
        columns.append(node_fn(F.struct(F.col("ref").alias("id"), "lat", "lon")).alias("node"))
    if way_fn is not None:
        columns.append(way_fn(F.col("way_id")).alias("way"))
    return joined.select(*columns)


def collect_path(resolved: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """Ordered coordinates per way: (way_id, piece, points); ``pos`` must count densely from 0."""
    return collect_pieces(resolved, "way_id", "pos", "points", bits)


def is_cycleway(way_tags: DataFrame, value: str = "cycleway", key: str = "highway") -> DataFrame:
    """Ids of the ways whose first ``key`` tag has the value; later tags do not count.

    Compares two positions instead of carrying the text, so it aggregates in place.
    """
    first = F.min("pos")
    first_match = F.min(F.when(F.col("v") == value, F.col("pos")))
    return (
        way_tags.where(F.col("k") == key)
        .groupBy("way_id")
        .agg(first.alias("_first"), first_match.alias("_match"))
        .where(F.col("_first") == F.col("_match"))
        .select("way_id")
    )


def tag_values(way_tags: DataFrame, key: str = "highway") -> DataFrame:
    """Distinct values of one tag key, sorted."""
    return way_tags.where(F.col("k") == key).select("v").distinct().orderBy("v")


def of_ways(df: DataFrame, ways: DataFrame) -> DataFrame:
    """The rows (references, tags) of the given ways."""
    return df.join(ways.select("way_id"), "way_id", "left_semi")


def distinct_refs(way_nodes: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """Distinct node ids used by the ways (all, or those in ``ways``)."""
    if ways is not None:
        way_nodes = of_ways(way_nodes, ways)
    return way_nodes.select("ref").distinct()


def referenced_nodes(nodes: DataFrame, way_nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes used by the given ways. The ways, then the node ids, are computed and stored first."""
    return nodes_with_ids(nodes, distinct_refs(way_nodes, key_set(ways.select("way_id").distinct())))


def nodes_with_ids(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    refs = key_set(refs)
    return nodes.join(refs, nodes["id"] == refs["ref"], "left_semi")


def way_subset(tables: MapTables, value: str = "cycleway", key: str = "highway") -> MapTables:
    """The sub-document of matching ways: their nodes and tags, no relations.

    The matching ways and their node ids are computed and stored first.
    """
    chosen = key_set(is_cycleway(tables.way_tags, value, key))
    return MapTables(
        nodes=nodes_with_ids(tables.nodes, distinct_refs(tables.way_nodes, chosen)),
        ways=of_ways(tables.ways, chosen),
        way_nodes=of_ways(tables.way_nodes, chosen),
        way_tags=of_ways(tables.way_tags, chosen),
    )


def split_elements(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A mixed element table as (nodes, ways), whatever the order of the rows."""
    return elements.where(F.col("type") == "node"), elements.where(F.col("type") == "way")


def union_elements(*elements: DataFrame) -> DataFrame:
    """Element tables as one; columns a table lacks are null."""
    result = elements[0]
    for other in elements[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def ways_touching(
    way_nodes: DataFrame,
    nodes: DataFrame,
    way_tags: DataFrame,
    ring: Ring,
    key: str = "highway",
    value: str = "cycleway",
    node_order: str | None = None,
) -> DataFrame:
    """Ids of the ways with a node in the polygon and the tag at any place among their tags.

    With ``node_order`` the last of several nodes with one id counts, before the polygon is asked;
    without it ids must be unique. The nodes in the polygon are computed and stored first.
    """
    inside = key_set(points_inside(one_per_id(nodes, node_order), ring).select("id"))
    tagged = way_tags.where((F.col("k") == key) & (F.col("v") == value)).select("way_id").distinct()
    return (
        way_nodes.join(inside, way_nodes["ref"] == inside["id"], "left_semi")
        .select("way_id")
        .distinct()
        .join(tagged, "way_id", "left_semi")
    )


def ways_with_nodes(
    way_nodes: DataFrame, nodes: DataFrame, ways: DataFrame, node_order: str | None = None
) -> DataFrame:
    """The given ways and all their nodes, also those outside the polygon, without tags.

    Element rows (type, id, pos, ref, lat, lon): one per way reference and one per node. With
    ``node_order`` the last of several nodes with one id counts; without it ids must be unique. The
    ways, then the node ids, are computed and stored first.
    """
    chosen = of_ways(way_nodes, key_set(ways.select("way_id").distinct()))
    way_rows = chosen.select(F.lit("way").alias("type"), F.col("way_id").alias("id"), "pos", "ref")
    used = one_per_id(nodes_with_ids(nodes, distinct_refs(chosen)), node_order)
    node_rows = used.select(
        F.lit("node").alias("type"), "id", "lat", "lon"
    )
    return union_elements(way_rows, node_rows).select("type", "id", "pos", "ref", "lat", "lon")
