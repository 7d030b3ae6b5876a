"""Mappings of the general-purpose test tables onto tracks, map data and messages.

Values are derived so that coordinates fall on a grid around one town and every rule of the operators
is exercised. Row numbers per track go through the same block-wise numbering as real data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions.geometry import SEMICIRCLE, semi_to_deg
from tracklake.functions.scalar import epoch_ms, md5_upper
from tracklake.operators.blocks import block_of, number_rows
from tracklake.operators.changes import ADDED, CHANGE, GENERATED, REMOVED, REQUEST

# Grid origin in semicircles.
LAT0, LON0 = 461900000, -109400000
POS_BITS = 40


def on_grid(x: float, y: float) -> tuple[float, float]:
    return (LAT0 + x * 1000) * SEMICIRCLE, (LON0 + y * 1000) * SEMICIRCLE


RECT = [(38.73, -9.15), (38.78, -9.15), (38.78, -9.10), (38.73, -9.10)]
SMALL = [(38.74, -9.14), (38.76, -9.14), (38.76, -9.12), (38.74, -9.12)]
ELL = [
    on_grid(*v)
    for v in [(200, 200), (800, 200), (800, 500), (500, 500), (500, 800), (200, 800)]
]
TRI = [on_grid(*v) for v in [(100, 100), (900, 100), (500, 900)]]
DRAWN = {"rect": RECT, "ell": ELL, "tri": TRI}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid_semicircles(number: Column, user: Column) -> tuple[Column, Column]:
    lat = F.lit(LAT0) + ((number * 37 + user * 101) % 1000) * 1000
    lon = F.lit(LON0) + ((number * 53 + user * 211) % 1000) * 1000
    return lat, lon


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as device records; errors have no position."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    numbered = number_rows(events, ["user_id"], ["event_id"], "seq")
    lat, lon = _grid_semicircles(F.col("seq") + 1, F.col("user_id"))
    valid = F.col("event_type") != "error"
    return numbered.select(
        F.col("user_id").alias("track_id"),
        "seq",
        F.when(valid, lat).cast("int").alias("position_lat"),
        F.when(valid, lon).cast("int").alias("position_long"),
        "ts",
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    events = events.select("user_id", "event_id", "ts")
    numbered = number_rows(events, ["user_id"], ["event_id"], "seq")
    lat, lon = _grid_semicircles(F.col("seq") + 1, F.col("user_id"))
    return numbered.select(
        F.col("user_id").alias("track_id"),
        "seq",
        semi_to_deg(lat).alias("lat"),
        semi_to_deg(lon).alias("lon"),
        epoch_ms(F.col("ts")).alias("ts_ms"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        semi_to_deg(F.lit(LAT0) + (key * 7919 % 1000) * 1000).alias("lat"),
        semi_to_deg(F.lit(LON0) + (key * 104729 % 100) * 10000).alias("lon"),
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way_id"))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as way references.

    ``pos`` orders the references without a window: line number, then part. Equal places have equal
    references.
    """
    pos = F.shiftleft(F.col("l_linenumber").cast("long"), POS_BITS) + F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("way_id"), pos.alias("pos"), F.col("l_partkey").alias("ref")
    )


def dense_way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ``pos`` counting from 0 per way."""
    sparse = way_nodes(spark, sf_dir).withColumnRenamed("pos", "_pos")
    return number_rows(sparse, ["way_id"], ["_pos"], "pos", block_of("_pos", 32)).select(
        "way_id", "pos", "ref"
    )


PRIORITY_CLASS = {
    "1-URGENT": "cycleway",
    "2-HIGH": "residential",
    "3-MEDIUM": "primary",
    "4-NOT SPECIFIED": "track",
    "5-LOW": "steps",
}


def way_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tags per order, and a second highway tag that must not count for finished ones."""
    orders = table(spark, sf_dir, "orders")
    road = F.lit(None)
    for priority, name in PRIORITY_CLASS.items():
        road = F.when(F.col("o_orderpriority") == priority, name).otherwise(road)
    tag = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    tags = F.array(tag("surface", F.col("o_orderstatus")), tag("highway", road))
    extra = F.array(tag("highway", F.lit("cycleway")))
    tags = F.when(F.col("o_orderstatus") == "F", F.concat(tags, extra)).otherwise(tags)
    return orders.select(
        F.col("o_orderkey").alias("way_id"), F.posexplode(tags).alias("pos", "_t")
    ).select("way_id", F.col("pos").cast("long").alias("pos"), "_t.k", "_t.v")


def track_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        md5_upper(F.col("text")).alias("hash"),
        F.col("text").alias("data"),
        "lang",
        "source",
    )


def known_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_blobs(spark, sf_dir).where(F.col("lang") == "en")


def new_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_blobs(spark, sf_dir).where(F.col("lang") != "en")


def _by_type(names: dict[str, str]) -> Column:
    """The names of some event types; the others stay as they are and mean nothing to the operators."""
    kind = F.col("event_type")
    for event_type, name in names.items():
        kind = F.when(F.col("event_type") == event_type, name).otherwise(kind)
    return kind


CHANGE_KINDS = {"signup": ADDED, "purchase": REMOVED}
LOG_KINDS = {"signup": CHANGE, "view": GENERATED, "click": REQUEST}


def changes(events: DataFrame) -> DataFrame:
    """All events, batch or stream, as messages, among them adds and removes."""
    return events.select(
        F.col("event_id").alias("order_no"),
        _by_type(CHANGE_KINDS).alias("kind"),
        F.col("user_id").alias("key"),
        F.col("props").alias("payload"),
    )


def artifact_log(events: DataFrame) -> DataFrame:
    """All events, batch or stream, as a log of ten artifacts with changes, generations and requests."""
    return events.select(
        (F.col("user_id") % 10).alias("artifact_id"),
        F.col("event_id").alias("order_no"),
        _by_type(LOG_KINDS).alias("kind"),
        (F.col("event_id") % 3).cast("string").alias("hash"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("message_id"), F.col("turn").alias("n"), F.col("text").alias("chunk")
    )


def drawn_polygons(spark: SparkSession) -> DataFrame:
    from tracklake import schemas

    return spark.createDataFrame([(name, ring) for name, ring in DRAWN.items()], schemas.POLYGONS)


def part_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-cornered polygon per part, in grid units."""
    x = (F.col("p_partkey") * 7919 % 1000).cast("double")
    y = (F.col("p_partkey") * 104729 % 1000).cast("double")
    size = F.col("p_size").cast("double")
    corners = [(x, y), (x + size, y), (x + size * 1.5, y + size), (x + size, y + size * 2), (x, y + size)]
    ring = F.array(*[F.struct(a.alias("lat"), b.alias("lon")) for a, b in corners])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("polygon_id"), ring.alias("ring")
    )


def supplier_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle or diamond per supplier on the node grid, of 2 to 600 grid units in size."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    half = nation * nation * F.lit(0.5) + 1
    x = (key * 613 % 1000).cast("double")
    y = (key * 389 % 1000).cast("double")
    lat = lambda v: semi_to_deg(F.lit(LAT0) + v * 1000)
    lon = lambda v: semi_to_deg(F.lit(LON0) + v * 1000)
    vertex = lambda a, b: F.struct(lat(a).alias("lat"), lon(b).alias("lon"))
    box = [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)]
    diamond = [(x - half, y), (x, y - half), (x + half, y), (x, y + half)]
    ring = F.when(nation < 12, F.array(*[vertex(*v) for v in box])).otherwise(
        F.array(*[vertex(*v) for v in diamond])
    )
    return table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("polygon_id"), ring.alias("ring")
    )


def supplier_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of 1,000 vertices per supplier, in grid units: zigzags above and below a level line."""
    key = F.col("s_suppkey")
    x, y = (key * 7919 % 1000).cast("double"), (key * 104729 % 500).cast("double")
    steps = F.sequence(F.lit(0), F.lit(499))
    vertex = lambda lat, t: F.struct(lat.alias("lat"), (y + t).alias("lon"))
    upper = F.transform(steps, lambda t: vertex(x + 40 + t % 2 * 20, t))
    lower = F.transform(F.reverse(steps), lambda t: vertex(x - 40 - t % 3 * 10, t))
    return table(spark, sf_dir, "supplier").select(key.cast("string").alias("polygon_id"), F.concat(upper, lower).alias("ring"))


def half_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points on the same grid, at whole latitudes and half longitudes."""
    key = F.col("p_partkey")
    lat, lon = (key * 7919 % 1000).cast("double"), (key * 104729 % 2000) / F.lit(2.0)
    return table(spark, sf_dir, "part").select(key.alias("id"), lat.alias("lat"), lon.alias("lon"))
