"""Shapes of plans that matter on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from tracklake import schemas
from tracklake.operators import changes, keys, positions, runs, store, ways
from tracklake.plans import fixtures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("positions"))
    fixtures.positions(spark, sf_dir).write.parquet(f"{path}/positions")
    return spark.read.parquet(f"{path}/positions")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def scans(text):
    return [line for line in text.splitlines() if "FileScan" in line]


def test_clip_shuffles_positions_once(stored, no_broadcast):
    text = plan(runs.clip_tracks(stored, fixtures.RECT))
    wide = [line for line in text.splitlines() if "Exchange" in line]
    # Positions on (track, block); for the run numbers the inside ones again, without coordinates,
    # their block totals by track, and those back on (track, block).
    assert len(wide) == 4
    assert all("SinglePartition" not in line for line in wide)
    assert len([line for line in wide if re.search(r"hashpartitioning\(track_id#\d+L, _block", line)]) == 3


def test_clip_prunes_the_run_number_scan(stored):
    found = scans(plan(runs.clip_tracks(stored, fixtures.ELL)))
    counted, whole = sorted(found, key=lambda line: "ts_ms" in line)
    assert "PushedFilters: [" in counted and "GreaterThan(lat," in counted and "LessThan(lat," in counted
    assert "ts_ms" not in counted.split("ReadSchema")[1]
    assert "ts_ms" in whole.split("ReadSchema")[1]


def test_hot_track_is_split(stored, no_broadcast):
    by_track = stored.repartition("track_id")
    text = plan(runs.clip_tracks(by_track, fixtures.RECT))
    assert len(re.findall(r"hashpartitioning\(track_id#\d+L, _block", text)) == 3


def test_no_python_and_no_nested_loops(spark, sf_dir):
    events = fixtures.table(spark, sf_dir, "events")
    frames = [
        runs.clip_tracks(fixtures.positions(spark, sf_dir), fixtures.TRI),
        ways.ways_touching(
            fixtures.way_nodes(spark, sf_dir),
            fixtures.nodes(spark, sf_dir),
            fixtures.way_tags(spark, sf_dir),
            fixtures.ELL,
        ),
        store.append_tracks(
            fixtures.known_blobs(spark, sf_dir), fixtures.new_blobs(spark, sf_dir), "id"
        ),
        changes.artifact_freshness(fixtures.artifact_log(events)),
    ]
    for df in frames:
        text = plan(df)
        assert not re.search(r"Python|Pandas|NestedLoop|Cartesian", text)


def test_hash_operators_do_not_read_blobs(spark, tmp_path):
    spark.createDataFrame([(1, "A", bytearray(b"x"))], schemas.TRACK_BLOBS).write.parquet(
        str(tmp_path / "blobs")
    )
    blobs = spark.read.parquet(str(tmp_path / "blobs"))
    for df in (
        store.scan_tracks(blobs),
        store.known_hashes(blobs),
        store.offer_hashes(blobs.select("id", "hash"), blobs),
        store.new_files(blobs.select("id", "hash"), blobs, "id"),
    ):
        assert all("data" not in line.split("ReadSchema")[1] for line in scans(plan(df)))
    assert "EqualTo(id,1)" in plan(store.blob_lookup(blobs, 1))


def test_lookup_of_first_tag_aggregates_in_place(spark, sf_dir):
    text = plan(ways.is_cycleway(fixtures.way_tags(spark, sf_dir)))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_null_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([], schemas.RECORDS).write.parquet(str(tmp_path / "records"))
    records = spark.read.parquet(str(tmp_path / "records"))
    assert "IsNotNull(position_lat)" in plan(positions.to_positions(records))


def test_numbering_has_no_single_task_over_rows(stored, no_broadcast):
    text = plan(runs.segment_runs(runs.halo_keep(stored, F.col("lat") > 0)))
    assert "SinglePartition" not in text


@pytest.fixture
def small_skew_limits(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(keys, "MAX_BROADCAST_KEYS", 0)
    limits = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for name, value in limits.items():
        spark.conf.set(name, value)
    yield
    for name in limits:
        spark.conf.unset(name)


def executed(df):
    """The plan as it was adapted while running."""
    df._jdf.queryExecution().executedPlan().executeCollectPublic()
    return plan(df)


def test_hot_node_is_split(spark, small_skew_limits):
    refs = spark.range(0, 300_000, numPartitions=16).select(
        F.col("id").alias("way_id"),
        (F.col("id") * 3).alias("pos"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("ref"),
    )
    nodes = spark.range(1000).select("id", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    for mode in ("error", "drop"):
        assert "skew=true" in executed(ways.resolve_ways(refs, nodes, on_missing=mode))


def test_hot_way_is_split(spark, small_skew_limits):
    refs = spark.range(0, 300_000, numPartitions=16).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("way_id"),
        F.col("id").alias("pos"),
        (F.col("id") * 7).alias("ref"),
    )
    tags = spark.range(1000).select(
        F.col("id").alias("way_id"), F.lit(0).alias("pos"), F.lit("highway").alias("k"), F.lit("cycleway").alias("v")
    )
    chosen = keys.key_set(ways.is_cycleway(tags))
    assert "skew=true" in executed(ways.of_ways(refs, chosen))


def test_small_key_sets_are_broadcast(spark):
    few = keys.key_set(spark.range(10).select(F.col("id").alias("way_id")))
    many = keys.key_set(spark.range(10).select(F.col("id").alias("way_id")), max_broadcast=9)
    refs = spark.range(100).select(F.col("id").alias("way_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(ways.of_ways(refs, few))
        assert "SortMergeJoin" in plan(ways.of_ways(refs, many))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_content_is_split(spark, small_skew_limits):
    offers = spark.range(0, 300_000, numPartitions=16).select(
        F.md5(F.col("id").cast("string")).alias("name"),
        F.md5(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("string")).alias("hash"),
    )
    known = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("hash"))
    assert "skew=true" in executed(store.offer_hashes(offers, known))
