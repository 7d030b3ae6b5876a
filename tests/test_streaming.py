"""Streams in several micro-batches give the batch result, and a second run adds nothing."""

import pytest
from pyspark.sql import functions as F

from tracklake.functions.scalar import md5_upper
from tracklake.operators import changes
from tracklake.plans import fixtures
from tracklake.streaming import changes as streams
from tracklake.streaming import ingest, store


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def split_events(spark, sf_dir, tmp_path_factory):
    """Events in order in four folders of one stream, written one after the other."""
    path = str(tmp_path_factory.mktemp("events"))
    events = fixtures.table(spark, sf_dir, "events")
    for i in range(4):
        part = events.where(F.col("event_id").between(i * 2500, i * 2500 + 2499))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def twice(run):
    """Runs a query, then again on its checkpoint; the number of batches of each."""
    counts = []
    for _ in range(2):
        query = run()
        query.awaitTermination()
        counts.append(sum(p["numInputRows"] > 0 for p in query.recentProgress))
    return counts


def test_ingest(spark, sf_dir, tmp_path):
    source = str(tmp_path / "source")
    documents = fixtures.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("data"))
    documents.repartition(4).write.parquet(source)
    target = str(tmp_path / "store")
    read = stream(spark, source)
    batches = twice(
        lambda: ingest.stream_ingest(read, target, str(tmp_path / "cp"), "doc_id", interval=None)
    )
    assert batches == [4, 0]
    stored = ingest.read_ingested(read, target, "doc_id")
    wanted = documents.select(md5_upper(F.col("data")).alias("hash")).distinct()
    assert rows(stored, "hash") == rows(wanted, "hash")


def test_ingest_of_files(spark, tmp_path):
    source, later = tmp_path / "tracks", tmp_path / "later"
    (source / "deeper").mkdir(parents=True)
    (source / "deeper" / "no").write_bytes(b"no")
    for name, data in {"a": b"1", "b": b"2", "c": b"1"}.items():
        (source / name).write_bytes(data)
    target = str(tmp_path / "store")

    def run():
        files = ingest.file_stream(spark, [str(source), str(later)], max_files=1)
        return ingest.stream_ingest(files, target, str(tmp_path / "cp"), "path", interval=None)

    run().awaitTermination()
    (source / "d").write_bytes(b"2")
    later.mkdir()
    (later / "e").write_bytes(b"3")
    run().awaitTermination()
    stored = ingest.read_ingested(ingest.file_stream(spark, [str(source)]), target, "path")
    assert sorted(bytes(r.data) for r in stored.collect()) == [b"1", b"2", b"3"]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    path, schema = str(tmp_path), "a long"
    df = spark.createDataFrame([(1,), (2,)], schema)
    store.prepare(spark, path, df.schema)
    store.write_batch(df, path, 0)
    store.write_batch(df, path, 1)
    store.write_batch(df, path, 1)
    assert store.read(spark, path, df.schema).count() == 4
    assert store.read_before(spark, path, df.schema, 1).count() == 2


def test_track_set(spark, sf_dir, split_events, tmp_path):
    messages = fixtures.changes(stream(spark, split_events))
    target = str(tmp_path / "store")
    batches = twice(
        lambda: streams.stream_track_set(messages, target, str(tmp_path / "cp"), interval=None)
    )
    assert batches == [4, 0]
    wanted = changes.track_set(fixtures.changes(fixtures.table(spark, sf_dir, "events")))
    got = streams.read_track_set(spark, target)
    assert rows(got, "key", "order_no") == rows(wanted, "key", "order_no")


def test_latest_value(spark, sf_dir, split_events, tmp_path):
    updates = stream(spark, split_events).select("user_id", "event_id", "value")
    target = str(tmp_path / "store")
    streams.stream_latest_value(
        updates, "user_id", "event_id", target, str(tmp_path / "cp"), interval=None
    ).awaitTermination()
    wanted = changes.latest_value(
        fixtures.table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id"
    )
    got = streams.read_latest_value(spark, target, updates.schema, "user_id")
    assert rows(got, "user_id", "event_id") == rows(wanted, "user_id", "event_id")


def test_freshness(spark, sf_dir, split_events, tmp_path):
    log = fixtures.artifact_log(stream(spark, split_events))
    target = str(tmp_path / "store")
    batches = twice(lambda: streams.stream_freshness(log, target, str(tmp_path / "cp"), interval=None))
    assert batches == [4, 0]
    wanted = changes.artifact_freshness(fixtures.artifact_log(fixtures.table(spark, sf_dir, "events")))
    columns = ("artifact_id", "order_no", "hash", "up_to_date")
    assert rows(streams.read_freshness(spark, target), *columns) == rows(wanted, *columns)


def test_freshness_state_is_kept_in_two_directories(spark, split_events, tmp_path):
    log = fixtures.artifact_log(stream(spark, split_events))
    target = tmp_path / "store"
    streams.stream_freshness(log, str(target), str(tmp_path / "cp"), interval=None).awaitTermination()
    assert sorted(p.name for p in (target / "states").iterdir() if p.is_dir()) == ["batch=2", "batch=3"]


def test_freshness_refuses_falling_order(spark, tmp_path):
    log = tmp_path / "log"
    schema = "artifact_id long, order_no long, kind string, hash string"
    for n, order in enumerate((5, 3)):
        rows = spark.createDataFrame([(1, order, changes.CHANGE, None)], schema)
        rows.coalesce(1).write.parquet(str(log / str(n)))
        given = spark.readStream.schema(schema).parquet(str(log / "*"))
        query = streams.stream_freshness(given, str(tmp_path / "store"), str(tmp_path / "cp"), interval=None)
        if n == 0:
            query.awaitTermination()
        else:
            with pytest.raises(Exception, match="comes after"):
                query.awaitTermination()


def test_heartbeats_on_a_stream(spark, split_events):
    from tracklake.operators.messages import drop_heartbeats

    kinds = stream(spark, split_events).withColumnRenamed("event_type", "kind")
    assert drop_heartbeats(kinds, "view").isStreaming
