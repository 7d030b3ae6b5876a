import hashlib

import threading

import pytest
from pyspark.sql import functions as F

from tracklake import schemas
from tracklake.functions.scalar import md5_upper
from tracklake.operators import store
from tracklake.plans import workflows
from tracklake.sources import named_files, snapshots, tracks


def digest(data):
    return hashlib.md5(data).hexdigest().upper()


def blobs(spark, *data, start=1):
    rows = [(i, digest(d), bytearray(d)) for i, d in enumerate(data, start)]
    return spark.createDataFrame(rows, schemas.TRACK_BLOBS)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scan_directories(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "deeper").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "1.fit").write_bytes(b"\x00\xff")
    (tmp_path / "a" / "deeper" / "no.fit").write_bytes(b"no")
    (tmp_path / "b" / "2.fit").write_bytes(b"2")
    found = tracks.scan_track_files(spark, [str(tmp_path / d) for d in ("a", "b", "missing")])
    assert pairs(found, "hash") == sorted([(digest(b"\x00\xff"),), (digest(b"2"),)])
    assert tracks.scan_track_files(spark, [str(tmp_path / "missing")]).count() == 0
    with_data = tracks.scan_track_files(spark, [str(tmp_path / "a")], with_data=True)
    assert bytes(with_data.first().data) == b"\x00\xff"


def test_no_file_is_left_out_of_a_scan(spark, tmp_path):
    for name, content in (("a.fit", b"a"), ("empty.fit", b""), ("also empty", b""), ("_SUCCESS", b"")):
        (tmp_path / name).write_bytes(content)
    found = tracks.scan_track_files(spark, [str(tmp_path)], with_data=True)
    assert pairs(found, "hash", "length") == sorted([(digest(b"a"), 1), (digest(b""), 0), (digest(b""), 0)])
    assert all(r.modificationTime.year > 2000 for r in found.collect())
    for name in ("_b.fit", ".c.fit", "d %41:é.fit"):
        (tmp_path / name).write_bytes(name.encode())
    found = tracks.scan_track_files(spark, [f"file://{tmp_path}"], tasks=3)
    names = {r.path.rsplit("/", 1)[1]: r.hash for r in found.collect()}
    assert names == {p.name: digest(p.read_bytes()) for p in tmp_path.iterdir() if p.name != "_SUCCESS"}
    assert found.rdd.getNumPartitions() == 3


def test_files_are_read_in_bounded_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(named_files, "READ_BYTES", 5)
    monkeypatch.setattr(named_files, "LIST_ROWS", 2)
    contents = {f"{k}.fit": b"x" * k for k in range(7)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    import pyarrow as pa

    listed = list(named_files._list(iter([pa.record_batch([[str(tmp_path), str(tmp_path / "none")]], names=["d"])])))
    assert [b.num_rows for b in listed] == [2, 2, 2, 1]
    rows = pa.Table.from_batches(listed).sort_by("length").combine_chunks().to_batches()
    read = list(named_files._read(iter(rows)))
    assert [b.num_rows for b in read] == [4, 2, 1]
    assert [len(c) for b in read for c in b.column(3).to_pylist()] == list(range(7))


def test_append_counts_on(spark):
    stored = blobs(spark, b"a", b"b", start=5)
    new = spark.createDataFrame([(30, bytearray(b"x")), (10, bytearray(b"b"))], "n long, data binary")
    added = store.append_tracks(stored, new, "n")
    assert pairs(added, "id", "hash") == [(7, digest(b"b")), (8, digest(b"x"))]
    first = store.append_tracks(stored.where("false"), new, "n")
    assert pairs(first, "id") == [(1,), (2,)]


def test_ingest_skips_known_and_repeated_content(spark):
    stored = blobs(spark, b"a")
    files = spark.createDataFrame(
        [(n, bytearray(d)) for n, d in enumerate([b"a", b"x", b"y", b"x"])], "n long, data binary"
    ).withColumn("hash", md5_upper(F.col("data")))
    added = workflows.ingest_files(files, stored, "n")
    assert pairs(added, "id", "hash") == [(2, digest(b"y")), (3, digest(b"x"))]


def test_offers_and_uploads(spark):
    stored = blobs(spark, b"a")
    offers = spark.createDataFrame(
        [(1, digest(b"a")), (2, digest(b"x")), (3, digest(b"x"))], "id long, hash string"
    )
    answers = store.offer_hashes(offers, stored)
    assert pairs(answers, "id", "answer") == [(1, "confirm"), (2, "accept"), (3, "accept")]
    assert pairs(store.new_files(offers, stored, "id"), "id") == [(3,)]
    uploads = store.accepted_uploads(answers.where("answer = 'accept'"), offers, "id")
    assert pairs(uploads, "id", "hash") == [(3, digest(b"x"))]


def test_delete_of_an_unknown_id_still_reports(spark):
    stored = blobs(spark, b"a", b"b")
    ids = spark.createDataFrame([(2,), (77,)], "id long")
    assert pairs(store.delete_tracks(stored, ids), "id") == [(1,)]
    assert pairs(store.removal_messages(ids), "kind", "key") == [("removed", 2), ("removed", 77)]


def test_upsert(spark):
    schema = "id string, data string, version long"
    base = spark.createDataFrame([("a", "old", 9), ("b", "old", 9)], schema)
    updates = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("c", "1", 1)], schema)
    got = store.upsert_latest(base, updates, "id", "version")
    assert pairs(got, "id", "data") == [("a", "2"), ("b", "old"), ("c", "1")]


def test_lookup(spark):
    stored = blobs(spark, b"a", b"b")
    assert bytes(store.blob_lookup(stored, 2).first().data) == b"b"
    assert store.blob_lookup(stored, 3).isEmpty()


def test_sets(spark):
    one = spark.createDataFrame([("a",), ("b",)], "hash string")
    two = spark.createDataFrame([("b",), ("c",)], "hash string")
    assert pairs(store.set_add(one, two), "hash") == [("a",), ("b",), ("c",)]
    assert pairs(store.set_remove(one, two), "hash") == [("a",)]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "table")
    assert snapshots.load_snapshot(spark, path, schemas.NODES).count() == 0
    assert snapshots.save_snapshot(spark.createDataFrame([(1, 1.0, 1.0)], schemas.NODES), path) == 1
    current = snapshots.load_snapshot(spark, path, schemas.NODES)
    assert snapshots.save_snapshot(current.where("false"), path, expected=1) == 2
    assert snapshots.load_snapshot(spark, path, schemas.NODES).count() == 0


def test_drawings_conflict(spark, tmp_path):
    path = str(tmp_path / "drawings")
    drawn = spark.createDataFrame([("p", [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], schemas.POLYGONS)
    assert snapshots.load_polygons(spark, path).isEmpty()
    assert snapshots.save_polygons(drawn, path, expected=0) == 1
    with pytest.raises(snapshots.RevisionConflict):
        snapshots.save_polygons(drawn, path, expected=0)
    assert snapshots.load_polygons(spark, path).collect() == drawn.collect()


def test_ensure_table_seeds_once(spark, tmp_path):
    spark.sql(f"create database if not exists seeded location '{tmp_path}/seeded.db'")
    seed = spark.createDataFrame([(1, 1.0, 1.0)], schemas.NODES)
    assert snapshots.ensure_table(spark, "seeded.nodes", schemas.NODES, seed)
    assert not snapshots.ensure_table(spark, "seeded.nodes", schemas.NODES, seed)
    assert spark.table("seeded.nodes").count() == 1
    assert snapshots.ensure_table(spark, "seeded.more", schemas.NODES)
    assert spark.table("seeded.more").count() == 0
    for name in ("nodes", "more"):
        spark.sql(f"drop table seeded.{name}")
    spark.sql("drop database seeded")


def test_decoder_hook(spark):
    def decode(batches):
        for batch in batches:
            yield (
                batch.assign(position_lat=batch["data"].map(list))
                .explode("position_lat")
                .assign(seq=lambda d: d.groupby(level=0).cumcount(), position_long=1, ts=None)
                .rename(columns={"id": "track_id"})
            )[["track_id", "seq", "position_lat", "position_long", "ts"]]

    stored = blobs(spark, b"\x05\x06", b"\x07")
    got = tracks.decode_tracks(stored, decode)
    assert pairs(got, "track_id", "seq", "position_lat") == [(1, 0, 5), (1, 1, 6), (2, 0, 7)]
    degree = 180.0 / 2**31
    assert pairs(workflows.all_positions(stored, decode), "track_id", "seq", "lat") == [
        (1, 0, 5 * degree), (1, 1, 6 * degree), (2, 0, 7 * degree),
    ]


@pytest.mark.parametrize("source", ["parquet", "csv", "json"])
def test_read_records(spark, tmp_path, source):
    rows = spark.sql("select 1L track_id, 0L seq, 5 position_lat, null position_long, timestamp'2024-01-01' ts")
    path = str(tmp_path / source)
    rows.withColumn("position_long", F.col("position_long").cast("int")).write.format(source).save(path)
    read = tracks.read_records(spark, path, source)
    assert read.schema == schemas.RECORDS and read.first().position_long is None


def test_only_one_of_two_savers_wins(spark, tmp_path):
    """Both pass the first check before either has written."""
    path = str(tmp_path / "drawings")
    ready = threading.Barrier(2)
    check = snapshots._require
    first_checks = set()

    def meet(expected, found):
        check(expected, found)
        if threading.get_ident() not in first_checks:
            first_checks.add(threading.get_ident())
            ready.wait(60)

    results = {}

    def save(who):
        rows = spark.createDataFrame([(who, float(who), float(k)) for k in range(200)], schemas.NODES)
        try:
            results[who] = snapshots.save_snapshot(rows, path, expected=0)
        except Exception as error:  # noqa: BLE001
            results[who] = error

    snapshots._require = meet
    try:
        threads = [threading.Thread(target=save, args=(who,)) for who in (1, 2)]
        for t in threads:
            t.start()
        for t in threads:
            t.join(120)
    finally:
        snapshots._require = check
    [winner] = [who for who, r in results.items() if r == 1]
    assert isinstance(results[3 - winner], snapshots.RevisionConflict)
    found = snapshots.load_snapshot(spark, path, schemas.NODES).collect()
    assert len(found) == 200 and {r.id for r in found} == {winner}
    assert snapshots.latest_revision(spark, path) == 1
    assert snapshots.save_snapshot(spark.createDataFrame([], schemas.NODES), path) == 2
