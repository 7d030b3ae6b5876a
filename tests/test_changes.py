import random

import pytest
from pyspark.sql import functions as F

from tracklake import schemas
from tracklake.functions import scalar
from tracklake.operators import changes, messages


def log(spark, rows):
    return spark.createDataFrame(rows, schemas.ARTIFACT_LOG)


def freshness(rows):
    cached, answers = {}, {}
    for artifact, order, kind, value in sorted(rows, key=lambda r: r[1]):
        if kind == "change":
            cached[artifact] = None
        elif kind == "generated":
            cached[artifact] = value
        elif kind == "request":
            answers[order] = value is not None and cached.get(artifact) == value
    return answers


def answered(df):
    return {r.order_no: r.up_to_date for r in df.collect()}


def test_freshness_cases(spark):
    rows = [
        (1, 1, "request", "h"),
        (1, 2, "generated", "h"),
        (1, 3, "request", "h"),
        (1, 4, "request", None),
        (1, 5, "request", "g"),
        (1, 6, "change", None),
        (1, 7, "request", "h"),
        (2, 8, "request", "h"),
        (1, 9, "generated", "g"),
        (1, 10, "request", "g"),
    ]
    got = answered(changes.artifact_freshness(log(spark, rows)))
    assert got == freshness(rows)
    assert [got[n] for n in (1, 3, 4, 5, 7, 8, 10)] == [False, True, False, False, False, False, True]


@pytest.mark.parametrize("bits", [1, 3, 18])
def test_freshness_across_blocks(spark, bits):
    rng = random.Random(bits)
    kinds = ["request"] * 4 + ["generated", "change", "other"]
    rows = [
        (rng.choice([1, 1, 2, 3]), n, rng.choice(kinds), rng.choice(["a", "b", None]))
        for n in range(400)
    ]
    assert answered(changes.artifact_freshness(log(spark, rows), bits)) == freshness(rows)


def test_add_remove_add(spark):
    rows = [
        (1, "added", 5), (2, "removed", 5), (3, "added", 5),
        (1, "added", 6), (2, "removed", 6), (9, "Tick", 6), (1, "removed", 7),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], schemas.CHANGES)
    assert [tuple(r) for r in changes.track_set(df).collect()] == [(5, 3)]
    cut = changes.snapshot_then_changes(df, 1)
    assert sorted(tuple(r) for r in cut.collect()) == [
        (1, "added", 5), (1, "added", 6), (2, "removed", 5), (2, "removed", 6), (3, "added", 5),
    ]
    refolded = changes.track_set(cut)
    assert [r.key for r in refolded.collect()] == [5]


def test_message_round_trip(spark):
    rows = [(1, "added", 5, 'quo"te\n'), (2, "Tick", None, None)]
    df = spark.createDataFrame(rows, schemas.CHANGES)
    texts = messages.encode_message(df)
    assert sorted(tuple(r) for r in messages.decode_message(texts, schemas.CHANGES).collect()) == rows
    assert messages.drop_heartbeats(df).count() == 1
    with pytest.raises(Exception, match="MALFORMED"):
        messages.decode_message(spark.createDataFrame([("{",)], "text string"), schemas.CHANGES).collect()


@pytest.mark.parametrize("bits", [0, 1, 10])
def test_chunks(spark, bits):
    rng = random.Random(bits)
    rows = [(m, n, f"{m}:{n};") for m in (1, 2) for n in range(25)]
    whole = {m: "".join(f"{m}:{n};" for n in range(25)) for m in (1, 2)}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "message_id long, n long, chunk string")
    assert {r.message_id: r.text for r in messages.reassemble_chunks(df, bits).collect()} == whole


def test_binary_chunks(spark):
    rows = [(1, 1, bytearray(b"\xff\x00")), (1, 0, bytearray(b"\x01")), (1, 2, bytearray(b""))]
    df = spark.createDataFrame(rows, "message_id long, n long, chunk binary")
    assert bytes(messages.reassemble_chunks(df).first().data) == b"\x01\xff\x00"


def test_fingerprint_ignores_order_only(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "t string")
    one = messages.fingerprint(df, "t").first()
    assert messages.fingerprint(df.orderBy(F.desc("t")), "t").first() == one
    assert messages.fingerprint(df.where("t <> 'c'"), "t").first() != one
    assert messages.fingerprint(df.unionByName(df), "t").first().n == 6


def test_fingerprint_counts_repeated_rows_and_nulls(spark):
    def of(*values):
        return tuple(messages.fingerprint(spark.createDataFrame([(v,) for v in values], "t string"), "t").first())

    assert of("a", "a") != of("b", "b")
    assert of("a", "a", "b") != of("a", "b", "b")
    assert of("a", None) != of("a")
    assert of("b", None, "a") == of("a", "b", None)
    assert of() == (0, 0)
    assert of(None) == (0, 1)


def test_rewrite_by_kind(spark):
    df = spark.createDataFrame([("course", "a"), ("record", "b")], "kind string, name string")
    got = messages.rewrite_by_kind(df, "course", "name", F.lit("x"))
    assert [r.name for r in got.collect()] == ["x", "b"]


def test_scalars(spark):
    df = spark.createDataFrame([("a b<&é*~", '{"nodes":[4,5],"k":"v"}')], "t string, j string")
    row = df.select(
        scalar.url_encode(F.col("t")),
        scalar.json_field(F.col("j"), "$.nodes[1]"),
        scalar.md5_upper(F.lit("")),
        scalar.ms_to_ts(F.lit(1500)).cast("timestamp_ntz").cast("string"),
    ).first()
    assert tuple(row) == (
        "a+b%3C%26%C3%A9*%7E", "5", "D41D8CD98F00B204E9800998ECF8427E", "1970-01-01 00:00:01.5",
    )
