import datetime

import pytest
from pyspark.sql import functions as F

from tracklake import schemas
from tracklake.functions.geometry import semi_to_deg
from tracklake.functions.scalar import text_to_double, text_to_long
from tracklake.operators import positions
from tracklake.operators.runs import clip_tracks

T0 = datetime.datetime(2024, 1, 1, 0, 0, 0, 1999)


def test_missing_coordinates_are_dropped_before_numbering(spark):
    rows = [
        (1, 0, 10, 20, T0),
        (1, 1, None, 20, T0),
        (1, 2, 10, None, T0),
        (1, 3, None, None, T0),
        (1, 4, 11, 21, T0),
    ]
    got = positions.to_positions(spark.createDataFrame(rows, schemas.RECORDS)).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 1]
    assert got[1].lat == 11 * 180.0 / 2**31
    assert got[0].ts_ms == 1704067200001


def test_missing_coordinates_do_not_split_a_run(spark):
    lat, far = 1 << 24, 1 << 30
    rows = [(1, 0, lat, lat, T0)] + [(1, i, None, lat, T0) for i in range(1, 6)]
    rows += [(1, 6, lat, lat, T0), (1, 7, far, lat, T0)]
    track = positions.to_positions(spark.createDataFrame(rows, schemas.RECORDS))
    clip = clip_tracks(track, [(0, 0), (0, 10), (10, 10), (10, 0)]).collect()
    assert sorted((r.run, r.seq) for r in clip) == [(0, 0), (0, 1), (0, 2)]


def test_renumber(spark):
    df = spark.createDataFrame([(1, i, float(i), 0.0, i) for i in range(9)], schemas.POSITIONS)
    got = positions.renumber(df.where("lat <> 3 and lat <> 4")).orderBy("seq").collect()
    assert [(r.seq, r.lat) for r in got] == list(enumerate([0.0, 1.0, 2.0, 5.0, 6.0, 7.0, 8.0]))


def test_semicircles(spark):
    df = spark.createDataFrame([(-(2**31),), (0,), (2**30,)], "s int")
    assert [r[0] for r in df.select(semi_to_deg(F.col("s"))).collect()] == [-180.0, 0.0, 90.0]


def test_polyline_in_pieces(spark):
    rows = [(1, i, float(i), 0.0, 0) for i in range(10)] + [(2, 0, 5.0, 5.0, 0)]
    df = spark.createDataFrame(rows, schemas.POSITIONS)
    pieces = positions.to_polyline(df, bits=2)
    assert {(r.track_id, r.piece): len(r.points) for r in pieces.collect()} == {
        (1, 0): 4, (1, 1): 4, (1, 2): 2, (2, 0): 1,
    }
    flat = positions.flatten_pieces(pieces, "seq", bits=2).orderBy("track_id", "seq").collect()
    assert [(r.track_id, r.seq, r.lat) for r in flat] == [(1, i, float(i)) for i in range(10)] + [(2, 0, 5.0)]


def test_start_is_the_first_in_sequence(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 50), (1, 1, 0.0, 0.0, 10)], schemas.POSITIONS)
    assert positions.track_start(df).first().start_ms == 50


def test_bounds(spark):
    df = spark.createDataFrame([(1, 0, 3.0, -1.0, 0), (2, 0, -2.0, 4.0, 0)], schemas.POSITIONS)
    assert tuple(positions.bounds(df).first()) == (-2.0, -1.0, 3.0, 4.0)
    assert positions.bounds(df.where("false"), "track_id").count() == 0
    with pytest.raises(Exception, match="no points"):
        positions.bounds(df.where("false")).collect()


def test_text_casts(spark):
    df = spark.createDataFrame([("x",)], "t string")
    assert df.select(text_to_long(F.col("t"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(text_to_double(F.col("t"))).collect()
