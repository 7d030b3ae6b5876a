import random

import pytest
from pyspark.sql import functions as F

from tracklake import schemas
from tracklake.operators import blocks, runs
from tracklake.plans import workflows

SQUARE = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
IN, OUT = 5.0, 20.0


def table(spark, tracks):
    """tracks: id -> string of i (inside) and o (outside)."""
    rows = [
        (track, seq, IN if c == "i" else OUT, 5.0, 1000 * seq)
        for track, pattern in tracks.items()
        for seq, c in enumerate(pattern)
    ]
    return spark.createDataFrame(rows, schemas.POSITIONS)


def runs_of(pattern):
    """Runs as lists of sequence numbers, in track order."""
    keep = [
        "i" in pattern[max(0, i - 1) : i + 2] for i in range(len(pattern))
    ]
    found, current = [], []
    for i, k in enumerate(keep):
        if k:
            current.append(i)
        elif current:
            found.append(current)
            current = []
    return found + ([current] if current else [])


def clipped(df):
    result = {}
    for r in df.collect():
        result.setdefault((r.track_id, r.run), []).append(r.seq)
    return {k: sorted(v) for k, v in result.items()}


def expected(tracks):
    return {
        (track, n): run for track, pattern in tracks.items() for n, run in enumerate(runs_of(pattern))
    }


CASES = {
    "gap of one": "iioii",
    "gap of two": "iiooii",
    "gap of three splits": "iioooii",
    "gap of four splits": "iiooooii",
    "first and last": "ioooooi",
    "single inside": "i",
    "single outside": "o",
    "straddling, none inside": "oo",
    "all": "iiiiiiiii",
    "late start": "ooooooooi",
    "empty": "",
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    tracks = {1: CASES[name]}
    assert clipped(runs.clip_tracks(table(spark, tracks), SQUARE, bits=2)) == expected(tracks)


@pytest.mark.parametrize("bits,selective", [(1, False), (2, False), (3, True), (18, False)])
def test_random_tracks_across_blocks(spark, bits, selective):
    rng = random.Random(bits)
    tracks = {
        t: "".join(rng.choice("iooo" if t % 2 else "iiio") for _ in range(rng.randrange(1, 60)))
        for t in range(30)
    }
    tracks[99] = "".join(rng.choice("iooooo") for _ in range(700))  # holds a third of all rows
    df = table(spark, tracks)
    assert clipped(runs.clip_tracks(df, SQUARE, bits=bits, selective=selective)) == expected(tracks)
    halo = runs.halo_keep(df, F.col("lat") < 10, bits=bits)
    kept = {(r.track_id, r.seq) for r in halo.where("keep").collect()}
    assert kept == {(t, s) for (t, _), run in expected(tracks).items() for s in run}
    assert halo.count() == df.count()
    assert clipped(runs.segment_runs(halo, bits=bits)) == expected(tracks)


def test_selective_without_broadcast(spark):
    tracks = {1: "oooiioooooi", 2: "ooo"}
    result = runs.clip_tracks(
        table(spark, tracks), SQUARE, bits=1, selective=True, max_broadcast_blocks=0
    )
    assert clipped(result) == expected(tracks)


def test_order_is_sequence_not_time(spark):
    df = table(spark, {1: "iooooi"}).withColumn("ts_ms", -F.col("ts_ms"))
    assert clipped(runs.clip_tracks(df, SQUARE)) == {(1, 0): [0, 1], (1, 1): [4, 5]}


def test_export_numbers(spark, monkeypatch):
    monkeypatch.setattr(blocks.sum_before, "__defaults__", (1,))
    rng = random.Random(7)
    tracks = {t: "".join(rng.choice("iooo") for _ in range(40)) for t in (5, 2, 11, 3)}
    clip = runs.clip_tracks(table(spark, tracks), SQUARE, bits=2)
    listed = [
        (t, n, run)
        for t in sorted(tracks)
        for n, run in reversed(list(enumerate(runs_of(tracks[t]))))
    ]
    rank = {(t, n): i for i, (t, n, _) in enumerate(listed)}
    assert {(r.track_id, r.run): r.run_rank for r in runs.run_order(clip).collect()} == rank
    flat = [(t, n, seq, pos) for t, n, run in listed for pos, seq in enumerate(run)]
    wanted = {
        (t, n, seq): (pos, node, len(listed) - 1 - rank[t, n])
        for node, (t, n, seq, pos) in enumerate(flat)
    }
    got = runs.sequential_ids(clip).collect()
    assert {(r.track_id, r.run, r.seq): (r.pos, r.node_id, r.way_id) for r in got} == wanted


def test_nothing_to_export(spark):
    outside = table(spark, {1: "oooo"})
    assert runs.nothing_to_export(runs.clip_tracks(outside, SQUARE))
    assert workflows.clip_and_export(outside, SQUARE) is None


def test_flatten_runs(spark):
    df = spark.createDataFrame(
        [(1, [(1.0, 2.0), (3.0, 4.0)]), (2, [])], "way_id long, points array<struct<lat:double,lon:double>>"
    )
    assert [tuple(r) for r in runs.flatten_runs(df).orderBy("pos").collect()] == [
        (1, 0, 1.0, 2.0),
        (1, 1, 3.0, 4.0),
    ]


@pytest.mark.parametrize("keys", [["k"], []])
def test_numbering_across_blocks(spark, keys):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), v, rng.randrange(9)) for v in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k long, v long, w long")
    groups = {}
    for row in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(row[0] if keys else None, []).append(row)
    numbered = blocks.number_rows(df, keys, ["v"], "n", blocks.block_of("v", 3))
    assert {(r.k, r.v): r.n for r in numbered.collect()} == {
        (r[0], r[1]): i for g in groups.values() for i, r in enumerate(g)
    }
    wanted = {}
    for g in groups.values():
        for i, r in enumerate(g):
            wanted[r[0], r[1]] = sum(x[2] for x in g[:i])
    for levels in (0, 1, 2):
        summed = blocks.sum_before(df, keys, "v", {"s": "w"}, levels, bits=3)
        assert {(r.k, r.v): r.s for r in summed.collect()} == wanted
