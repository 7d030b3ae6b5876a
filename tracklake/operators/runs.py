"""Clipping tracks to a polygon and cutting them into contiguous runs.

Positions must be numbered densely per track (``seq`` 0, 1, 2, ...), as ``to_positions`` does, and
their order is ``seq``, never time. A position is kept if it or a direct neighbour is inside, so an
inside position continues a run while fewer than three positions lie between it and the inside
position before. Runs are numbered from 0 along the track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracklake.functions.geometry import Ring, point_in_polygon
from tracklake.operators.blocks import (
    BLOCK,
    BLOCK_BITS,
    block_of,
    block_offsets,
    sum_before,
    to_blocks,
)
from tracklake.operators.keys import key_set
from tracklake.session import materialize

TRACK_BLOCK = ["track_id", BLOCK]
# A new run starts when the inside position before is more than this many steps back.
_RUN_REACH = 3


def _spread(df: DataFrame, before: int, after: int, bits: int) -> DataFrame:
    """Copies rows at block ends into the neighbouring blocks that look at them.

    A row is seen by windows reaching ``before`` rows back and ``after`` rows ahead; all but those
    next to a block end stay single.
    """
    first = block_of(F.greatest(F.col("seq") - after, F.lit(0)), bits)
    last = block_of(F.col("seq") + before, bits)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last)))


def _to_track_blocks(df: DataFrame) -> DataFrame:
    return to_blocks(df, ["track_id"])


def _own(df: DataFrame, bits: int) -> DataFrame:
    """Drops the copies again."""
    return df.where(block_of("seq", bits) == F.col(BLOCK))


def _in_block() -> Window:
    return Window.partitionBy(*TRACK_BLOCK).orderBy("seq")


def halo_keep(
    positions: DataFrame, inside: Column | str = "inside", bits: int = BLOCK_BITS
) -> DataFrame:
    """Adds ``keep``: the position or its predecessor or successor is inside."""
    flagged = positions.withColumn("_inside", F.col(inside) if isinstance(inside, str) else inside)
    keep = F.max("_inside").over(_in_block().rowsBetween(-1, 1))
    return (
        _own(_to_track_blocks(_spread(flagged, 1, 1, bits)).withColumn("keep", keep), bits)
        .drop("_inside", BLOCK)
    )


def segment_runs(positions: DataFrame, keep: str = "keep", bits: int = BLOCK_BITS) -> DataFrame:
    """The kept rows with their run number: gaps and islands over ``keep``."""
    columns = [c for c in positions.columns if c != keep]
    flagged = positions.withColumn("keep", F.col(keep))
    spread = _to_track_blocks(_spread(flagged, 1, 0, bits))
    before = F.lag("keep", 1, False).over(_in_block())
    kept = _own(spread.withColumn("_before", before), bits).where("keep")
    starts = kept.withColumn("_start", (~F.col("_before")).cast("int"))
    totals = starts.groupBy(*TRACK_BLOCK).agg(F.sum("_start").alias("_n"))
    return _numbered(starts, block_offsets(totals, ["track_id"], "_n", "_offset"), columns)


def _numbered(starts: DataFrame, offsets: DataFrame, columns: list[str]) -> DataFrame:
    running = F.sum("_start").over(_in_block().rowsBetween(Window.unboundedPreceding, 0))
    run = (F.col("_offset") + F.col("_running") - 1).cast("long")
    return (
        starts.withColumn("_running", running)
        .join(offsets, TRACK_BLOCK)
        .select("track_id", run.alias("run"), *[c for c in columns if c != "track_id"])
    )


def _touched_blocks(positions: DataFrame, inside: Column, bits: int) -> DataFrame:
    """Per block with kept rows: how many runs start in the track's earlier blocks.

    Only inside positions are read, so the polygon's box prunes the scan.
    """
    rows = positions.where(inside).select("track_id", "seq")
    spread = _to_track_blocks(_spread(rows, _RUN_REACH - 1, 1, bits))
    step = F.col("seq") - F.lag("seq").over(_in_block())
    run_start = F.greatest(F.col("seq") - 1, F.lit(0))
    starts_here = (
        (block_of(run_start, bits) == F.col(BLOCK)) & (step.isNull() | (step > _RUN_REACH))
    )
    seen = spread.withColumn("_start", starts_here.cast("int"))
    # A copy made only for looking back does not make the block one with kept rows.
    first_kept, last_kept = block_of(run_start, bits), block_of(F.col("seq") + 1, bits)
    totals = (
        seen.where(F.col(BLOCK).between(first_kept, last_kept))
        .groupBy(*TRACK_BLOCK)
        .agg(F.sum("_start").alias("_n"))
    )
    return block_offsets(totals, ["track_id"], "_n", "_offset")


def clip_tracks(
    positions: DataFrame,
    ring: Ring,
    bits: int = BLOCK_BITS,
    selective: bool = False,
    max_broadcast_blocks: int | None = None,
) -> DataFrame:
    """Runs of the positions in the polygon: (track_id, run, seq, lat, lon, ts_ms).

    Positions are shuffled once, on (track_id, block). With ``selective`` the blocks that hold kept
    rows are computed, stored and counted first, and if they are few they are broadcast, so that all
    other positions are dropped before the shuffle. That takes a job of its own, which pays where the
    polygon holds a small part of a large input.
    """
    inside = point_in_polygon(F.col("lat"), F.col("lon"), ring)
    blocks = _touched_blocks(positions, inside, bits)
    spread = _spread(positions.withColumn("_inside", inside), 2, 1, bits)
    if selective:
        blocks = key_set(blocks, max_broadcast_blocks)
        spread = spread.join(blocks.select(*TRACK_BLOCK), TRACK_BLOCK, "left_semi")
    window = _in_block()
    flagged = _to_track_blocks(spread).select(
        "*",
        F.max("_inside").over(window.rowsBetween(-1, 1)).alias("keep"),
        F.max("_inside").over(window.rowsBetween(-2, 0)).alias("_before"),
    )
    # Run numbers are worked out over the kept rows alone.
    follows = (F.col("seq") > 0) & F.col("_before")
    starts = _own(flagged, bits).where("keep").withColumn("_start", (~follows).cast("int"))
    columns = ["track_id", "seq", "lat", "lon", "ts_ms"]
    return _numbered(starts, blocks, columns)


def nothing_to_export(runs: DataFrame) -> bool:
    """True when the clip is empty; looks at one row only."""
    return runs.isEmpty()


def flatten_runs(runs: DataFrame, points: str = "points") -> DataFrame:
    """A list of lists as rows: one row per element with its place ``pos`` in its list."""
    others = [c for c in runs.columns if c != points]
    return runs.select(*others, F.posexplode(points).alias("pos", "_p")).select(
        *others, F.col("pos").cast("long").alias("pos"), "_p.*"
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """One row per run: its length and first ``seq``. Sums up before the shuffle."""
    return runs.groupBy("track_id", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )


def run_order(runs: DataFrame) -> DataFrame:
    """Output rank of each run: tracks ascending, within a track the last run first.

    The summary of the runs is computed and stored first.
    """
    return _ranked(materialize(run_summary(runs))).select("track_id", "run", "n", "run_rank")


def _ranked(summary: DataFrame) -> DataFrame:
    """Adds rank and first node number of each run without a window over all runs.

    Runs are counted per track, the tracks' counts are summed up in track order, and the place
    within the track follows from the run number. Tracks are dealt by ranges of their ids and summed
    within a range; the ranges' totals, one row each, are all that meets in one task.
    """
    tracks = summary.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("_runs"), F.sum("n").alias("_nodes")
    )
    tracks = _sum_before_by_range(tracks, "track_id", {"_runs_before": "_runs", "_nodes_before": "_nodes"})
    within = sum_before(summary, ["track_id"], "run", {"_nodes_earlier": "n"}, levels=1)
    later_nodes = F.col("_nodes") - F.col("_nodes_earlier") - F.col("n")
    rank = F.col("_runs_before") + F.col("_runs") - 1 - F.col("run")
    return within.join(tracks, "track_id").select(
        *summary.columns,
        rank.cast("long").alias("run_rank"),
        (F.col("_nodes_before") + later_nodes).cast("long").alias("first_node"),
    )


def _sum_before_by_range(df: DataFrame, order: str, values: dict[str, str]) -> DataFrame:
    """Adds sums over all rows before in ``order``: ``values`` maps new columns to summed ones."""
    ranges = materialize(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    totals = ranges.groupBy("_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values.values()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), zero).alias(f"_o_{v}") for v in values.values()])
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranges.select("*", *[F.coalesce(F.sum(v).over(within), zero).alias(f"_l_{v}") for v in values.values()])
    # One row per partition of the ranges, so the broadcast does not grow with the rows.
    sums = [(F.col(f"_l_{v}") + F.col(f"_o_{v}")).cast("long").alias(o) for o, v in values.items()]
    return local.join(F.broadcast(offsets), "_range").select(*df.columns, *sums)


def sequential_ids(runs: DataFrame) -> DataFrame:
    """Adds ``pos`` (place in the run), ``node_id`` and ``way_id`` for an export.

    Node ids count from 0 over all runs in output order, way ids over the same list reversed.
    The summary of the runs is computed and stored first, so ``runs`` is read twice; pass a stored
    frame if it is expensive.
    """
    summary = materialize(run_summary(runs))
    n_runs = summary.agg(F.count(F.lit(1)).alias("n")).scalar()
    pos = F.col("seq") - F.col("first_seq")
    return runs.join(_ranked(summary), ["track_id", "run"]).select(
        *runs.columns,
        pos.alias("pos"),
        (F.col("first_node") + pos).alias("node_id"),
        (n_runs - 1 - F.col("run_rank")).cast("long").alias("way_id"),
    )
