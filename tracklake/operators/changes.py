"""Folding change messages: the current set, snapshots, latest values, freshness of results.

Messages are ordered by ``order_no``, which the source assigns; row order means nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators.blocks import BLOCK, BLOCK_BITS, before_in_key, block_of, to_blocks
from tracklake.operators.ways import last_by_key

ADDED, REMOVED = "added", "removed"
CHANGE, GENERATED, REQUEST = "change", "generated", "request"


def last_change(changes: DataFrame) -> DataFrame:
    """Each key's last add or remove; other messages are ignored. Works on batches and streams.

    Two numbers per key, which are aggregated in place.
    """
    last_add = F.max(F.when(F.col("kind") == ADDED, F.col("order_no")))
    kind = F.when(F.col("_added") == F.col("order_no"), ADDED).otherwise(REMOVED)
    return (
        changes.where(F.col("kind").isin(ADDED, REMOVED))
        .groupBy("key")
        .agg(F.max("order_no").alias("order_no"), last_add.alias("_added"))
        .select("key", "order_no", kind.alias("kind"))
    )


def track_set(changes: DataFrame) -> DataFrame:
    """Keys present after all changes: (key, order_no) with the add that put them in."""
    return last_change(changes).where(F.col("kind") == ADDED).select("key", "order_no")


def snapshot_then_changes(changes: DataFrame, cut: int) -> DataFrame:
    """What a subscriber joining at ``cut`` receives: the set so far as adds, then the rest."""
    members = track_set(changes.where(F.col("order_no") <= cut))
    later = changes.where((F.col("order_no") > cut) & F.col("kind").isin(ADDED, REMOVED))
    return members.select(
        F.lit(cut).cast("long").alias("order_no"), F.lit(ADDED).alias("kind"), "key"
    ).unionByName(later.select("order_no", "kind", "key"))


def latest_value(updates: DataFrame, key: str, order: str) -> DataFrame:
    """The last value sent per key."""
    return last_by_key(updates, key, order)


def artifact_states(log: DataFrame) -> DataFrame:
    """Per artifact the last event that set or cleared its cached hash."""
    return (
        log.where(F.col("kind").isin(CHANGE, GENERATED))
        .groupBy("artifact_id")
        .agg(F.max(_state()).alias("_state"))
        .select("artifact_id", "_state.order_no", "_state.kind", "_state.hash")
    )


def _state():
    cached = F.when(F.col("kind") == GENERATED, F.col("hash"))
    state = F.struct("order_no", "kind", cached.alias("hash"))
    return F.when(F.col("kind").isin(CHANGE, GENERATED), state)


def artifact_freshness(log: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Answers each request: up to date iff its hash is the one cached for the artifact.

    A generation caches its hash, any change clears it. The log is walked in blocks per artifact and
    only the last state of each block is carried on, since one artifact may have most of the log.
    """
    blocked = log.withColumn(BLOCK, block_of("order_no", bits)).withColumn("_state", _state())
    local = F.last("_state", ignorenulls=True).over(
        before_in_key(["artifact_id", BLOCK], "order_no")
    )
    ends = blocked.groupBy("artifact_id", BLOCK).agg(F.max("_state").alias("_end"))
    carried = ends.select(
        "artifact_id",
        BLOCK,
        F.last("_end", ignorenulls=True).over(before_in_key(["artifact_id"])).alias("_carried"),
    )
    current = F.coalesce(F.col("_local"), F.col("_carried"))
    up_to_date = F.coalesce(F.col("hash") == current["hash"], F.lit(False))
    return (
        to_blocks(blocked, ["artifact_id"])
        .withColumn("_local", local)
        .where(F.col("kind") == REQUEST)
        .join(carried, ["artifact_id", BLOCK])
        .select("artifact_id", "order_no", "hash", up_to_date.alias("up_to_date"))
    )
