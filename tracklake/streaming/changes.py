"""Change messages as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracklake import schemas
from tracklake.operators.changes import ADDED, artifact_freshness, artifact_states, last_change
from tracklake.operators.ways import last_by_key
from tracklake.streaming import store
from tracklake.streaming.ingest import start

_LAST = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("order_no", T.LongType()),
        T.StructField("kind", T.StringType()),
    ]
)
_ANSWERS = T.StructType(
    [
        T.StructField("artifact_id", T.LongType()),
        T.StructField("order_no", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("up_to_date", T.BooleanType()),
    ]
)
_STATES = schemas.ARTIFACT_LOG


def _updates(aggregated: DataFrame, path: str, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Writes the keys each batch changed, not the whole state."""
    store.prepare(aggregated.sparkSession, path, aggregated.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        store.write_batch(batch, path, batch_id)

    writer = aggregated.writeStream.outputMode("update").foreachBatch(write)
    return start(writer, checkpoint, interval)


def stream_track_set(
    changes: DataFrame, path: str, checkpoint: str, interval: str | None = "15 seconds"
) -> StreamingQuery:
    """Keeps each key's last change with a native streaming aggregation."""
    return _updates(last_change(changes), path, checkpoint, interval)


def read_track_set(spark: SparkSession, path: str) -> DataFrame:
    """The keys now present: (key, order_no)."""
    last = last_by_key(store.read(spark, path, _LAST), "key", store.BATCH)
    return last.where(F.col("kind") == ADDED).select("key", "order_no")


def stream_latest_value(
    updates: DataFrame,
    key: str,
    order: str,
    path: str,
    checkpoint: str,
    interval: str | None = "15 seconds",
) -> StreamingQuery:
    """Keeps the last value per key."""
    return _updates(last_by_key(updates, key, order), path, checkpoint, interval)


def read_latest_value(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    return last_by_key(store.read(spark, path, schema), key, store.BATCH).drop(store.BATCH)


def stream_freshness(
    log: DataFrame, path: str, checkpoint: str, interval: str | None = "15 seconds"
) -> StreamingQuery:
    """Answers requests as they come; an artifact's ``order_no`` must rise from batch to batch.

    Each artifact's last state is put in front of the batch as one more log row. Every batch writes the
    whole state and reads the one before. A row at or before its artifact's state is an error, since
    requests between them have been answered.
    """
    spark = log.sparkSession
    answers, states = f"{path}/answers", f"{path}/states"
    store.prepare(spark, answers, _ANSWERS)
    store.prepare(spark, states, _STATES)

    def write(batch: DataFrame, batch_id: int) -> None:
        before = store.read_state_before(batch.sparkSession, states, _STATES, batch_id)
        batch.persist()
        lowest = batch.groupBy("artifact_id").agg(F.min("order_no").alias("lowest"))
        late = lowest.join(before, "artifact_id").where(F.col("lowest") <= F.col("order_no")).head()
        if late:
            raise ValueError(f"artifact {late.artifact_id}: order_no {late.lowest} comes after {late.order_no}")
        rows = before.unionByName(batch.select(*before.columns))
        store.write_batch(artifact_freshness(rows), answers, batch_id)
        store.write_state(artifact_states(rows), states, batch_id)
        batch.unpersist()

    return start(log.writeStream.foreachBatch(write), checkpoint, interval)


def read_freshness(spark: SparkSession, path: str) -> DataFrame:
    return store.read(spark, f"{path}/answers", _ANSWERS).drop(store.BATCH)
