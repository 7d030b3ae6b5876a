"""De-duplicating ingest of track files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracklake.functions.scalar import md5_upper
from tracklake.operators.keys import key_set
from tracklake.sources.tracks import FILES, as_pattern
from tracklake.streaming import store

INTERVAL = "1 minute"


def start(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Polls at the interval, or without one processes what is there and ends."""
    writer = writer.option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def file_stream(
    spark: SparkSession, directories: Sequence[str], max_files: int = 1000
) -> DataFrame:
    """New files directly in the directories as (path, modificationTime, data).

    A directory may be missing, and is read from when it appears.
    """
    stream = None
    for directory in directories:
        files = (
            spark.readStream.format("binaryFile")
            .schema(FILES)
            .option("maxFilesPerTrigger", max_files)
            .load(as_pattern(directory))
            .select("path", "modificationTime", F.col("content").alias("data"))
        )
        stream = files if stream is None else stream.unionByName(files)
    if stream is None:
        raise ValueError("no directories to watch")
    return stream


def _stored(stream: DataFrame, order: str, data: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("hash", T.StringType()),
            T.StructField(order, stream.schema[order].dataType),
            T.StructField("data", stream.schema[data].dataType),
        ]
    )


def stream_ingest(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    order: str,
    data: str = "data",
    interval: str | None = INTERVAL,
) -> StreamingQuery:
    """Stores each content once: (hash, ``order``, data), the first in order within its batch.

    The stored hashes are the memory of what is done, so there is no streaming state to grow. The
    batch's copies are reduced before its rows are compared with the store, and the store is filtered
    by the batch's hashes first, so that it need not be shuffled for a small batch.
    """
    schema = _stored(stream, order, data)
    store.prepare(stream.sparkSession, path, schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            md5_upper(F.col(data)).alias("hash"), order, F.col(data).alias("data")
        )
        first = (
            rows.groupBy("hash")
            .agg(F.min_by(F.struct(order, "data"), order).alias("_first"))
            .select("hash", "_first.*")
        )
        offered = key_set(rows.select("hash").distinct())
        known = store.read_before(batch.sparkSession, path, schema, batch_id).select("hash")
        known = known.join(offered, "hash", "left_semi")
        store.write_batch(first.join(known, "hash", "left_anti"), path, batch_id)

    return start(stream.writeStream.foreachBatch(write), checkpoint, interval)


def read_ingested(stream: DataFrame, path: str, order: str, data: str = "data") -> DataFrame:
    return store.read(stream.sparkSession, path, _stored(stream, order, data)).drop(store.BATCH)
