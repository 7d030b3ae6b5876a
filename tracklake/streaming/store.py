"""A folder with one directory per micro-batch.

A batch that is run again overwrites its own directory and reads only those of earlier batches, so
retries give the same result. A store of states keeps its last two batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch"


def prepare(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Makes the folder readable before the first batch."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{BATCH}=-1")


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows with the number of their batch."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(
        path
    )


def read_before(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """The rows of earlier batches; later directories are not opened."""
    return read(spark, path, schema).where(F.col(BATCH) < batch_id).drop(BATCH)


def _batches(spark: SparkSession, path: str):
    """The store's folder and its batches' numbers, by directory names alone."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(root)]
    return files, root, sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BATCH}="))


def read_state_before(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """The state that the last earlier batch left; no other directory is read."""
    earlier = [n for n in _batches(spark, path)[2] if n < batch_id]
    return spark.read.schema(schema).parquet(f"{path}/{BATCH}={earlier[-1]}")


def write_state(df: DataFrame, path: str, batch_id: int) -> None:
    """Writes the whole state, and drops all but this one and the one before, which a retry reads."""
    write_batch(df, path, batch_id)
    files, root, numbers = _batches(df.sparkSession, path)
    for number in [n for n in numbers if n < batch_id][:-1]:
        files.delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(root, f"{BATCH}={number}"), True)
