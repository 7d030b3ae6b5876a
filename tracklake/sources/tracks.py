"""Track files and records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake import schemas
from tracklake.functions.scalar import md5_upper
from tracklake.sources import named_files

if TYPE_CHECKING:
    import pandas as pd

FILE_COLUMNS = ["path", "modificationTime", "length"]
# Fixed by Spark's binaryFile source.
FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def as_pattern(path: str) -> str:
    """The path as a glob pattern, so that a stream accepts a file, or a folder that may come later."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def scan_track_files(
    spark: SparkSession, directories: Sequence[str], with_data: bool = False, tasks: int | None = None
) -> DataFrame:
    """The files directly in the directories with their content hash, whatever their names, empty ones too.

    Missing directories are skipped, as is the empty ``_SUCCESS`` that Spark leaves where it writes. Tasks
    list and read the files (``named_files``).
    """
    listed = named_files.list_files(spark, directories)
    mark = F.col("path").endswith("/_SUCCESS") & (F.col("length") == 0)
    return hash_content(named_files.read_files(listed.where(~mark), tasks), "content", FILE_COLUMNS, with_data)


def hash_content(
    files: DataFrame, content: str, columns: Sequence[str], with_data: bool = False
) -> DataFrame:
    """The given columns and the content hash, for files and for tables of texts alike."""
    data = [F.col(content).alias("data")] if with_data else []
    return files.select(*columns, md5_upper(F.col(content)).alias("hash"), *data)


def read_records(spark: SparkSession, path: str, source: str = "parquet", **options: str) -> DataFrame:
    """Typed scan of decoded device records, without schema inference."""
    return spark.read.schema(schemas.RECORDS).format(source).options(**options).load(path)


def decode_tracks(
    blobs: DataFrame,
    decode: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: T.StructType | str = schemas.RECORDS,
) -> DataFrame:
    """Applies the caller's decoder to every blob, spread over the cluster in Arrow batches.

    The decoder should yield its records in batches, numbered by ``seq`` in file order.
    """
    return blobs.mapInPandas(decode, schema)
