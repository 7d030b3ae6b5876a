"""Files read by their names, whatever these are.

Spark's own file source leaves out empty files and names that begin with ``_`` or ``.``. Here tasks list
the directories, one task each at most, the names are dealt out by their hash, and other tasks open the
files. The driver sees neither names nor bytes. Directories are local paths or addresses that Arrow's file
systems know (``file:``, ``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

LISTED = "path string, modificationTime timestamp, length long"
READ = f"{LISTED}, content binary"
#: Names in one batch of a listing, and bytes of content in one batch of a read.
LIST_ROWS, READ_BYTES = 10_000, 8 << 20
_TIME = pa.timestamp("us", tz="UTC")


def _entries(directory: str) -> Iterator[tuple[str, int, int]]:
    """Path, time of change in microseconds and length of the files directly in a directory; none if it is missing."""
    files, root = fs.FileSystem.from_uri(directory if ":" in directory else os.path.abspath(directory))
    if files.type_name != "local":
        scheme = directory.split(":", 1)[0]
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.type == fs.FileType.File:
                yield f"{scheme}://{info.path}", (info.mtime_ns or 0) // 1000, info.size
        return
    # A local directory is read name by name, so its names need not fit into memory.
    try:
        found = os.scandir(root)
    except FileNotFoundError:
        return
    with found:
        for entry in found:
            if entry.is_file():
                status = entry.stat()
                yield f"file:{os.path.join(root, entry.name)}", status.st_mtime_ns // 1000, status.st_size


def _content(path: str) -> bytes:
    if path.startswith("file:"):
        with open(path[len("file:") :], "rb") as file:
            return file.read()
    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_stream(name) as stream:
        return stream.read()


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for directory in batch.column(0).to_pylist():
            rows: list[tuple] = []
            for row in _entries(directory):
                rows.append(row)
                if len(rows) == LIST_ROWS:
                    yield _listed(rows)
                    rows = []
            if rows:
                yield _listed(rows)


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    paths, times, lengths = zip(*rows)
    return pa.record_batch(
        [pa.array(paths), pa.array(times, pa.int64()).cast(_TIME), pa.array(lengths, pa.int64())],
        names=["path", "modificationTime", "length"],
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, held = 0, []
        for row, path in enumerate(batch.column(0).to_pylist(), 1):
            held.append(_content(path))
            if sum(map(len, held)) >= READ_BYTES or row == batch.num_rows:
                part = batch.slice(first, row - first)
                yield pa.record_batch([*part.columns, pa.array(held, pa.binary())], names=[*part.schema.names, "content"])
                first, held = row, []


def list_files(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """The files directly in the directories: path, modificationTime, length. Missing directories have none."""
    names = spark.createDataFrame([(d,) for d in directories], "directory string")
    return names.repartition(max(1, len(directories))).mapInArrow(_list, LISTED)


def read_files(listed: DataFrame, tasks: int | None = None) -> DataFrame:
    """Listed files with their content, in ``tasks`` tasks; four for each core unless given.

    A task holds ``READ_BYTES`` and one file more at a time. A file that is gone since the listing is an error.
    """
    tasks = tasks or 4 * listed.sparkSession.sparkContext.defaultParallelism
    return listed.repartition(tasks, "path").mapInArrow(_read, READ)


def write_files(files: DataFrame, directory: str) -> int:
    """Writes rows of (name, content) as files into a local or shared directory; their number.

    A task that is run again writes the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(directory, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(os.path.join(directory, name), "wb") as file:
                    file.write(content)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = files.select("name", "content").mapInArrow(write, "n long")
    return written.groupBy().sum("n").first()[0] or 0
