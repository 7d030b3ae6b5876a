"""Versioned Parquet tables: every write is a new directory, nothing that is read is overwritten."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracklake import schemas


class RevisionConflict(ValueError):
    """Someone else saved in between."""


class _Folder:
    """The versions of a table in one directory.

    A version's rows are written to a directory of their own. A small file ``rev=N`` then claims the
    number N by naming that directory; it appears with its content in one step, and only one can.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def revisions(self) -> list[int]:
        if not self.files.exists(self.root):
            return []
        names = [status.getPath().getName() for status in self.files.listStatus(self.root)]
        return [int(n[4:]) for n in names if n.startswith("rev=")]

    def rows_of(self, revision: int) -> str:
        """The directory with the rows of a version."""
        stream = self.files.open(self._path(f"rev={revision}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def claim(self, revision: int, rows: str) -> bool:
        """Makes ``rows`` that version, unless someone else has claimed the number."""
        draft, target = self._path(f"claim-{uuid.uuid4().hex}"), self._path(f"rev={revision}")
        stream = self.files.create(draft, False)
        stream.write(bytearray(rows.encode()))
        stream.close()
        try:
            if self.files.getScheme() == "file":
                # A local rename replaces; a link does not.
                nio = self.jvm.java.nio.file
                local = [nio.Path.of(self.jvm.java.net.URI(f"file://{p.toUri().getPath()}")) for p in (target, draft)]
                nio.Files.createLink(*local)
            else:
                none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
                options[0] = none
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf).rename(draft, target, options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.files.delete(draft, False)
        return True


def latest_revision(spark: SparkSession, path: str) -> int:
    """The newest version, 0 if there is none."""
    return max(_Folder(spark, path).revisions(), default=0)


def load_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest version; empty if nothing was saved yet."""
    folder = _Folder(spark, path)
    revision = max(folder.revisions(), default=0)
    if revision == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{folder.rows_of(revision)}")


def save_snapshot(df: DataFrame, path: str, expected: int | None = None) -> int:
    """Writes the next version and returns its number.

    With ``expected`` it fails with ``RevisionConflict`` unless that is still the newest version when
    the rows are written; without it the next free number is taken. A version is visible with all its
    rows or not at all.
    """
    folder = _Folder(df.sparkSession, path)
    if expected is not None:
        _require(expected, max(folder.revisions(), default=0))
    rows = f"rows-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/{rows}")
    while True:
        current = max(folder.revisions(), default=0)
        if expected is not None:
            _require(expected, current)
        if folder.claim(current + 1, rows):
            return current + 1


def _require(expected: int, found: int) -> None:
    if expected != found:
        raise RevisionConflict(f"expected revision {expected}, found {found}")


def load_polygons(spark: SparkSession, path: str) -> DataFrame:
    """The saved drawings, none if there are none."""
    return load_snapshot(spark, path, schemas.POLYGONS)


def save_polygons(polygons: DataFrame, path: str, expected: int) -> int:
    """Replaces all drawings if nobody saved since revision ``expected``; the new revision."""
    return save_snapshot(polygons, path, expected)


def ensure_table(
    spark: SparkSession, name: str, schema: T.StructType, seed: DataFrame | None = None
) -> bool:
    """Creates the table, with the seed rows, unless it exists; True if it was created."""
    if spark.catalog.tableExists(name):
        return False
    rows = spark.createDataFrame([], schema) if seed is None else seed.select(*schema.fieldNames())
    rows.write.saveAsTable(name)
    return True
