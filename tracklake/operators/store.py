"""Track store: de-duplication by content hash, appends, deletes, upserts.

Operators return the new content; :mod:`tracklake.sources.snapshots` writes it as a new version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions.scalar import md5_upper
from tracklake.operators.blocks import number_rows
from tracklake.operators.keys import broadcast_if_small, key_set
from tracklake.operators.ways import last_by_key
from tracklake.session import materialize


def scan_tracks(tracks: DataFrame, with_data: bool = False) -> DataFrame:
    """All tracks as (id, hash); the blobs are read only on request."""
    return tracks.select("id", "hash", *(["data"] if with_data else []))


def blob_lookup(blobs: DataFrame, key: object, id_column: str = "id") -> DataFrame:
    """The blob with this key, or no row."""
    return blobs.where(F.col(id_column) == F.lit(key)).select("data").limit(1)


def append_tracks(tracks: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The rows to append: (id, hash, data), ids counting on from the largest one in use.

    ``order`` (a unique whole number) decides who gets which id. No check for duplicate content. The
    order column alone is ranked, and the ranks are joined back.
    """
    last_id = F.coalesce(tracks.select(F.max("id")).scalar(), F.lit(0))
    ranks = number_rows(new.select(order), [], [order], "_rank")
    return new.select(order, "data").join(ranks, order).select(
        (last_id + 1 + F.col("_rank")).cast("long").alias("id"),
        md5_upper(F.col("data")).alias("hash"),
        "data",
    )


def delete_tracks(tracks: DataFrame, ids: DataFrame) -> DataFrame:
    """The tracks without the given ids; unknown ids do nothing. The ids are stored first."""
    return tracks.join(key_set(ids.select("id").distinct()), "id", "left_anti")


def removal_messages(ids: DataFrame) -> DataFrame:
    """One removal per requested id, known or not."""
    return ids.select(F.lit("removed").alias("kind"), F.col("id").alias("key"))


def upsert_latest(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Insert or replace: the base without the updated keys, and each key's last update.

    The last updates are stored first; the base is only filtered, never re-aggregated.
    """
    latest = materialize(last_by_key(updates, key, order))
    return base.join(broadcast_if_small(latest.select(key)), key, "left_anti").unionByName(latest)


def known_hashes(tracks: DataFrame) -> DataFrame:
    return tracks.select("hash").distinct()


def offer_hashes(offers: DataFrame, tracks: DataFrame) -> DataFrame:
    """Answers each offered hash: accept if no track has it, else confirm.

    Of the known hashes only offered ones are kept; they are computed and stored first.
    """
    offered = known_hashes(tracks).join(known_hashes(offers), "hash", "left_semi")
    known = key_set(offered.select(F.col("hash").alias("_known")))
    answer = F.when(F.col("_known").isNull(), "accept").otherwise("confirm")
    joined = offers.join(known, offers["hash"] == known["_known"], "left")
    return joined.select(*[offers[c] for c in offers.columns], answer.alias("answer"))


def last_file_per_hash(files: DataFrame, order: str) -> DataFrame:
    """Equal content scanned more than once counts once, as the last file: (hash, ``order``)."""
    return files.groupBy("hash").agg(F.max(order).alias(order))


def new_files(files: DataFrame, done: DataFrame, order: str) -> DataFrame:
    """Scanned files whose hash is not processed yet, one per hash. ``order`` must be unique.

    Copies are reduced before the join on both sides, so a hash with many copies does not skew it, and
    hashes alone are joined; the other columns are fetched for the files that are left.
    """
    fresh = last_file_per_hash(files, order).join(known_hashes(done), "hash", "left_anti")
    return _fetched(files, fresh, order)


def accepted_uploads(accepted: DataFrame, files: DataFrame, order: str) -> DataFrame:
    """The local files to send: the last file of each accepted hash. ``order`` must be unique."""
    return _fetched(files, last_file_per_hash(files, order).join(known_hashes(accepted), "hash"), order)


def _fetched(files: DataFrame, chosen: DataFrame, order: str) -> DataFrame:
    """The rows of the chosen (hash, ``order``) pairs; the pairs are enough if nothing else is asked."""
    if set(files.columns) <= {"hash", order}:
        return chosen.select(*files.columns)
    return files.join(chosen.select("hash", order), ["hash", order], "left_semi").select(*files.columns)


def set_add(keys: DataFrame, added: DataFrame) -> DataFrame:
    return keys.unionByName(added).distinct()


def set_remove(keys: DataFrame, removed: DataFrame) -> DataFrame:
    """The keys that are not removed; those are stored first."""
    return keys.join(key_set(removed.distinct()), keys.columns, "left_anti")
