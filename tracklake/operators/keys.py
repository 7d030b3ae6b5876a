"""Sets of keys that large tables are filtered by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.session import materialize

MAX_BROADCAST_KEYS = 500_000
MAX_BROADCAST_BYTES = 64 << 20


def key_set(keys: DataFrame, max_broadcast: int | None = None) -> DataFrame:
    """Computes and stores a set of keys, and measures it.

    A set of at most ``max_broadcast`` rows is broadcast, so the filtered table is not shuffled. A
    larger one is shuffled; as a stored table it meets the join without an aggregation in between,
    which lets adaptive execution split the partitions of a hot key.
    """
    return broadcast_if_small(materialize(keys), max_broadcast)


def broadcast_if_small(stored: DataFrame, max_broadcast: int | None = None) -> DataFrame:
    """Marks a stored frame for broadcast if it is measured to be small, else leaves it as it is.

    Rows are counted and the lengths of texts and binaries summed up, so wide rows are not few bytes.
    """
    limit = MAX_BROADCAST_KEYS if max_broadcast is None else max_broadcast
    long = [f.name for f in stored.schema if f.dataType.typeName() in ("string", "binary")]
    others = [f for f in stored.schema if f.name not in long]
    if any(f.dataType.typeName() in ("array", "map", "struct", "variant") for f in others):
        return stored
    width = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in long), F.lit(8 * len(others)))
    rows, size = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(stored) if rows <= limit and size <= MAX_BROADCAST_BYTES else stored
