"""Ordered numbering that never puts one whole key into one task.

A key (a track, a way, an artifact) may hold a large share of all rows. Work that needs order is
therefore done in blocks: a block is a stretch of the order column, ``order >> bits``, so with unique
order values it holds at most ``2**bits`` rows of one key. Rows are shuffled once on (key, block);
what has to cross blocks is carried by a summary with one row per block, which is joined back on the
columns the rows are already partitioned by. Key and order columns must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_BITS = 18
BLOCK = "_block"


def block_of(order: str | Column, bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(F.col(order) if isinstance(order, str) else order, bits).cast("long")


def to_blocks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shuffles rows on (key, block), the partitioning all later steps in the block share.

    Spelled out, because rows that are already partitioned by the key alone would satisfy a window
    over (key, block) as well, with all of a large key in one task.
    """
    return df.repartition(*keys, BLOCK)


def before_in_key(keys: Sequence[str], order: str = BLOCK) -> Window:
    """All earlier rows of the key, the current one excluded."""
    return (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def sum_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, str],
    levels: int,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Adds running sums over the key's earlier rows: ``values`` maps new columns to summed ones.

    ``order`` is a whole number, unique within the key. Each level sums within blocks and hands the
    blocks' totals to the next one; the last one is a plain window per key over what is left, which is
    ``2**(bits * levels)`` times shorter than the range of ``order``.
    """
    zero = F.lit(0)
    if levels == 0:
        earlier = before_in_key(keys, order)
        sums = [F.coalesce(F.sum(v).over(earlier), zero).cast("long").alias(o) for o, v in values.items()]
        return df.select("*", *sums)
    block = f"{BLOCK}_{levels}"
    blocked = df.withColumn(block, block_of(order, bits))
    totals = blocked.groupBy(*keys, block).agg(*[F.sum(v).alias(f"_t_{o}") for o, v in values.items()])
    carried = {f"_o_{o}": f"_t_{o}" for o in values}
    offsets = sum_before(totals, keys, block, carried, levels - 1, bits).select(*keys, block, *carried)
    within = before_in_key([*keys, block], order)
    sums = [F.coalesce(F.sum(v).over(within), zero).alias(f"_l_{o}") for o, v in values.items()]
    local = blocked.repartition(*keys, block).select("*", *sums)
    whole = [(F.col(f"_l_{o}") + F.col(f"_o_{o}")).cast("long").alias(o) for o in values]
    return local.join(offsets, [*keys, block]).select(*df.columns, *whole)


def block_offsets(totals: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Per block the sum of ``value`` over the key's earlier blocks; one row per (key, block)."""
    # Without a key all blocks would meet in one task, so they are summed in blocks again.
    return sum_before(totals, keys, BLOCK, {out: value}, 0 if keys else 1).select(*keys, BLOCK, out)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    block: Column | None = None,
) -> DataFrame:
    """Adds the dense 0-based number of each row within its key, in the given order.

    ``block`` must not decrease along the order; by default it is taken from the first order column.
    """
    block = block_of(order[0]) if block is None else block
    blocked = df.withColumn(BLOCK, block)
    window = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    local = to_blocks(blocked, keys).withColumn("_local", F.row_number().over(window) - 1)
    counts = blocked.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    return (
        local.join(block_offsets(counts, keys, "_n", "_offset"), [*keys, BLOCK])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_local", "_offset", BLOCK)
        .select(*df.columns, out)
    )

