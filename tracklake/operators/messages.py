"""Messages as rows and as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEARTBEAT = "Tick"
CHUNK_BITS = 10


def encode_message(messages: DataFrame, out: str = "text") -> DataFrame:
    """Each row as one JSON object tagged by its ``kind``; null fields are left out."""
    return messages.select(F.to_json(F.struct("*")).alias(out))


def decode_message(texts: DataFrame, schema: T.StructType, text: str = "text") -> DataFrame:
    """JSON texts back to message rows; malformed text fails."""
    parsed = F.from_json(text, schema, {"mode": "FAILFAST"})
    return texts.select(parsed.alias("_m")).select("_m.*")


def drop_heartbeats(messages: DataFrame, heartbeat: str = HEARTBEAT) -> DataFrame:
    """Without keep-alive messages; works on batches and streams."""
    return messages.where(F.col("kind") != heartbeat)


def rewrite_by_kind(df: DataFrame, kind: str, field: str, value: Column) -> DataFrame:
    """Sets one field on the rows of a kind and passes all others through."""
    return df.withColumn(field, F.when(F.col("kind") == kind, value).otherwise(F.col(field)))


def reassemble_chunks(chunks: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Whole messages from their fragments in order ``n``: (message_id, text) or (message_id, data).

    Fragments are texts or bytes. They are joined in stretches of ``2**bits`` first, so the last step
    sees few long pieces; bytes travel as hex digits, for which Spark has an array join.
    """
    binary = isinstance(chunks.schema["chunk"].dataType, T.BinaryType)
    chunk = F.hex("chunk") if binary else F.col("chunk")

    def join(df: DataFrame, *keys: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("_place", "chunk")))
        text = F.array_join(F.transform(ordered, lambda c: c.chunk), "")
        return df.groupBy(*keys).agg(text.alias("chunk"))

    placed = chunks.select(
        "message_id",
        F.shiftright("n", bits).alias("_stretch"),
        F.col("n").alias("_place"),
        chunk.alias("chunk"),
    )
    stretches = join(placed, "message_id", "_stretch").withColumnRenamed("_stretch", "_place")
    whole = join(stretches, "message_id")
    if binary:
        return whole.select("message_id", F.unhex("chunk").alias("data"))
    return whole.withColumnRenamed("chunk", "text")


def fingerprint(df: DataFrame, column: str) -> DataFrame:
    """Hash of a whole column in any row order: (fingerprint, n). Equal content, equal result.

    Each value's hash has 60 bits; their sum is taken modulo 2^60, so repeated values count as often as
    they occur. Nulls are rows and add to n alone. No rows: 0 and 0.
    """
    digits = F.md5(F.col(column))
    # Two halves of 30 bits: their sums over up to 2^33 rows fit a long.
    half = lambda start, bits: F.shiftrightunsigned(F.conv(F.substring(digits, start, 8), 16, 10).cast("long"), bits)
    high, low = (F.coalesce(F.sum(half(start, 2)), F.lit(0)) for start in (1, 9))
    carried = high + F.shiftright(low, 30)
    whole = F.shiftleft(carried.bitwiseAND((1 << 30) - 1), 30).bitwiseOR(low.bitwiseAND((1 << 30) - 1))
    return df.agg(whole.alias("fingerprint"), F.count(F.lit(1)).alias("n"))
