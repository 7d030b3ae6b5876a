"""Hashes, times, JSON and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_upper(data: Column) -> Column:
    """Content hash: MD5 as upper-case hex."""
    return F.upper(F.md5(data))


def epoch_ms(ts: Column) -> Column:
    """Timestamp as epoch milliseconds, rounded down."""
    return F.unix_millis(ts.cast("timestamp"))


def ms_to_ts(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def json_field(text: Column, path: str) -> Column:
    """One field of a JSON text, such as ``$.k`` or ``$.nodes[0]``, as text."""
    return F.get_json_object(text, path)


def url_encode(text: Column) -> Column:
    """Form encoding of a text (UTF-8, space as plus)."""
    return F.url_encode(text)


def text_to_long(text: Column, strict: bool = True) -> Column:
    """Text as a number; strict fails on malformed text, otherwise it gives null."""
    return text.cast("long") if strict else text.try_cast("long")


def text_to_double(text: Column, strict: bool = True) -> Column:
    return text.cast("double") if strict else text.try_cast("double")
