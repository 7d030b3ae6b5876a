"""Access to Arrow batches and to the few settings the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer file of this name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one run of UTF-8 bytes and the n + 1 offsets of the texts in it.

    A null text is an empty one.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(ends) or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def give_back() -> None:
    """What a worker has read and freed goes back to the system; it may wait for other tasks for long."""
    pa.default_memory_pool().release_unused()
    # Freed blocks between others stay with the process else. Only glibc has this.
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], most: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        bins = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)
    give_back()


def usable_vector(column: str) -> Column:
    """Whether a vector is there, is not zero and has only finite components."""
    parts = F.col(column)
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(parts, lambda x: x != 0), F.lit(False))


def vectors_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in the order of the components, so that equal rows give equal sums."""
    sums = np.zeros(len(a))
    for k in range(a.shape[1]):
        sums += a[:, k] * b[:, k]
    return sums


def ascii_lower(text: str) -> Column:
    """A text with A-Z in lower case and all else as it is; a null one is empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower())
