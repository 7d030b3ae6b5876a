"""Concatenate-and-cut packing.

A first pass tokenizes every document once and stores its ids with the document's place within its
partition. The partitions' totals, one row each, are summed to global offsets. A second pass cuts the
run of all tokens into windows of a fixed length; a document across a boundary leaves one record in each
window it touches. Only the last window is not full.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.columns import slices, text_bytes, tokenizer_path
from tracklake.session import work_path

REMEMBERED = 500_000
KEPT = 150_000
REMEMBERED_LENGTH = 40
SLICE_BYTES = 1 << 20


#: Words whose composition and lower case are the same in every library: printable ASCII and Latin letters.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
SPECIAL = "<|"


class WordIds(dict):
    """The ids of a word between white space, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and no token spans it, so a text's ids are its words' ids in a row.
    It also cuts a word into runs of letters, digits and runs of signs, which its model turns into ids
    one by one; plain words go to the model in these pieces, all others to the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        steps = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"]
        # Python's own expressions know letters and digits of plain words by these ranges.
        pattern = steps[0]["pattern"]["Regex"].replace("[\\p{N}]", "[0-9]")
        pattern = pattern.replace("\\p{L}", "a-z\u00df-\u00f6\u00f8-\u00ff").replace("\\p{N}", "0-9")
        self.pieces = re.compile(pattern).findall
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {c: [t.id for t in self.model.tokenize(c)] for c in map(chr, range(0x21, 0x7F))}
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if PLAIN.fullmatch(text) and SPECIAL not in text:
            lower, ids = text.lower(), []
            if len(lower) < len(word):
                pieces = [p.translate(self.letters) for p in self.pieces(lower)]
            else:
                pieces = self.pieces(lower)
            for piece in pieces:
                if len(piece) > 1:
                    ids += [token.id for token in self.model.tokenize(piece)]
                else:
                    ids += self.signs[piece]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        found = pack_ids(f"<{len(ids)}I", *ids)
        if len(word) <= REMEMBERED_LENGTH:
            self[word] = found
        return found

    def texts(self, data: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of each text of a column."""
        whole = data.tobytes()
        if len(self) > REMEMBERED:
            self.clear()
        return [b"".join(map(self.__getitem__, whole[a:b].split())) for a, b in zip(ends.tolist(), ends[1:].tolist())]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table of ids for each Python worker and tokenizer."""
    return WordIds(path)


def tokenize(docs: DataFrame, path: str, end_id: int, key: str, text: str) -> DataFrame:
    """One row per document: ``_part``, ``_at`` (tokens before it in its partition), key, ``_ids``, doc_tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, at = word_ids(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        try:
            for batch in slices(batches, SLICE_BYTES, text):
                ids = [i + end for i in table.texts(*text_bytes(batch.column(1)))]
                counts = np.array([len(i) // 4 for i in ids], np.int64)
                before = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.record_batch(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(before), batch.column(0), pa.array(ids, pa.binary()), pa.array(counts)],
                    names=["_part", "_at", key, "_ids", "doc_tokens"],
                )
        finally:
            # The worker may go on to tasks of other kinds, which need the memory. Frequent words came first.
            for word in [*table][KEPT:]:
                del table[word]

    kind = docs.schema[key].dataType.simpleString()
    schema = f"_part int, _at long, `{key}` {kind}, _ids binary, doc_tokens long"
    return docs.select(key, text).mapInArrow(encode, schema)


def pack(
    docs: DataFrame,
    length: int = 4096,
    tokenizer: str | None = None,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Packs all documents into sequences of ``length`` tokens; one row per piece of a document.

    Columns: ``key``, start (ids of the document before the piece), length, doc_tokens (``end_id``
    included), sequence_id, offset (place in the sequence, without gaps from 0) and ids (little-endian
    unsigned 32-bit). ``tokenizer`` is the path of a word-level BPE file that drops white space; without
    it word_bpe_49k.json. A null or empty text is its end id alone, null keys stay null, equal rows are
    packed each, an empty table gives no pieces. Other columns are ignored, whatever their names. A long
    document is cut into as many pieces as it needs.
    """
    spark = docs.sparkSession
    path = work_path(spark, "packing")
    tokens = tokenize(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), end_id, key, text)
    tokens.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(tokens.schema).parquet(path)

    totals = stored.groupBy("_part").agg(F.sum("doc_tokens").alias("_total"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    # One row per task of the first pass, so the broadcast is far smaller than what the driver already
    # keeps about those tasks.
    begin = F.col("_base") + F.col("_at")
    placed = stored.join(F.broadcast(offsets), "_part").withColumn("_begin", begin)
    finish = F.col("_begin") + F.col("doc_tokens")
    windows = placed.withColumn(
        "sequence_id", F.explode(F.sequence(F.expr(f"_begin div {length}"), F.expr(f"(_begin + doc_tokens - 1) div {length}")))
    )
    floor = F.col("sequence_id") * length
    from_ = F.greatest(floor, "_begin")
    size = F.least(floor + length, finish) - from_
    start = from_ - F.col("_begin")
    return windows.select(
        key,
        start.alias("start"),
        size.alias("length"),
        "doc_tokens",
        "sequence_id",
        (from_ - floor).alias("offset"),
        F.substring("_ids", (start * 4 + 1).cast("int"), (size * 4).cast("int")).alias("ids"),
    )


def sequences(pieces: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, ids (padded to ``length``), n_tokens without padding.

    A group holds at most ``length`` tokens.
    """
    gathered = pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_pieces"), F.sum("length").alias("n_tokens")
    )
    joined = F.expr("aggregate(_pieces, X'', (whole, piece) -> concat(whole, piece.ids))")
    return gathered.select("sequence_id", F.rpad(joined, F.lit(length * 4), F.lit(pad_id.to_bytes(4, "little"))).alias("ids"), "n_tokens")


def digests(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pieces with a check sum in place of their ids."""
    return pieces.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
