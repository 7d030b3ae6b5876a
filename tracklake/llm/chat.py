"""Chat formatting with loss masks aligned by offsets.

A turn is rendered as ``<|im_start|>role<|im_sep|>text<|im_end|>``. The three marks are tokens of their
own, so no token reaches over the edge of a text. A conversation is rendered whole and encoded once with
offsets; a binary search of the turns' spans in the tokens' spans gives the tokens under the loss.
In roles and texts a backslash is put into every ``<`` + backslashes + ``|``, which leaves no mark and
can be undone.

Conversations are dealt out in blocks of 256 turn numbers and streamed through, so that one with a
large share of all rows fills neither a task nor its memory: a row of the result is a conversation, or a
piece of one that ends with a turn. Marks end a token, so pieces have the tokens of the whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.columns import tokenizer_path

START, BETWEEN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
BLOCK_BITS = 8
PIECE_CHARS = 1 << 20
BATCH_CHARS = 1 << 20

OPEN = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of some turns and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{BETWEEN}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at = spans[-1][1] + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a rendered text."""
    at = 0
    while at < len(formatted):
        between = formatted.index(BETWEEN, at)
        end = formatted.index(END, between)
        yield unescape(formatted[at + len(START) : between]), unescape(formatted[between + len(BETWEEN) : end])
        at = end + len(END)


def token_ranges(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each span the first token that reaches into it and the first behind it."""
    first = np.searchsorted(ends, spans[:, 0], "right")
    return np.stack([first, np.maximum(first, np.searchsorted(starts, spans[:, 1], "left"))], 1)


@lru_cache(maxsize=2)
def encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([START, BETWEEN, END])
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def format_conversations(
    conversations: DataFrame,
    tokenizer: str | None = None,
    loss_role: str = "assistant",
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Renders and encodes all conversations; one row per conversation or piece of a long one.

    Columns: ``conv``, block and piece (their order within the conversation), n_turns, formatted, ids,
    starts and ends (of the tokens, in code points of ``formatted``), loss (token ranges, the end
    exclusive, one for each text of ``loss_role``). ``tokenizer`` is the path of a byte-level file; without
    it byte_bpe_50k.json. Rows go by turn, then role, then text; null turns come first; null roles and
    texts are empty ones; a null conversation is a conversation; equal rows are turns of their own. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def emit(pieces: list[tuple]) -> pa.RecordBatch:
        rendered = [render(turns) for *_, turns in pieces]
        rows = []
        for (key, block, piece, turns), (formatted, spans), e in zip(
            pieces, rendered, encoder(path).encode_batch([r[0] for r in rendered], add_special_tokens=False)
        ):
            offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
            wanted = np.array([s for s, t in zip(spans, turns) if t[0] == loss_role], np.int32).reshape(-1, 2)
            ranges = token_ranges(offsets[:, 0], offsets[:, 1], wanted)
            rows.append((key, block, piece, len(turns), formatted, e.ids, offsets[:, 0], offsets[:, 1], ranges.tolist()))
        return pa.record_batch(
            [pa.array([r[k] for r in rows], arrow.field(k).type) for k in range(len(arrow.names))], schema=arrow
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        turns: list[tuple[str, str]] = []
        now, piece, size, waiting = None, 0, 0, 0
        for batch in batches:
            for key, block, spoken, said in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if turns and (now != (key, block) or size >= PIECE_CHARS):
                    done.append((*now, piece, turns))
                    piece, turns, waiting, size = piece + 1, [], waiting + size, 0
                if now != (key, block):
                    now, piece = (key, block), 0
                turns.append((spoken or "", said or ""))
                size += len(turns[-1][0]) + len(turns[-1][1]) + 40
                if waiting >= BATCH_CHARS:
                    yield emit(done)
                    done, waiting = [], 0
        if turns:
            done.append((*now, piece, turns))
        if done:
            yield emit(done)

    schema = f"`{conv}` {conversations.schema[conv].dataType.simpleString()}, block long, piece int, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<array<int>>"
    block = F.shiftright(F.col(turn).cast("long"), BLOCK_BITS)
    rows = conversations.select(conv, block.alias("_block"), role, text, turn)
    dealt = rows.repartition(conv, "_block").sortWithinPartitions(conv, "_block", turn, role, text)
    arrow = _arrow_schema(conversations, conv)
    return dealt.mapInArrow(scan, schema)


def _arrow_schema(frame: DataFrame, conv: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    ints = pa.list_(pa.int32())
    return pa.schema(
        [(conv, to_arrow_type(frame.schema[conv].dataType)), ("block", pa.int64()), ("piece", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("ids", ints), ("starts", ints), ("ends", ints), ("loss", pa.list_(ints))]
    )


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its pieces: counts and check sums of turns and of loss text.

    A check sum runs over a conversation from start to end, so its pieces pass through one task, one
    after the other and never together in memory.
    """
    schema = f"`{conv}` {formatted.schema[conv].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    class Sums:
        def __init__(self, key):
            self.key, self.turns, self.loss_chars, self.chars = key, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def row(self) -> tuple:
            return self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = None, []

        def out(kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], kinds[k] or kind) for k in range(len(names))]
            return pa.record_batch(columns, names=names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text, starts, ends, loss in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if sums is None or sums.key != key:
                    rows += [sums.row()] if sums else []
                    sums = Sums(key)
                sums.chars += len(text)
                for role, said in parse(text):
                    sums.turns += 1
                    sums.all.update(f"{role}\n{said}\n".encode())
                for first, last in loss:
                    if last > first:
                        said = unescape(text[starts[first] : ends[last - 1]])
                        sums.loss_chars += len(said)
                        sums.loss.update(said.encode())
            if len(rows) >= 1000:
                yield out(kind)
                rows = []
        if sums:
            rows.append(sums.row())
            yield out(kind)

    pieces = formatted.select(conv, "formatted", "starts", "ends", "loss", "block", "piece")
    return pieces.repartition(conv).sortWithinPartitions(conv, "block", "piece").mapInArrow(scan, schema)
