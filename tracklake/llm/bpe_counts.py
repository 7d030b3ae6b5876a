"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pieces by the tokenizer's pattern; a piece starts as a linked list of its bytes, and
a heap of adjacent pairs gives the merge of lowest rank, leftmost first. Each merge joins two symbols,
so a piece's tokens are its bytes minus its merges; no identifier is ever made. Words that occur
again are looked up. A piece of any length takes n log n steps.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracklake.llm.columns import tokenizer_path

PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
MIXED_SPACES = regex.compile(r"\s \s|\s $")
REMEMBERED = 1_200_000
REMEMBERED_LENGTH = 40


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or one beyond 255."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class PieceCounts(dict):
    """Tokens by piece; a missing piece is merged and, if short, remembered."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        number: dict[str, int] = {}
        for symbol in [*byte_symbols(), *(a + b for a, b in merges)]:
            number.setdefault(symbol, len(number))
        # A pair of symbols and a merge (rank, joint symbol) are one whole number each.
        self.bits = len(number).bit_length()
        self.merged = {
            number[a] << self.bits | number[b]: rank << self.bits | number[a + b]
            for rank, (a, b) in reversed([*enumerate(merges)])
        }
        self.first = [number[s] for s in byte_symbols()]
        self.chunks = ChunkCounts(self)
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def __missing__(self, piece: str) -> int:
        count = self.merge(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = count
        return count

    def merge(self, data: bytes) -> int:
        """Initial symbols minus merges."""
        n = len(data)
        if n < 2:
            return n
        find, bits, places = self.merged.get, self.bits, n.bit_length()
        joint_mask, place_mask = (1 << bits) - 1, (1 << places) - 1
        first = self.first
        symbols = [first[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for at in range(n - 1):
            found = find(symbols[at] << bits | symbols[at + 1])
            if found is not None:
                heap.append(found << places | at)
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        merges = 0
        while heap:
            entry = pop(heap)
            at, merge = entry & place_mask, entry >> places
            other = after[at]
            # An entry is stale once the pair at its place is another one.
            if other >= n or symbols[at] < 0 or find(symbols[at] << bits | symbols[other]) != merge:
                continue
            merges += 1
            joint = merge & joint_mask
            symbols[at], symbols[other] = joint, -1
            after[at] = beyond = after[other]
            if beyond < n:
                before[beyond] = at
                found = find(joint << bits | symbols[beyond])
                if found is not None:
                    push(heap, found << places | at)
            earlier = before[at]
            if earlier >= 0:
                found = find(symbols[earlier] << bits | joint)
                if found is not None:
                    push(heap, found << places | earlier)
        return n - merges

    def words(self, text: str) -> int:
        """Tokens of a text without special strings.

        No piece holds a space after another character, so a text may be cut before each space that
        follows a non-space, and the cuts looked up. Where spaces meet, the text is matched whole.
        """
        if MIXED_SPACES.search(text):
            return sum(map(self.__getitem__, PIECES.findall(text)))
        start, *others = text.split(" ")
        return sum(map(self.__getitem__, PIECES.findall(start))) + sum(map(self.chunks.__getitem__, others))

    def text(self, text: str) -> int:
        """Tokens of a whole text; a special string in it is one token."""
        if self.special is None or not self.special.search(text):
            return self.words(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.words, parts))


class ChunkCounts(dict):
    """Tokens of a space and what follows it, by what follows; of several pieces only short ones stay."""

    def __init__(self, pieces: PieceCounts):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, chunk: str) -> int:
        found = PIECES.findall(" " + chunk)
        if len(found) == 1:
            count = self.pieces.merge(found[0].encode("utf-8", "surrogatepass"))
            keep = len(chunk) <= REMEMBERED_LENGTH
        else:
            count = sum(self[p[1:]] if p[0] == " " and len(p) > 1 else self.pieces[p] for p in found)
            keep = len(chunk) <= 8
        if keep:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = count
        return count


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    """One table of counts for each Python worker and tokenizer."""
    return PieceCounts(path)


def token_counts(
    docs: DataFrame, tokenizer: str | None = None, limit: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Counts the tokens of every text: ``key``, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the path of a byte-level BPE file; without it byte_bpe_50k.json. No row is dropped:
    a null key stays null, a null or empty text has 0 bytes and tokens, equal rows are counted each, an
    empty table gives an empty result. Other columns are ignored, whatever their names. A text without
    spaces or of any length is merged whole.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(path)
        for batch in batches:
            texts = batch.column(1)
            tokens, sizes = [], []
            for scalar in texts:
                value = scalar.as_py() or ""
                tokens.append(counts.text(value))
                sizes.append(len(value.encode("utf-8", "surrogatepass")))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
