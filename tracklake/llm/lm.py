"""Language-model scores of whole documents, learned from the corpus itself.

Tokens are counted over all training documents. The most frequent words are symbols of a gated recurrent
model (see ``gru``), all others fall into classes by how they begin. The model is trained in rounds: every
task trains a copy on every token of its documents, and copies are averaged. Then every text is
scored from its first token to its end, the state running on through its windows. A word outside the
vocabulary has its class's probability from the model and its share of the class by its count; those
counts come by a join, since no task holds the whole vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm import gru
from tracklake.llm.columns import slices, text_bytes
from tracklake.llm.shingles import mix, word_numbers
from tracklake.session import materialize

SLICE_BYTES = 1 << 20
VOCABULARY = 1536
TAIL_BITS = 5
TAILS = 1 << TAIL_BITS
#: Words whose counts every task holds; those of all others are joined.
HELD_WORDS = 1 << 18
ADDED = 0.1
ROUNDS = 2
#: Tokens are learned from in stretches of about this many, side by side in lanes: many where there are many
#: tokens, so that matrix products are large, but of at least LANE_TOKENS each between the two numbers.
TRAIN_TOKENS = 1 << 19
TRAIN_LANES = 32, 512
LANE_TOKENS = 1 << 10
SCORE_TOKENS = 2_000_000
AVERAGED_AT_ONCE = 32
PIECE = 1 << 14
END = np.uint64(0xE5D0F7E872A31B00)
LOG10 = np.log(10.0)


def token_ids(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each token of each text, its end included, and the texts' bounds among them.

    The low bits name the class that the word falls into if it is no symbol: its first two bytes, mixed.
    """
    numbers, starts, stops = word_numbers(data, ends)
    each = np.diff(np.searchsorted(starts, ends))
    if len(numbers):
        lower = lambda b: np.where((b >= 65) & (b <= 90), b + np.uint8(32), b).astype(np.uint64)
        second = np.where(starts + 1 < stops, lower(data[np.minimum(starts + 1, len(data) - 1)]), np.uint64(0))
        begin = lower(data[starts]) * np.uint64(256) + second
        numbers = (numbers & ~np.uint64(TAILS - 1)) | (mix(begin) >> np.uint64(64 - TAIL_BITS))
    bounds = np.concatenate([[0], np.cumsum(each + 1)])
    out = np.full(bounds[-1], END, np.uint64)
    inside = np.ones(bounds[-1], bool)
    inside[bounds[1:] - 1] = False
    out[inside] = numbers
    return out, bounds


def remainder(key: str, modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) over all texts, exact; equal tokens are counted together before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
            waiting.clear()
            return pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], names=["token", "c"])

        for batch in slices(batches, SLICE_BYTES, "text"):
            waiting.append(token_ids(*text_bytes(batch.column(0)))[0])
            if sum(map(len, waiting)) > 4_000_000:
                yield flush()
        yield flush()

    return texts.mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Places:
    """Finds tokens in an ascending array: they are evenly spread, so their first bits tell about where."""

    def __init__(self, tokens: np.ndarray):
        bits = len(tokens).bit_length() + 1
        self.tokens, self.shift = tokens, np.uint64(64 - bits)
        self.starts = np.searchsorted(tokens, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """The place of each token, or one that holds another."""
        last = len(self.tokens) - 1
        at = np.minimum(self.starts[(tokens >> self.shift).view(np.int64)], last)
        behind = np.flatnonzero(self.tokens[at] < tokens)
        while len(behind):
            at[behind] += 1
            behind = behind[at[behind] <= last]
            behind = behind[self.tokens[at[behind]] < tokens[behind]]
        return np.minimum(at, last, out=at)


class Vocabulary:
    """The symbols' tokens and counts, the held tokens' counts, and the totals of all."""

    def __init__(self, counts: DataFrame):
        self.total, self.distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
        held = counts.orderBy(F.desc("c"), "token").limit(HELD_WORDS).toArrow()
        tokens, c = held.column(0).to_numpy().view(np.uint64), held.column(1).to_numpy()
        if END not in tokens:
            tokens, c = np.concatenate([tokens, [END]]), np.concatenate([c, [0]])
        top = tokens[:VOCABULARY]
        self.symbols = np.concatenate([top[top != END], [END]])
        top_counts = dict(zip(tokens.tolist(), c.tolist()))
        own = np.array([top_counts.get(t, 0) for t in self.symbols.tolist()], float)
        order = np.argsort(tokens)
        self.held, self.held_counts = tokens[order], c[order]
        tails = counts.groupBy(F.col("token").bitwiseAND(TAILS - 1).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
        # Sums and numbers of words of each tail class, the symbols among them taken off.
        self.tail_sums, self.tail_sizes = np.zeros(TAILS), np.zeros(TAILS)
        for r in tails.collect():
            self.tail_sums[r["k"]], self.tail_sizes[r["k"]] = r["n"], r["v"]
        of = (self.symbols & np.uint64(TAILS - 1)).astype(int)
        np.subtract.at(self.tail_sums, of, own)
        np.subtract.at(self.tail_sizes, of, own > 0)
        self.counts = np.concatenate([own, self.tail_sums])
        self.shape = gru.make_shape(self.counts, TAILS)
        self._order = np.argsort(self.symbols)
        self._sorted = self.symbols[self._order]

    @cached_property
    def _symbol_places(self) -> Places:
        return Places(self._sorted)

    @cached_property
    def _held_places(self) -> Places:
        return Places(self.held)

    def symbols_of(self, tokens: np.ndarray) -> np.ndarray:
        """The symbol of each token; from ``len(symbols)`` on those of tail classes."""
        at = self._symbol_places.of(tokens)
        tail = len(self.symbols) + (tokens & np.uint64(TAILS - 1)).astype(np.int64)
        return np.where(self._sorted[at] == tokens, self._order[at], tail).astype(np.int32)

    def counts_of(self, tokens: np.ndarray) -> np.ndarray:
        """The count of each held token, -1 for others."""
        at = self._held_places.of(tokens)
        return np.where(self.held[at] == tokens, self.held_counts[at], -1)

    def base_room(self) -> float:
        return float(np.log10(self.total + ADDED * (self.distinct + 1)))

    def tail_room(self) -> np.ndarray:
        return np.log10(np.maximum(self.tail_sums, 0) + ADDED * (np.maximum(self.tail_sizes, 0) + 1))


def train_round(texts: DataFrame, vocabulary: Vocabulary, weights: gru.Weights) -> gru.Weights:
    """Every task trains a copy on its whole texts; the copies are averaged by the tokens they saw."""
    size = len(weights.flat())
    pieces = -(-size // PIECE)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = gru.Trainer(weights.filled(weights.flat()), vocabulary.shape)
        waiting: list[np.ndarray] = []

        def learn() -> None:
            fresh = np.zeros(sum(map(len, waiting)), bool)
            fresh[np.cumsum([0, *map(len, waiting)])[:-1]] = True
            least, most = TRAIN_LANES
            trainer.lanes = min(most, max(least, len(fresh) // LANE_TOKENS))
            trainer.run(np.concatenate(waiting), fresh)
            waiting.clear()

        for batch in slices(batches, SLICE_BYTES, "text"):
            tokens, bounds = token_ids(*text_bytes(batch.column(0)))
            symbols = vocabulary.symbols_of(tokens)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                waiting.append(symbols[a:b])
            if sum(map(len, waiting)) >= TRAIN_TOKENS:
                learn()
        if waiting:
            learn()
        if trainer.symbols:
            flat = trainer.w.flat().astype(np.float32)
            yield pa.record_batch(
                [
                    pa.array([TaskContext.get().partitionId()] * pieces, pa.int32()),
                    pa.array(range(pieces), pa.int32()),
                    pa.array([float(trainer.symbols)] * pieces),
                    pa.array([flat[k * PIECE : (k + 1) * PIECE].tobytes() for k in range(pieces)], pa.binary()),
                ],
                names=["copy", "piece", "seen", "part"],
            )

    def average(group: pa.Table) -> pa.Table:
        seen = np.array(group.column("seen").to_pylist())
        parts = np.array([np.frombuffer(p, np.float32) for p in group.column("part").to_pylist()], float)
        whole = (seen / seen.sum()) @ parts
        return pa.table(
            {
                "copy": pa.array([group.column("copy")[0].as_py() // AVERAGED_AT_ONCE], pa.int32()),
                "piece": group.column("piece").slice(0, 1),
                "seen": [float(seen.sum())],
                "part": pa.array([whole.astype(np.float32).tobytes()], pa.binary()),
            }
        )

    schema = "copy int, piece int, seen double, part binary"
    copies = materialize(texts.mapInArrow(train, schema))
    # Groups of bounded size, level by level, until one copy is left.
    most = copies.agg(F.max("copy")).first()[0]
    if most is None:
        return weights
    while True:
        copies = copies.groupBy(F.expr(f"copy div {AVERAGED_AT_ONCE}").alias("g"), "piece").applyInArrow(average, schema)
        most //= AVERAGED_AT_ONCE
        if not most:
            break
        copies = materialize(copies)
    parts = copies.select("piece", "part").orderBy("piece").collect()
    return weights.filled(np.concatenate([np.frombuffer(r["part"], np.float32) for r in parts]))


def train(texts: DataFrame, key: str, vocabulary: Vocabulary, rounds: int = ROUNDS) -> gru.Weights:
    """A round takes the training documents that a hash of the key gives it; each has one round."""
    weights = gru.first_weights(vocabulary.counts, vocabulary.shape)
    of = F.pmod(F.xxhash64(key, "text"), F.lit(rounds))
    for k in range(rounds):
        weights = train_round(texts.filter(of == k).select("text"), vocabulary, weights)
    return weights


def with_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """Per document: ``key``, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` marks documents not learned from; without it those whose crc32(key as text) mod 10 is 0,
    a null key being an empty text. Tokens are words and one end; a null text is an empty one. Both scores
    are log10 probabilities of the whole text: base_score by the tokens' counts alone, score by the
    recurrent model. Equal rows are scored each, an empty table gives an empty result, other columns are
    ignored. Without training documents all tokens are unknown.
    """
    held = F.coalesce(held_out, F.lit(True)) if held_out is not None else remainder(key, 10) == 0
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), held.alias("held_out"))
    training = rows.filter("not held_out")
    counts = materialize(count_tokens(training.select("text")))
    vocabulary = Vocabulary(counts)
    weights = train(training.select("key", "text"), "key", vocabulary)
    base_room, tail_room = vocabulary.base_room(), vocabulary.tail_room()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[pa.RecordBatch, list]] = []
        number, size = TaskContext.get().partitionId() << 33, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            parts = [p for _, found in waiting for p in found]
            logs = gru.score(weights, vocabulary.shape, [p[0] for p in parts]) / LOG10
            at = 0
            for batch, found in waiting:
                n = batch.num_rows
                ids = np.arange(number, number + n)
                number += n
                _, known, sizes, sums, rooms, rare, times = ([p[k] for p in found] for k in range(7))
                yield pa.record_batch(
                    [
                        pa.array(ids),
                        *(batch.column(k) for k in (0, 2)),
                        pa.array(sizes, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(np.array(sums) - np.array(sizes) * base_room),
                        # The tail words' own counts are in the sums; what the model adds is the symbols.
                        pa.array(logs[at : at + n] + np.array(rooms)),
                        pa.array(rare, pa.list_(pa.int64())),
                        pa.array(times, pa.list_(pa.int32())),
                    ],
                    names=["id", "key", "held_out", "n_tokens", "n_known", "base", "model", "rare", "times"],
                )
                at += n
            waiting.clear()

        for batch in slices(batches, SLICE_BYTES, "text"):
            tokens, bounds = token_ids(*text_bytes(batch.column(1)))
            symbols, c = vocabulary.symbols_of(tokens), vocabulary.counts_of(tokens)
            logc = np.log10(np.maximum(c, 0) + ADDED)
            tail = symbols - len(vocabulary.symbols)
            own = np.where(tail >= 0, -tail_room[np.maximum(tail, 0)] + np.where(c >= 0, logc, 0), 0)
            found = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                here = c[a:b] >= 0
                rare, times = np.unique(tokens[a:b][~here], return_counts=True)
                found.append((symbols[a:b], int((c[a:b] > 0).sum()), b - a, float(logc[a:b][here].sum()), float(own[a:b].sum()), rare.view(np.int64), times.astype(np.int32)))
            waiting.append((batch, found))
            size += len(tokens)
            if size >= SCORE_TOKENS:
                yield from flush()
                size = 0
        if waiting:
            yield from flush()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"id long, key {kind}, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<long>, times array<int>"
    scored = materialize(rows.mapInArrow(score, schema))
    pairs = scored.select("id", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("id", F.col("p.rare").alias("token"), F.col("p.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    joined = pairs.join(counts, "token", "left").groupBy("id").agg(
        F.sum(F.log10(c + ADDED) * F.col("times")).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare", "times").join(joined, "id", "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
