"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Documents with equal sets are one node. Which pairs of rows of the incidence are multiplied follows from
sizes: of a set of n grams, a linked set holds at least need(n), so in any common order of the grams two
linked sets share one among the first n - need(n) + 1. The order puts grams that many documents share
last, the most frequent of all behind the others. Nodes that share such a gram are multiplied: the columns are dealt in blocks of the gram's value,
overlaps are added up over the blocks, and a pair goes as soon as what is left cannot reach the bound.

Groups are not expanded into pairs. First each node is multiplied with up to three others, those with
which it shares most leading grams among the grams' first, last and drawn nodes, and linked nodes are
joined to clusters. While grams still lead in so many clusters that their pairs would outgrow the rows,
nodes outside a gram's largest cluster are tried again, with that cluster's best linked member and with a
fresh draw from it. Then only pairs across clusters are listed, and of those every one that the places of
their first common gram and the sets' parities still allow: each gram flips one of 256 bits, so sets that
differ in as many bits differ in at least as many grams. Overlaps within the leading grams are counted
first, and only pairs that may still reach the bound are multiplied in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.columns import give_back, slices, text_bytes
from tracklake.llm.components import components
from tracklake.llm.shingles import mix, shingle_sets, signature
from tracklake.operators.keys import broadcast_if_small, key_set
from tracklake.session import materialize

SLICE_BYTES = 1 << 19
#: A gram counts as common from this many documents on, counted from where a stretch of a task's grams
#: holds it twice; of more than the second number the most frequent. Both move the order of the grams,
#: never the result.
COMMON_FROM, COMMON_MOST = 16, 1_000_000
#: So does a gram that still leads in more documents than this.
LEADING_MOST = 8
COMPACT_ROWS = 1_000_000
BLOCKS = 4
#: 64-bit words of a set's parities. From about 800 grams on, sets may differ in more grams than there are bits.
PARITY_WORDS = 4
BITMAP_BITS = 24
#: Bits of a map of grams that lead in several documents: as many for each gram at least, but 16 MB for each task
#: at most, however many grams there are. Places that grams share move work, never results.
MARK_SPARE, MARK_LEAST, MARK_BITS = 5, 16, 27
#: Tries go on while pairs across clusters are more than so many times the rows of leading grams, and while
#: a round links at least this share of the nodes it tries. Both move work, never results.
CROSS_MOST, PROGRESS = 2, 0.05
#: A turn that leaves more than this share of the rows across clusters is the last; that too only moves work.
CROSS_FALL = 0.9
#: From more pairs than so many for each node on, they are multiplied by turns; that too only moves work.
PAIRS_MOST = 4


def text_name(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("name")


def need(n: int, percent: int) -> int:
    """The least overlap of a set of n grams with a linked one."""
    return -(-percent * n // 100)


def _longs(grams: np.ndarray) -> np.ndarray:
    return grams.view(np.int64)


def common_grams(docs: DataFrame, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams, ascending, and their levels: counted per task, over distinct sets, and summed.

    At most ``COMMON_MOST``, so what each task gets of them is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        waiting: list[np.ndarray] = []
        grams, counts, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

        def compact() -> None:
            nonlocal grams, counts, rows
            fresh, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
            at = np.minimum(np.searchsorted(grams, fresh), max(0, len(grams) - 1))
            old = grams[at] == fresh if len(grams) else np.zeros(len(fresh), bool)
            counts[at[old]] += times[old]
            new = ~old & (times >= 2)
            grams, counts = np.concatenate([grams, fresh[new]]), np.concatenate([counts, times[new]])
            order = np.argsort(grams)
            grams, counts = grams[order], counts[order]
            waiting.clear()
            rows = 0

        for batch in slices(batches, SLICE_BYTES, text):
            for grams_of in shingle_sets(*text_bytes(batch.column(0)), size):
                name = signature(grams_of)
                if len(grams_of) and name not in seen:
                    seen.add(name)
                    waiting.append(grams_of)
                    rows += len(grams_of)
            if rows > COMPACT_ROWS:
                compact()
        compact()
        yield pa.record_batch([pa.array(_longs(grams)), pa.array(counts)], names=["gram", "n"])

    counted = materialize(
        docs.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_FROM)
    )
    return _most_frequent(counted)


def _most_frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a stored table (gram, n), ascending, and their levels; the most frequent if they are too many.

    A level is a quarter power of two of how often a gram was counted.
    """
    # From the largest level on, as long as their grams are not too many together.
    level = F.floor(F.log2("n") * 4).cast("int")
    total, least = 0, None
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > COMMON_MOST:
            break
        least = r["level"]
    common = counted.filter(level >= least if least is not None else F.lit(False))
    found = common.select("gram", level.cast("tinyint").alias("level")).toArrow()
    grams = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(grams)  # as unsigned numbers, the order of every set
    return grams[order], found.column(1).to_numpy()[order]


def leading_grams(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Prefixes in an order that puts last what tasks see often, and what then still leads in many sets.

    Of these the rarest come first, so that a set that has no other grams leads with those few sets share.
    Before those, and behind all others, come grams that lead in two documents or more, so that a set with
    enough grams of its own has only those in its prefix and meets no other. They are told to tasks by a map of
    bits; others may share a bit, which moves them in the order for all documents alike.
    """
    common = common_grams(docs, text, size)
    first = prefixes(docs, key, text, size, percent, common).select(F.explode("prefix").alias("gram"))
    shared = materialize(first.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    often = _most_frequent(shared.filter(F.col("n") > LEADING_MOST))
    late = np.union1d(common[0], often[0])
    levels = np.zeros(len(late), np.int8)
    for grams, level in (common, often):
        at = np.searchsorted(late, grams)
        levels[at] = np.maximum(levels[at], level)
    return prefixes(docs, key, text, size, percent, (late, levels), _marks(shared))


def _marks(grams: DataFrame) -> np.ndarray:
    """A map of bits of the grams of a stored table, by their first bits."""
    bits = min(MARK_BITS, max(MARK_LEAST, grams.count().bit_length() + MARK_SPARE))
    return _bits(grams, F.shiftrightunsigned("gram", 64 - bits), bits)


def _marked(grams: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which grams have their bit in a map."""
    at = (grams >> np.uint64(62 - len(marks).bit_length())).view(np.int64)
    return (marks[at >> 3] >> (at & 7) & 1).astype(bool)


def shared_leading(found: DataFrame) -> DataFrame:
    """Of prefixes the grams that lead in another document too, with their places; others meet nothing.

    ``found`` is a stored table of ``prefixes``; instead of prefix there are prefix and places. Grams that lead in
    two documents are told to tasks by a map of bits, so some others stay.
    """
    grams = found.select(F.explode("prefix").alias("gram"))
    marks = _marks(materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")))
    columns = [c for c in found.columns if c != "prefix"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(len(columns))
            grams = prefix.flatten().to_numpy().view(np.uint64)
            sizes = pc.list_value_length(prefix).to_numpy()
            places = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            stays = _marked(grams, marks)
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[stays], minlength=len(sizes)))])
            made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v[stays], t)) for v, t in ((_longs(grams), pa.int64()), (places, pa.int32()))]
            yield pa.record_batch(batch.columns[:-1] + made, names=[*columns, "prefix", "places"])
        give_back()

    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in columns)
    return found.select(*columns, "prefix").mapInArrow(scan, f"{kinds}, prefix array<long>, places array<int>")


def parities(grams: np.ndarray) -> np.ndarray:
    """How often, modulo 2, a set's grams fall on each of the bits."""
    at = mix(grams) % np.uint64(64 * PARITY_WORDS)
    odd = np.bincount(at.astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def alike(a: str, b: str, na: str, nb: str, percent: int) -> Column:
    """Whether sets with these parities and sizes may link: linked ones differ in few grams, so in few bits."""
    differ = sum(F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(PARITY_WORDS))
    return differ * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)


def prefixes(
    docs: DataFrame, key: str, text: str, size: int, percent: int, common: tuple[np.ndarray, np.ndarray], marked: np.ndarray | None = None
) -> DataFrame:
    """Per document: ``key``, name, n (size of its set), s1 and s2 (the set's name), prefix (its leading grams), parity.

    Grams come by their values, those in ``common`` after all others by their levels, and before them those whose
    bit is set in ``marked``, a map by the grams' first bits.
    """
    often, levels = common

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES, text):
            sets = shingle_sets(*text_bytes(batch.column(1)), size)
            names = [signature(s) for s in sets]
            leading = []
            for grams in sets:
                at = np.minimum(np.searchsorted(often, grams), max(0, len(often) - 1))
                known = often[at] == grams if len(often) else np.zeros(len(grams), bool)
                parts = [grams[~known], grams[known][np.argsort(levels[at[known]], kind="stable")]]
                if marked is not None:
                    late = _marked(parts[0], marked)
                    parts[:1] = parts[0][~late], parts[0][late]
                ordered = np.concatenate(parts)
                leading.append(_longs(ordered[: len(grams) - need(len(grams), percent) + 1]))
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array([n[k] for n in names], pa.int64()) for k in (0, 1)),
                    pa.array(leading, pa.list_(pa.int64())),
                    pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
                ],
                names=[key, "name", "n", "s1", "s2", "prefix", "parity"],
            )

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(key, text, text_name(text))
    return named.mapInArrow(scan, f"`{key}` {kind}, name string, n long, s1 long, s2 long, prefix array<long>, parity array<long>")


def _bits(rows: DataFrame, place: Column, bits: int) -> np.ndarray:
    """A map of fixed size with a bit for each place of the rows, a number below two to the ``bits``."""
    # The functions count values from 1 on.
    at = rows.select((place + 1).alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket"))
    found = at.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits")).collect()
    whole = np.zeros(1 << bits >> 3, np.uint8)
    for r in found:
        start = (r["bucket"] - 1) * 4096
        whole[start : start + 4096] = np.frombuffer(r["bits"], np.uint8)
    return whole


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """The incidence of some nodes (node, id, s1, s2) in blocks: node, block, grams.

    A map of bits keeps most other documents' sets from being made; a join by id and set removes the rest.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP_BITS))
    bits = _bits(nodes, place, BITMAP_BITS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES, "text"):
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            if not batch.num_rows:
                continue
            rows, blocks, grams, names = [], [], [], []
            for row, own in enumerate(shingle_sets(*text_bytes(batch.column(1)), size)):
                cuts = np.searchsorted(own, np.arange(1, BLOCKS, dtype=np.uint64) << np.uint64(62))
                rows += [row] * BLOCKS
                blocks += range(BLOCKS)
                names += [signature(own)] * BLOCKS
                grams += [_longs(part) for part in np.split(own, cuts)]
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(rows)),
                    *(pa.array([n[k] for n in names], pa.int64()) for k in (0, 1)),
                    pa.array(blocks, pa.int32()),
                    pa.array(grams, pa.list_(pa.int64())),
                ],
                names=["id", "s1", "s2", "block", "grams"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.filter("id is not null").select("id", "text", place.alias("_at"))
    made = rows.mapInArrow(scan, f"id {kind}, s1 long, s2 long, block int, grams array<long>")
    return made.join(nodes, ["id", "s1", "s2"]).select("node", "block", "grams")


def linked(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    return overlap * 100 >= (a + b - overlap) * percent


def multiply(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, na, nb) those that link: a, b.

    The first block's overlaps decide whether the rest may still reach the bound; then the others follow.
    """
    sets = materialize(sets)
    left = sets.select(F.col("node").alias("a"), "block", F.col("grams").alias("_a"))
    right = sets.select(F.col("node").alias("b"), "block", F.col("grams").alias("_b"))

    def overlaps(frame: DataFrame, blocks: str) -> DataFrame:
        both = frame.join(left.filter(blocks).drop("block" if blocks == "block = 0" else "_"), "a")
        other = right.filter(blocks).drop("block" if blocks == "block = 0" else "_")
        return both.join(other, "b" if blocks == "block = 0" else ["b", "block"])

    own = F.size(F.array_intersect("_a", "_b")).cast("long")
    rest = F.least(F.col("na") - F.size("_a"), F.col("nb") - F.size("_b"))
    first = overlaps(pairs, "block = 0").withColumn("o", own)
    hopeful = materialize(first.filter(linked(F.col("o") + rest, F.col("na"), F.col("nb"), percent)).select("a", "b", "na", "nb", "o"))
    # A largest value per block, since equal rows have a set each.
    others = overlaps(hopeful, "block > 0").groupBy("a", "b", "na", "nb", "o")
    others = others.agg(sum(F.max(F.when(F.col("block") == k, own)) for k in range(1, BLOCKS)).alias("more"))
    return others.filter(linked(F.col("o") + F.col("more"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes may link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


class Tries:
    """Pairs of nodes multiplied so far, and the links among them."""

    def __init__(self, docs: DataFrame, classes: DataFrame, kept: DataFrame, size: int, percent: int):
        self.docs, self.classes, self.kept, self.size, self.percent = docs, classes, kept, size, percent
        self.tried: DataFrame | None = None
        self.links: DataFrame | None = None
        self._clusters: DataFrame | None = None

    def clusters(self) -> DataFrame:
        """(node, component) of the links so far, computed once for them."""
        if self._clusters is None:
            self._clusters = materialize(components(self.links, "a", "b"))
        return self._clusters

    def hopeful(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), a below b, the new ones that may reach the bound: a, b, na, nb.

        All that two sets share up to the end of the prefix that ends first lies in both prefixes; behind it
        they share no more than is left of that set.
        """
        if self.tried is not None:
            pairs = pairs.join(self.tried.select("a", "b"), ["a", "b"], "left_anti")
        for end in ("a", "b"):
            pairs = pairs.join(self.kept.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("parity").alias(f"_{end}")), end)
        # Sizes and parities first, so that few prefixes are met.
        near = may_link("na", "nb", self.percent) & alike("_a", "_b", "na", "nb", self.percent)
        pairs = materialize(pairs.filter(near).select("a", "b", "na", "nb"))
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        leading = materialize(self.kept.select("node", "prefix").join(key_set(ends), "node", "left_semi"))
        for end in ("a", "b"):
            pairs = pairs.join(leading.select(F.col("node").alias(end), F.col("prefix").alias(f"_{end}")), end)
        most = F.size(F.array_intersect("_a", "_b")) + F.expr(f"(greatest(na, nb) * {self.percent} + 99) div 100") - 1
        return materialize(pairs.filter(linked(most, F.col("na"), F.col("nb"), self.percent)).select("a", "b", "na", "nb"))

    def run(self, pairs: DataFrame) -> tuple[int, int]:
        """Multiplies those that may link; the number of pairs tried and of new links.

        While nodes have many pairs, one of each is drawn and multiplied first: what it joins to one cluster
        needs no other pair.
        """
        pairs, tried, new = self.hopeful(pairs), 0, 0
        while True:
            whole = pairs.count()
            if not whole and self.links is not None:
                return tried, new
            both = pairs.select(F.col("a").alias("node"), "*").union(pairs.select("b", "*"))
            drawn = both.groupBy("node").agg(F.min_by(F.struct("a", "b", "na", "nb"), F.xxhash64("a", "b")).alias("pair"))
            drawn = materialize(drawn)
            ends = broadcast_if_small(drawn.select("node"))
            if whole <= PAIRS_MOST * drawn.count():
                break
            times, found = self._run(materialize(drawn.select("pair.*").distinct()), ends)
            tried, new = tried + times, new + found
            pairs = materialize(self._apart(pairs.join(self.tried.select("a", "b"), ["a", "b"], "left_anti")))
            if found <= PROGRESS * times:
                break
        times, found = self._run(pairs, ends)
        return tried + times, new + found

    def _apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends the links so far don't join."""
        for end in ("a", "b"):
            pairs = pairs.join(self.clusters().select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
        apart = F.coalesce("_a", "a") != F.coalesce("_b", "b")
        return pairs.filter(apart).select("a", "b", "na", "nb")

    def _run(self, pairs: DataFrame, ends: DataFrame) -> tuple[int, int]:
        """Multiplies pairs whose ends are the nodes ``ends``."""
        nodes = materialize(self.classes.select("node", "id", "s1", "s2").join(ends, "node", "left_semi"))
        found = materialize(multiply(pairs, sets_of(self.docs, nodes, self.size), self.percent))
        times, new = pairs.count(), found.count()
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        if self.links is None or new:
            self.links = found if self.links is None else self.links.union(found)
            self._clusters = None
        return times, new


def _best(rows: DataFrame, *ways: str) -> DataFrame:
    """For each node and way the pair with the leader it shares most leading grams with; ``ways`` name leaders."""
    stars = rows.select("node", F.inline(F.array(*[F.struct(F.lit(k).alias("way"), F.col(w).alias("leader")) for k, w in enumerate(ways)])))
    common = stars.filter("node <> leader").groupBy("node", "way", "leader").agg(F.count(F.lit(1)).alias("common"))
    best = common.groupBy("node", "way").agg(F.max(F.struct("common", "leader")).alias("best"))
    return best.select(F.least("node", "best.leader").alias("a"), F.greatest("node", "best.leader").alias("b")).distinct()


def _placed(rows: DataFrame, tries: Tries) -> tuple[DataFrame, int]:
    """Rows of grams of several clusters, and a bound on the rows of pairs across.

    They bear their cluster, the gram's largest, main, and whether the gram's pairs across outgrow its rows, wide.
    """
    placed = rows.join(tries.clusters(), "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    placed = materialize(placed.select("gram", "node", "n", "place", "cluster"))
    counts = placed.groupBy("gram", "cluster").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("gram").agg(F.max(F.struct("c", "cluster")).alias("most"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("clusters"))
    main = materialize(main.filter("clusters > 1").select("gram", F.col("most.cluster").alias("main"), ((F.col("c") - F.col("most.c")) * F.col("c")).alias("cross"), (F.col("c") - F.col("most.c") > CROSS_MOST).alias("wide")))
    mixed = materialize(placed.join(main.drop("cross"), "gram"))
    return mixed, main.agg(F.sum("cross")).first()[0] or 0


def _again(mixed: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """Fresh tries for nodes outside the largest cluster of a gram, each with two members of it."""
    mixed = mixed.filter("wide")
    degrees = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    inside = mixed.filter("cluster = main").join(degrees, "node", "left").groupBy("gram").agg(
        F.max_by("node", F.coalesce("degree", F.lit(0))).alias("hub"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("drawn")
    )
    return _best(mixed.filter("cluster <> main").select("gram", "node").join(inside, "gram"), "hub", "drawn")


def grouped(docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """Per document: id, name (of its text), n (size of its set), component_id, group (of linked sets).

    A set is one node, whatever ids its documents bear; documents without words or id have no group.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    found = materialize(leading_grams(docs, "id", "text", size, percent))
    usable = found.filter("n > 0 and id is not null")
    leading = shared_leading(usable.select("id", "n", "s1", "s2", "prefix", "parity"))
    # Equal sets have equal prefixes, so those move once, and only what of them another set may have.
    same = [F.first(c).alias(c) for c in ("prefix", "places", "parity")]
    classes = materialize(leading.groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), *same).withColumn("node", F.monotonically_increasing_id()))
    kept = classes.select("node", F.col("n").cast("int").alias("n"), "prefix", "places", "parity")

    rows = kept.select("node", "n", F.inline(F.arrays_zip("prefix", "places")).alias("gram", "place"))
    # Three nodes of a gram to try others with: its first, its last, and one that a hash gives.
    mixed = F.xxhash64("node")
    shared = rows.groupBy("gram").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.min_by("node", mixed).alias("drawn"))
    rows = materialize(rows.join(shared.filter("first <> last"), "gram"))

    tries = Tries(docs, classes, kept, size, percent)
    tries.run(_best(rows, "first", "last", "drawn"))
    rows = rows.select("gram", "node", "n", "place")
    mixed, cross = _placed(rows, tries)
    whole, turn, more = rows.count(), 1, True
    while more and cross > CROSS_MOST * whole:
        tried, new = tries.run(_again(mixed, tries.links, turn))
        more, turn, before = new > PROGRESS * tried, turn + 1, cross
        if new:
            # A gram of one cluster stays so.
            mixed, cross = _placed(mixed.select(*rows.columns), tries)
        # Where a gram leads in many texts that don't link, further turns join no clusters of it.
        more = more and cross < CROSS_FALL * before

    # Linked sets share a gram first of all whose places leave room for the overlap they need. Of each pair
    # of clusters of a gram one at least is not the largest.
    mixed = mixed.join(kept.select("node", "parity"), "node")
    columns = ("node", "n", "place", "cluster", "parity")
    side = lambda frame, x: frame.select("gram", "main", *[F.col(c).alias(f"{c}_{x}") for c in columns])
    left = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    room = left * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent
    apart = (F.col("cluster_x") != F.col("cluster_y")) & ((F.col("cluster_y") == F.col("main")) | (F.col("node_x") < F.col("node_y")))
    across = side(mixed.filter("cluster <> main"), "x").join(side(mixed, "y").drop("main"), "gram")
    across = across.filter(apart & room & may_link("n_x", "n_y", percent) & alike("parity_x", "parity_y", "n_x", "n_y", percent))
    tries.run(across.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct())

    whole = tries.clusters()
    named = materialize(classes.select("node", "n", "s1", "s2", "id").join(whole, "node", "left").withColumn("group", F.coalesce("component", "node")))
    lowest = named.groupBy("group").agg(F.min("id").alias("component_id"))
    of_class = named.join(lowest, "group").select("n", "s1", "s2", "group", "component_id")
    narrow = found.select("id", "name", "n", "s1", "s2")
    placed = narrow.filter("n > 0 and id is not null").join(of_class, ["n", "s1", "s2"]).select("id", "name", "n", "component_id", "group")
    alone = narrow.filter("n = 0 or id is null").select("id", "name", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    return placed.union(alone)


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: ``key``, n_shingles, component_id (the smallest key reachable by links).

    Two documents link when their sets of shingles of ``size`` words have a Jaccard similarity of at least
    ``percent`` / 100; every link counts. A set holds the whole sequence if the words are fewer. A document
    without words, or null, has an empty set and links with nothing, and one with a null key has a null
    component. Equal rows are one node and each keep their row; different texts of one key are judged apart.
    An empty table gives an empty result; other columns are ignored, whatever their names. Texts are read
    whole. Shingles are told apart by 64-bit numbers and sets by 128-bit ones, so results hold up to their
    collisions.
    """
    found = grouped(docs, size, percent, key, text)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def first_of_groups(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies, that of the smallest key; all columns.

    Rows of one key and text are one; different texts of one key stay unless they link. Documents without
    words stay, and so do those with a null key.
    """
    found = grouped(docs, size, percent, key, text)
    first = found.filter("group is not null").groupBy("group").agg(F.min(F.struct("id", "name")).alias("_first")).select("_first.*")
    first = first.union(found.filter("group is null and id is not null").select("id", "name").distinct())
    first = first.select(F.col("id").alias("_first_id"), F.col("name").alias("_first_name"))
    named = docs.withColumns({"_own_id": F.col(key), "_own_name": text_name(text)})
    kept = named.join(first, (F.col("_own_id") == F.col("_first_id")) & (F.col("_own_name") == F.col("_first_name")), "left_semi")
    kept = kept.dropDuplicates(["_own_id", "_own_name"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.union(docs.filter(F.col(key).isNull()))
