"""Audit of how far sources diverge, by sparse merges of pairs of groups.

Words are counted once per language and source; a language keeps the terms that enough of its documents
hold, numbers them within blocks of bounded size, and every group becomes, in each block, a sorted array of
term numbers and counts. For each unordered pair of groups, two such arrays are merged: the shorter one is
searched for in the longer by galloping, which prices terms of both, and terms of one side alone are priced
against the other's price of an absent term, both ways at once. Terms that neither holds have one price a
pair, so they are added at the end by their number.

Arrays travel in tiles of a few sources, so a group meets the other sources of its language in a task for
each tile, not in one for each source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracklake.llm.columns import ascii_lower
from tracklake.session import materialize

#: What lies between terms, and what prices are scaled to.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP = 200
BLOCK_TERMS = 1 << 15
TILE_SOURCES = 4


def counted_terms(docs: DataFrame, text: str) -> DataFrame:
    """Stored rows lang, source, term, n (occurrences), documents (that hold it), from one scan.

    A document's terms are sorted, so that a term's first occurrence in it stands behind another term.
    """
    terms = F.sort_array(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""))
    places = docs.select("lang", "source", terms.alias("_terms")).select("lang", "source", "_terms", F.posexplode_outer("_terms").alias("_at", "term"))
    first = (F.col("_at") == 0) | (F.get("_terms", F.col("_at") - 1) != F.col("term"))
    rows = places.filter("term is not null").select("lang", "source", "term", first.cast("long").alias("first"))
    return materialize(rows.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("documents")))


def kept_terms(counted: DataFrame, least: int, block_terms: int) -> DataFrame:
    """Stored rows lang, term, n_lang, block, id: ids ascend within blocks of a language's terms."""
    kept = counted.groupBy("lang", "term").agg(F.sum("documents").alias("_d"), F.sum("n").alias("n_lang"))
    kept = materialize(kept.filter(F.col("_d") >= least).drop("_d"))
    blocks = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block_terms).alias("_blocks"))
    dealt = kept.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("_blocks")).cast("int")).drop("_blocks")
    # Dealt by both columns, as the join would leave a whole language in one task.
    dealt = dealt.repartition("lang", "block")
    return materialize(dealt.withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term"))))


def price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(scale * (count + 1) / (total + terms)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + terms)) + 1


def prices(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same for an array of counts; the division goes by thousands, so no product leaves 64 bits."""
    divisor = total + terms
    whole, rest = np.divmod(counts + 1, divisor)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, divisor)
        whole = whole * 1000 + digits
    return whole + 1


def divergences(p: np.ndarray, q: np.ndarray) -> int:
    """The sum of floor((p - q)^2 / q)."""
    return int(((p - q) ** 2 // q).sum())


def gallop(ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common numbers of two ascending arrays, in both.

    The shorter is searched for in the longer; as the numbers sought ascend, a search starts from the last.
    """
    if len(ids) > len(others):
        there, here = gallop(others, ids)
        return here, there
    at = np.searchsorted(others, ids)
    inside = at < len(others)
    found = np.zeros(len(ids), bool)
    found[inside] = others[at[inside]] == ids[inside]
    return np.flatnonzero(found), at[found]


def merge(a: tuple, b: tuple) -> tuple[int, int, int]:
    """Of two groups (ids, counts, total, terms): the number of terms that either holds, and the sums of
    their divergences, of the first group from the second and of the second from the first."""
    (ids, counts, total, terms), (other_ids, other_counts, other_total, _) = a, b
    here, there = gallop(ids, other_ids)
    p, q = prices(counts, total, terms), prices(other_counts, other_total, terms)
    absent = np.zeros(1, np.int64)
    none_p, none_q = prices(absent, total, terms), prices(absent, other_total, terms)
    alone, other_alone = np.delete(p, here), np.delete(q, there)
    forth = divergences(p[here], q[there]) + divergences(alone, none_q) + divergences(none_p, other_alone)
    back = divergences(q[there], p[here]) + divergences(none_q, alone) + divergences(other_alone, none_p)
    return len(p) + len(other_alone), forth, back


def pair_sums(entries: DataFrame, groups: DataFrame, tile_sources: int) -> DataFrame:
    """Per language and unordered pair of sources: lang, a, b, held (terms of either), forth, back.

    Every group has a row in every block of its language, an empty array where it holds none of the terms.
    """
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile_sources).cast("int").alias("tiles"))
    blocks = entries.groupBy("lang").agg(F.max("block").alias("last"))
    placed = groups.join(sizes, "lang").join(blocks, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    placed = placed.select("lang", "source", "total", "terms", "tile", "tiles", F.explode(F.sequence(F.lit(0), "last")).alias("block"))
    arrays = entries.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("entries"))
    arrays = materialize(placed.join(arrays, ["lang", "source", "block"], "left"))
    row = ["lang", "source", "block", "total", "terms", "entries"]
    left = arrays.select(*row, F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"))
    # New names of the same columns tell the two sides apart.
    right = arrays.select(*[F.col(c).alias(c) for c in row], F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"))

    def merge_tiles(one: pa.Table, other: pa.Table) -> pa.Table:
        out = []
        if one.num_rows and other.num_rows:
            lang, same = one.column("lang")[0].as_py(), one.column("i")[0].as_py() == one.column("j")[0].as_py()
            theirs = _groups_of(other)
            for a, own in _groups_of(one):
                for b, others in theirs:
                    if a < b:
                        out.append((lang, a, b, *merge(own, others)))
                    elif not same:
                        out.append((lang, b, a, *merge(others, own)))
        columns, kinds = list(zip(*out)) if out else [()] * 6, [pa.string()] * 3 + [pa.int64()] * 3
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("lang", "a", "b", "held", "forth", "back"), columns, kinds)})

    at = ["lang", "block", "i", "j"]
    merged = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(merge_tiles, "lang string, a string, b string, held long, forth long, back long")
    return merged.groupBy("lang", "a", "b").agg(F.sum("held").alias("held"), F.sum("forth").alias("forth"), F.sum("back").alias("back"))


def _groups_of(table: pa.Table) -> list[tuple]:
    rows = []
    for source, total, terms, entries in zip(*(table.column(c) for c in ("source", "total", "terms", "entries"))):
        held = entries.values
        ids, counts = [held.field(k).to_numpy().astype(np.int64) for k in (0, 1)] if held is not None else [np.zeros(0, np.int64)] * 2
        rows.append((source.as_py(), (ids, counts, total.as_py(), terms.as_py())))
    return rows


def audit(
    docs: DataFrame,
    least: int = LEAST_DOCUMENTS,
    top: int = TOP,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    block_terms: int = BLOCK_TERMS,
    tile_sources: int = TILE_SOURCES,
) -> DataFrame:
    """How far each (lang, source) group diverges: lang, source, part, item, value, rank.

    A language keeps its terms that at least ``least`` of its documents hold. A term has a price in each
    group and language, 1 + floor(10^9 (count + 1) / (all counts of kept terms + number of kept terms)), and
    the divergence of a price p from q is floor((p - q)^2 / q). Part ``pair`` has for each other source of
    the language the sum of its divergences over all kept terms; part ``term`` the ``top`` terms that the
    group holds and that are dearer there than in the whole language, by their divergence. Ranks run from 1
    by falling value, then by ascending item. All arithmetic is exact, for up to 9 * 10^15 kept words.

    Null texts, languages and sources are empty ones, and equal rows count each. A group without terms, or
    in a language without kept terms, has its pairs (of value 0 in the latter) but no terms; a language of
    one source has no pairs. An empty table gives an empty result; other columns are ignored. Texts are read
    whole. A task merges at most two tiles of about ``tile_sources`` arrays of about ``block_terms`` terms.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    counted = counted_terms(docs, "text")
    kept = kept_terms(counted, least, block_terms)
    entries = materialize(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "block", "id", "n", "n_lang"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("total_lang"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.select("lang", "source", zero("total"), zero("terms"), zero("total_lang")))

    # The result has a row for every ordered pair of sources of a language; here is one for each unordered one.
    one = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("ta"), "terms")
    other = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("tb"))
    pairs = one.join(other, "lang").filter("a < b").join(pair_sums(entries, groups, tile_sources), ["lang", "a", "b"], "left")
    absent = lambda p, q: F.expr(f"({p} - {q}) * ({p} - {q}) div {q}") * (F.col("terms") - F.col("held"))
    pairs = pairs.withColumns({p: F.when(F.col("terms") > 0, price(F.lit(0), F.col(t), F.col("terms"))) for p, t in (("pa", "ta"), ("pb", "tb"))})
    pairs = materialize(pairs.select("lang", "a", "b", (F.col("forth") + absent("pa", "pb")).alias("ab"), (F.col("back") + absent("pb", "pa")).alias("ba")))
    value = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias("value")
    of_pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value("ab")).union(
        pairs.select("lang", F.col("b"), F.lit("pair"), F.col("a"), value("ba"))
    )

    priced = entries.join(groups, ["lang", "source"])
    priced = priced.withColumns({"p": price(F.col("n"), F.col("total"), F.col("terms")), "q": price(F.col("n_lang"), F.col("total_lang"), F.col("terms"))})
    dearer = priced.filter("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q"))
    rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    of_terms = dearer.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    of_terms = of_terms.select("*", rank()).filter(F.col("rank") <= top)
    return of_pairs.select("*", rank()).union(of_terms)


def oracle(least: int = LEAST_DOCUMENTS, top: int = TOP) -> str:
    """The query's result in SQL, with every kept term of every pair."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{BETWEEN}')"
    cost = lambda c, n, v: f"1 + ({SCALE}::HUGEINT * ({c} + 1)) // ({n} + {v})"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {words} AS w FROM documents),
    places AS (SELECT r, lang, source, term FROM (SELECT r, lang, source, unnest(w) AS term FROM docs) WHERE term <> ''),
    kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM places GROUP BY lang, term HAVING count(DISTINCT r) >= {least}),
    langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM places SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0) AS total
        FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
    priced AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {cost('coalesce(c.n, 0)', 'g.total', 'l.v')} AS p, {cost('k.n', 'l.total', 'l.v')} AS q
        FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM priced WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
