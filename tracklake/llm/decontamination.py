"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are runs of so many words; a document is contaminated where it holds one. A window's
set is its shingles, and only documents that hold all of them in place can hold the window, so one shingle
of each window is prefix enough. Shingles are ordered by how often documents hold them, rarest first; as
neighbouring windows mostly agree on the rarest, a shared passage meets few prefixes. A document's shingles
are joined with the prefixes alone; a window's length and the shingle's place in it bound where it may lie
in the document, and the words there are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracklake.llm.columns import ascii_lower
from tracklake.session import materialize

#: Fixed value: what lies between words, in lower-case text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
SHINGLE = 4
#: Windows of one broadcast, in bytes of their words.
BROADCAST_BYTES = 16 << 20


def words_of(text: str) -> Column:
    """The words of a text in order. Splitting takes linear time; extracting all matches does not."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def item_windows(items: DataFrame, size: int, item: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Stored tables of distinct windows (window, words, length) and of their items (window, item)."""
    words = items.select(F.col(item).cast("string").alias("item"), words_of(text).alias("_words")).filter(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - size, F.lit(0)) + 1)
    spread = words.select("item", "_words", F.explode(starts).alias("_start"))
    spread = materialize(spread.select("item", F.slice("_words", F.col("_start"), F.lit(size)).alias("words")))
    windows = spread.select("words").distinct().withColumn("length", F.size("words"))
    windows = materialize(windows.withColumn("window", F.monotonically_increasing_id()))
    members = spread.filter("item is not null").join(windows, "words").select("window", "item").distinct()
    return windows, materialize(members)


def _shingle(words: str, place: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), place + k) for k in range(size)])


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """The shingles of each window: gram, window, words, length, place, size; shorter windows are one shingle."""
    sized = windows.withColumn("size", F.least("length", F.lit(shingle)))
    parts = [
        sized.filter(F.col("size") == k)
        .withColumn("place", F.explode(F.sequence(F.lit(0), F.col("length") - k)))
        .withColumn("gram", _shingle("words", F.col("place"), k))
        for k in range(1, shingle + 1)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def document_shingles(docs: DataFrame, text: str, size: int) -> DataFrame:
    """A row per shingle of a document: its columns, _n (number of words), _words, _at, gram.

    The words are held once for each document: what follows in the same stage reads them by place.
    """
    own = docs.withColumn("_words", words_of(text)).withColumn("_n", F.size("_words"))
    # The outer form, since the plain one has texts split once more, for a filter on empty ones.
    places = own.select("*", F.posexplode_outer("_words").alias("_at", "_word")).drop("_word", text)
    return places.filter(F.col("_at") + size <= F.col("_n")).withColumn("gram", _shingle("_words", F.col("_at"), size))


def scans(shingles: DataFrame, broadcast_bytes: int) -> list[tuple[int, Column]]:
    """Sizes of shingles and conditions on ``gram`` that cut a table of them into blocks to broadcast."""
    width = F.aggregate("words", F.lit(64), lambda a, w: a + 16 + F.octet_length(w))
    sums = shingles.groupBy("size").agg(F.sum(width.cast("long")).alias("bytes")).orderBy("size").collect()
    cuts = [(r["size"], max(1, -(-r["bytes"] // broadcast_bytes))) for r in sums]
    return [(size, (F.col("size") == size) & (F.pmod("gram", F.lit(n)) == k)) for size, n in cuts for k in range(n)]


def prefixes(docs: DataFrame, shingles: DataFrame, text: str, parts: list[tuple[int, Column]]) -> DataFrame:
    """Each window's rarest shingle: window, gram, place, size, length, words.

    Shingles are counted over all documents. A window with one that no document holds can't occur.
    """
    grams = materialize(shingles.select("gram", "size").distinct())
    counts = None
    for size, part in parts:
        found = document_shingles(docs.select(text), text, size).join(F.broadcast(grams.filter(part).select("gram")), "gram")
        found = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.lit(size))
        counts = found if counts is None else counts.union(found)
    held = shingles.join(materialize(counts), ["gram", "size"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = held.groupBy("window").agg(F.min(F.struct("n", "gram", "place", "size", "length", "words")).alias("first"))
    return first.filter("first.n > 0").select("window", "first.*").drop("n")


def occurrences(docs: DataFrame, prefix: DataFrame, text: str, size: int) -> DataFrame:
    """Where windows occur: the columns of ``docs`` but the text, start, stop (in words), window."""
    start = F.col("_at") - F.col("place")
    met = document_shingles(docs, text, size).join(F.broadcast(prefix.select("gram", "window", "place", "length", "words")), "gram")
    within = met.filter((start >= 0) & (start + F.col("length") <= F.col("_n")))
    same = within.filter(F.slice("_words", start + 1, F.col("length")) == F.col("words"))
    own = [c for c in docs.columns if c != text]
    return same.select(*own, start.alias("start"), (start + F.col("length")).alias("stop"), "window")


def row_name(key: str, text: str) -> Column:
    """Names a row by its key and text."""
    parts = [F.col(key).isNull().cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = SIZE,
    shingle: int = SHINGLE,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per document: ``key``, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words that lie inside an occurrence of any item's window of ``size`` words (of all of
    its words, if it has fewer), n_items the items with an occurring window; items_sha256 digests their ids,
    sorted as texts and joined by commas. Windows are compared word by word after the prefix join, so the
    result is exact. A null or empty text has no words, and an item without words no window. Items with a
    null id hit words but are neither counted nor listed; several rows of one id are one item. Null keys are
    kept, equal rows each keep their row, and rows of one key with different texts are judged apart. Empty
    tables give no rows or no hits. Other columns are ignored, whatever their names. Texts are read whole; a
    document's hits are merged in one task, as its text, being one value, was in one.

    Windows are broadcast in blocks of about ``broadcast_bytes``; each block is a scan of the documents.
    """
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    windows, members = item_windows(items, size, item, item_text)
    shingles = materialize(window_shingles(windows, shingle))
    parts = scans(shingles, broadcast_bytes)
    named = docs.withColumn("_row", row_name("_key", "_text"))
    result = named.select("_key", "_row", F.size(words_of("_text")).cast("long").alias("n_words"))
    if parts:
        prefix = materialize(prefixes(docs, shingles, "_text", parts))
        met = None
        for length, part in parts:
            # The row's name is taken of what was found only, from its text then held beside its words.
            found = occurrences(named.select("_row", "_text"), prefix.filter(part), "_text", length)
            met = found if met is None else met.union(found)
        met = materialize(met)
        before = Window.partitionBy("_row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
        spans = met.select("_row", "start", "stop").distinct().withColumn("_reached", F.coalesce(F.max("stop").over(before), F.lit(0)))
        fresh = F.greatest(F.col("stop") - F.greatest("start", "_reached"), F.lit(0))
        hits = spans.groupBy("_row").agg(F.sum(fresh.cast("long")).alias("n_hit"))
        listed = met.select("_row", "window").distinct().join(members, "window").select("_row", "item").distinct()
        listed = listed.groupBy("_row").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item")).alias("_items"))
        result = result.join(hits, "_row", "left").join(listed, "_row", "left")
    else:
        result = result.withColumns({"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "_items": F.array().cast("array<string>")})
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    digest = F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")).cast("binary"), 256)
    return result.select(
        F.col("_key").alias(key),
        "n_words",
        number("n_hit").alias("n_hit"),
        number("n_items").alias("n_items"),
        digest.alias("items_sha256"),
        (number("n_hit") > 0).alias("contaminated"),
    )


def oracle(size: int = SIZE) -> str:
    """The query's result in SQL: every window of every document, joined with the items' by its words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{BETWEEN}'), lambda x: x <> '')"
    return f"""WITH items AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
    windows AS (SELECT DISTINCT item, list_slice(w, s::BIGINT, s::BIGINT + {size - 1}) AS win
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {size}, 0) + 2)) AS s FROM items WHERE len(w) > 0)),
    docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
    places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs JOIN lengths ON len(w) >= n),
    found AS (SELECT r, s, n, item FROM places JOIN windows ON list_slice(w, s::BIGINT, (s + n - 1)::BIGINT) = win),
    hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM found) GROUP BY r),
    listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)"""
