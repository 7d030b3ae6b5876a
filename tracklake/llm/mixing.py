"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed to cells of source, language and topic. Sweeps rake the cells' weights to the target
share of each source, then language, then topic, over and over. A document's probability is its cell's
weight per token times the share of tokens to keep, at most one: a cell that would have to be repeated is
kept whole, all others are thinned to their proportion. That alone misses the targets where cells are cut
off at one; a number of copies holds what lies above, so that documents times copies meet them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.session import materialize

DIMENSIONS = ("source", "lang", "topic")
SWEEPS = 8
KEEP = 0.5
#: A share is taken to this power of the observed share where no target is stated.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
WORD = r"[^\x20\x09-\x0D]+"


def token_weight(text: str = "text") -> Column:
    """Words and one end, so that every document has a weight."""
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)) + 1).cast("long")


def topic_of(text: str = "text") -> Column:
    """A text's topic by its form, where a corpus has no topics of its own."""
    whole = F.coalesce(F.col(text), F.lit(""))
    length = F.length(whole)
    return F.when(whole.contains(" | "), "table").when(length < 500, "note").when(length < 5000, "article").otherwise("chapter")


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares in proportion to a power of the observed ones: ``dimension``, target."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("_n"))
    raised = sums.select(dimension, F.pow(F.col("_n").cast("double"), F.lit(power)).alias("_p"))
    whole = raised.agg(F.sum("_p").alias("_all"))
    return raised.join(F.broadcast(whole)).select(dimension, (F.col("_p") / F.col("_all")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """Adds ``weight``: the cells' tokens fitted to the target shares, which may not add up to one.

    Each step is one sum per value of a dimension, joined back; targets are joined once, before all sweeps. A
    sweep is a written table; cells number at most the product of the dimensions' values that occur, far fewer
    than documents. A value without a target keeps its weight.
    """
    total = F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 0))
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dimension, target in targets.items():
        now = now.join(target.select(dimension, F.col("target").alias(f"_t_{dimension}")), dimension, "left")
    now = materialize(now)
    for _ in range(sweeps):
        for dimension in targets:
            sums = now.groupBy(dimension).agg(F.sum("weight").alias("_sum"), F.first(f"_t_{dimension}").alias("_target"))
            factors = sums.select(dimension, (F.col("_target") * total / F.col("_sum")).alias("_factor"))
            now = now.join(factors, dimension, "left")
            now = now.withColumn("weight", F.col("weight") * F.coalesce("_factor", F.lit(1.0))).drop("_factor")
        now = materialize(now)
    return now.select(*cells.columns, "weight")


def draw(key: str, seed: int) -> Column:
    """A number from 0 to 1 that depends on key and seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def with_mixture(
    docs: DataFrame,
    tokens: Column | None = None,
    topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None,
    powers: dict[str, float] | None = None,
    sweeps: int = SWEEPS,
    keep: float = KEEP,
    seed: int = 0,
    key: str = "doc_id",
    source: str = "source",
    lang: str = "lang",
) -> DataFrame:
    """Adds ``_topic``, ``_tokens``, ``_weight``, ``_probability``, ``_kept`` and ``_copies`` to all documents.

    ``targets`` maps source, lang or topic to a table (value in a column of that name, target share); for
    the others the target is the observed share to a power. A null source or language is the value ''.
    ``_copies`` is how often to take a document, on average its weight times ``keep``; it is above 0 where
    ``_kept`` is true. A null or empty text weighs one token. Equal keys share one draw. An empty table gives an empty
    result. Other columns stay as they are; ones named like those added must not be there.
    """
    own = docs.withColumns({"_topic": topic if topic is not None else topic_of(), "_tokens": tokens if tokens is not None else token_weight()})
    values = {"source": F.coalesce(F.col(source).cast("string"), F.lit("")), "lang": F.coalesce(F.col(lang).cast("string"), F.lit("")), "topic": F.coalesce(F.col("_topic").cast("string"), F.lit(""))}
    placed = own.withColumns({f"_c_{d}": v for d, v in values.items()})
    sums = placed.groupBy(*[F.col(f"_c_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("_tokens").alias("tokens"))
    cells = materialize(sums)
    given = targets or {}
    wanted = {d: given[d] if d in given else materialize(tempered(cells, d, (powers or POWERS)[d])) for d in DIMENSIONS}
    raked = rake(cells, wanted, sweeps)
    weight = (F.col("weight") / F.col("tokens")).alias("_weight")
    rated = placed.join(raked.select(*[F.col(d).alias(f"_c_{d}") for d in DIMENSIONS], weight), [f"_c_{d}" for d in DIMENSIONS])
    rated = rated.withColumn("_probability", F.least(F.lit(1.0), F.col("_weight") * keep))
    drawn = draw(key, seed)
    times = F.col("_weight") * keep
    copies = F.floor(times) + (drawn < times - F.floor(times)).cast("long")
    return rated.select(
        *docs.columns, "_topic", "_tokens", "_weight", "_probability", (drawn < F.col("_probability")).alias("_kept"), copies.cast("long").alias("_copies")
    )


def oracle(sweeps: int = SWEEPS, keep: float = KEEP, seed: int = 0) -> str:
    """The query's result in SQL."""
    parts = [
        f"""docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
        CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN length(coalesce(text, '')) < 500 THEN 'note'
             WHEN length(coalesce(text, '')) < 5000 THEN 'article' ELSE 'chapter' END AS topic,
        len(regexp_extract_all(coalesce(text, ''), '{WORD}')) + 1 AS n_tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        raised = f"(SELECT {d}, pow(sum(tokens), {POWERS[d]}) AS p FROM cells GROUP BY {d})"
        parts.append(f"target_{d} AS MATERIALIZED (SELECT {d}, p / sum(p) OVER () AS target FROM {raised})")
    parts.append("w0 AS (SELECT *, tokens AS weight FROM cells)")
    step = 0
    for _ in range(sweeps):
        for d in DIMENSIONS:
            factor = f"weight * target * (SELECT sum(tokens) FROM cells) / sum(weight) OVER (PARTITION BY {d})"
            parts.append(
                f"w{step + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, {factor} AS weight FROM w{step} JOIN target_{d} USING ({d}))"
            )
            step += 1
    parts.append(f"rates AS (SELECT source, lang, topic, weight / tokens AS rate, least(1.0, weight / tokens * {keep}) AS p FROM w{step})")
    unit = f"('0x' || substr(md5('{seed}:' || doc_id), 1, 8))::BIGINT / 4294967296.0"
    return f"""WITH {', '.join(parts)}
    SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, round(rate, 6) AS weight, round(p, 6) AS probability, {unit} < p AS kept
    FROM docs JOIN rates USING (source, lang, topic)"""
