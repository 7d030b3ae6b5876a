import compare
import pytest
from pyspark.sql import functions as F

from tracklake.llm import mixing, queries


def test_query_against_sql(spark, sf_dir):
    got = compare.spark_rows(queries.QUERIES["op6_mixing"](spark, sf_dir))
    assert got == compare.duck_rows(compare.connect(sf_dir), queries.ORACLE["op6_mixing"])


def test_kept_tokens_have_the_target_shares(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    target = spark.createDataFrame([("en", 0.4), ("de", 0.2), ("fr", 0.2), ("es", 0.2)], "lang string, target double")
    mixed = mixing.with_mixture(docs, targets={"lang": target}, sweeps=20).cache()
    weights = mixed.groupBy("lang").agg(F.sum(F.col("_tokens") * F.col("_weight")).alias("t")).collect()
    total = sum(r.t for r in weights)
    assert {r.lang: round(r.t / total, 3) for r in weights} == {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
    assert total == pytest.approx(mixed.agg(F.sum("_tokens")).first()[0])
    p, t = F.col("_probability"), F.col("_tokens")
    mean, spread, kept = mixed.agg(F.sum(p * t), F.sqrt(F.sum(t * t * p * (1 - p))), F.sum(F.when(F.col("_kept"), t))).first()
    assert abs(kept - mean) < 4 * spread
    assert mixed.filter(F.abs(p - F.least(F.lit(1.0), F.col("_weight") / 2)) > 1e-9).isEmpty()


def test_copies_have_the_target_shares(spark):
    """A language that must be repeated: all its documents are kept, and copies make up its share."""
    rows = [(i, "w " * 19, "s", "es" if i % 10 == 0 else "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    target = spark.createDataFrame([("en", 0.65), ("es", 0.35)], "lang string, target double")
    mixed = mixing.with_mixture(docs, targets={"lang": target}, keep=1.0).cache()
    assert mixed.filter(F.col("_kept") != (F.col("_copies") > 0)).isEmpty()
    taken = {r.lang: r.t for r in mixed.groupBy("lang").agg(F.sum(F.col("_tokens") * F.col("_copies")).alias("t")).collect()}
    assert taken["es"] / sum(taken.values()) == pytest.approx(0.35, abs=0.02)
    assert sum(taken.values()) == pytest.approx(80_000, rel=0.03)


def test_edge_rows(spark):
    rows = [(1, None, None, None, 1), (2, "", "a", "en", 1), (None, "x y", "b", None, 1), (2, "", "a", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight int")
    mixed = mixing.with_mixture(docs, sweeps=2)
    got = mixed.collect()
    assert len(got) == 4 and all(0 < r._probability <= 1 for r in got)
    assert len({r._kept for r in got if r.doc_id == 2}) == 1
    assert mixed.columns[:5] == docs.columns
    assert mixing.with_mixture(docs.limit(0), sweeps=2).count() == 0


def test_a_sweep_joins_its_sums_alone(spark, monkeypatch):
    """Targets are joined once; a sweep has one join for each dimension, and a value without a target keeps its weight."""
    rows = [("a", "en", "x", 30), ("a", "de", "y", 10), ("b", "en", "y", 60), ("b", "fr", "x", 7)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": spark.createDataFrame([("a", 0.6), ("b", 0.4), ("c", 0.1)], "source string, target double"), "lang": spark.createDataFrame([("en", 0.7), ("de", 0.2)], "lang string, target double")}
    plans = []
    store = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df))
    got = {(r.source, r.lang): r.weight for r in mixing.rake(cells, targets, 1).collect()}
    a, b = 107 * 0.6 / 40, 107 * 0.4 / 67
    en, de = 107 * 0.7 / (30 * a + 60 * b), 107 * 0.2 / (10 * a)
    assert got == pytest.approx({("a", "en"): 30 * a * en, ("a", "de"): 10 * a * de, ("b", "en"): 60 * b * en, ("b", "fr"): 7 * b})
    # The second sum is over the first join, which therefore is named twice.
    assert plans[-1].count("Join ") == 3
