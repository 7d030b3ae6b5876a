import os

import numpy as np
import pytest

import corpus_pipeline
from test_ngram_join import brute_force as groups
from test_packing import encoded
from test_pii import brute_force as spans
from tracklake.llm import mixing, pii, quality
from tracklake.session import materialize


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """What each stage got and returned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir))
        found[name] = docs, out
        docs = out
    return found


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_return_the_columns_of_documents(steps):
    for name, (given, out) in [*steps.items()][:-1]:
        assert out.dtypes == given.dtypes, name


def test_quality_stage(spark, sf_dir, steps):
    given, out = steps["quality_classifier"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.with_quality(given, labels).collect()}
    assert rows(out).keys() == {k for k, s in scores.items() if s >= 0.3}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(good - rows(out).keys()) <= 0.02 * len(good)


def test_near_copies_stage(steps):
    given, out = map(rows, steps["ngram_jaccard_join"])
    expected = groups([(k, r.text) for k, r in given.items()], 5, 80)
    assert out == {k: r for k, r in given.items() if expected[k][1] == k}
    assert len(out) < len(given)


def test_personal_data_stage(steps):
    given, out = map(rows, steps["pii"])
    assert given.keys() == out.keys()
    for k, r in out.items():
        assert not any(pii.find(r.text)) and r.n_chars == len(r.text)
        if not any(spans(given[k].text)) and not any(pii.find(given[k].text)):
            assert r == given[k]


def test_mixing_stage(steps):
    given, out = steps["mixing"]
    mixed = mixing.with_mixture(given, keep=1.0).collect()
    assert rows(out).keys() == {r.doc_id for r in mixed if r._kept}
    assert all(r._kept for r in mixed if r._weight >= 1)


def test_packing_stage(steps):
    given, out = steps["packing"]
    pieces = {}
    for p in out.collect():
        pieces.setdefault(p.doc_id, []).append(p)
    assert pieces.keys() == rows(given).keys()
    for k, r in rows(given).items():
        ids = b"".join(p.ids for p in sorted(pieces[k], key=lambda p: p.start))
        assert (np.frombuffer(ids, "<u4") == encoded(r.text)).all()


def test_stages_take_odd_rows(spark, sf_dir, tmp_path):
    data = [(1, None, None, None, None), (None, "a@b.cd x", "en", "s", 8), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(os.fspath(tmp_path / "labels.parquet"))
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = materialize(stage(spark, frame, os.fspath(tmp_path)))
