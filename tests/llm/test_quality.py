import random
import zlib

import numpy as np
import pytest

from tracklake.llm import quality, queries


def held_out_accuracy(rows, labels):
    truth = {r.doc_id: r.quality for r in labels}
    seen = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return np.array(seen)


def test_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op4_quality"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(rows) == docs.count()
    for r in rows[:500]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    seen = held_out_accuracy(rows, spark.read.parquet(f"{sf_dir}/labels.parquet").collect())
    predicted = seen[:, 0] >= 0.3
    good = seen[:, 1] == 1
    assert (predicted == good).mean() > 0.97
    assert predicted[good].mean() > 0.99
    # Calibrated: where a score is given, about that share is good.
    assert abs(seen[:, 0].mean() - good.mean()) < 0.02


def test_scores_do_not_depend_on_held_out_labels(spark):
    draw = random.Random(5)
    alphabets = ("$%&#*!x ", "abcdefgh ")
    texts = ["".join(draw.choices(alphabets[i % 3 > 0], k=600)) for i in range(90)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    wrong = spark.createDataFrame(
        [(i, int(i % 3 > 0) if zlib.crc32(str(i).encode()) % 5 else int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int"
    )
    scores = [sorted(quality.with_quality(docs, given).collect()) for given in (labels, wrong)]
    assert scores[0] == scores[1]
    assert all((r.score > 0.5) == (r.doc_id % 3 > 0) for r in scores[0])


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (None, 0), (2, 7)]])
def test_edge_rows(spark, labels):
    rows = [(1, None, 5.0), (2, "", 5.0), (None, "x" * 100_000, None), (2, "", 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    scored = quality.with_quality(docs, given)
    assert scored.columns == ["doc_id", "text", "score"]
    got = scored.collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.with_quality(docs.limit(0), given).count() == 0


def test_logistic_fit_of_separable_rows():
    x = np.array([[1.0, v] for v in (-2, -1, 1, 2)])
    weights = quality.fit_logistic(x, np.array([0.0, 0, 1, 1]))
    assert (np.sign(x @ weights) == [-1, -1, 1, 1]).all()
