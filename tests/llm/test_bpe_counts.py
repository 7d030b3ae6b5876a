import random

import pytest
from tokenizers import Tokenizer

from tracklake.llm import bpe_counts, queries
from tracklake.llm.columns import tokenizer_path

TOKENIZER = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def expected(texts):
    found = TOKENIZER.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [(len((t or "").encode()), len(e.ids), len(e.ids) > 1024) for t, e in zip(texts, found)]


def counted(frame):
    return sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in frame.collect())


def test_query_against_tokenizer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    wanted = sorted((d.doc_id, *e) for d, e in zip(docs, expected([d.text for d in docs])))
    assert counted(queries.QUERIES["op5_token_counts"](spark, sf_dir)) == wanted


def test_odd_texts(spark):
    draw = random.Random(5)
    signs = ["a", "Z", " ", "  ", "\n", "\t", "'s", "'LL", "9", "12", "é", "e\u0301", "ß", "日本", "🙂", "\u200b", "\xa0", "\x00", "<|endoftext|>", "<|", "...", "\u0130"]
    texts = ["".join(draw.choices(signs, k=draw.randint(1, 40))) for _ in range(3000)] + ["", None]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert counted(bpe_counts.token_counts(frame)) == sorted((i, *e) for i, e in enumerate(expected(texts)))


@pytest.mark.parametrize("unit", ["a", "xyzzy", "é9"])
def test_a_long_text_without_spaces(spark, unit):
    text = unit * (100_000 // len(unit.encode()))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert counted(bpe_counts.token_counts(frame)) == [(1, *expected([text])[0])]


def test_edge_rows(spark):
    rows = [(1, "one two", 5, "x"), (1, "one two", 5, "x"), (None, None, None, None), (2, "", 7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, _text string")
    got = [tuple(r) for r in bpe_counts.token_counts(frame).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    assert sorted(got, key=repr) == sorted([(1, 7, 2, False), (1, 7, 2, False), (None, 0, 0, False), (2, 0, 0, False)], key=repr)
    assert bpe_counts.token_counts(frame.limit(0)).count() == 0
