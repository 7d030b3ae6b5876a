import zlib

import numpy as np
from tokenizers import Tokenizer

from tracklake.llm import packing, queries
from tracklake.llm.columns import tokenizer_path

TOKENIZER = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def encoded(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def check(pieces, docs, length):
    """Each id lies in one piece, pieces fill their sequences without gaps, only the last is not full."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == {d.doc_id for d in docs}
    for d in docs:
        ids, at = encoded(d.text), 0
        for p in sorted(by_doc[d.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert sorted(by_sequence) == [*range(len(by_sequence))]
    for s, found in by_sequence.items():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or s == len(by_sequence) - 1 and at <= length


def test_query_against_tokenizer(spark, sf_dir):
    pieces = queries.QUERIES["op1_packing"](spark, sf_dir).collect()
    check(pieces, spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), 4096)


def test_words_are_tokenized_as_texts(spark):
    texts = ["don't STOP'S", "a<|endoftext|>b <|ENDOFTEXT|>", "ΑΣ ΑΣ. ΣΑΣ", "é ́x", "\x1ca\x85b c d", "İI ß", "１２3 ²", "\x0b\x0c", "x" * 5000, "🙂🙂 日本"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    check(packing.digests(packing.pack(docs, 16)).collect(), docs.collect(), 16)


def test_edge_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "word " * 300, 7), (4, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    pieces = packing.pack(docs, 64)
    check(packing.digests(pieces).collect(), docs.collect(), 64)
    assert packing.pack(docs.limit(0)).count() == 0
    twice = packing.pack(docs.union(docs)).agg({"length": "sum"}).first()[0]
    assert twice == 2 * sum(len(encoded(r[1])) for r in rows)
    assert packing.pack(spark.createDataFrame([(None, "a")], "doc_id long, text string")).first().doc_id is None


def test_sequences(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 7)) for i in range(60)], "doc_id long, text string")
    pieces = packing.pack(docs, 32)
    made = sorted(packing.sequences(pieces, 32).collect())
    assert all(len(s.ids) == 128 for s in made) and all(s.n_tokens == 32 for s in made[:-1])
    whole = np.concatenate([np.frombuffer(s.ids, "<u4")[: s.n_tokens] for s in made])
    order = sorted(pieces.collect(), key=lambda p: (p.sequence_id, p.offset))
    assert (whole == np.concatenate([encoded(f"some words here " * (p.doc_id % 7))[p.start : p.start + p.length] for p in order])).all()
