import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = ["a", "e", "the", "'s", "'re", "'", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "中", "😀", "!", "...", "\u00a0", "\u2003", "x" * 40]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=200), st.integers(1, 9))
def test_tree_equals_flat(parts, leaf):
    text = "".join(parts)
    tool = bpe.codec(PATH)
    ids = tool.encode(text, leaf)
    assert ids == tool.flat.encode_ordinary(text)
    assert tool.decode(ids, 3) == text.encode()


def test_long_texts():
    tool, dice = bpe.codec(PATH), random.Random(3)
    for text in ("a" * 50_000, " " * 50_000, "".join(dice.choice(ALPHABET) for _ in range(60_000))):
        assert tool.encode(text) == tool.flat.encode_ordinary(text)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "i"), (None, "", "i"), (3, "It's <|endoftext|> é", "i"), (3, "It's <|endoftext|> é", "i")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in out.collect()) == [(0, ""), (1, ""), (3, "It's <|endoftext|> é"), (3, "It's <|endoftext|> é")]
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_query(spark):
    import hashlib

    tool = bpe.codec(PATH)
    got = {r["doc_id"]: r for r in queries.op4_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = tool.flat.encode_ordinary(r["text"])
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
