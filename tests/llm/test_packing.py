import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import packing, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def flat():
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*tool.encode(text or "", add_special_tokens=False).ids, 0]


def test_query_keeps_every_id_once(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op3_packing(spark, sf).collect()
    encode = flat()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(by_doc) == {d["doc_id"] for d in docs}
    for d in docs:
        ids, at = np.array(encode(d["text"]), dtype="<u4"), 0
        for r in sorted(by_doc[d["doc_id"]], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        short += at < 1024
    assert short <= 1


@pytest.mark.parametrize("text", ["x<|endoftext|>y", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|>\n", "<|endoftext|", "a<|endoftext|>" * 5000])
def test_ids_are_those_of_the_tokenizers_call(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = packing.encoded(docs, RANKS, queries.SPECIAL).first()["ids"]
    assert [*np.frombuffer(got, "<u2").tolist(), 0] == flat()(text)
    assert len(packing.encoded(docs, RANKS, {}).first()["ids"]) >= len(got)


def test_edge_rows(spark):
    texts = [(1, None), (None, ""), (2, "a b c"), (2, "a b c"), (3, "<|endoftext|> 'll   é😀"), (4, "word " * 30_000)]
    docs = spark.createDataFrame([(*t, "x", 9) for t in texts], "doc_id long, text string, shard string, length int")
    encode = flat()
    for shard in (1 << 22, 50):
        out = packing.pack(docs, RANKS, 64, shard, queries.SPECIAL).cache()
        ends = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("k"), F.count("*").alias("m"))
        assert ends.where("n != end or k != m or n > 64").count() == 0
        assert shard == 50 or ends.where("n < 64").count() <= 1
        got = out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
        want = defaultdict(int)
        for i, t in texts:
            want[i] += len(encode(t))
        assert {r["doc_id"]: r["n"] for r in got} == want
    assert packing.pack(docs.limit(0), RANKS).count() == 0


def stats_of(docs):
    df = np.zeros(200, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    return packing.Statistics(df, len(docs), sum(map(len, docs)))


def test_neighbours_are_the_best_by_bm25():
    dice = np.random.default_rng(1)
    docs = [dice.integers(0, 60, dice.integers(5, 40)) for _ in range(50)]
    index = packing.Index(docs, stats_of(docs))
    used = np.zeros(50, dtype=bool)
    used[::3] = True
    n, mean = len(docs), np.mean([len(d) for d in docs])

    def weight(d, t):
        df, tf = sum(t in x for x in docs), (docs[d] == t).sum()
        return 0 if df < 2 else np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))

    for seed in (1, 7, 20):
        terms = sorted(set(docs[seed]), key=lambda t: -weight(seed, t))
        for rest, mine in ((False, terms[: packing.TERMS]), (True, terms[packing.TERMS :])):
            got = index.neighbours(seed, used, rest)
            score = {d: sum(weight(d, t) for t in mine if t in docs[d]) for d in range(n) if not used[d]}
            assert np.allclose([score[d] for d in got], sorted((s for s in score.values() if s > 0), reverse=True), rtol=1e-4)


def test_statistics_cover_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.encoded(docs, RANKS, {})
    stats = packing.statistics(rows, 50257, "<u2")
    ids = [np.frombuffer(r["ids"], "<u2") for r in rows.collect()]
    df = np.zeros(50257, np.int64)
    for x in ids:
        df[np.unique(x)] += 1
    assert (stats.docs, stats.ids) == (len(ids), sum(map(len, ids))) and (stats.df == df).all()


def test_related_documents_meet():
    a, b = np.arange(10, 40), np.arange(100, 130)
    docs = [np.append(x, 0) for x in (a, b, a, b)]
    pieces = list(packing.fill(docs, 62, stats_of([d[:-1] for d in docs])))
    assert [p[0] for p in pieces if p[3] == 0] == [0, 2]


def test_terms_beyond_the_heaviest_are_asked_for_before_the_order():
    shared = np.arange(packing.TERMS)
    one, other, last = np.append(shared, [50, 51]), np.array([60, 61, 62]), np.array([50, 70, 71])
    docs = [np.append(x, 0) for x in (one, other, shared, last)]
    pieces = list(packing.fill(docs, 1000, stats_of([d[:-1] for d in docs])))
    assert [p[0] for p in pieces] == [0, 2, 3, 1]


def test_related_documents_are_dealt_to_one_shard(spark):
    """Documents of one topic share a few rare words: most windows' documents are of one topic, whatever their order."""
    dice = np.random.default_rng(8)
    tool = packing.codec(RANKS).flat
    words = [w.decode() for w in (tool.decode_single_token_bytes(i) for i in range(2000, 9000)) if w[:1] == b" " and w[1:].isalpha() and w.isascii()]
    common, topics = words[:300], [words[300 + 12 * t : 312 + 12 * t] for t in range(40)]
    rows = []
    for i in range(1200):
        words = list(dice.choice(common, 30)) + list(dice.choice(topics[i % 40], 10))
        rows.append((i, "".join(dice.permutation(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = packing.pack(docs, RANKS, 512, 8000).select("doc_id", "sequence_id").collect()
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append(r["doc_id"] % 40)
    share = np.mean([max(x.count(t) for t in set(x)) / len(x) for x in by.values() if len(x) > 1])
    assert share > 0.5


def test_keys_are_dealt_by_size():
    first, copies, tasks = packing.dealt(np.array([0, 5, 4, 2, 35, 0, 3, 10, 1]), 10)
    assert (first.tolist(), copies.tolist(), tasks) == ([0, 0, 0, 1, 2, 0, 6, 7, 8], [1, 1, 1, 1, 4, 1, 1, 1, 1], 9)
    assert packing.dealt(np.zeros(4, np.int64), 10)[2] == 1
