import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import maxent, queries


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


def brute(rows, held):
    train = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(train.values()), len(train)
    return sorted((i if i is not None else -1, held(i), len(tokens(x)), sum(train[t] > 0 for t in tokens(x)), n, round(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for i, x in rows)


def told(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect())


def crc(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_query_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.op8_maxent(spark, sf).cache()
    assert told(out) == brute(rows, crc)
    held = out.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] - held[1] > 0.05 * held[2]


@pytest.mark.parametrize("head", [1 << 20, 5])
def test_edges(spark, monkeypatch, head):
    monkeypatch.setattr(maxent.vocabulary, "__defaults__", (head,))
    rows = [(i, t) for i, t in enumerate([None, "", " A a b", "a B c c", "É é", "new words here", "x " * 200_000, "a b"])] + [(3, "a B c c"), (None, "a b")]
    df = spark.createDataFrame([(i, t, 5, "n") for i, t in rows], "doc_id long, text string, n int, names string")
    out = maxent.score(df, F.col("doc_id") == 5)
    assert told(out) == brute(rows, lambda i: i == 5)
    none = maxent.score(df, F.lit(True)).collect()
    assert {(r["n_known"], r["base_score"], round(r["score"], 6), r["train_tokens"]) for r in none} == {(0, 0.0, 0.0, 0)}
    assert maxent.score(df.limit(0), F.lit(False)).count() == 0


def test_probabilities_sum_to_one():
    dice = np.random.default_rng(3)
    names = np.sort(dice.integers(0, 1 << 60, 30, dtype=np.uint64))
    n = maxent.CLASSES * maxent.SLOTS
    sums = np.zeros(n)
    sums[:30] = dice.integers(1, 50, 30)
    vocab = maxent.Vocabulary(0, 0, names, names, names, np.arange(30), *maxent.biases(sums, 40))
    model = maxent.Weights.zero(0)
    learner = maxent.Learner(model)
    context = maxent.context_rows(names[:20], names[5:25])
    learner.learn(vocab, context, np.arange(20))
    one = np.repeat(context[:, :1], 31, axis=1)
    p = np.exp(learner.weights.log_place(vocab, one, np.append(np.arange(30), n)))
    assert abs(p.sum() - 1) < 1e-4
    assert p[0] > np.exp(model.log_place(vocab, one, np.append(np.arange(30), n)))[0]


def test_every_counted_token_has_a_place_told_by_context(spark):
    assert maxent.CLASSES * maxent.SLOTS >= 2048
    dice = np.random.default_rng(4)
    names = np.unique(dice.integers(0, 1 << 64, 5000, dtype=np.uint64))
    n = dice.integers(1, 1000, len(names))
    names, n = np.append(names, maxent.END), np.append(n, 9)
    vocab = maxent.vocabulary(spark.createDataFrame(list(zip(names.view(np.int64).tolist(), n.tolist(), strict=True)), "name long, n long"))
    place, leaf = vocab.place_of(names), vocab.tree.leaf_of(names)
    rare = np.flatnonzero(place == maxent.CLASSES * maxent.SLOTS)
    assert len(np.unique(leaf[rare])) > 0.5 * min(len(rare), 1 << maxent.MOST_BITS)  # leaves follow the vocabulary
    a, b = rare[0], rare[np.flatnonzero(leaf[rare] != leaf[rare[0]])[0]]
    context = maxent.context_rows(names[[5, 6]], names[[7, 8]])
    learner = maxent.Learner(maxent.Weights.zero(0))
    for _ in range(20):
        learner.learn(vocab, context, place[[a, b]], names[[a, b]])

    def p(k):
        one = np.repeat(context[:, k : k + 1], len(names) + 1, axis=1)
        all_leaf = np.append(leaf, vocab.tree.leaf_of(np.array([maxent.UNKNOWN])))
        out = learner.weights.log_place(vocab, one, np.append(place, maxent.CLASSES * maxent.SLOTS))
        low = np.append(place == maxent.CLASSES * maxent.SLOTS, True)
        out[low] += learner.weights.log_leaf(vocab.tree, one[:, low], all_leaf[low]) + np.log(np.append(n, 0)[low] + 1) - np.log(vocab.tree.size[all_leaf[low]])
        return np.exp(out)

    first, second = p(0), p(1)
    assert abs(first.sum() - 1) < 1e-3 and abs(second.sum() - 1) < 1e-3
    assert first[a] > 2 * second[a] and second[b] > 2 * first[b]


def test_tables_grow_with_the_training_tokens():
    sizes = [maxent.table_rows(10**k) for k in range(14)]
    assert sizes == sorted(sizes) and sizes[0] == (1 << 16, 1 << 18) and sizes[-1] == tuple(4 * n for n in sizes[0])


def test_gradient_sums_equal_adding_row_by_row():
    dice = np.random.default_rng(5)
    learner = maxent.Learner(maxent.Weights.zero(0))
    width = 1 << maxent.FAN
    rows, g = dice.integers(0, 40, (3, 500)), dice.normal(size=(500, width)).astype(np.float32)
    want, square = np.zeros((len(learner.weights.deep), width)), learner.squares[1].copy()
    for r in rows:
        np.add.at(want, r, g)
    square += (want * want).mean(axis=1)
    learner._apply(1, learner.weights.deep, rows, g)
    assert np.allclose(learner.weights.deep, -maxent.RATE * want / np.sqrt(square)[:, None], atol=1e-5)
    assert learner.steps[1].sum() == 1500


def test_batches_with_and_without_unknown_tokens_are_of_one_kind(spark):
    rows = [(i, "a b c") for i in range(40)] + [(100, "quite unknown words"), (101, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert told(maxent.score(df, F.col("doc_id") >= 100)) == brute(rows, lambda i: i >= 100)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_token_frequent_in_held_out_texts_alone_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(maxent.vocabulary, "__defaults__", (5,))
    rows = [(i, "only here " + f"w{i % 3} x{i}") for i in range(400)] + [(1000 + i, f"w{i % 3} train y{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(maxent.score(df, F.col("doc_id") < 1000)) == brute(rows, lambda i: i < 1000)
