import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import queries, toxicity

CHAIN = queries.CHAIN
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()).encode()


def words(text):
    return [w.strip(PUNCTUATION) for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))]


def brute_features(text):
    """What the features stand for."""
    out = set()
    for w in words(text):
        if w:
            out |= {(0, w)} | {(n, w[:n]) for n in (4, 6) if len(w) >= n}
            if len(w) > toxicity.LONG:
                chars = w.decode()
                out |= {(9, chars[i : i + toxicity.GRAM].encode()) for i in range(len(chars) - toxicity.GRAM + 1)}
    return out


def hashed(texts):
    import pyarrow as pa

    out = []
    for _, n, owner, feature in toxicity.features(*toxicity.buffers(pa.array(texts))):
        out += [set(feature[owner == i].tolist()) for i in range(n)]
    return out


TEXTS = ["", "Plain words, here.", "!!! ((well...)) ?!?!?! --'x'--", "a" * 30 + "b", "a" * 30 + "c", "A" * 30 + "b!!!!!!", "日本語のとても長い文章です、そして続きます", "日本語のとても長い文章です、ただし別です", "x_" * 40, "tail " * 3 + "word", ".", "ab abc abcd abcdef abcdefg"]


def test_features_hold_whole_words_and_long_runs():
    found = hashed(TEXTS)
    want = [brute_features(t) for t in TEXTS]
    ids = {f: i for i, f in enumerate(sorted(set().union(*want)))}
    # hashed and plain features meet: the same sizes and the same overlaps for every two texts
    assert [len(x) for x in found] == [len(x) for x in want]
    assert [[len(a & b) for a in found] for b in found] == [[len(a & b) for a in want] for b in want]
    assert found[3] != found[4] and found[3] == found[5]
    assert len(ids) < toxicity.DIMS


def test_features_of_a_very_long_text_equal_those_of_its_parts():
    one, other = "lorem Ipsum, dolor-sit ", "日本語" * 20 + " "
    text = (one * 60_000 + other) * 2 + "z" * 2_000_000
    assert hashed([text])[0] == hashed([one + other + "z" * 2_000_000])[0]


@pytest.mark.parametrize("lang", ["en", "de", "es", "fr"])
def test_held_out_accuracy(spark, lang, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where((F.col("doc_id") % 2 == 1) & (F.col("lang") == lang))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    n = {(r["toxic"], r["flagged"]): r["count"] for r in toxicity.score(docs, model).join(labels, "doc_id").groupBy("toxic", "flagged").count().collect()}
    caught, missed = n.get((1, True), 0), n.get((1, False), 0)
    assert caught >= (0.9 if lang in ("en", "fr") else 0.85) * (caught + missed), n  # 36 German and 17 Spanish ones in all
    assert n.get((0, True), 0) <= 0.01 * n[(0, False)], n


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0")
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), CHAIN)
    assert model.chain[0, 1] == 0
    return model


def brute_chain(rows, labels, picked):
    """The chain by dense matrices, on the features that were picked."""
    y = {i: (int(q == 0), t) for i, q, t in labels}
    learnt = sorted((i, t) for i, t in rows if i in y)
    x = np.array([[float(f in h) for f in picked] for h in hashed([t for _, t in learnt])]).reshape(len(learnt), len(picked))
    fold, before, out = np.array([i % toxicity.FOLDS for i, _ in learnt]), np.zeros((len(learnt), 0)), []
    for c in range(2):
        goal = np.array([float(y[i][c]) for i, _ in learnt])
        full = np.column_stack([x, before])

        def fit(a, b):
            w, m, v = np.zeros(a.shape[1] + 1), 0, 0
            share = min(max(b.mean(), 1e-4), 1 - 1e-4)
            w[-1] = np.log(share / (1 - share))
            if b.min() == b.max():
                return w
            a = np.column_stack([a, np.ones(len(a))])
            for step in range(1, toxicity.STEPS + 1):
                g = a.T @ (1 / (1 + np.exp(-np.clip(a @ w, -30, 30))) - b) / len(b)
                g[:-1] += toxicity.L2 * w[:-1]
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            return w

        held = np.zeros(len(learnt))
        for f in range(toxicity.FOLDS):
            w = fit(full[fold != f], goal[fold != f])
            held[fold == f] = full[fold == f] @ w[:-1] + w[-1]
        out.append(fit(full, goal))
        before = np.column_stack([before, 1 / (1 + np.exp(-held))])
    chance = []
    for h in hashed([t for _, t in sorted(rows)]):
        v = np.array([float(f in h) for f in picked])
        first = 1 / (1 + np.exp(-(v @ out[0][:-1] + out[0][-1])))
        chance.append((first, 1 / (1 + np.exp(-(np.append(v, first) @ out[1][:-1] + out[1][-1])))))
    return chance


def test_chain_equals_brute_force(spark):
    dice = np.random.default_rng(6)
    rows = [(i, " ".join(dice.choice(["nice", "day", "vile", "words", "tree", "lake", "mean", "thing"], 6)) + (" vilest" if i % 3 == 0 else "")) for i in range(160)]
    labels = [(i, i % 5 % 2, int(i % 3 == 0)) for i in range(0, 160, 2)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known, CHAIN)
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in toxicity.score(docs, model).collect()}
    assert np.allclose([got[i] for i, _ in sorted(rows)], brute_chain(rows, labels, model.picked.tolist()), atol=1e-6)
    assert Counter(r["flagged"] for r in toxicity.score(docs.where("doc_id % 2 = 1 and doc_id % 3 = 0"), model).collect()) == {True: 27}


def test_without_a_feature_every_document_has_the_share(spark):
    docs = spark.createDataFrame([(i, "") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels, CHAIN)).collect()
    assert {round(r["p_toxic"], 3) for r in got} == {0.25} and not any(r["flagged"] for r in got)


def test_edge_rows(spark):
    rows = [(1, None, "p"), (2, "", "q"), (2, "", "q"), (None, "vile vile word", "r"), (4, "x " * 300_000 + "vile", "s"), (5, "good day", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, flagged string")
    labels = spark.createDataFrame([(1, 1, 0, "a"), (2, 1, 0, "a"), (4, 1, 1, "a"), (5, 1, None, "a"), (None, 0, 1, "a"), (4, 1, 0, "a")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.fit(docs, labels, CHAIN)
    assert toxicity.score(docs, model).count() == 6
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    none = toxicity.fit(docs, labels.limit(0), CHAIN)
    assert {r["flagged"] for r in toxicity.score(docs, none).collect()} == {False}
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_one_text_of_a_labelled_document_is_learnt(spark):
    rows = [(1, f"text {i}") for i in range(300)] + [(i, "vile" if i % 2 else "nice") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, CHAIN)
    assert toxicity.score(docs.where("doc_id > 1"), model).where(F.col("flagged") != (F.col("doc_id") % 2 == 1)).count() == 0


def test_query_rows(spark):
    out = queries.op2_toxicity(spark, "/root/testdata/sf0.01")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()


@pytest.mark.parametrize("told", [[(0, 1), (1, 1)], [(0, 1), (1, 0)], [(0, 0), (1, 0)], [(900, 1), (901, 1), (902, 1), (903, 1), (904, 1), (0, 0)], []])
def test_without_evidence_nothing_is_flagged(spark, told):
    """One class, too few features, labels of documents that don't exist, no labels."""
    docs = spark.createDataFrame([(i, f"clean words number {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, t in told], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, CHAIN)
    assert toxicity.keep_clean(docs, model).count() == 30
    assert toxicity.score(docs, model).where("flagged").count() == 0


def test_labels_of_absent_documents_count_nowhere(spark):
    docs = spark.createDataFrame([(i, "awful nasty words" if i % 3 == 0 else "kind good words") for i in range(60)], "doc_id long, text string")
    own = [(i, 1, int(i % 3 == 0)) for i in range(60)]
    fit = lambda rows: toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), CHAIN)
    one, other = fit(own), fit(own + [(1000 + i, 0, 1) for i in range(500)])
    assert one.threshold == other.threshold and (one.bias == other.bias).all() and (one.picked == other.picked).all()
    assert {r["doc_id"] for r in toxicity.score(docs, one).where("flagged").collect()} == set(range(0, 60, 3))
