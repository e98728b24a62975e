import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import queries, repeats


def brute(rows, width=35):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i if i is not None else -1, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def told(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"], r["s"]) for r in df.collect())


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert told(queries.op7_repeats(spark, "/root/testdata/sf0.01").withColumnRenamed("kept_sha256", "s")) == brute(rows)


@pytest.mark.parametrize(("sample", "flush"), [(64, 500_000), (1, 2000)])
def test_edges(spark, monkeypatch, sample, flush):
    monkeypatch.setattr(repeats, "SAMPLE", sample)
    monkeypatch.setattr(repeats, "FLUSH", flush)
    dice = random.Random(2)
    fresh = lambda n: " ".join(f"w{dice.randrange(10**7)}" for _ in range(n))
    passage, short = fresh(60), fresh(34)
    texts = [None, "", " ", fresh(34), fresh(35), "a " * 34, "a " * 35, "a " * 36, "b " * 40, "b " * 35, "a b " * 50, "é ü " * 18, "é ü " * 18]
    texts += [f"{fresh(dice.randrange(40))} {passage} {fresh(dice.randrange(40))}" for _ in range(60)]
    texts += [f"{fresh(5)} {short} {fresh(5)}" for _ in range(5)] + [f"{fresh(3)} {short} tail {fresh(5)}" for _ in range(3)]
    texts += ["x y\t" + passage.replace(" ", "\n") + "\x0bz", fresh(40_000)]
    texts.append(" ".join(texts[-1].split()[1000:1040]))
    rows = list(enumerate(texts)) + [(40, texts[40]), (None, texts[4])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, spans int").repartition(7)
    assert told(repeats.find(df).withColumn("s", F.sha2("kept", 256))) == brute(rows)
    out = repeats.remove(df)
    assert out.columns == df.columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert left[0] is None and left[3] == texts[3] and left[7] == "" and left[5] == texts[5]


def test_places_and_counts_are_wide():
    one = np.zeros(3, np.int64)
    first = np.array([1 << 40, (1 << 40) + 1, 5])
    assert [x.tolist() for x in repeats.intervals(one, one, first)] == [[0, 0], [0, 0], [5, 1 << 40], [1, 2]]


def test_a_run_of_more_windows_than_24_bits():
    n = (1 << 24) + 40
    words, removed, kept = repeats.kept_words(b"a " * n + b"tail end", [{"first": 0, "count": n - 34}], 35)
    assert (words, removed, kept) == (n + 2, n, b"tail end")


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.find(df).count() == 0


def test_equal_windows_share_their_anchor():
    dice = np.random.default_rng(4)
    for alphabet in (2, 5, 1000):
        core = dice.integers(0, alphabet, 35, dtype=np.uint64)
        seen = set()
        for _ in range(40):
            text = np.concatenate([dice.integers(0, alphabet, dice.integers(0, 30), dtype=np.uint64), core, dice.integers(0, alphabet, 30, dtype=np.uint64)])
            at = len(text) - 65
            with np.errstate(over="ignore"):
                names = repeats.mix(text.copy())
                codes = repeats.window_names(names, 35)
                anchor, place = repeats.anchors(names, np.zeros(len(text), np.int64), np.array([at]), codes[[at]], 35)
            seen.add((int(anchor[0]), int(place[0]) - at, int(codes[at])))
        assert len(seen) == 1


def test_windows_that_share_one_digest_are_told_apart_by_the_other():
    dice = np.random.default_rng(7)
    for _ in range(50):
        code, other = dice.integers(0, 3, 40).astype(np.uint64), dice.integers(0, 4, 40).astype(np.uint64)
        order, same = repeats.by_codes(code, other)
        pairs = list(zip(code[order].tolist(), other[order].tolist(), strict=True))
        assert sorted(order.tolist()) == list(range(40)) and same.tolist() == [i > 0 and pairs[i] == pairs[i - 1] for i in range(40)]
        assert (~same).sum() == len(set(pairs))
    order, same = repeats.by_codes(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    assert len(order) == len(same) == 0


def test_both_digests_follow_the_words_alone():
    with np.errstate(over="ignore"):
        names = np.random.default_rng(8).integers(0, 1 << 63, 200).astype(np.uint64)
        code, other = repeats.window_codes(np.concatenate([names, names]), 35)
    assert (code[:166] == code[200:366]).all() and (other[:166] == other[200:366]).all()
    assert len(np.unique(code)) == len(np.unique(other)) == 200 and not (code == other).any()
