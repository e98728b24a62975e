import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusmill.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width):
    """(doc_id, n_words, n_hit, items, matches) by comparing every window with every place."""
    out = []
    for doc, text in docs:
        own, hit, found, runs = words(text), set(), set(), set()
        for item, t in items:
            theirs = words(t)
            k = min(len(theirs), width)
            if not k or item is None:
                continue
            places = {(i, j) for i in range(len(own) - k + 1) for j in range(len(theirs) - k + 1) if own[i : i + k] == theirs[j : j + k]}
            for i, j in places:
                hit |= set(range(i, i + k))
                found.add(str(item))
                if (i - 1, j - 1) not in places:
                    n = 1
                    while (i + n, j + n) in places:
                        n += 1
                    runs.add((str(item), j, i, n + k - 1))
        out.append((doc, len(own), len(hit), sorted(found), sorted(runs)))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], sorted((m["item"], m["at"], m["word"], m["length"]) for m in r["matches"])) for r in df.collect()), key=repr)


@given(st.lists(st.integers(0, 3), min_size=0, max_size=80), st.integers(1, 4))
def test_suffix_arrays_are_in_order(numbers, docs):
    counts = np.bincount(np.sort(np.random.default_rng(len(numbers)).integers(0, docs, len(numbers))), minlength=docs)
    shard = decontaminate.Shard(np.array(numbers, dtype=np.uint64), counts)
    text = shard.text.tolist()
    assert shard.order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


DOCS = [(1, "Alpha beta, GAMMA delta! epsilon zeta eta"), (2, None), (3, ""), (4, "alpha beta gamma"), (None, "x alpha beta gamma delta y"), (4, "alpha beta gamma"), (5, "é ñandú 7 été ÀB àb"), (6, "one"), (7, "zeta zeta zeta zeta zeta zeta")]
ITEMS = [(10, "beta gamma delta epsilon"), (9, "ALPHA beta gamma"), (11, None), (12, "one"), (None, "alpha beta gamma"), (10, "zeta zeta zeta"), (13, "ñandú 7 ÉTÉ"), (14, "Ñandú 7 été"), (15, "ñandú 7 été"), (16, "!!"), (17, "zeta zeta zeta")]


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item string"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("most", [1 << 20, 4])
def test_edge_rows(spark, tmp_path, most):
    docs, items = frames(spark, DOCS, ITEMS)
    assert told(decontaminate.find(docs, items, 3, most)) == brute(DOCS, ITEMS, 3)
    clean = decontaminate.remove(docs, items, 3)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3]
    assert told(decontaminate.find(docs, items.limit(0), 3)) == brute(DOCS, [], 3)
    assert decontaminate.find(docs.limit(0), items, 3).count() == 0 and decontaminate.remove(docs, items.limit(0), 3).count() == len(DOCS)


def test_random_texts_long_documents_and_small_shards(spark):
    dice = random.Random(7)
    text = lambda n, k: " ".join(dice.choice("abcdefgh"[:k]) for _ in range(n))
    docs = [(i, text(dice.randrange(40), 3)) for i in range(30)] + [(100, text(400, 2)), (101, "a " * 300), (102, text(200, 8))]
    docs += [(200 + i, docs[30][1]) for i in range(3)]
    items = [(i, text(dice.randrange(12), 3)) for i in range(12)] + [(50, docs[30][1][100:180]), (51, docs[32][1][:60])]
    for width in (2, 5):
        assert told(decontaminate.find(*frames(spark, docs, items), width, 30, 64)) == brute(docs, items, width)


def test_longest_matches(spark):
    docs, items = frames(spark, [(1, "a b c d e f"), (2, "x a b c d"), (3, "y a b c d"), (4, "a b")], [(7, "z a b c d q"), (8, "a b c d e")])
    got = sorted(tuple(r) for r in decontaminate.longest(decontaminate.find(docs, items, 2)).collect())
    assert got == [("7", 4, 3, 1, 0, 1), ("8", 5, 1, 1, 0, 0)]
