import random
import re
from collections import Counter

import pytest

from corpusmill.llm import collocations


def brute(docs, least, n):
    f, all_ = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            all_[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    cands = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
    rows = {}
    for (lang, p), a in cands.items():
        if any(la == lang and inside(p, q) and 100 * b >= 50 * a for (la, q), b in cands.items()):
            continue
        score, k, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, all_[lang], -score) for lang, own in rows.items() for i, (score, a, p, l, r) in enumerate(sorted(own)[:n]))


def told(spark, docs, least, n, parts=3, **sizes):
    df = spark.createDataFrame([(i, *d, "x", 1) for i, d in enumerate(docs)], "doc_id long, text string, lang string, phrase string, n int").repartition(parts)
    return sorted(tuple(r) for r in collocations.collocations(df, least, n, **sizes).collect())


EDGE = [(None, "en"), ("", "en"), (" \t\n", None), ("One two three. ONE TWO, one two\x0bthree! one  two\tthree", None), ("one two three", "en"), ("one two three", "en"), ("one two three", ""), ("ñ é à ñ é à ñ é à", "es"), ("a a a a a a a", "en"), ("a a a a.a a a:a", "es"), ("w" * 70_000 + " tail", "en")]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_edge_rows(spark, least):
    assert told(spark, EDGE, least, 50) == brute(EDGE, least, 50)
    assert told(spark, EDGE[:3], 1, 50) == []
    assert told(spark, [], 1, 50) == []


def test_counts_run_over_blocks_shards_and_groups(spark, monkeypatch):
    """Words stand at all places of the bitmaps' blocks; small shards and cells part texts and phrases anywhere."""
    dice = random.Random(5)
    text = lambda n: "".join(dice.choice(["a", "b", "c", "de", "é"]) + dice.choice([" ", " ", " ", " ", "  ", ". ", "\n"]) for _ in range(n))
    docs = [(text(dice.randrange(300)), dice.choice(["x", "x", "y"])) for _ in range(40)] + [(text(3000), "x")]
    want = brute(docs, 4, 30)
    assert told(spark, docs, 4, 30) == want
    monkeypatch.setattr(collocations, "SALTS", 3)
    assert told(spark, docs, 4, 30, size=64, cells=200) == want
    assert told(spark, docs, 4, 30, bits=1) == want  # nearly all meet: exact counts decide


def test_scores_are_exact_beyond_64_bits(spark):
    row = lambda phrase, n: ("en", phrase, n)
    make = lambda rows: spark.createDataFrame(rows, "lang string, phrase string, n long")
    big = 9 * 10**12 + 7
    words, pairs = make([row("a", big + 3), row("b", big + 5), row("c", big)]), make([row("a b", big), row("b c", 10)])
    triples = make([row("a b c", 10)])
    got = sorted(tuple(r) for r in collocations.scored(words, pairs, triples).collect())
    # at a score of 0 for both, the first cut of the three counts
    assert got == [("en", "a b", big, big + 3, big + 5, 10**6 * big * big // ((big + 3) * (big + 5))), ("en", "a b c", 10, big + 3, 10, 10**6 * 100 // ((big + 3) * 10))]
