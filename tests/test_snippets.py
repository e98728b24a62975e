"""Snippets in the JVM and by the index's places, against a plain reading of the rule."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.functions.fold import folded
from corpusmill.operators import index

SF = "/root/testdata/sf0.001"


def spans(raw):
    return [m.span() for m in re.finditer("[^\\W_](?:[^\\W_]|[̀-ͯ])*", raw)]


def shown(raw, hits, size):
    """hits: place to word."""
    places, best, at = spans(raw), 0, 0
    for start in sorted(hits):
        found = len({w for p, w in hits.items() if start <= p < start + size})
        if found > best:
            best, at = found, start
    at = max(0, min(at, len(places) - size))
    chosen = list(enumerate(places))[at : at + size]
    if not chosen:
        return best, raw
    end = chosen[0][1][0]
    out = "..." if at else raw[:end]
    for i, (a, b) in chosen:
        out += raw[end:a] + (f"<mark>{raw[a:b]}</mark>" if i in hits else raw[a:b])
        end = b
    return best, out + ("..." if at + size < len(places) else raw[end:])


def brute(raw, words, size):
    hits = {}
    for i, (a, b) in enumerate(spans(raw)):
        token = folded(raw[a:b])
        word = next((k for k, w in enumerate(words) if token.startswith(w)), None)
        if word is not None:
            hits[i] = word
    return shown(raw, hits, size)


def texts():
    dice = random.Random(7)
    words = ["Lice", "licença", "the", "Théa", "x", "йод", "a_b", unicodedata.normalize("NFD", "théâtre"), "9", "é"]
    gaps = [" ", ", ", "\n", " - ", "_", "́ "]
    made = ["".join(dice.choice(words) + dice.choice(gaps) for _ in range(dice.randrange(60))) for _ in range(150)]
    return [*made, "", None, " ., ", "́", "lice", " lice ", "x " * 3000 + "lice"]


def test_snippets_equal_the_rule(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "id int, t string")
    for words, size in ((["lice", "th"], 5), (["th", "the", "e"], 42), (["none"], 3), ([], 4)):
        out = df.select("id", text.token_snippet(F.col("t"), words, size).alias("s"))
        assert "Python" not in out._jdf.queryExecution().toString()
        got = {r["id"]: r["s"] for r in out.collect()}
        assert got == {i: None if t is None else brute(t, words, size)[1] for i, t in rows}


def test_the_best_of_several_columns(spark):
    rows = [("lice", "the lice"), ("the lice", "lice the"), (None, "x lice"), ("none", "nothing"), (None, None), ("lice", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a string, b string")
    got = {r["id"]: r["s"] for r in df.select("id", text.token_snippet(F.col("a"), ["lice", "th"], 9, F.col("b")).alias("s")).collect()}
    mark = lambda t: re.sub("(lice|the)", "<mark>\\1</mark>", t)
    assert got == {0: mark("the lice"), 1: mark("the lice"), 2: mark("x lice"), 3: "none", 4: None, 5: mark("lice")}


def test_places_of_the_index_give_the_same(spark, tmp_path):
    own = index.TextIndex(spark, f"file://{tmp_path}/index", "doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    made = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    docs = docs.union(made)
    own.put(docs.where("doc_id % 3 = 0"), F.lit("the lice of an older text"))
    own.put(docs, F.col("text"))
    assert own.live().count() == docs.count()
    raw = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = own.snippets(own.search("lice th"), docs, F.col("text"), "lice th")
    assert "Python" not in out._jdf.queryExecution().toString()
    got = {r["doc_id"]: r["snippet"] for r in out.collect()}
    want = {i: brute(t, ["lice", "th"], 42)[1] for i, t in raw.items() if t is not None and brute(t, ["lice", "th"], 10**9)[0] == 2}
    assert len(want) > 20 and got == want

    def phrase(t):
        tokens = [folded(t[a:b]) for a, b in spans(t)]
        return {p: 0 for i in range(len(tokens) - 1) if tokens[i : i + 2] == ["lice", "the"] for p in (i, i + 1)}

    got = {r["doc_id"]: r["snippet"] for r in own.snippets(own.search("Lice the", "phrase"), docs, F.col("text"), "Lice the", "phrase", 6).collect()}
    assert got and got == {i: shown(t, phrase(t), 6)[1] for i, t in raw.items() if t and phrase(t)}
    none = own.snippets(made, docs, F.col("text"), " ., ", size=4)
    assert {r["doc_id"]: r["snippet"] for r in none.collect()} == {i: None if t is None else shown(t, {}, 4)[1] for i, t in raw.items() if i >= 10_000_000}
