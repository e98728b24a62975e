import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.llm import spelling


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w] and max(n[v] for v in near[w]) >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, c, len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w, c in n.items())


def told(spark, docs):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3)
    return sorted(tuple(r) for r in spelling.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_edge_rows(spark):
    docs = [(1, None), (None, "hello hello hello Hello, HELLO!"), (2, ""), (3, "hallo hallo1hallo hallo-hell hellos hellos hellos"), (3, "banana banana banana bananas bananas bananas banan banan banan"), (3, "banana"), (4, "ÀÉÎõü àéîõü ÀÉÎõü ÀÉÎõü ×××÷÷ ×××÷÷ ×××÷÷ aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa"), (5, "x" * 70_000 + " ab abcd " * 5), (6, "日本語 словослово " * 5)]
    assert told(spark, docs) == brute(docs)
    assert told(spark, []) == [] and told(spark, docs[:1]) == []


def test_all_near_words_of_random_ones_are_found(spark):
    """Few letters, so that bigrams repeat within words and tie in frequency; chains of forms."""
    dice = random.Random(11)
    docs = []
    for letters in ("ab", "abc", "aàeéz", "abcdefghijklmnop"):
        pool = ["".join(dice.choice(letters) for _ in range(dice.randrange(5, 10))) for _ in range(60)]
        for w in list(pool):
            i = dice.randrange(len(w))
            pool += [w[:i] + w[i + 1 :], w[:i] + dice.choice(letters) + w[i:], w[:i] + dice.choice(letters) + w[i + 1 :], dice.choice(letters) + w, w + dice.choice(letters)]
        docs += [(len(docs) + i, " ".join(dice.choices(pool, [1 / (1 + k) for k in range(len(pool))], k=400))) for i in range(6)]
    want = brute(docs)
    assert len(want) > 400 and max(r[2] for r in want) > 10
    assert told(spark, docs) == want


def test_long_chains_of_forms(spark):
    rows = [(f"w{i}", 2**i, 1, f"w{i + 1}" if i < 20 else None, 2 ** (i + 1)) for i in range(21)] + [("alone", 3, 0, None, None)]
    df = spark.createDataFrame(rows, "word string, n long, n_near long, form string, form_n long")
    got = {r["word"]: r["root"] for r in spelling.rooted(df).collect()}
    assert got == {f"w{i}": "w20" for i in range(21)} | {"alone": "alone"}


def test_the_join_is_by_three_bigrams_a_word(spark):
    own = spark.createDataFrame([("abcdefgh", 5), ("abcde", 3), ("zzzzz", 3)], "word string, n long")
    assert spelling.rarest(own).groupBy("word").count().agg(F.max("count")).first()[0] == spelling.PREFIX
