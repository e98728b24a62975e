import random
import re

import pytest

from corpusmill.llm import near_dups


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """Over all pairs that share a shingle; rows of one doc_id are linked, but for those without words."""
    sets = [(i, shingles(t)) for i, t in rows]
    live = [k for k, (i, s) in enumerate(sets) if i is not None and s]
    root = {k: k for k in live}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def link(a, b):
        root[find(a)] = find(b)

    by_set, by_doc = {}, {}
    for k in live:
        i, s = sets[k]
        s = frozenset(s)
        link(k, by_set.setdefault(s, k))
        link(k, by_doc.setdefault(i, k))
    distinct, holders = list(by_set), {}
    for n, s in enumerate(distinct):
        for x in s:
            holders.setdefault(x, []).append(n)
    for n, s in enumerate(distinct):
        for m in {m for x in s for m in holders[x] if m > n}:
            if 100 * len(s & distinct[m]) >= 75 * len(s | distinct[m]):
                link(by_set[s], by_set[distinct[m]])
    least = {}
    for k in live:
        r = find(k)
        least[r] = min(least.get(r, sets[k][0]), sets[k][0])
    out = []
    for k, (i, s) in enumerate(sets):
        component = -1 if i is None else least[find(k)] if k in root else i
        out.append((i if i is not None else -1, len(s), component, i is None or i == component))
    return sorted(out)


def told(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1, r["kept"]) for r in df.collect())


def group(dice, n, words, edits, base):
    text = [f"w{base}x{dice.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        mine = list(text)
        for _ in range(dice.randint(0, edits)):
            mine[dice.randrange(words)] = f"e{dice.randrange(10**6)}"
        out.append(" ".join(mine))
    return out


@pytest.mark.parametrize("least", [256, 2])
def test_large_groups_and_edges(spark, monkeypatch, least):
    monkeypatch.setattr(near_dups, "LEAST", least)
    dice = random.Random(7)
    passage = " ".join(f"common{i}" for i in range(60))
    texts = group(dice, 120, 100, 4, 1) + group(dice, 40, 60, 3, 2)
    texts += [f"{passage} " + " ".join(f"u{dice.randrange(10**6)}" for _ in range(dice.randint(15, 90))) for _ in range(90)]
    texts += [None, "", "  \n ", "One two", "one TWO", "one two three", "É è é", "é è é", "a " * 9, "a " * 50, texts[0], texts[0].upper(), "word " * 2 + "tail " + "x y z " * 40_000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[0]), (None, None), (5000, "first of two texts for one id"), (5000, "one two three")]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, n_shingles int, root string")
    assert told(near_dups.near_duplicates(df)) == brute(rows)
    kept = near_dups.keep_one(df)
    assert kept.columns == df.columns


def test_keep_one_leaves_one_row_of_a_text(spark):
    t, other = "one two three four five six", "quite another text of seven words here"
    rows = [(1, t), (1, t), (2, t), (7, ""), (7, t), (8, other), (8, other), (8, other.upper()), (9, None), (9, None), (None, t), (None, None), (10, t + " x"), (11, other + " and " + "more " * 3)]
    df = spark.createDataFrame([(i, x, k, "a") for k, (i, x) in enumerate(rows)], "doc_id long, text string, number long, all string")
    got = near_dups.keep_one(df).collect()
    assert [r["doc_id"] for r in got if r["text"] and r["text"].lower() == t] in ([1, None], [None, 1])
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got if r["doc_id"] != 8) == sorted([(-1, t), (-1, ""), (1, t), (7, ""), (9, ""), (9, ""), (10, t + " x"), (11, rows[-1][1])])
    assert sum(r["doc_id"] == 8 for r in got) == 1
    assert near_dups.keep_one(df.limit(0)).count() == 0


def test_documents_with_several_texts_link_them_all(spark):
    dice = random.Random(9)
    fresh = [" ".join(f"w{dice.randrange(10**6)}" for _ in range(20)) for _ in range(6)]
    rows = [(5, fresh[0]), (5, fresh[1]), (5, fresh[2]), (3, fresh[1]), (9, fresh[2]), (2, fresh[2] + " tail"), (6, fresh[3]), (1, fresh[4]), (1, fresh[3]), (7, fresh[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(near_dups.near_duplicates(df)) == brute(rows)


def test_hot_keys_are_split(spark, monkeypatch):
    """A third of the rows copies of one text, and a third near-copies of another, with a bar of ten rows."""
    from corpusmill.llm import common

    monkeypatch.setattr(common, "LEAST_HEAVY", 10)
    dice = random.Random(11)
    texts = ["copy " * 3 + "of one text for all"] * 150 + group(dice, 150, 80, 3, 5) + [" ".join(f"u{dice.randrange(10**6)}" for _ in range(30)) for _ in range(150)] + [""] * 50
    rows = [*enumerate(texts), *[(7, texts[7])] * 60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(near_dups.near_duplicates(df)) == brute(rows)
    kept = {(r["doc_id"]): r["text"] for r in near_dups.keep_one(df).collect()}
    assert set(kept) == {i for i, _, _, k in brute(rows) if k}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dups.near_duplicates(df).count() == 0


def test_a_group_of_near_copies_makes_fewer_links_than_rows(spark):
    """All pairs of 80 near copies are similar; of a task's links only those that join two components are told."""
    from pyspark.sql import functions as F

    from corpusmill.llm import common, components

    dice = random.Random(13)
    texts = group(dice, 80, 200, 3, 8) + group(dice, 40, 200, 3, 9) + [" ".join(f"u{dice.randrange(10**6)}" for _ in range(30)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = common.materialize(near_dups.sketch(docs).select(F.col("doc_id").alias("id"), "signs", "digest"), "classes")
    leaves = classes.select(F.lit(1).cast("long").alias("node"), "id", F.col("id").alias("root"), F.lit(0).cast("long").alias("major"), F.lit(len(texts) - 1).cast("long").alias("minor"), F.lit(len(texts)).cast("long").alias("n"))
    links = near_dups.exhaustive(common.materialize(leaves, "leaves"), classes, docs, 75, 100)
    assert links.count() < len(texts)
    assert {(r["id"], r["root"]) for r in components.components(links).collect()} == {(i, 0 if i < 80 else 80) for i in range(120)}
