import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.fold import folded
from corpusmill.operators import index, search

SCHEMA = "id string, text string"


def ranked(df):
    return {r["id"]: round(r["rank"], 9) for r in df.collect()}


@pytest.fixture
def own(spark, tmp_path):
    return index.TextIndex(spark, f"file://{tmp_path}/index", "id", "string")


def test_the_index_ranks_as_a_scan_does_through_all_changes(spark, own):
    dice = random.Random(3)
    words = ["alfa", "alfredo", "beta", "Béta", "gama", "йод", "Άλφα", "x1", "delta"]
    text = lambda: " ".join(dice.choice(words) for _ in range(dice.randrange(25)))
    state = {f"d{i}": text() for i in range(60)} | {"empty": "", "null": None}
    frame = lambda rows: spark.createDataFrame([*rows.items()], SCHEMA)

    def check(*more):
        docs = frame(state)
        for query, mode in (("beta gama", "words"), ("alfa alfa", "phrase"), *more):
            assert ranked(own.search(query, mode)) == ranked(search.search_full_text(docs, "id", F.col("text"), query, mode)), query

    own.put(frame(state), F.col("text"))
    check(("alf", "words"), ("beta", "phrase"), ("beta gama alfa", "phrase"), ("йод", "words"), ("zzz", "words"), ("!?", "words"))
    fresh = {f"d{i}": text() for i in range(50, 70)}
    own.add(frame(fresh), F.col("text"))
    state = fresh | state
    check()
    changed, gone = {f"d{i}": text() for i in range(10)}, [f"d{i}" for i in range(5, 25)]
    own.saved(frame(changed), F.col("text"), frame(dict.fromkeys(gone)))
    state = {k: v for k, v in (state | changed).items() if k not in gone}
    check()
    own.put(frame({"d6": "alfa beta gama"}), F.col("text"))
    state["d6"] = "alfa beta gama"
    check()
    half = frame({k: v for k, v in state.items() if k < "d4"})
    assert set(ranked(own.search("alf", inside=half))) == {k for k in ranked(own.search("alf")) if k < "d4"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_query_reads_its_buckets_alone(spark, own, monkeypatch):
    monkeypatch.setattr(index, "SMALL", 0)
    for docs, large in (("a", index.LARGE), ("b", 0)):
        monkeypatch.setattr(index, "LARGE", large)
        own.put(spark.createDataFrame([(docs, "alfa beta"), (docs + "2", "gama")], SCHEMA), F.col("text"))
    plan = plan_of(own.postings(["alf"], True))
    assert len(re.findall(r"PartitionFilters: \[.*?bucket#\d+ = \d+", plan)) == 2 and plan.count("StringStartsWith(token,alf)") == 2
    assert set(ranked(own.search("a"))) == {"a", "b"} and set(ranked(own.search("alfa beta", "phrase"))) == {"a", "b"}
    # no table of all documents is read
    assert "/docs" not in "".join(own.search("alf").inputFiles())


def test_a_call_that_was_cut_short_does_not_count(spark, own, monkeypatch):
    own.put(spark.createDataFrame([("a", "alfa")], SCHEMA), F.col("text"))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(index, "put_new", lambda *x: (_ for _ in ()).throw(RuntimeError("lost")))
        own.put(spark.createDataFrame([("b", "alfa"), ("a", "beta")], SCHEMA), F.col("text"))
    assert set(ranked(own.search("alfa"))) == {"a"}
    own.vacuum()
    assert set(ranked(own.search("alfa"))) == {"a"} and len(index.names(spark, own.folder)) == 2


def test_two_writers_at_a_time_are_an_error(spark, own):
    own.put(spark.createDataFrame([("a", "alfa")], SCHEMA), F.col("text"))
    now = own.manifest()
    own._commit(now, docs=now["docs"])
    with pytest.raises(Exception, match="(?i)exist"):
        own._commit(now, docs=0)
    assert own.manifest()["docs"] == 1


def test_keys_must_be_known_and_distinct(spark, own):
    for rows in ([("a", "x"), ("a", "y")], [(None, "x")]):
        with pytest.raises(ValueError, match="null or comes twice"):
            own.put(spark.createDataFrame(rows, SCHEMA), F.col("text"))
    assert own.manifest()["runs"] == []


def test_runs_are_merged_by_tiers(spark, own, monkeypatch):
    """After many calls a search equals the scan; after a whole merge it reads as many files as after one call."""
    monkeypatch.setattr(index, "FAN", 3)
    dice, state = random.Random(1), {}
    words = ["alfa", "alfredo", "beta", "gama", "delta"]
    for turn in range(14):
        fresh = {f"d{dice.randrange(30)}": " ".join(dice.choices(words, k=4)) for _ in range(4)}
        own.put(spark.createDataFrame([*fresh.items()], SCHEMA).coalesce(1), F.col("text"))
        state |= fresh
        if turn % 4 == 3:
            gone = sorted(state)[:2]
            own.remove(spark.createDataFrame([(g,) for g in gone], "id string"))
            state = {k: v for k, v in state.items() if k not in gone}
    assert len(own.manifest()["runs"]) <= 6
    check = lambda: all(ranked(own.search(q, m)) == ranked(search.search_full_text(spark.createDataFrame([*state.items()], SCHEMA), "id", F.col("text"), q, m)) for q, m in (("alf be", "words"), ("gama delta", "phrase")))
    assert check()
    own.merge(every=True)
    own.vacuum()
    now = own.manifest()
    assert check() and len(now["runs"]) == 1 and now["dead"] is None and now["docs"] == len(state) == now["runs"][0]["docs"]
    assert len(own.search("alf").inputFiles()) == 1


def test_an_index_of_a_table_follows_its_files(spark, tmp_path):
    path = f"file://{tmp_path}/docs.parquet"
    for text in ("alfa", "beta"):
        spark.createDataFrame([(1, text)], "id long, text string").write.mode("overwrite").parquet(path)
        own = index.of_table(spark, path, "id", "text")
        assert own is index.of_table(spark, path, "id", "text")
        assert [r["id"] for r in own.search(text).collect()] == [1]


def test_tokens_are_grouped_within_their_row(spark):
    texts = [[], ["b", "a", "b", "b", "c"], ["x"] * 5]
    rows = spark.createDataFrame([(t,) for t in texts], "t array<string>").select(index.grouped("t").alias("g")).collect()
    assert [[(w["token"], w["places"]) for w in r["g"] or []] for r in rows] == [[], [("a", [1]), ("b", [0, 2, 3]), ("c", [4])], [("x", [0, 1, 2, 3, 4])]]


def test_queries_fold_as_texts_do(spark):
    texts = ["йод", "ЙОД", "Άλφα ΏΡΑ", "İstanbul", "é", "é", "ﬁ", "Ǆ", "한글", "क़", "ñandú"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    from corpusmill.functions.fold import fold

    assert [r[0] for r in rows.select(fold(F.col("t"))).collect()] == [folded(t) for t in texts]
    docs = spark.createDataFrame([*enumerate(texts)], "id long, text string")
    for i, t in enumerate(texts):
        for found in (search.search_full_text(docs, "id", F.col("text"), t), search.search_static(docs, F.col("text"), {}, t)):
            assert i in {r["id"] for r in found.collect()}, t


@pytest.mark.parametrize("piece", [1 << 18, 7])
def test_postings_of_many_rows_are_those_of_each(spark, monkeypatch, piece):
    monkeypatch.setattr(index, "PIECE", piece)
    dice = random.Random(5)
    texts = [[dice.choice(["a", "b", "ä", "bb", "йод", ""]) for _ in range(n)] for n in (0, 1, 5, 40, 0, 0, 3, 12, 0)]
    rows = spark.createDataFrame([(f"k{i}", t, 3, 10**12 + i) for i, t in enumerate(texts)], "id string, t array<string>, gen int, ord long").coalesce(1)
    got = index.postings_of(rows, "id", "string").collect()
    want = {(f"k{i}", w): [j for j, x in enumerate(t) if x == w] for i, t in enumerate(texts) for w in t}
    assert {(r["id"], r["token"]): r["places"] for r in got} == want and len(got) == len(want)
    assert all((r["n"], r["tf"], r["gen"], r["ord"]) == (len(texts[int(r["id"][1:])]), len(r["places"]), 3, 10**12 + int(r["id"][1:])) for r in got)
    assert index.postings_of(rows.limit(0), "id", "string").count() == 0
