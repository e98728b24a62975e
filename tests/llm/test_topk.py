import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import queries, topk


def brute(rows, every, k):
    rows = [(i, np.floor(np.array(v, float) * 64)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for i, q in rows:
        if i % every == 0:
            found = sorted((-int(q @ c), j) for j, c in rows if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def told(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert told(queries.op6_top_k(spark, "/root/testdata/sf0.01")) == brute(rows, 20, 20)


def test_ties_skew_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 8)
    dice = np.random.default_rng(5)
    rows = [(i, list(map(float, dice.normal(size=24) * dice.choice([0.05, 1, 3])))) for i in range(300)]
    rows += [(1000 + i, [1.0] * 24) for i in range(60)]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 22), (2002, [float("nan")] * 24), (2003, [float("inf")] * 24), (2004, [0.0] * 24), (2020, [-1.0] * 24)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, n int")
    assert told(topk.top_k(df, F.col("vec_id") % 20 == 0, 5)) == brute(rows, 20, 5)


def test_scores_are_exact_to_the_limit_of_a_long(spark):
    """Around 2^53 doubles begin to round; the last scores are those next to 2^63."""
    big = [(0, [94906265.0, 94906267.0, 1.0]), (1, [94906266.0, 94906265.0, 3.0]), (2, [94906266.0, 94906265.0, 2.0]), (3, [2e9 + 1, 2e9 + 3, 5.0]), (20, [2e9 + 7, 2e9 + 9, 11.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    want = []
    for i, q in big:
        if i % 20 == 0:
            found = sorted((-sum(int(a) * int(b) for a, b in zip(q, c)), j) for j, c in big if j != i)
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    assert told(topk.top_k(df, F.col("vec_id") % 20 == 0, 5, 1.0)) == sorted(want)
    edge = spark.createDataFrame([(0, [3037000499.0, 1.0]), (1, [3037000499.0, 5.0]), (2, [-3037000499.0, 7.0])], "vec_id long, embedding array<double>")
    assert told(topk.top_k(edge, F.col("vec_id") == 0, 5, 1.0)) == [(0, 1, 1, 3037000499**2 + 5), (0, 2, 2, 7 - 3037000499**2)]
    beyond = spark.createDataFrame([(0, [4e9]), (1, [4e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(beyond, F.col("vec_id") == 0, 5, 1.0).collect()


def test_lengths_are_searched_among_their_own(spark):
    rows = [(0, [1.0]), (1, [2.0]), (20, [1.0, 1.0]), (21, [0.5, 1.0]), (22, [3.0, 0.0]), (40, []), (41, []), (None, [1.0]), (60, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert told(topk.top_k(df, F.col("vec_id") % 20 == 0)) == [(0, 1, 1, 8192), (20, 1, 22, 12288), (20, 2, 21, 6144), (40, 1, 41, 0)]


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [-1.0]), (3, [0.5])], "vec_id long, embedding array<float>")
    assert told(topk.top_k(df, F.col("vec_id") % 20 == 0)) == [(0, 1, 3, 2048), (0, 2, 20, -4096), (20, 1, 3, -2048), (20, 2, 0, -4096)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") % 20 == 7).count() == 0


def test_exploded_rows_are_shuffled_not_broadcast(spark):
    """Spark takes exploded rows for as many bytes as before; such a side must not reach the driver for a join."""
    from corpusmill.llm.common import split_join

    left = spark.range(20).select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    right = spark.range(10).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("double"))
    met = split_join(left, right, "k", left.groupBy("k").agg(F.count("*").alias("n")), F.col("id"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [k" in plan and sorted(map(tuple, met.select("id", "k", "double").collect())) == [(i, k, 2 * k) for i in range(20) for k in range(10)]


@pytest.mark.parametrize(("top", "size"), [(127, 1), (-128, 2), (32768, 4), (-(2.0**31), 8), (2.0**60, 8)])
def test_packed_vectors_come_back_whole(top, size):
    x = np.array([[top, 0.0], [-1.0, 3.0]])
    data = topk.packed(x)
    assert len(data) == 1 + 4 * size and (topk.unpacked(data, 2) == x).all()
