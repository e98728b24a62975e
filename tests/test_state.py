import random

from pyspark.sql import functions as F

from corpusmill.operators import state
from corpusmill.sources import sinks


def one_by_one(rows):
    """The first row of a path keeps it; each further one takes the least number that no path and no row before it has."""
    literal, taken, names = {p for _, p in rows}, set(), {}
    for key, path in sorted(rows):
        if path not in names.values() and path not in taken:
            name = path
        else:
            stem, dot, ending = path.partition(".")
            n = 1
            while f"{stem} ({n}){dot}{ending}" in literal | taken:
                n += 1
            name = f"{stem} ({n}){dot}{ending}"
        taken.add(name)
        names[key] = name
    return names


def test_no_two_rows_share_a_name(spark):
    dice = random.Random(9)
    for trial in range(4):
        rows = [(i, dice.choice(["a", "b", "a.txt"])) for i in range(40)]
        for i in range(40, 80):
            stem, dot, ending = dice.choice(["a", "b", "a.txt", "a (1)", "a (2).txt"]).partition(".")
            rows.append((i, f"{stem} ({dice.choice([1, 2, 3, 5, 8, 9, 30, '01', 0, 10**15])}){dot}{ending}"))
        dice.shuffle(rows)
        rows = [(i, p) for i, (_, p) in enumerate(rows)]
        df = spark.createDataFrame(rows, "id long, path string").repartition(3)
        stem = F.substring_index("path", ".", 1)
        got = {r["id"]: r["unique_name"] for r in state.unique_suffix(df, "path", [F.col("id")], stem, F.substr("path", F.length(stem) + 1)).collect()}
        assert len(set(got.values())) == len(rows) and got == one_by_one(rows), trial


def test_verified_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a (1)"), (4, "a (2)"), (5, None), (6, None)], "id long, path string")
    got = {r["id"]: r["unique_name"] for r in state.unique_suffix(df, "path", [F.col("id")], F.col("path"), F.lit("")).collect()}
    assert got == {1: "a", 2: "a (3)", 3: "a (1)", 4: "a (2)", 5: None, 6: None}


def test_numbers_run_over_ranges_of_a_hot_key(spark):
    df = spark.range(5000).select((F.col("id") % 50 == 0).alias("cold"), F.when(F.col("id") % 2 == 0, "x").alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = state.numbered(df, ["k"], [F.desc("id")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["k"], r["id"]): r["_k"] for r in got} == {("x" if i % 2 == 0 else None, i): (4999 - i) // 2 + 1 for i in range(5000)}


def test_null_keys_are_equal(spark, tmp_path):
    old, new = spark.createDataFrame([(1, None), (None, "a")], "id long, v string"), spark.createDataFrame([(None, "b"), (2, None)], "id long, v string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(state.insert_if_absent(old, new, ["id"])) == [(1, None), (2, None), (None, "a")]
    assert rows(state.upsert(old, new, ["id"], ["v"])) == [(1, None), (2, None), (None, "b")]
    assert rows(state.delete_by(old, new, ["id"])) == [(1, None)]
    path = f"file://{tmp_path}/csv"
    for _ in range(3):
        known = spark.read.option("header", True).csv(path) if sinks.exists(spark, path) else None
        sinks.csv_rows(spark.createDataFrame([("p", None, "x"), ("p", "s", None), ("p", None, "x")], "protocol string, subject string, act string"), path, known)
    assert rows(spark.read.option("header", True).csv(path)) == [("p", "s", None), ("p", None, "x")]
