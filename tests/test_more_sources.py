"""SQLite files, limits, listing requests, trees of any depth, folders that keep what is there, pending errors."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import extract, records
from corpusmill.operators import export, state, trees
from corpusmill.sources import limits, listing, sinks, sqlite
from corpusmill.streaming import incremental


@pytest.fixture
def cache(tmp_path):
    path = tmp_path / "cache.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE arquivos (file_id TEXT, file_name TEXT, file_size TEXT, destination TEXT, instancia TEXT)")
    con.executemany("INSERT INTO arquivos VALUES (?, ?, ?, ?, ?)", [("a", "x.pdf", 3, "/d/x.pdf", "1a_instancia"), ("b", None, None, "", "é")])
    con.execute("CREATE TABLE sif_pares (file_id TEXT, pares TEXT)")
    con.executemany("INSERT INTO sif_pares VALUES (?, ?)", [("a", '[["LEI 1/01", "X"], ["LEI 2/02", null]]'), ("b", None)])
    con.execute("CREATE TABLE index_folders (folder_id TEXT, folder_name TEXT, instancia TEXT, indexed_at REAL)")
    con.execute("INSERT INTO index_folders VALUES ('f', 'n', '2a_instancia', 1.5)")
    con.commit()
    con.close()
    return f"file://{path}"


def test_sqlite_tables(spark, cache):
    assert [tuple(r) for r in sqlite.read(spark, cache, "arquivos").orderBy("file_id").collect()] == [("a", "x.pdf", "3", "/d/x.pdf", "1a_instancia"), ("b", None, None, "", "é")]
    assert sqlite.read(spark, cache, "index_folders").first()["indexed_at"] == 1.5
    assert [(r["file_id"], r["state"], r["pairs"] and [tuple(p) for p in r["pairs"]]) for r in sqlite.pairs(sqlite.read(spark, cache, "sif_pares")).orderBy("file_id").collect()] == [("a", "pairs", [("LEI 1/01", "X"), ("LEI 2/02", None)]), ("b", "none", None)]
    with pytest.raises(Exception, match="no such table"):
        sqlite.read(spark, cache, "meta").collect()


def test_count_probe_is_zero_on_any_error(spark, cache, tmp_path):
    (tmp_path / "no.db").write_bytes(b"not a database" * 100)
    assert sqlite.count(spark, cache) == 2
    assert sqlite.count(spark, cache, "meta") == 0
    assert sqlite.count(spark, f"file://{tmp_path}/no.db") == 0
    assert sqlite.count(spark, f"file://{tmp_path}/missing.db") == 0


def test_limiter_keeps_its_interval():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    one = limits.RateLimiter(4, lambda: now[0], sleep)
    starts = []
    for pause in (0, 0, 1, 0.1):
        now[0] += pause
        starts.append(one.wait())
    assert starts == [0, 0.25, 1.25, 1.5] and slept[0] == 0.25


def test_listing_request():
    pushed = {"after": "2099-01-01T00:00:00Z", "types": ["b", "a"], "name": "it's"}
    assert listing.request("f'1", pushed) == "('f\\'1' in parents) and trashed=false and modifiedTime > '2099-01-01T00:00:00Z' and (mimeType='a' or mimeType='b') and name contains 'it\\'s'"
    assert listing.request("f", {"from": "t"}) == "('f' in parents) and trashed=false and modifiedTime >= 't'"


def test_listing_pushes_lists_and_parts_of_names():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, StringContains, StringStartsWith

    reader = listing.ListingReader({})
    filters = [In(("mimeType",), ("x", "y")), StringStartsWith(("name",), "oto"), StringContains(("name",), "x"), GreaterThanOrEqual(("modifiedTime",), "t"), EqualTo(("size",), "3")]
    assert list(reader.pushFilters(filters)) == filters
    assert reader.pushed == {"types": ["x", "y"], "name": "oto", "from": "t"}


def test_subtree_success(spark):
    edges = spark.createDataFrame([("a", "b", "n"), ("b", "c", "n"), ("x", "y", "n"), ("y", "x", "n")], "parent string, id string, name string")
    listed = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("x", True), ("y", True)], "id string, ok boolean")
    roots = spark.createDataFrame([("a",), ("c",), ("x",), ("z",)], "id string")
    assert {r["id"]: (r["ok"], r["folders"]) for r in trees.subtree_ok(edges, listed, roots).collect()} == {"a": (False, 3), "c": (False, 1), "x": (True, 2), "z": (False, 1)}


def test_fan_out_keeps_what_is_there(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    schema = "level string, law string, act string, id long, body string"
    sinks.fan_out(spark.createDataFrame([("1", "L", "A", 1, "old"), ("1", "L", "A", 1, "old")], schema), path)
    sinks.fan_out(spark.createDataFrame([("1", "L", "A", 1, "new"), ("1", "L", "A", 2, "new")], schema), path)
    assert sorted((r["id"], r["body"]) for r in spark.read.parquet(path).collect()) == [(1, "old"), (2, "new")]


def test_checkpoint_object_replaces_the_old_one(spark, tmp_path):
    path = f"file://{tmp_path}/marco.json"
    for n in (1, 2):
        sinks.checkpoint_object({"n": n}, path, spark)
    assert (tmp_path / "marco.json").read_text().strip() == '{\n  "n": 2\n}'
    assert not (tmp_path / "marco.json.part").exists()


def test_errors_stay_pending_until_they_are_handled(spark, tmp_path):
    base, schema = f"file://{tmp_path}/state", "id long, modified string"
    feed = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3")], schema)
    none = feed.limit(0)
    incremental.begin(base, known=none, revisions=none, pending=none)
    bad = lambda *ids: lambda todo: todo.select("id", F.when(F.col("id").isin(*ids), F.lit("x")).alias("error"))
    rows = lambda name: sorted(tuple(r) for r in incremental.tables(spark, base).read(name).collect())
    for _ in range(2):  # a batch that runs again leaves the same
        incremental.step(feed, 0, base, bad(2), F.lit(True), F.lit(True))
        assert (rows("pending"), rows("revisions"), rows("known")) == ([(2, "t2")], [(1, "t1"), (3, "t3")], [(1,), (3,)])
    incremental.step(spark.createDataFrame([(3, "t3"), (1, "t9")], schema), 1, base, bad(99), F.lit(True), F.lit(True))
    assert (rows("pending"), rows("revisions")) == ([], [(1, "t9"), (2, "t2"), (3, "t3")])


def test_small_rules(spark):
    rows = spark.createDataFrame([("a", "p.PDF", "", "k", "b"), ("b", "q", None, None, None)], "id string, path string, first string, second string, target_id string")
    told = records.decorated(F.col("path"), F.col("id"), F.col("first"), F.col("second"))
    assert [tuple(r) for r in rows.select(*[c.alias(n) for n, c in told.items()]).collect()] == [(".pdf", "k", "a", True), ("", None, "b", False)]
    assert [(r["id"], r["target_path"]) for r in export.with_targets(rows, shown=("path",)).orderBy("id").collect()] == [("a", "q"), ("b", None)]
    names = spark.createDataFrame([("b",), ("Á",), ("a",), ("B",), ("á",), ("c",)], "n string")
    assert [r["n"] for r in names.orderBy(export.in_locale(F.col("n"))).collect()] == ["a", "á", "Á", "b", "B", "c"]
    assert state.cleared(rows).count() == 0 and state.cleared(rows).columns == rows.columns
    one = spark.createDataFrame([(10, 2, 5, False), (10, 0, 5, False), (10, 2, 5, True)], "d long, f long, n long, c boolean")
    assert [r[0] for r in one.select(export.expected_total(F.col("d"), F.col("f"), F.col("n"), F.col("c"))).collect()] == [25, 10, 10]


def test_act_blocks_end_at_labels_without_accents(spark):
    texts = ["ATO  OU FATO CONSTITUTIVO DA INFRACAO x\nline one\n DESCRICAO  COMPLEMENTAR z", "ATO OU FATO CONSTITUTIVO DA INFRAÇÃO\nline one\nMEDIDA  AFERIDA"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0] for r in rows.select(extract.block(F.col("t"), extract.ACT_HEAD, extract.ACT_STOPS)).collect()} == {"line one"}


def test_marks_of_a_long_text_take_time_in_proportion(spark):
    from corpusmill.functions import text

    raw = "é & ação " * 20_000
    got = spark.createDataFrame([(raw,)], "t string").select(text.highlight(F.col("t"), ["acao"])).first()[0]
    assert got == "é &amp; <mark>ação</mark> " * 20_000


def test_a_batch_is_classified_once(spark, tmp_path):
    from pyspark.sql import functions as F

    base, asked = f"file://{tmp_path}/state", spark.sparkContext.accumulator(0)
    none = spark.createDataFrame([], "id long, modified string")
    incremental.begin(base, known=none.select("id"), revisions=none, pending=none)

    @F.udf("boolean")
    def seen(i):
        asked.add(1)
        return i % 2 == 0

    feed = spark.range(40).select("id", F.lit("t1").alias("modified")).coalesce(1)
    incremental.step(feed, 0, base, lambda todo: todo.select("id", F.lit(None).cast("string").alias("error")), seen.asNondeterministic()("id"), F.lit(True))
    assert sorted(r["id"] for r in incremental.tables(spark, base).read("known").collect()) == list(range(0, 40, 2))
    assert asked.value == 40
