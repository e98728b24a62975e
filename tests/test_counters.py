"""Running counters of a stream: errors, retried batches, shares and times."""

import time

import pytest
from pyspark.sql import functions as F

from corpusmill.streaming import counters, feed

SCHEMA = "id long, level string, act string, state string, citations int"
ROWS = [(k, "1a" if k % 2 else "2a", None if k % 5 == 0 else f"act{k % 3}", ("new", "there", "error")[k % 3], k % 4 or None) for k in range(60)]


def found():
    return {
        "total": F.lit(True),
        "downloaded": F.col("state") == "new",
        "skipped": F.col("state") == "there",
        "errors": F.col("state") == "error",
        "organized": (F.col("state") != "error") & F.col("act").isNotNull(),
        "without_act": (F.col("state") != "error") & F.col("act").isNull(),
        "citations": F.col("citations"),
        "citations_done": F.when(F.col("state") != "error", F.col("citations")),
    }


def wanted():
    ok = [r for r in ROWS if r[3] != "error"]
    return {
        "total": len(ROWS), "indexed": 0, "downloaded": sum(r[3] == "new" for r in ROWS), "skipped": sum(r[3] == "there" for r in ROWS),
        "organized": sum(r[2] is not None for r in ok), "without_act": sum(r[2] is None for r in ok), "passed_over": 0,
        "citations": sum(r[4] or 0 for r in ROWS), "citations_done": sum(r[4] or 0 for r in ok), "errors": len(ROWS) - len(ok),
    }


@pytest.fixture
def panel(spark):
    own = counters.Panel()
    spark.streams.addListener(own)
    yield own
    spark.streams.removeListener(own)


def settled(panel, total):
    until = time.time() + 20
    while panel.snapshot()["total"] < total and time.time() < until:
        time.sleep(0.1)
    time.sleep(0.5)
    return panel.snapshot()


def put(spark, folder):
    for k in range(3):
        spark.createDataFrame(ROWS[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return feed.read(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, 1)


def test_a_sink_shows_each_counter(spark, tmp_path, panel):
    stream = put(spark, tmp_path)
    for _ in range(2):  # the second time nothing is left to do
        feed.run_once(counters.counted(stream, found()), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = settled(panel, len(ROWS))
    assert {f: got[f] for f in counters.FIELDS} == wanted()
    assert got["done"] == 40 and got["percent"] == pytest.approx(100 * 40 / 60) and got["left_s"] > 0


def test_a_handler_that_fails_and_reads_twice(spark, tmp_path):
    stream, own, calls, snaps = put(spark, tmp_path), counters.Panel(), [], []

    def handle(batch, number):
        calls.append(number)
        batch.write.mode("append").format("noop").save()
        if len(calls) == 2:
            raise OSError("lost after its rows were read")
        own.add_acts(batch.where("state <> 'error'"), batch=number)
        snaps.append(own.snapshot())

    run = lambda: feed.upsert_batches(stream, own.batches(found(), handle), f"{tmp_path}/ck").awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    got = own.snapshot()
    assert calls == [0, 1, 1, 2]
    assert {f: got[f] for f in counters.FIELDS} == wanted()
    assert [s["total"] for s in snaps] == [0, 20, 40] and all(0 <= s["percent"] <= 100 for s in snaps)
    acts = {}
    for _, level, act, state, _ in ROWS:
        if state != "error" and act is not None:
            acts[f"{level}/{act}"] = acts.get(f"{level}/{act}", 0) + 1
    assert got["acts"] == sorted(acts.items(), key=lambda a: (-a[1], a[0]))[: counters.TOP]


def test_snapshots_without_work_and_with_a_part_of_the_folders():
    now = [100.0]
    own = counters.Panel(folders=4, clock=lambda: now[0])
    assert own.snapshot() | {"acts": []} == dict.fromkeys(counters.FIELDS, 0) | {"done": 0, "percent": 0.0, "citations_percent": 0.0, "acts": [], "seconds": 0.0, "left_s": None}
    now[0] += 10
    assert own.add({"total": 10, "indexed": 1, "organized": 4, "without_act": 1, "other": 7, "errors": None}, ("q", 0))
    assert not own.add({"total": 10}, ("q", 0))
    got = own.snapshot()
    assert (got["done"], got["percent"], got["other"], got["errors"]) == (5, 50.0, 7, 0)
    assert got["left_s"] == (40 - 5) * 10 / 5
    own.add({"passed_over": 90})
    assert own.snapshot()["percent"] == 100.0
    assert own.lines()[0].startswith("gone 10s, left ") and [counters.duration(s) for s in (3.9, 123, 3723)] == ["3s", "2m03s", "1h02m03s"]
