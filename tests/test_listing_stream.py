"""The listing as a stream: restarts, late items, failing calls and tasks, slices of a folder's time."""

import json
import os
from datetime import UTC, datetime

import pytest

from corpusmill.sources import listing
from corpusmill.streaming import feed, incremental

STORE = "/tmp/corpusmill-listing-store"


class Store:
    """Items and the time are files of a folder; pages of two items; the bounds are not looked at."""

    def __init__(self):
        self.folder = open(STORE).read()

    def load(self, name):
        with open(os.path.join(self.folder, name)) as f:
            return json.load(f)

    def now(self):
        return self.load("now")

    def page(self, folder, token, pushed):
        with open(os.path.join(self.folder, "calls"), "a") as out:
            out.write(json.dumps([folder, token, pushed]) + "\n")
        items = self.load("items")[folder]
        n = int(token or 0)
        return items[n : n + 2], str(n + 2) if n + 2 < len(items) else None


@pytest.fixture
def store(spark, tmp_path):
    folder = tmp_path / "store"
    folder.mkdir()
    with open(STORE, "w") as out:
        out.write(str(folder))

    def put(now, **items):
        (folder / "now").write_text(json.dumps(now))
        (folder / "items").write_text(json.dumps({f: [{"id": i, "name": i, "modifiedTime": t} for i, t in rows] for f, rows in items.items()}))
        (folder / "calls").write_text("")

    put.calls = lambda: [json.loads(line) for line in (folder / "calls").read_text().splitlines()]
    return put


def test_restarts_lose_and_repeat_nothing(spark, tmp_path, store):
    stream = lambda **o: feed.changes(spark, "tests.test_listing_stream.Store", "f,g", wait="0", **o)
    run = lambda: feed.run_once(stream().select("id", "modifiedTime"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    rows = lambda: sorted((r["id"], r["modifiedTime"] or "") for r in spark.read.schema("id string, modifiedTime string").parquet(f"{tmp_path}/out").collect())
    first = [("a", "2099-01-01T10:00:00Z"), ("b", "2099-01-01T09:00:00Z"), ("n", None)]
    store("2099-01-01T10:00:01Z", f=first, g=[("c", "2099-01-01T09:59:00.5Z"), ("z", "2099-01-01T10:00:01Z")])
    run()
    want = [("a", first[0][1]), ("b", first[1][1]), ("c", "2099-01-01T09:59:00.5Z"), ("n", "")]
    assert rows() == want  # z is of the next interval
    # shown late: d lies 299 s behind the last listing; a changed; e is new; old ones come again and are dropped
    second = [*first, ("d", "2099-01-01T09:55:02Z"), ("a", "2099-01-01T10:03:00Z")]
    store("2099-01-01T10:04:00Z", f=second, g=[("c", "2099-01-01T09:59:00.5Z"), ("z", "2099-01-01T10:00:01Z"), ("e", "2099-01-01T10:00:02+00:00")])
    run()
    want += [("a", "2099-01-01T10:03:00Z"), ("d", "2099-01-01T09:55:02Z"), ("e", "2099-01-01T10:00:02+00:00"), ("z", "2099-01-01T10:00:01Z")]
    assert rows() == sorted(want)
    assert all(p["from"] == "2099-01-01T09:55:01.000000Z" and p["before"] == "2099-01-01T10:04:00.000000Z" for *_, p in store.calls())
    store("2099-01-01T10:05:00Z", f=second, g=[])
    run()
    assert rows() == sorted(want)


def test_a_batch_that_fails_is_listed_again(spark, tmp_path, store):
    store("2099-01-01T10:00:00Z", f=[(f"i{k}", f"2099-01-01T09:{k:02}:00Z") for k in range(7)], g=[])
    seen = []

    def write(batch, number):
        seen.append((number, sorted(r["id"] for r in batch.collect())))
        if len(seen) == 1:
            raise OSError("lost")

    stream = lambda: feed.changes(spark, "tests.test_listing_stream.Store", "f", wait="0")
    with pytest.raises(Exception, match="lost"):
        feed.upsert_batches(stream(), write, f"{tmp_path}/checkpoint").awaitTermination()
    feed.upsert_batches(stream(), write, f"{tmp_path}/checkpoint").awaitTermination()
    assert seen[:2] == [(0, [f"i{k}" for k in range(7)])] * 2 and not any(ids for _, ids in seen[2:])


def test_the_feed_goes_into_versioned_state(spark, tmp_path, store):
    from pyspark.sql import functions as F

    state, kinds = f"file://{tmp_path}/state", incremental.KINDS
    incremental.begin(state, 4, **{k: spark.createDataFrame([], s) for k, s in kinds.items()})
    handle = lambda todo: todo.select("id", F.when(F.col("id") == 2, F.lit("x")).alias("error"))
    table = lambda name: sorted(tuple(r) for r in incremental.tables(spark, state).read(name).collect())

    def run():
        rows = feed.changes(spark, "tests.test_listing_stream.Store", "f", wait="0").select(F.col("id").cast("long").alias("id"), F.col("modifiedTime").alias("modified"))
        incremental.run(rows, state, handle, F.lit(True), F.lit(True), f"{tmp_path}/checkpoint").awaitTermination()

    store("2099-01-01T10:00:00Z", f=[("1", "2099-01-01T09:00:00Z"), ("2", "2099-01-01T09:30:00Z")])
    run()
    assert (table("revisions"), table("pending")) == ([(1, "2099-01-01T09:00:00Z")], [(2, "2099-01-01T09:30:00Z")])
    store("2099-01-01T11:00:00Z", f=[("1", "2099-01-01T10:30:00Z"), ("2", "2099-01-01T09:30:00Z")])
    run()
    assert (table("revisions"), table("pending")) == ([(1, "2099-01-01T10:30:00Z")], [(2, "2099-01-01T09:30:00Z")])


def test_intervals_are_cut_without_gaps():
    reader = listing.ListingStreamReader({"path": "f,g", "slices": "3", "overlap": "60"})
    cuts = reader.partitions({"until": "2099-01-01T10:00:00Z"}, {"until": "2099-01-01T10:02:00Z"})
    assert [(c.folder, c.start[11:19], c.end[11:19]) for c in cuts] == [(f, a, b) for f in "fg" for a, b in (("09:59:00", "10:00:00"), ("10:00:00", "10:01:00"), ("10:01:00", "10:02:00"))]
    assert [(c.folder, c.start) for c in reader.partitions({"until": ""}, {"until": "2099-01-01T10:02:00Z"})] == [("f", ""), ("g", "")]
    assert listing.moment("not a time") is None and listing.moment("2099-01-01") == datetime(2099, 1, 1, tzinfo=UTC)
    assert listing.request("f", {"from": "a", "before": "b"}) == "('f' in parents) and trashed=false and modifiedTime >= 'a' and modifiedTime < 'b'"
