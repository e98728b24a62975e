import json
import os
import time

import pytest

from corpusmill.operators import keyed
from corpusmill.session import ship
from corpusmill.sources import limits, lookup

KINDS = {"a": "id long, v string", "b": "id long"}


class Recording:
    """A client that writes down every call; 3 fails at first, 4 always, odd numbers from 5 on are absent."""

    def __init__(self):
        self.folder = open("/tmp/corpusmill-recording").read()

    def get(self, key):
        calls = os.path.join(self.folder, f"{key}-{time.time_ns()}")
        with open(calls, "w") as out:
            out.write(str(time.time()))
        asked = sum(name.startswith(f"{key}-") for name in os.listdir(self.folder))
        if key == "4" or (key == "3" and asked == 1):
            raise OSError("no answer")
        return None if int(key) > 4 and int(key) % 2 else f"v{key}"


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    with open("/tmp/corpusmill-recording", "w") as out:
        out.write(str(folder))
    return lambda: sorted((float((folder / name).read_text()), name.split("-")[0]) for name in os.listdir(folder))


def test_a_change_rewrites_its_buckets_alone(spark, tmp_path):
    own = keyed.KeyedTables(spark, f"file://{tmp_path}/state", KINDS, buckets=16)
    rows = lambda name: sorted(tuple(r) for r in own.read(name).collect())
    own.commit({"a": (spark.range(500).selectExpr("id", "'old' v"), None), "b": (spark.range(10), None)}, batch=0)
    before = own.manifest()["tables"]
    change = spark.createDataFrame([(3, "new"), (1000, "new")], KINDS["a"])
    gone = spark.createDataFrame([(7,), (9999,)], "id long")
    assert own.commit({"a": (change, gone)}, batch=1)
    after = own.manifest()["tables"]
    touched = own.buckets_of(change, gone)
    assert {b for b in after["a"] if before["a"][b] != after["a"][b]} <= set(map(str, touched)) and len(touched) <= 4 and before["b"] == after["b"]
    want = sorted({**{i: "old" for i in range(500) if i != 7}, 3: "new", 1000: "new"}.items())
    assert rows("a") == want
    assert not own.commit({"a": (change.limit(0), spark.range(500))}, batch=1) and rows("a") == want  # a batch that runs again
    own.vacuum()
    assert rows("a") == want and rows("b") == [(i,) for i in range(10)]
    own.commit({"b": (None, spark.range(10))})
    assert rows("b") == []
    for bad in ([(1, "x"), (1, "y")], [(None, "x")]):
        with pytest.raises(ValueError, match="null or comes twice"):
            own.commit({"a": (spark.createDataFrame(bad, KINDS["a"]), None)})


def test_slots_of_callers_lie_apart():
    now = [0.0]
    sleep = lambda s: now.__setitem__(0, now[0] + s)
    one = limits.Slots(4, 1, 2, lambda: now[0], sleep)
    starts = []
    for pause in (0, 0, 0.6, 0):
        now[0] += pause
        starts.append(one.wait())
    assert starts == [0.25, 0.75, 1.75, 2.25]  # a lost slot is not made up for


def test_a_registry_is_asked_once_and_never_too_fast(spark, tmp_path, calls):
    ship(spark)
    spark.sparkContext.addPyFile(__file__)
    table = lookup.memory(spark, f"file://{tmp_path}/memory")
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "key string")
    ask = lambda k, **more: {r["key"]: (r["state"], r["value"], r["attempts"]) for r in lookup.resolve(k, table, "test_keyed.Recording", 20, tasks=4, **more).collect()}
    first = ask(keys("1", "2", "2", None, "3", "4", "5", "6", "1"), tries=1)
    assert first == {"1": ("found", "v1", 1), "2": ("found", "v2", 1), "3": ("failed", None, 1), "4": ("failed", None, 1), "5": ("absent", None, 1), "6": ("found", "v6", 1)}
    assert sorted(k for _, k in calls()) == list("123456")
    # failed and new ones alone
    second = ask(keys("1", "3", "4", "5", "8"), tries=2)
    assert second == {"1": ("found", "v1", 1), "3": ("found", "v3", 2), "4": ("failed", None, 3), "5": ("absent", None, 1), "8": ("found", "v8", 1)}
    assert sorted(k for _, k in calls()) == sorted("123456" + "3448")
    assert ask(keys("4"), again=3) == {"4": ("failed", None, 3)} and len(calls()) == 10
    assert ask(keys("5"), absent_for="0 seconds")["5"] == ("absent", None, 2)
    ask(keys(*map(str, range(100, 140, 2))))
    times = [t for t, k in calls() if int(k) >= 100]
    assert len(times) == 20 and max(sum(a <= t < a + 0.5 for t in times) for a in times) <= 0.5 * 20 + 1


def test_manifests_are_plain_json(spark, tmp_path):
    own = keyed.KeyedTables(spark, f"file://{tmp_path}/state", KINDS)
    own.commit({"b": (spark.range(3), None)})
    assert json.loads((tmp_path / "state/manifest/000000000001.json").read_text())["number"] == 1
