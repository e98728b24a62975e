import random

from corpusmill.operators import trees

EDGES, ID = "parent string, id string, name string", "id string"


def test_trees_deeper_than_a_hundred_levels_are_whole(spark):
    names = [(f"f{i}", f"f{i + 1}", f"n{i + 1}") for i in range(150)] + [("f150", "f3", "loop")]
    edges = spark.createDataFrame(names, "parent string, id string, name string").coalesce(1)
    found = {r["id"]: r["depth"] for r in trees.walk(edges, spark.createDataFrame([("f0",)], "id string").coalesce(1)).collect()}
    assert found == {f"f{i}": i for i in range(1, 151)}


def test_ancestors(spark):
    edges = spark.createDataFrame([("a", "b", "B"), ("b", "c", "Sessão 1"), ("z", "c", "Sessão 1"), ("c", "d", "D"), ("x", "y", "Y"), ("y", "x", "X")], "parent string, id string, name string")
    starts = spark.createDataFrame([("d",), ("c",), ("y",), ("a",)], "id string")
    roots = spark.createDataFrame([("a",), ("z",)], "id string")
    told = lambda *more: {r["id"]: (r["root"], r["depth"]) for r in trees.ancestors(edges, starts, roots, *more).collect()}
    assert told() == {"d": ("z", 2), "c": ("z", 1), "y": (None, None), "a": ("a", 0)}
    assert told(lambda name: name.startswith("Sess")) == {"d": ("c", 1), "c": ("c", 0), "y": (None, None), "a": ("a", 0)}


def diamonds(n):
    return [e for i in range(n) for e in ((f"t{i}", f"l{i}", "left"), (f"t{i}", f"r{i}", "right"), (f"l{i}", f"t{i + 1}", f"top{i + 1}"), (f"r{i}", f"t{i + 1}", f"top{i + 1}"))]


def test_shared_folders_are_entered_once(spark):
    """30 diamonds have 2^30 paths; a cycle leads from the last one to the first."""
    edges = spark.createDataFrame([*diamonds(30), ("t30", "t0", "loop")], EDGES).coalesce(1)
    rows = trees.walk(edges, spark.createDataFrame([("t0",), ("t29",)], ID).coalesce(1)).collect()
    assert len(rows) == 90 + 90 and len({(r["root"], r["id"]) for r in rows}) == 180
    last = next(r for r in rows if r["id"] == "t30" and r["root"] == "t0")
    assert last["depth"] == 60 and last["names"][:3] == ["left", "top1", "left"] and last["parent"] == "l29"


def test_failures_are_folded_upwards(spark):
    tree = diamonds(4)
    folders = sorted({e[0] for e in tree} | {"t4"})
    edges = lambda *more: spark.createDataFrame([*tree, *more], EDGES).coalesce(1)
    listed = lambda *bad: spark.createDataFrame([(i, i not in bad) for i in folders], "id string, ok boolean").coalesce(1)
    roots = spark.createDataFrame([("t0",), ("r3",), ("t4",), ("zz",)], ID).coalesce(1)
    ok = lambda e, told: {r["id"]: (r["ok"], r["folders"]) for r in trees.subtree_ok(e, told, roots).collect()}
    assert ok(edges(), listed("l2")) == {"t0": (False, 13), "r3": (True, 2), "t4": (True, 1), "zz": (False, 1)}
    assert ok(edges(("t4", "t0", "loop")), listed("l2")) == {"t0": (False, 13), "r3": (False, 13), "t4": (False, 13), "zz": (False, 1)}


def test_a_chain_of_a_thousand_takes_ten_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(f"f{i}", f"f{i + 1}", "n") for i in range(1000)], EDGES).coalesce(1)
    rounds, put = [], trees.Levels.put
    monkeypatch.setattr(trees.Levels, "put", lambda self, level: (rounds.append(self), put(self, level))[1])
    found = {r["id"]: (r["root"], r["depth"]) for r in trees.ancestors(edges, edges.select("id"), spark.createDataFrame([("f0",)], ID)).collect()}
    assert found == {f"f{i}": ("f0", i) for i in range(1, 1001)} and len(rounds) <= 2 * 12


def test_nearest_roots_of_random_graphs(spark):
    dice = random.Random(4)
    for _ in range(1):
        edges = list({(f"{dice.randrange(60)}", f"{dice.randrange(60)}") for _ in range(80)})
        roots, starts = [f"{i}" for i in range(4)], [f"{i}" for i in range(60)] + ["zz"]
        want = {}
        for start in starts:
            level, seen, depth = {start}, {start}, 0
            while level and not level & set(roots):
                level = {p for p, i in edges if i in level} - seen
                seen |= level
                depth += 1
            want[start] = (min(level & set(roots)), depth) if level else (None, None)
        e = spark.createDataFrame([(*x, "n") for x in edges], EDGES).coalesce(1)
        own, some = spark.createDataFrame([(x,) for x in starts], ID).coalesce(1), spark.createDataFrame([(x,) for x in roots], ID).coalesce(1)
        told = lambda df: {r["id"]: (r["root"], r["depth"]) for r in df.collect()}
        found = trees.ancestors(e, own, some)
        assert told(found) == want
        half = found.where("id < '30'")
        assert told(trees.ancestors(e, own, some, memo=half)) == want
        # a memo that knows all starts is enough
        assert told(trees.ancestors(e.limit(0), own.where("id < '30'"), some.limit(0), memo=half)) == {k: v for k, v in want.items() if k < "30"}
