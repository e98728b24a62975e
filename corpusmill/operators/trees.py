"""Folder trees as edge tables, each folder entered once.

Downwards: each level is one join of the frontier with the edges, written to the shared folder beside a table of what was seen; a
folder that a root reached before is not entered again, so shared folders and cycles cost nothing more, and the walk ends
when a frontier is empty. Upwards: pointers to the folder 1, 2, 4, ... steps above are doubled, so a chain of n folders takes
log n rounds; what an earlier call found can be given as a memo. A lost executor costs no earlier level or round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import shared_folder


GATHER = 16  # levels


class Levels:
    """Tables that are written one after the other and read as one, with their `depth`."""

    def __init__(self, like: DataFrame, name: str) -> None:
        self.spark, self.base, self.kind, self.depth = like.sparkSession, shared_folder(like.sparkSession, name), like.schema, 0
        self.recent: list[str] = []

    def put(self, level: DataFrame) -> DataFrame:
        """The level as it was written."""
        path = f"{self.base}/depth={self.depth}"
        level.select(*self.kind.fieldNames()).write.parquet(path)
        self.depth += 1
        self.recent.append(path)
        return self.spark.read.schema(self.kind).parquet(path)

    def keys(self, *names: str) -> DataFrame:
        """The columns names of all levels. From time to time they are gathered in one table, so that few files are read."""
        found = self.spark.read.schema(StructType([self.kind[n] for n in names])).parquet(*self.recent)
        if len(self.recent) > GATHER:
            path = f"{self.base}-keys/{self.depth}"
            found.hint("rebalance").write.parquet(path)
            self.recent = [path]
        return found

    def all(self) -> DataFrame:
        schema = StructType([*self.kind.fields, StructField("depth", IntegerType())])
        return self.spark.read.schema(schema).option("basePath", self.base).parquet(*[f"{self.base}/depth={d}" for d in range(self.depth)])


def walk(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, parent, names, depth) of everything below roots (id), once for each root; edges (parent, id, name).

    A folder that is reached several ways stands at its least depth, below its least parent there (then its least name). A root
    that is met again below itself is not entered.
    """
    e = edges.select(F.col("parent").alias("_parent"), F.col("id").alias("_id"), F.col("name").alias("_name"))
    start = roots.select(F.col("id").alias("root"), "id", F.lit(None).cast(roots.schema["id"].dataType).alias("parent"), F.array().cast("array<string>").alias("names")).dropDuplicates(["root"])
    seen = Levels(start, "walk")
    level = seen.put(start)
    while not level.isEmpty():
        met = level.join(e, F.col("id") == F.col("_parent"))
        # one row for each folder, before it is met with what was seen
        found = met.groupBy("root", F.col("_id").alias("id")).agg(F.min(F.struct(F.col("_parent").alias("parent"), F.col("_name").alias("name"), "names")).alias("w"))
        fresh = found.join(seen.keys("root", "id"), ["root", "id"], "left_anti")
        level = seen.put(fresh.select("root", "id", "w.parent", F.array_append("w.names", F.col("w.name")).alias("names")))
    return seen.all().where("depth > 0").select("root", "id", "parent", "names", "depth")


def above(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id) of ids and every folder above one of them, each once however many ways lead there."""
    e = edges.select(F.col("parent").alias("_parent"), F.col("id").alias("_id")).distinct()
    start = ids.select("id").distinct()
    seen = Levels(start, "above")
    level = seen.put(start)
    while not level.isEmpty():
        met = level.join(e, F.col("id") == F.col("_id")).select(F.col("_parent").alias("id")).distinct()
        level = seen.put(met.join(seen.keys("id"), "id", "left_anti"))
    return seen.all().select("id")


def failed(edges: DataFrame, listed: DataFrame) -> DataFrame:
    """(id) of every folder with a failure below or at itself; listed: (id, ok) of folders, one that is missing or null is a failure.

    Failures are folded upwards: a folder fails as soon as one below it does, and is looked at once.
    """
    every = edges.select("id").union(edges.select("parent")).union(listed.select("id")).distinct()
    told = listed.groupBy("id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
    return above(edges, every.join(told, "id", "left").where(~F.coalesce("ok", F.lit(False))).select("id"))


def subtree_ok(edges: DataFrame, listed: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, ok, folders) of roots: whether every folder below was listed without an error, itself included, and how many those are."""
    own = roots.select("id").distinct()
    bad = failed(edges, listed).withColumn("_bad", F.lit(True))
    known = listed.select("id").distinct().withColumn("_known", F.lit(True))  # a root that no edge names may be listed or not
    sizes = walk(edges, own).groupBy(F.col("root").alias("id")).agg(F.count("*").alias("n"))
    told = own.join(bad, "id", "left").join(known, "id", "left").join(sizes, "id", "left")
    return told.select("id", (F.col("_bad").isNull() & F.col("_known").isNotNull()).alias("ok"), (F.coalesce("n", F.lit(0)) + 1).alias("folders"))


def ancestors(edges: DataFrame, starts: DataFrame, roots: DataFrame, recognised: Callable[[Column], Column] | None = None, memo: DataFrame | None = None) -> DataFrame:
    """(id, root, depth) of the nearest root above each start; ties go to the least root; null if there is none.

    A root is one of roots (id), or a folder whose name is recognised. memo: (id, root, depth) that an earlier call over the same
    folders gave; if it knows all starts, nothing is climbed.
    """
    if memo is None:
        return starts.select("id").join(climb(edges, roots, recognised), "id", "left")
    told = starts.select("id").distinct().join(memo.select("id", "root", "depth"), "id")
    unknown = starts.select("id").distinct().join(told.select("id"), "id", "left_anti")
    if not unknown.isEmpty():
        told = told.unionByName(unknown.join(climb(edges, roots, recognised), "id", "left"))
    return starts.select("id").join(told, "id", "left")


def climb(edges: DataFrame, roots: DataFrame, recognised: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, root, depth) of every folder with a root above it or at it, by pointers that double.

    In the round with pointers of s steps the root becomes known to all folders that have one s to 2 s - 1 steps above. Below a root s
    steps away there are folders at all lesser distances from it, so a round that finds none is the last.
    """
    named = edges.select("id", "name").groupBy("id").agg(F.min("name").alias("name"))
    hits = roots.select("id")
    if recognised is not None:
        hits = hits.union(named.where(recognised(F.col("name"))).select("id"))
    found = hits.distinct().select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("steps"))
    known = Levels(found, "roots")
    known.put(found)
    first = edges.select("id", F.col("parent").alias("at")).distinct().join(known.all().select("id"), "id", "left_anti")
    hops = Levels(first, "pointers")
    pointers, step = hops.put(first), 1
    while True:
        rooted = known.all().select(F.col("id").alias("at"), "root", "steps")
        best = pointers.join(rooted, "at").groupBy("id").agg(F.min(F.struct((F.col("steps") + step).alias("steps"), "root")).alias("b"))
        gained = known.put(best.select("id", "b.root", "b.steps"))
        if gained.isEmpty():
            return known.all().select("id", "root", F.col("steps").cast("int").alias("depth"))
        # folders that know nothing yet go on from where they point, also through those that have just learnt
        onward = pointers.select(F.col("id").alias("at"), F.col("at").alias("next"))
        left = pointers.join(gained.select("id"), "id", "left_anti")
        pointers, step = hops.put(left.join(onward, "at").select("id", F.col("next").alias("at")).distinct()), step * 2


def category(names: Column, root: str = "Raiz") -> Column:
    """The first folder below the root, or a name for files in the root itself."""
    folders = F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))
    return F.coalesce(F.get(folders, F.lit(0)), F.lit(root))


def folder_path(names: Column) -> Column:
    return F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))), " / ")


def by_name(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(name, ids) of everything below roots: the multimap that later matches are made against; a folder has all its names."""
    below = walk(edges, roots).select("id").distinct()
    named = edges.select("id", "name").distinct().join(below, "id")
    return named.groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("ids"))
