"""State as pure functions: state x changes -> state. Each is one join or window; write the result and swap it in.

Null keys are equal to each other, as in a set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def first_by(df: DataFrame, keys: list[str], by: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by columns that must order its rows wholly: one partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*by)).alias("_row")).select(*[F.col(f"_row.{c}") if c in rest else F.col(c) for c in df.columns])


def lacking(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df whose keys other lacks, nulls included."""
    theirs = other.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).distinct()
    return df.join(theirs, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]), "left_anti")


def insert_if_absent(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """State wins; changes come in only with new keys."""
    return state.unionByName(lacking(changes, state, keys))


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The latest change of each key replaces its row."""
    latest = first_by(changes, keys, by, last=True)
    return lacking(state, latest, keys).unionByName(latest, allowMissingColumns=True)


def delete_by(state: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return lacking(state, keys_of, keys)


def replace_children(children: DataFrame, fresh: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """All children of the parents that were saved again are replaced by the fresh ones."""
    return delete_by(children, parents, [key]).unionByName(fresh)


def accept_reject(accepted: DataFrame, rejected: DataFrame, saves: DataFrame, skips: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """An id is in one of both tables at most: a save removes its rejection, a skip its acceptance."""
    now_accepted = delete_by(delete_by(accepted, saves, [key]).unionByName(saves), skips, [key])
    now_rejected = delete_by(delete_by(rejected, skips, [key]), saves, [key]).unionByName(skips)
    return now_accepted, now_rejected


def acknowledge(pending: DataFrame, revisions: DataFrame, done: DataFrame, key: str = "id", time: str = "modified") -> tuple[DataFrame, DataFrame]:
    """Pending rows that are done go; those with a time become the revision."""
    promoted = pending.join(done.select(key), key, "left_semi").where(F.coalesce(F.col(time), F.lit("")) != "").select(key, time)
    return delete_by(pending, done, [key]), delete_by(revisions, promoted, [key]).unionByName(promoted)


def classify_changes(feed: DataFrame, revisions: DataFrame, known: DataFrame, in_scope: Column, typed: Column, key: str = "id", time: str = "modified") -> DataFrame:
    """feed with `change`: other type, unchanged (same id and time), modified (known id), out of scope, or new."""
    seen = feed.join(revisions.select(key, time).distinct().withColumn("_same", F.lit(True)), [key, time], "left").join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    change = F.when(~typed, "other type").when(F.col("_same"), "unchanged").when(F.col("_known"), "modified").when(~in_scope, "out of scope").otherwise("new")
    return seen.withColumn("change", change).drop("_same", "_known")


def merge_checkpoint(current: DataFrame, previous: DataFrame, id: str = "id", side: str = "side") -> DataFrame:
    """Ids of both lists now, and those of before that are in neither list now."""
    return current.select(id, side).unionByName(previous.select(id, side).join(current.select(id), id, "left_anti")).distinct()


def kept_count(now: Column, before: Column) -> Column:
    """A count that falls to zero keeps what it was."""
    return F.when(F.coalesce(now, F.lit(0)) == 0, F.coalesce(before, F.lit(0))).otherwise(now)


def cleared(state: DataFrame) -> DataFrame:
    """The state without rows, to be written over it."""
    return state.limit(0)


def resume_empty(items: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """Items that were not stored, or whose stored text is empty."""
    whole = stored.where(F.coalesce(text, F.lit("")) != "").select(key).distinct()
    return items.join(whole, key, "left_anti")


def islands(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Ranges of each key, with those that touch or overlap merged: gaps and islands by windows, which spill."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    told = df.withColumn("_new", (before.isNull() | (F.col(low) > before)).cast("int"))
    numbered = told.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")


def scheduled(calls: DataFrame, lanes: list[str], order: list[str], at: str, interval: Column) -> DataFrame:
    """calls with `start`: each as soon as it may, but no two of a lane nearer than interval (a number, as `at`).

    The k-th call starts at the greatest of (at of the j-th + (k - j) * interval) for all j up to k, so a running maximum
    says what a limiter that all callers share would do.
    """
    w = Window.partitionBy(*lanes).orderBy(*order)
    numbered = calls.withColumn("_k", F.row_number().over(w))
    free = F.max(F.col(at) - F.col("_k") * interval).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("start", free + F.col("_k") * interval).drop("_k")


def resume(items: DataFrame, done: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """Items that are not done, or are pending again."""
    told = items.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left").join(pending.select(key).distinct().withColumn("_pending", F.lit(True)), key, "left")
    return told.where(F.col("_done").isNull() | F.col("_pending")).drop("_done", "_pending")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "_k") -> DataFrame:
    """df with the number (from 1) of each row among those of its keys (of all rows, if there are none), in an order that should be whole.

    A key with very many rows is counted by several tasks: rows are dealt to ranges of keys and order and written, each range
    counts its own, and what the ranges before hold of a key is added.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "numbered")
    df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    # only keys in several ranges have any before
    some = before.where("_before is not null").select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"), "_before")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(keys)], F.lit(True))
    met = own.join(some, same & (F.col("_range") == F.col("_at")), "left")
    return met.withColumn(name, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long")).select(*df.columns, name)


def unique_suffix(df: DataFrame, path: str, order: list[Column], stem: Column, ending: Column) -> DataFrame:
    """df with `unique_name`: the first row of a path keeps it, the k-th further one is the path with the k-th number that is free.

    A number is taken if `stem (number)ending` is a path of some row itself. The taken numbers of a path leave gaps; each further
    row finds its gap by a join with their ranges, so no two rows share a name. Null paths stay null.
    """
    rows = numbered(df.withColumns({"_stem": stem, "_ending": ending}), [path], order, "_i").withColumn("_k", F.col("_i") - 1)
    literal = rows.where(F.col(path).isNotNull()).select("_stem", "_ending").distinct()
    form = "^(?s)(.*) \\(([1-9][0-9]{0,17})\\)$"
    taken = literal.where(F.col("_stem").rlike(form)).select(F.regexp_extract("_stem", form, 1).alias("_of"), F.col("_ending").alias("_with"), F.regexp_extract("_stem", form, 2).cast("long").alias("_number"))
    # of a path that has further rows: so many numbers are free below each taken one
    needed = rows.where(F.col(path).isNotNull()).groupBy("_stem", "_ending").agg(F.max("_k").alias("_most")).where("_most > 0")
    own = taken.join(needed, (F.col("_of") == F.col("_stem")) & (F.col("_with") == F.col("_ending"))).select("_of", "_with", "_number")
    w = Window.partitionBy("_of", "_with").orderBy("_number")
    gaps = own.withColumn("_j", F.row_number().over(w)).withColumn("_free", F.col("_number") - F.col("_j"))
    # the k-th free number is k and the taken ones below: those with fewer than k free ones before them
    ranges = gaps.groupBy("_of", "_with", "_free").agg(F.max("_j").alias("_j")).withColumn("_upto", F.lead("_free").over(Window.partitionBy("_of", "_with").orderBy("_free")))
    hit = (F.col("_stem") == F.col("_of")) & (F.col("_ending") == F.col("_with")) & (F.col("_k") > F.col("_free")) & (F.col("_upto").isNull() | (F.col("_k") <= F.col("_upto")))
    told = rows.join(ranges, hit, "left")
    number = (F.col("_k") + F.coalesce("_j", F.lit(0))).cast("string")
    named = F.when((F.col("_k") == 0) | F.col(path).isNull(), F.col(path)).otherwise(F.concat("_stem", F.lit(" ("), number, F.lit(")"), "_ending"))
    return told.withColumn("unique_name", named).select(*df.columns, "unique_name")
