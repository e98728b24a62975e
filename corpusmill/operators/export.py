"""Nested exports, fan-out and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(parents: DataFrame, children: DataFrame, key: str, order: list[str], fields: list[str], name: str = "children") -> DataFrame:
    """Parents with an array of their children's fields, sorted by order; an empty array if there are none."""
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, *fields])))).alias(name))
    kind = rows.schema[name].dataType.simpleString()
    return parents.join(rows, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def distinct_joined(df: DataFrame, key: str, value: str, order: str, separator: str = " | ") -> DataFrame:
    """Distinct values of each key in the order they are first seen (ties by value); only distinct ones are collected."""
    first = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_o"))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("v")))), lambda x: x["v"])
    return first.groupBy(key).agg(F.array_join(seen, separator).alias("joined"))


def with_targets(items: DataFrame, id: str = "id", target: str = "target_id", shown: tuple[str, ...] = ("name", "modified")) -> DataFrame:
    """Items with what a shortcut's target says in place of their own (`target_` columns are null for other items)."""
    theirs = items.groupBy(F.col(id).alias(target)).agg(*[F.max(c).alias(f"target_{c}") for c in shown])
    return items.join(theirs, target, "left")


def in_locale(name: Column, locale: str = "pt") -> Column:
    """A name to order by: accents and case matter only between names that are equal without them."""
    return F.collate(name, locale)


def with_links(decisions: DataFrame, kept: DataFrame, key: str, links: list[str], order: str) -> DataFrame:
    """Decisions with the links an earlier export gave them, the last one of each id; null where there is none."""
    latest = kept.groupBy(key).agg(F.max_by(F.struct(*links), order).alias("_links")).select(key, "_links.*")
    return decisions.drop(*links).join(latest, key, "left")


def top(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(n)


def fanout(df: DataFrame, level: Column, law: Column, act: Column, key: Column) -> DataFrame:
    """One row for each distinct (level, law, act, key): the partitions a document is copied to."""
    return df.select(level.alias("level"), law.alias("law"), act.alias("act"), key.alias("id")).distinct()


def progress(done: Column, total: Column, seconds: Column) -> dict[str, Column]:
    """Rate, percentage and time left, with guards for zero."""
    rate = F.try_divide(done.cast("double"), F.nullif(seconds, F.lit(0.0)))
    return {"rate": rate, "percent": F.coalesce(F.try_divide(done * 100.0, F.nullif(total, F.lit(0))), F.lit(0.0)), "left_s": F.try_divide((total - done).cast("double"), F.nullif(rate, F.lit(0.0)))}


def expected_total(done: Column, folders_done: Column, folders: Column, complete: Column) -> Column:
    """While folders are still being listed, the total that their share so far leads to expect."""
    return F.when(complete | (folders_done == 0), done).otherwise(F.ceil(done * folders / folders_done))


def clock(time: Column) -> Column:
    """`dd/mm hh:mm` of a time; a dash if there is none."""
    return F.coalesce(F.date_format(time, "dd/MM HH:mm"), F.lit("-"))


def counters(df: DataFrame, status: str) -> DataFrame:
    """How many rows have each status, most first, and their percentage."""
    by = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n")).scalar()
    return by.select("status", "n", F.coalesce(F.try_divide(F.col("n") * 100.0, F.nullif(total, F.lit(0))), F.lit(0.0)).alias("percent")).orderBy(F.desc("n"), "status")


def duration(seconds: Column) -> Column:
    """`1h02m03s`, `2m03s` or `3s`, truncated."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), two(m), F.lit("m"), two(r), F.lit("s"))).when(m > 0, F.concat(m.cast("string"), F.lit("m"), two(r), F.lit("s"))).otherwise(F.concat(r.cast("string"), F.lit("s")))
