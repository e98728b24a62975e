"""Keyed tables in buckets, changed together: copy-on-write of the buckets that a change falls in, and one manifest that counts.

A folder holds several tables, each with one row for a key, in buckets of the key's hash. A change writes new files for the buckets
that its keys fall in, with the rows of the old ones that it leaves; all other buckets stay as they are. The manifest that
names every bucket's folder is written last, under a number that must be new, for all tables at once: a reader sees all of
a change or nothing, a change that was cut short leaves nothing that counts, and of two writers at a time the second fails. A change
may have a batch number; one whose number was already committed does nothing, so a batch that runs again changes nothing.

Null keys are an error, as is a key that comes twice in one change.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import delete, names, put_new, small_text
from .state import lacking

BUCKETS = 64


class KeyedTables:
    def __init__(self, spark: SparkSession, folder: str, kinds: dict[str, str], key: str = "id", buckets: int = BUCKETS) -> None:
        """kinds: the columns of each table, the key among them."""
        self.spark, self.folder, self.kinds, self.key, self.buckets = spark, folder.rstrip("/"), kinds, key, buckets

    def manifest(self) -> dict:
        """number, batch (the last one), and of each table the folder of every bucket that has rows."""
        found = names(self.spark, f"{self.folder}/manifest")
        if not found:
            return {"number": 0, "batch": None, "buckets": self.buckets, "tables": {name: {} for name in self.kinds}}
        return json.loads(small_text(self.spark, f"{self.folder}/manifest/{max(found)}"))

    def columns(self, name: str) -> list[str]:
        return [c.split()[0] for c in self.kinds[name].split(", ")]

    def read(self, name: str, among: set[int] | None = None, now: dict | None = None) -> DataFrame:
        """A table, or its rows in some buckets."""
        parts = [path for b, path in (now or self.manifest())["tables"][name].items() if among is None or int(b) in among]
        if not parts:
            return self.spark.createDataFrame([], self.kinds[name])
        return self.spark.read.schema(self.kinds[name]).parquet(*parts)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.manifest()["buckets"])).cast("int"))

    def buckets_of(self, *keys: DataFrame) -> set[int]:
        """The buckets that keys fall in: so many numbers at most."""
        found: set[int] = set()
        for rows in keys:
            found |= {r[0] for r in self.bucketed(rows.select(self.key)).select("_bucket").distinct().collect()}
        return found

    def commit(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]], batch: int | None = None) -> bool:
        """Of each table the rows that come in, in place of those of their keys, and the keys that go; whether it was done."""
        now = self.manifest()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return False
        tables = {name: dict(parts) for name, parts in now["tables"].items()}
        for name, (rows, gone) in changes.items():
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            fresh = None
            if rows is not None:
                # written first: it may be costly, and is read three times
                rows.select(*self.columns(name)).write.parquet(f"{path}/fresh")
                fresh = self.spark.read.schema(self.kinds[name]).parquet(f"{path}/fresh")
                count, known = fresh.agg(F.count("*"), F.count_distinct(self.key)).first()
                if count != known:
                    raise ValueError(f"a key of {name} is null or comes twice")
            parts = [x for x in (fresh, gone) if x is not None]
            touched = self.buckets_of(*parts)
            left = self.read(name, touched, now)
            for keys in parts:
                left = lacking(left, keys, [self.key])
            whole = left if fresh is None else left.unionByName(fresh)
            self.bucketed(whole).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
            there = {int(x.partition("=")[2]) for x in names(self.spark, f"{path}/rows") if x.startswith("_bucket=")}
            for b in touched:
                tables[name].pop(str(b), None)
            tables[name] |= {str(b): f"{path}/rows/_bucket={b}" for b in there}
        told = {**now, "number": now["number"] + 1, "batch": now["batch"] if batch is None else batch, "tables": tables}
        put_new(self.spark, f"{self.folder}/manifest/{told['number']:012d}.json", json.dumps(told))
        return True

    def vacuum(self) -> None:
        """Delete what no table reads any more; no reader or writer may be at work."""
        kept = {path for parts in self.manifest()["tables"].values() for path in parts.values()}
        for one in names(self.spark, self.folder):
            if one == "manifest":
                continue
            rows = f"{self.folder}/{one}/rows"
            buckets = [x for x in names(self.spark, rows) if f"{rows}/{x}" in kept]
            if not buckets:
                delete(self.spark, f"{self.folder}/{one}")
                continue
            delete(self.spark, f"{self.folder}/{one}/fresh")
            for x in set(names(self.spark, rows)) - set(buckets):
                delete(self.spark, f"{rows}/{x}")
        for old in sorted(names(self.spark, f"{self.folder}/manifest"))[:-1]:
            delete(self.spark, f"{self.folder}/manifest/{old}")
