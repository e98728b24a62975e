"""A full-text index of postings: built once, kept up by runs, read by token.

A folder holds runs and manifests. A run is what one call put in, or a merge of runs: `postings` (token, key, n, tf, places, gen, ord),
sorted by token in buckets of the token's beginning, and `docs` (key, n, gen, ord). gen is the number of the call that a document came
by and ord its number there; a merge keeps both. `dead` holds bitmaps: of each gen the documents that were replaced or removed, in
blocks of 32,768. A manifest names the runs, the bitmaps, and how many documents and tokens are live; the greatest one counts.
It is the last thing that a call writes, under a number that must be new: a call that was cut short leaves nothing that
counts, and of two writers at a time the second fails.

A search reads the manifest's totals, the buckets of its words in each run (partitions are pruned and the token's beginning is
pushed to the files) and the bitmaps, and no table of all documents. Runs are merged by tiers: as soon as FAN of one tier are
there, they become one of the next without their dead documents, so a document is written again about log(documents) times and
there are few runs at any time. vacuum() deletes what no manifest that counts names.

An empty or punctuation-only query matches nothing. Null text has no tokens, but its document counts. Ties in rank are the
caller's to order. A key that comes twice in one call, or is null, is an error.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import bound
from ..functions.fold import terms
from ..functions.text import TOKENS, placed_snippet
from ..session import shared_folder, ship
from ..sources.sinks import delete, exists, names, put_new, small_text
from .search import bm25, query_terms

FAN, BLOCK = 8, 32_768
BUCKETS, FINER = 64, 8
PIECE = 1 << 18  # tokens handled at once
SMALL, LARGE = 1 << 12, 1 << 20  # documents from which a run has buckets, and finer ones


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str, key: str, kind: str = "long") -> None:
        self.spark, self.folder, self.key, self.kind = spark, folder.rstrip("/"), key, kind

    def manifest(self) -> dict:
        """What counts now: number, runs (path, tier, docs, buckets), dead (a path), docs, tokens, next gen."""
        paths = names(self.spark, f"{self.folder}/manifest")
        if not paths:
            return {"number": 0, "gen": 0, "runs": [], "dead": None, "docs": 0, "tokens": 0}
        return json.loads(small_text(self.spark, f"{self.folder}/manifest/{max(paths)}"))

    def _commit(self, now: dict, **changes: object) -> dict:
        told = {**now, **changes, "number": now["number"] + 1}
        put_new(self.spark, f"{self.folder}/manifest/{told['number']:012d}.json", json.dumps(told))
        return told

    def _new(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex}"

    def _docs(self, now: dict) -> DataFrame:
        kind = f"{self.key} {self.kind}, n long, gen int, ord long"
        if not now["runs"]:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{r['path']}/docs" for r in now["runs"]])

    def _alive(self, rows: DataFrame, now: dict) -> DataFrame:
        """rows (gen, ord, ...) without those that the bitmaps name."""
        if not now["dead"]:
            return rows
        dead = self.spark.read.schema("gen int, block long, bits binary").parquet(now["dead"])
        told = rows.withColumn("block", F.bitmap_bucket_number(F.col("ord") + 1)).join(dead, ["gen", "block"], "left")
        place = F.bitmap_bit_position(F.col("ord") + 1)
        byte = F.conv(F.hex(F.substr("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return told.where(F.col("bits").isNull() | (F.getbit(byte, (place % 8).cast("int")) == 0)).drop("block", "bits")

    def live(self) -> DataFrame:
        """(key, n) of every document that counts."""
        now = self.manifest()
        return self._alive(self._docs(now), now).select(self.key, "n")

    def _killed(self, keys: DataFrame, now: dict) -> tuple[str | None, int, int]:
        """The bitmaps with the live documents of keys added, and how many documents and tokens those are."""
        if not now["runs"]:
            return now["dead"], 0, 0
        path = self._new("killed")
        self._alive(self._docs(now).join(keys.select(self.key).distinct(), self.key, "left_semi"), now).select("gen", "ord", "n").write.parquet(path)
        killed = self.spark.read.schema("gen int, ord long, n long").parquet(path)
        count, tokens = killed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not count:
            return now["dead"], 0, 0
        at = F.col("ord") + 1
        maps = killed.groupBy("gen", F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        if now["dead"]:
            before = self.spark.read.schema("gen int, block long, bits binary").parquet(now["dead"])
            maps = before.unionByName(maps).groupBy("gen", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
        dead = self._new("dead")
        maps.write.parquet(dead)
        return dead, count, tokens

    def add(self, docs: DataFrame, text: Column) -> None:
        """Documents whose key the index lacks; others stay as they are."""
        self.put(docs.join(self.live().select(self.key), self.key, "left_anti"), text)

    def put(self, docs: DataFrame, text: Column) -> None:
        """Documents as they are now, in place of what the index held of them."""
        now, path = self.manifest(), self._new("run")
        gen = now["gen"] + 1
        # the numbers that documents get are written before anything reads them
        held = docs.select(F.col(self.key).cast(self.kind).alias(self.key), terms(F.coalesce(text, F.lit(""))).alias("t"), F.lit(gen).alias("gen"), F.monotonically_increasing_id().alias("ord"))
        held.write.parquet(f"{path}/texts")
        rows = self.spark.read.schema(f"{self.key} {self.kind}, t array<string>, gen int, ord long").parquet(f"{path}/texts")
        rows.select(self.key, F.size("t").cast("long").alias("n"), "gen", "ord").write.parquet(f"{path}/docs")
        fresh = self.spark.read.schema(f"{self.key} {self.kind}, n long, gen int, ord long").parquet(f"{path}/docs")
        count, known, tokens = fresh.agg(F.count("*"), F.count_distinct(self.key), F.coalesce(F.sum("n"), F.lit(0))).first()
        if count != known:
            raise ValueError("a key is null or comes twice")
        if not count:
            return
        ship(self.spark)
        self._write(postings_of(rows, self.key, self.kind), path, buckets := _buckets(count))
        delete(self.spark, f"{path}/texts")
        dead, gone, gone_tokens = self._killed(fresh, now)
        run = {"path": path, "tier": 0, "docs": count, "buckets": buckets}
        self._commit(now, gen=gen, runs=[*now["runs"], run], dead=dead, docs=now["docs"] + count - gone, tokens=now["tokens"] + tokens - gone_tokens)
        self.merge()

    def _write(self, postings: DataFrame, path: str, buckets: int) -> None:
        told = postings.withColumn("bucket", bucket(F.col("token"), buckets))
        told.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/postings")

    def merge(self, every: bool = False) -> None:
        """Tiers that hold FAN runs become one run of the next; every: all runs become one."""
        while True:
            now = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for run in now["runs"]:
                tiers.setdefault(0 if every else run["tier"], []).append(run)
            full = next((runs for _, runs in sorted(tiers.items()) if len(runs) >= (2 if every else FAN)), None)
            if full is None:
                return
            part, path = {**now, "runs": full}, self._new("run")
            self._alive(self._docs(part), now).write.parquet(f"{path}/docs")
            count = self.spark.read.parquet(f"{path}/docs").count()
            self._write(self._alive(reduce(DataFrame.union, [self._postings(r) for r in full]).drop("bucket"), now), path, buckets := _buckets(count))
            run = {"path": path, "tier": max(r["tier"] for r in full) + 1, "docs": count, "buckets": buckets}
            left = [r for r in now["runs"] if r not in full]
            self._commit(now, runs=[*left, run] if count else left, dead=now["dead"] if left else None)

    def remove(self, keys: DataFrame) -> None:
        """Documents that don't count any more; those the index lacks are no error."""
        now = self.manifest()
        dead, gone, tokens = self._killed(keys.select(F.col(self.key).cast(self.kind).alias(self.key)), now)
        if gone:
            self._commit(now, dead=dead, docs=now["docs"] - gone, tokens=now["tokens"] - tokens)

    def saved(self, saves: DataFrame, text: Column, skips: DataFrame) -> None:
        """What accept_reject does to decisions, for their texts: saves come in, then skips go."""
        self.put(saves, text)
        self.remove(skips)

    def vacuum(self) -> None:
        """Delete all runs, bitmaps and manifests but those that count; no search or writer may be at work."""
        now = self.manifest()
        kept = {r["path"].rsplit("/", 1)[1] for r in now["runs"]} | {(now["dead"] or "/").rsplit("/", 1)[1], "manifest"}
        for name in set(names(self.spark, self.folder)) - kept:
            delete(self.spark, f"{self.folder}/{name}")
        for name in sorted(names(self.spark, f"{self.folder}/manifest"))[:-1]:
            delete(self.spark, f"{self.folder}/manifest/{name}")

    def _postings(self, run: dict) -> DataFrame:
        return self.spark.read.schema(f"token string, {self.key} {self.kind}, n long, tf int, places array<int>, gen int, ord long, bucket int").parquet(f"{run['path']}/postings")

    def postings(self, words: list[str], prefix: bool, now: dict | None = None) -> DataFrame:
        """(token, key, n, tf, places, gen, ord, word) of the tokens that are, or begin with, each word; word: its number."""
        now, parts = now or self.manifest(), []
        for run in now["runs"]:
            for i, word in enumerate(words):
                fits = F.col("token").startswith(word) if prefix else F.col("token") == word
                parts.append(self._postings(run).where(F.col("bucket").isin(*numbers(word, prefix, run["buckets"])) & fits).drop("bucket").withColumn("word", F.lit(i)))
        return reduce(DataFrame.union, parts)

    def search(self, query: str, mode: str = "words", inside: DataFrame | None = None) -> DataFrame:
        """key and rank (BM25, lower is better) of the live documents that match, of those inside if that is given."""
        words, now = query_terms(query), self.manifest()
        if not words or not now["runs"]:
            return self.spark.createDataFrame([], f"{self.key} {self.kind}, rank double")
        met = self._alive(self.postings(words, mode != "phrase", now), now)
        if mode == "phrase":
            starts = met.select(self.key, "n", F.explode(F.transform("places", lambda p: p - F.col("word"))).alias("start"))
            whole = starts.groupBy(self.key, "n", "start").agg(F.count("*").alias("k")).where(F.col("k") == len(words))
            hits, parts = whole.groupBy(self.key, "n").agg(F.count("*").alias("f0")), 1
        else:
            parts = len(words)
            hits = met.groupBy(self.key, "n").agg(*[F.sum(F.when(F.col("word") == i, F.col("tf")).otherwise(0)).alias(f"f{i}") for i in range(parts)])
        stats = F.broadcast(hits.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"_n{i}") for i in range(parts)]))  # one row
        found = hits.where(" and ".join(f"f{i} > 0" for i in range(parts)))
        if inside is not None:
            found = found.join(inside.select(self.key), self.key, "left_semi")
        one = found.withColumn("_one", F.lit(1)).join(stats.withColumn("_one", F.lit(1)), "_one")
        mean = now["tokens"] / max(now["docs"], 1)
        return one.select(self.key, bm25([F.col(f"f{i}") for i in range(parts)], [F.col(f"_n{i}") for i in range(parts)], F.col("n"), F.lit(now["docs"]), F.lit(mean)).alias("rank"))


    def snippets(self, page: DataFrame, docs: DataFrame, text: Column, query: str, mode: str = "words", size: int = TOKENS) -> DataFrame:
        """Rows of docs whose key is in page, with `snippet`; text is what was put in for them.

        Places come from the postings of the query's words, so no text is searched; in the mode `phrase`, whole phrases alone are hits.
        """
        words, now = query_terms(query), self.manifest()
        keys = page.select(self.key).distinct()
        shown = docs.join(keys, self.key, "left_semi")
        if not words or not now["runs"]:
            return shown.withColumn("snippet", placed_snippet(text, F.lit(None).cast("array<struct<place:int,word:int>>"), 0, size)["snippet"])
        met = self._alive(self.postings(words, mode != "phrase", now).join(keys, self.key, "left_semi"), now)
        if mode == "phrase":
            starts = met.select(self.key, F.explode(F.transform("places", lambda p: p - F.col("word"))).alias("start"))
            whole = starts.groupBy(self.key, "start").agg(F.count("*").alias("k")).where(F.col("k") == len(words))
            met = whole.select(self.key, F.lit(0).alias("word"), F.transform(F.sequence(F.lit(0), F.lit(len(words) - 1)), lambda i: F.col("start") + i).alias("places"))
        hits = met.select(self.key, F.transform("places", lambda p: F.struct(p.cast("int").alias("place"), F.col("word").alias("word"))).alias("h")).groupBy(self.key).agg(F.flatten(F.collect_list("h")).alias("_hits"))
        return shown.join(hits, self.key, "left").withColumn("snippet", placed_snippet(text, F.col("_hits"), len(words), size)["snippet"]).drop("_hits")


def grouped(tokens: str) -> Column:
    """(token, places) of each distinct token of an array: its sorted runs, each cut out once. postings_of() does it for many rows at once."""
    pairs = F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("place"))))

    def cut(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["token"] != F.get(s, i - 1)["token"]))
        run = lambda b: F.transform(b, lambda x, i: F.struct(F.get(s, x)["token"].alias("token"), F.slice(s, x + 1, F.coalesce(F.get(b, i + 1), F.size(s)) - x)["place"].alias("places")))
        return F.when(F.size(s) > 0, bound(begins, run))

    return bound(pairs, cut)


def postings_of(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """(token, key, n, tf, places, gen, ord) of each distinct token of each row (key, t, gen, ord)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, low = np.cumsum(pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False)), 0
            while low < batch.num_rows:
                # rows of about PIECE tokens at once, a longer one alone
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE, side="right")))
                yield cut(batch.slice(low, high - low))
                low = high

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = batch.column("t").flatten().dictionary_encode()
        codes, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(row * max(1, len(coded.dictionary)) + codes, kind="stable")
        codes, row, place = codes[order], row[order], (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
        first = np.flatnonzero(np.r_[True, (np.diff(codes) != 0) | (np.diff(row) != 0)][: len(codes)])
        at, of = np.append(first, len(codes)).astype(np.int32), row[first]
        own = lambda name: batch.column(name).take(pa.array(of))
        places = pa.ListArray.from_arrays(pa.array(at), pa.array(place.astype(np.int32)))
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(codes[first])), own(key), pa.array(sizes[of]), pa.array(np.diff(at)), places, own("gen"), own("ord")], ["token", key, "n", "tf", "places", "gen", "ord"])

    return rows.select(key, "t", "gen", "ord").mapInArrow(work, f"token string, {key} {kind}, n long, tf int, places array<int>, gen int, ord long")


def _buckets(docs: int) -> int:
    """A small run is one file; from LARGE documents on, the second letter tells buckets apart as well."""
    return 1 if docs < SMALL else BUCKETS if docs < LARGE else BUCKETS * FINER


def bucket(token: Column, buckets: int) -> Column:
    spot = lambda at, n: F.crc32(F.substr(token, F.lit(at), F.lit(1)).cast("binary")) % n
    if buckets == 1:
        return F.lit(0)
    return (spot(1, BUCKETS) if buckets == BUCKETS else spot(1, BUCKETS) * FINER + spot(2, FINER)).cast("int")


def numbers(word: str, prefix: bool, buckets: int) -> list[int]:
    """The buckets that may hold a word, or tokens that begin with it."""
    spot = lambda at, n: zlib.crc32(word[at : at + 1].encode()) % n
    if buckets == 1:
        return [0]
    if buckets == BUCKETS:
        return [spot(0, BUCKETS)]
    return [spot(0, BUCKETS) * FINER + x for x in (range(FINER) if prefix and len(word) == 1 else [spot(1, FINER)])]


def files_of(spark: SparkSession, path: str) -> str:
    """What tells one state of a table's files from another: names, sizes and times."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found, told = fs.listFiles(target, True), []
    while found.hasNext():
        one = found.next()
        told.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
    return uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(sorted(told))).hex


@lru_cache(maxsize=8)
def _of_table(application: str, spark: SparkSession, path: str, files: str, key: str, column: str) -> TextIndex:
    index = TextIndex(spark, shared_folder(spark, "index"), key)
    index.put(spark.read.parquet(path), F.col(column))
    return index


def of_table(spark: SparkSession, path: str, key: str, column: str) -> TextIndex:
    """The index of a table's column, built once for each application and state of its files, and again if its folder was cleared."""
    asked = (spark.sparkContext.applicationId, spark, path, files_of(spark, path), key, column)
    index = _of_table(*asked)
    if not exists(spark, f"{index.folder}/manifest"):
        _of_table.cache_clear()
        index = _of_table(*asked)
    return index
