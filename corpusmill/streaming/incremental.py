"""The incremental loop as a stream: each batch of the feed meets the state tables and is committed to all of them at once.

State is three keyed tables: `known` (id), `revisions` and `pending` (id, modified). A batch's changes join what is still pending;
what the handler ends without an error is acknowledged, all else stays pending and is tried again with the next batch. Only the
buckets that a batch's ids fall in are read and written again. What came with a batch, what it has to do and what its handler did are written
by its number before the commit, so a batch that is tried again after that asks the handler no more, and one that was committed
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state
from ..operators.keyed import BUCKETS, KeyedTables
from ..sources.sinks import exists

KINDS = {"known": "id long", "revisions": "id long, modified string", "pending": "id long, modified string"}


def tables(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> KeyedTables:
    """The state; buckets count when it begins."""
    return KeyedTables(spark, folder, KINDS, buckets=buckets)


def begin(folder: str, buckets: int = BUCKETS, **rows: DataFrame) -> None:
    """The state before the first batch."""
    own = tables(rows["known"].sparkSession, folder, buckets)
    if not own.commit({name: (rows[name].select(*own.columns(name)), None) for name in KINDS}, batch=-1):
        raise ValueError("there is a state already")


def step(batch: DataFrame, number: int, folder: str, handle: Callable[[DataFrame], DataFrame], in_scope: Column, typed: Column) -> None:
    """One batch (id, modified and what in_scope and typed read); handle returns its rows' id and error."""
    spark = batch.sparkSession
    own = tables(spark, folder)
    now = own.manifest()
    if now["batch"] is not None and number <= now["batch"]:
        return
    among = own.buckets_of(batch)
    told = state.classify_changes(batch, own.read("revisions", among, now), own.read("known", among, now), in_scope, typed).where(F.col("change").isin("new", "modified"))
    # written: it is read four times, and each would classify the batch again
    latest = _once(told.groupBy("id").agg(F.max("modified").alias("modified")), f"{folder}/latest/batch={number}", KINDS["pending"])
    todo = _once(state.upsert(own.read("pending", None, now), latest, ["id"], ["modified"]), f"{folder}/todo/batch={number}", KINDS["pending"])
    done = _once(handle(todo).where("error is null").select("id").distinct(), f"{folder}/done/batch={number}", "id long")
    left, promoted = state.acknowledge(todo, spark.createDataFrame([], KINDS["revisions"]), done)
    # those that were pending already are in their buckets
    queued = left.join(latest.select("id"), "id", "left_semi")
    own.commit({"known": (done, None), "revisions": (promoted, None), "pending": (queued.select("id", "modified"), done)}, batch=number)


def _once(rows: DataFrame, path: str, kind: str) -> DataFrame:
    """rows as they were when they were first written whole."""
    spark = rows.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(kind).parquet(path)


def run(stream: DataFrame, folder: str, handle: Callable[[DataFrame], DataFrame], in_scope: Column, typed: Column, checkpoint: str) -> StreamingQuery:
    """All that is there now, batch by batch; a later run goes on from the checkpoint and the last state."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: step(batch, number, folder, handle, in_scope, typed))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
