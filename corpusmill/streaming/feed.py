"""The change feed as a stream: files in, duplicates within the watermark dropped, idempotent batches out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_folder
from ..sources.listing import ListingSource

LATE = "5 minutes"
OVERLAP_S = 300


def read(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:  # noqa: ANN001
    """Parquet files as they arrive, at most per_trigger in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = LATE) -> DataFrame:
    """Rows whose key came already within the watermark are dropped; time may be without a zone (read as the session's)."""
    return stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys).drop("_at")


def changes(spark: SparkSession, client: str, folders: str, overlap: int = OVERLAP_S, **options: str) -> DataFrame:
    """The listing of folders as a stream of its changes: each (id, modifiedTime) once.

    Items that the store shows late come if they are less than `overlap` seconds behind the last listing. What is met twice is
    told by state that the watermark bounds, a second behind the overlap. Items without a time come with the first batch, and
    are the only ones of their id to do so.
    """
    spark.dataSource.register(ListingSource)
    stream = spark.readStream.format("listing").option("client", client).option("overlap", overlap).option("times", "true").options(**options).load(folders)
    # the first batch drops what isn't later than the epoch
    at = F.greatest(F.col("at"), F.timestamp_seconds(F.lit(1)))
    return deduplicated(stream.withColumn("at", at), ["id", "modifiedTime"], "at", f"{overlap + 1} seconds").drop("at")


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """All that is there now, as Parquet files: offsets are kept, so a restart repeats nothing."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_batches(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:  # noqa: ANN001
    """write(batch, number) is called once or more for each batch, so it must be idempotent by the number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_events(spark: SparkSession, path: str) -> DataFrame:
    """The events, fed twice, without the second time."""
    base = shared_folder(spark, "feed")
    events = spark.read.parquet(path)
    for _ in range(2):
        events.write.mode("append").parquet(f"{base}/in")
    run_once(deduplicated(read(spark, f"{base}/in", events.schema), ["event_id"], "ts").select("event_id", "user_id", "event_type"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{base}/out")
