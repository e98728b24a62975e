"""Queries over single records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records
from ..sources.tables import load
from .registry import query


@query("""SELECT p_partkey, lpad(p_partkey::varchar, 8, '0') AS digits, 'AN' AS letters, 'it\\''s \\\\ ' || p_name AS literal FROM part""")
def code_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits, letters = records.code_parts(F.concat(F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("-an ")))
    return load(spark, sf_dir, "part").select("p_partkey", digits.alias("digits"), letters.alias("letters"), records.query_literal(F.concat(F.lit("it's \\ "), F.col("p_name"))).alias("literal"))


@query("""SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 5 MINUTES, '%Y-%m-%dT%H:%M:%SZ') AS since, CASE WHEN event_id % 2 = 0 THEN 'b' || event_id ELSE 'a' || event_id END AS target, CASE WHEN event_id % 3 = 0 THEN '2099' ELSE strftime(ts, '%Y') END AS revision FROM events""")
def feed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("text", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    scan = records.since(F.lit(None).cast("timestamp"), records.iso_time(F.col("text")))
    key = F.col("event_id").cast("string")
    target, _ = records.resolved(F.concat(F.lit("a"), key), F.lit("x"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("b"), key)).otherwise(F.lit("")), F.lit(""))
    later = records.revision(F.date_format("ts", "yyyy"), F.when(F.col("event_id") % 3 == 0, F.lit("2099")))
    return events.select("event_id", records.iso_text(scan).alias("since"), target.alias("target"), later.alias("revision"))


@query("""WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(r[1:4], ', ') || CASE WHEN len(r) > 4 THEN ' +' || (len(r) - 4) ELSE '' END AS chips FROM t""")
def chip_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return turns.select("conv_id", records.chips(F.col("r")).alias("chips"))
