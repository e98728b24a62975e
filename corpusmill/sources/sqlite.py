"""Reading the pipeline's SQLite cache files from any store: the file's bytes go to one task, which opens them in memory."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The cache's tables and columns.
TABLES = {
    "arquivos": "file_id string, file_name string, file_size string, destination string, instancia string",
    "index_folders": "folder_id string, folder_name string, instancia string, indexed_at double",
    "meta": "key string, value string",
    "sif_pares": "file_id string, pares string",
    "public_updates": "file_id string, reason string, modified_time string, detected_at double",
    "drive_revisions": "file_id string, modified_time string, processed_at double",
}
ROWS = 10_000


def opened(content: bytes) -> sqlite3.Connection:
    connection = sqlite3.connect(":memory:")
    connection.deserialize(content)
    return connection


def read(spark: SparkSession, path: str, table: str, schema: str | None = None) -> DataFrame:
    """The rows of a table; another schema may name any of its columns. A missing file or table is an error."""
    schema = schema or TABLES[table]
    names = [part.split()[0] for part in schema.split(",")]
    kinds = ["REAL" if part.split()[1] == "double" else "INTEGER" if part.split()[1] in ("long", "int") else "TEXT" for part in schema.split(",")]
    types = {"REAL": pa.float64(), "INTEGER": pa.int64(), "TEXT": pa.string()}
    ask = f"""SELECT {", ".join(f'CAST("{n}" AS {k})' for n, k in zip(names, kinds, strict=True))} FROM "{table}" """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                connection = opened(content.as_py())
                rows = connection.execute(ask)
                while part := rows.fetchmany(ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)
                connection.close()

    wide = ", ".join(f"{n} {'double' if k == 'REAL' else 'long' if k == 'INTEGER' else 'string'}" for n, k in zip(names, kinds, strict=True))
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, wide)


def count(spark: SparkSession, path: str, table: str = "arquivos") -> int:
    """How many rows a table has; 0 for a missing file, a file of another kind or a missing table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                try:
                    n = opened(content.as_py()).execute(f'SELECT count(*) FROM "{table}"').fetchone()[0]
                except sqlite3.Error:
                    n = 0
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    try:
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "n long").agg(F.sum("n")).first()[0] or 0
    except Exception as e:  # noqa: BLE001  only a path that isn't there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


def pairs(rows: DataFrame) -> DataFrame:
    """file_id, state, pairs of the pair cache: `none` where the text is null, an array of (law, act) elsewhere."""
    told = F.transform(F.from_json("pares", "array<array<string>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("law"), F.get(p, F.lit(1)).alias("act")))
    return rows.select("file_id", F.when(F.col("pares").isNull(), "none").otherwise("pairs").alias("state"), told.alias("pairs"))
