"""Writers: nested JSON lines, CSV with distinct rows, a checkpoint object, and the tree of levels, laws and acts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import lacking


def json_lines(df: DataFrame, path: str, order: list[str], with_text: bool = True, text: str = "texto") -> None:
    """Sorted lines; Spark's range partitions keep the order over files, so no task holds all rows.

    All files are written beside and take the export's place when they are whole, so a job that fails leaves the former export
    as it was, and df may read it.
    """
    out = df if with_text else df.drop(text)
    replaced(df.sparkSession, path, lambda beside: out.orderBy(*order).write.option("ignoreNullFields", True).json(beside))


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """write(folder) fills a new folder, which then takes path's place by a rename.

    Between the former folder's leaving and the new one's coming there is none for the time of a rename; if the writer ends there,
    `restore` (which the next `replaced` of the path calls) brings the former one back. What failed writers left is removed.
    """
    target, fs = _place(spark, path)
    restore(spark, path)
    parent, name = target.getParent(), target.getName()
    in_parent = lambda x: spark._jvm.org.apache.hadoop.fs.Path(parent, x)
    beside, former = in_parent(f".{name}.{uuid.uuid4().hex}.part"), in_parent(f".{name}.former")
    try:
        write(beside.toString())
        if fs.exists(target) and not fs.rename(target, former):
            raise OSError(f"{path} can't be moved")
        if not fs.rename(beside, target):
            raise OSError(f"{beside.toString()} can't be moved")
    except BaseException:
        restore(spark, path)
        fs.delete(beside, True)
        raise
    fs.delete(former, True)


def restore(spark: SparkSession, path: str) -> bool:
    """Brings a former export back that was moved away without another in its place; removes it if there is another."""
    target, fs = _place(spark, path)
    former = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.former")
    if not fs.exists(former):
        return False
    if fs.exists(target):
        fs.delete(former, True)
        return False
    return fs.rename(former, target)


def csv_rows(df: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Distinct rows that known lacks, appended with a header; empty fields are equal to each other."""
    fresh = df.dropDuplicates()
    if known is not None:
        fresh = lacking(fresh, known, df.columns)
    fresh.write.mode("append").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    target, fs = _place(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def small_text(spark: SparkSession, path: str) -> str:
    """A small file, read by the driver without a job."""
    target, fs = _place(spark, path)
    source = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _place(spark, path)
    fs.delete(target, True)


def fan_out(df: DataFrame, path: str) -> None:
    """One folder for each level, law and act. What is there (by level, law, act and id) stays; only what is absent comes.

    Rows of a folder are dealt to several tasks if Spark finds it large.
    """
    parts = ["level", "law", "act"]
    if exists(df.sparkSession, path):
        there = df.sparkSession.read.schema(df.schema).parquet(path).select(*parts, "id")
        df = df.join(there, [*parts, "id"], "left_anti")
    df.dropDuplicates([*parts, "id"]).hint("rebalance", *parts).write.mode("append").partitionBy(*parts).parquet(path)


def checkpoint_object(row: dict, path: str, spark: SparkSession) -> None:
    """One JSON object with sorted keys, written beside and renamed, so readers see the old one or the new one."""
    _renamed(spark, path, json.dumps(row, ensure_ascii=False, sort_keys=True, indent=2), "OVERWRITE")


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """A file that must not be there yet, whole or not at all: of two writers of one path the second fails."""
    _renamed(spark, path, text, "NONE")


def _renamed(spark: SparkSession, path: str, text: str, option: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.part")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    fs = target.getFileSystem(conf)
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    # the new one takes its place in one step
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, option)
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(target), how)
    except Exception:
        fs.delete(beside, False)
        raise


def patch_checkpoint(old: dict, counts: dict, public: dict, description: str) -> dict:
    """Two parts replaced, the rest kept, the description only where there is none."""
    return {**old, "counts": {**(old.get("counts") or {}), **counts}, "public_drive": public, "description": old.get("description") or description}


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))
