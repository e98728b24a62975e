"""A registry asked by key, with memory: each distinct key once, all tasks together under one rate.

The memory is a keyed table: of every key what the registry said (`found` with a value, `absent`), or `failed` after an error, how
often it was asked, and when last. A call asks for keys that were never asked, and again for failed ones, and for absent ones that are
older than a limit; all others are answered from memory. The answers of a call are written before they are used.

The client is any class with `get(key) -> str | None`; None: the registry has no such key. An OSError is tried again in a later slot;
after the last try the key has failed, which is a row and no error. Calls are dealt to the tasks of a barrier stage, which start
together: with n tasks and a rate of r a second, task i may call at (i + n k) / r seconds for whole k, so no two calls of the
whole cluster are nearer than 1 / r, whatever the calls take. A lost task runs the stage again; what it asked before is asked again.

Null keys are not asked and get no answer.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from importlib import import_module

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import KeyedTables
from .limits import Slots

KIND = "key string, state string, value string, attempts int, asked timestamp"


def memory(spark: SparkSession, folder: str) -> KeyedTables:
    return KeyedTables(spark, folder, {"answers": KIND}, key="key")


def unknown(keys: DataFrame, answers: DataFrame, again: int, absent_for: str | None) -> DataFrame:
    """(key, attempts) of the distinct keys to be asked; again: how often a failed one is asked in all; absent_for: an interval."""
    asked = keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct().join(answers, "key", "left")
    old = F.lit(False) if absent_for is None else (F.col("state") == "absent") & (F.col("asked") < F.current_timestamp() - F.expr(f"interval {absent_for}"))
    return asked.where(F.col("state").isNull() | ((F.col("state") == "failed") & (F.col("attempts") < again)) | old).select("key", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def ask(todo: DataFrame, client: str, rate: float, tries: int = 3, tasks: int | None = None) -> DataFrame:
    """The answers to todo (key, attempts) of the client `module.Class`."""
    tasks = tasks or todo.sparkSession.sparkContext.defaultParallelism

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, name = client.rpartition(".")
        own = getattr(import_module(module), name)()
        context = BarrierTaskContext.get()
        context.barrier()  # all tasks begin their slots together
        slots = Slots(rate, context.partitionId(), tasks)
        for frame in frames:
            out = []
            for key, attempts in zip(frame["key"], frame["attempts"], strict=True):
                state, value, n = "failed", None, int(attempts)
                for _ in range(tries):
                    slots.wait()
                    n += 1
                    try:
                        value = own.get(key)
                        state = "absent" if value is None else "found"
                        break
                    except OSError:
                        continue
                out.append((key, state, value, n, pd.Timestamp(time.time_ns() // 1000, unit="us", tz="UTC")))
            yield pd.DataFrame(out, columns=["key", "state", "value", "attempts", "asked"])

    return todo.repartition(tasks).mapInPandas(work, KIND, barrier=True)


def resolve(keys: DataFrame, table: KeyedTables, client: str, rate: float, tries: int = 3, again: int = 1 << 30, absent_for: str | None = None, tasks: int | None = None) -> DataFrame:
    """(key, state, value, attempts) of the distinct keys (key), the memory kept up on the way."""
    todo = unknown(keys, table.read("answers"), again, absent_for)
    if not todo.isEmpty():
        table.commit({"answers": (ask(todo, client, rate, tries, tasks), None)})
    wanted = keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    return wanted.join(table.read("answers"), "key").select("key", "state", "value", "attempts")
