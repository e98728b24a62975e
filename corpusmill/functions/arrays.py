"""Arrays within a row: values made once, running states without quadratic copies, characters of long texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, CHARS = 512, 4096


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once, however often the body uses it, branches and lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """(state, out) after all items: step(state, item) gives the next state and an element (of type kind) of out.

    out grows by blocks of BLOCK elements, so that the time is in proportion to the items.
    """

    def one(done: Column, item: Column) -> Column:
        state, element = step(done["state"], item)
        return F.struct(state.alias("state"), F.concat(done["out"], F.array(element)).alias("out"))

    def folded(items: Column) -> Column:
        def block(done: Column, number: Column) -> Column:
            fresh = F.struct(done["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
            own = F.aggregate(F.slice(items, number * BLOCK + 1, F.lit(BLOCK)), fresh, one)
            return bound(own, lambda b: F.struct(b["state"].alias("state"), F.concat(done["blocks"], F.array(b["out"])).alias("blocks")))

        numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("blocks"))
        return F.aggregate(numbers, start, block, lambda done: F.struct(done["state"].alias("state"), F.flatten(done["blocks"]).alias("out")))

    return bound(items, folded)


def chunked(text: Column) -> Column:
    """The text in chunks of CHARS characters, for between()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))


def between(chunks: Column, low: Column, high: Column) -> Column:
    """The characters [low, high) of a chunked text; only the chunks they lie in are read."""
    first = F.floor(low / CHARS).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, F.floor(high / CHARS).cast("int") - first + 1), "")
    return F.when(high > low, F.substring(near, low - first * CHARS + 1, high - low)).otherwise(F.lit(""))
