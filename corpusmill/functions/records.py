"""Small rules on records: codes, times, shortcuts, links and what a result shows of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OVERLAP = "5 minutes"
CHIPS = 4


def query_literal(value: Column) -> Column:
    """A value inside a listing query: backslashes and single quotes are escaped."""
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def code_parts(code: Column) -> tuple[Column, Column]:
    """The digits and the letters of a code, without anything else."""
    clean = F.regexp_replace(F.upper(code), "[^0-9A-Z]", "")
    return F.regexp_extract(clean, "^(\\d*)", 1), F.regexp_extract(clean, "([A-Z]*)$", 1)


def iso_time(text: Column) -> Column:
    """A timestamp from ISO text; without a zone it is UTC, what can't be read is null."""
    zoned = F.when(text.rlike("(Z|[+-]\\d{2}:?\\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def iso_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def since(last_scan: Column, checkpoint: Column, asked: Column | None = None) -> Column:
    """Where a scan starts: what was asked for, else the last scan, else the checkpoint, less the overlap for both."""
    found = F.coalesce(last_scan, checkpoint) - F.expr(f"INTERVAL {OVERLAP}")
    return F.coalesce(asked, found) if asked is not None else found


def revision(own: Column, target: Column) -> Column:
    """Of a shortcut's time and its target's, as text: the later one."""
    return F.greatest(F.coalesce(own, F.lit("")), F.coalesce(target, F.lit("")))


def resolved(id: Column, kind: Column, target_id: Column, target_kind: Column) -> tuple[Column, Column]:
    """Id and type of a shortcut's target, else the item's own."""
    return F.coalesce(F.nullif(target_id, F.lit("")), id), F.coalesce(F.nullif(target_kind, F.lit("")), kind)


def public_id(*keys: Column) -> Column:
    """The first key that isn't empty."""
    return F.coalesce(*[F.nullif(k, F.lit("")) for k in keys])


def decorated(path: Column, own_id: Column, *public: Column) -> dict[str, Column]:
    """What a result shows of its file: extension, the id under which it is public, whether there is one."""
    key = public_id(*public)
    return {"ext": F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1)), "public_id": key, "id": own_id, "available": key.isNotNull()}


def chips(labels: Column, n: int = CHIPS) -> Column:
    """The first labels joined, and how many more there are."""
    more = F.size(labels) - n
    return F.concat(F.array_join(F.slice(labels, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(F.lit("")))


def processed_ids(lists: Column) -> Column:
    """Distinct ids of a map of lists, without empty ones."""
    return F.array_distinct(F.filter(F.flatten(F.map_values(lists)), lambda x: x.isNotNull() & (x != "")))
