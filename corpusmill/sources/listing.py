"""A paged folder listing as a Python data source: one partition for each folder, pages fetched until no token is left.

The client is any class with `page(folder, token, fields) -> (items, next token)`; tests use one over a dict. Calls are
retried with growing waits. Predicates on type and time are pushed to the client as part of the request.

As a stream, the source's offset is the time up to which the folders were listed. A batch lists [start - overlap, end), so that an
item which the store shows late is still met; those met before come again and are dropped by `streaming.feed.changes`. A batch
that is tried again lists the same interval.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

SCHEMA = "id string, name string, mimeType string, size string, parents array<string>, modifiedTime string"


def waits(tries: int, first: float = 2.0, most: float = 60.0) -> Iterator[float]:
    """first, twice that, and so on, up to most; tries 0: without end."""
    n = 0
    while not tries or n < tries:
        yield min(first * 2**n, most)
        n += 1


def retried(call, tries: int = 20, first: float = 2.0, most: float = 60.0, sleep=time.sleep):  # noqa: ANN001, ANN201
    last: Exception | None = None
    for wait in waits(tries, first, most):
        try:
            return call()
        except OSError as e:
            last = e
            sleep(wait)
    raise last or OSError("no try was made")


def request(folder: str, pushed: dict) -> str:
    """The listing query a client of this kind of store would send."""
    # The query words of the store's interface.
    quoted = lambda x: "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    parts = [f"({quoted(folder)} in parents)", "trashed=false"]
    if "after" in pushed:
        parts.append(f"modifiedTime > {quoted(pushed['after'])}")
    if "from" in pushed:
        parts.append(f"modifiedTime >= {quoted(pushed['from'])}")
    if "before" in pushed:
        parts.append(f"modifiedTime < {quoted(pushed['before'])}")
    if "types" in pushed:
        parts.append("(" + " or ".join(f"mimeType={quoted(t)}" for t in sorted(pushed["types"])) + ")")
    if "name" in pushed:
        parts.append(f"name contains {quoted(pushed['name'])}")
    return " and ".join(parts)


class Folder(InputPartition):
    def __init__(self, folder: str) -> None:
        self.folder = folder


class ListingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.pushed: dict[str, object] = {}

    def pushFilters(self, filters):  # noqa: ANN001, ANN201, N802
        """Type (one or a list), a lower bound on time and the name's beginning go to the client; all others stay with Spark.

        Such a store's `contains` finds beginnings of words, which a part of a name need not be.

        The folder is the partition's own, and clients list nothing that is in the bin.
        """
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("mimeType",):
                self.pushed["types"] = [f.value]
            elif isinstance(f, In) and f.attribute == ("mimeType",):
                self.pushed["types"] = list(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("name",):
                self.pushed["name"] = f.value
            elif isinstance(f, GreaterThan) and f.attribute == ("modifiedTime",):
                self.pushed["after"] = f.value
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("modifiedTime",):
                self.pushed["from"] = f.value
            yield f  # a client may ignore them, so Spark checks again

    def partitions(self) -> list[Folder]:
        return [Folder(f) for f in self.options["path"].split(",") if f]

    def read(self, partition: Folder):  # noqa: ANN201
        return pages(self.options, partition.folder, self.pushed)


def made(options: dict):  # noqa: ANN201
    """A client, of the class that the options name; the driver and the executors must be able to import it."""
    module, _, name = options["client"].rpartition(".")
    return getattr(import_module(module), name)()


def pages(options: dict, folder: str, pushed: dict) -> Iterator[tuple]:
    """All items of a folder, page by page; a page is asked for again when the call fails."""
    client, tries, first, token = made(options), int(options.get("tries", 20)), float(options.get("wait", 2)), None
    while True:
        items, token = retried(lambda: client.page(folder, token, pushed), tries, first)  # noqa: B023
        for i in items:
            row = (i["id"], i.get("name"), i.get("mimeType"), i.get("size"), i.get("parents", [folder]), i.get("modifiedTime"))
            yield (*row, moment(row[5])) if options.get("times") else row
        if not token:
            return


def moment(text: str | None) -> datetime | None:
    """A time from ISO text; without a zone it is UTC, what can't be read is None."""
    try:
        found = datetime.fromisoformat(text) if text else None
    except ValueError:
        return None
    return found.replace(tzinfo=UTC) if found and found.tzinfo is None else found


def written(time: datetime) -> str:
    return time.astimezone(UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")


class Interval(InputPartition):
    """A folder's items modified from `start` to before `end`; without a start, also those without a time."""

    def __init__(self, folder: str, start: str, end: str) -> None:
        self.folder, self.start, self.end = folder, start, end


class ListingStreamReader(DataSourceStreamReader):
    """Options besides those of the table: `since` (the first batch begins there, else with the first item), `overlap` (300 s),
    `slices` (1): into how many equal times a folder's interval is cut, so that a large folder is listed by several tasks.

    A client may tell the store's time by `now()`; else it is this machine's, whose lag the overlap has to cover.
    """

    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": self.options.get("since", "")}

    def latestOffset(self) -> dict:  # noqa: N802
        client = made(self.options)
        return {"until": written(moment(client.now()) if hasattr(client, "now") else datetime.now(UTC))}

    def partitions(self, start: dict, end: dict) -> list[Interval]:
        since, until = moment(start["until"]), moment(end["until"])
        if since:
            since -= timedelta(seconds=float(self.options.get("overlap", 300)))
        n = int(self.options.get("slices", 1)) if since else 1
        cuts = [since + (until - since) * k / n for k in range(n)] + [until] if since else [None, until]
        texts = [written(c) if c else "" for c in cuts]
        return [Interval(f, a, b) for f in self.options["path"].split(",") if f for a, b in zip(texts, texts[1:], strict=False)]

    def read(self, partition: Interval):  # noqa: ANN201
        """Rows of the interval alone, whatever the client made of the bounds."""
        start, end = moment(partition.start), moment(partition.end)
        pushed = {"before": partition.end, **({"from": partition.start} if start else {})}
        for row in pages(self.options, partition.folder, pushed):
            at = moment(row[5])
            if (at is None and start is None) or (at is not None and at < end and (start is None or at >= start)):
                yield row


class ListingSource(DataSource):
    """spark.dataSource.register(ListingSource); spark.read.format("listing").option("client", "module.Class").load("folder,folder"); readStream alike."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        """With the option `times`, also `at`: modifiedTime as a timestamp, null if it can't be read."""
        return SCHEMA + (", at timestamp" if self.options.get("times") else "")

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options)

    def streamReader(self, schema: StructType) -> ListingStreamReader:  # noqa: N802
        return ListingStreamReader(self.options)
