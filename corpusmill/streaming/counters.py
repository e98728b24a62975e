"""Counters of running work: each batch of a stream is counted where its rows pass, and a panel adds batches up as they end.

`counted` observes a stream whose sink reads a batch once; `Panel` listens to the session's streams, and tasks send their partial
counts with their results. A foreachBatch handler may read its batch several times, which would count it as often: `Panel.batches`
holds the batch, counts what it holds in one aggregation and adds it when the handler has ended. Either way a batch that is tried
again is counted when it ends, once.
"""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NAME = "counters"
#: What is ended for good, out of all that was found; the rest is open.
DONE = ("organized", "without_act", "passed_over")
FIELDS = ("total", "indexed", "downloaded", "skipped", *DONE, "citations", "citations_done", "errors")
TOP = 12


def _sums(rows: DataFrame, found: dict[str, Column]) -> list[Column]:
    kinds = rows.select(*[c.alias(f) for f, c in found.items()]).schema
    one = lambda f, c: F.count_if(c) if kinds[f].dataType.typeName() == "boolean" else F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return [one(f, c).alias(f) for f, c in found.items()]


def counted(stream: DataFrame, found: dict[str, Column], name: str = NAME) -> DataFrame:
    """The stream, whose rows are counted by condition (boolean columns) or added up (numeric ones); null counts as nothing."""
    return stream.observe(name, *_sums(stream, found))


def duration(seconds: float) -> str:
    """`1h02m03s`, `2m03s` or `3s`, truncated."""
    h, rest = divmod(int(seconds), 3600)
    m, s = divmod(rest, 60)
    return f"{h}h{m:02}m{s:02}s" if h else f"{m}m{s:02}s" if m else f"{s}s"


class Panel(StreamingQueryListener):
    """Adds the observed counts of every batch that ends; `snapshot` tells counts, shares and the time that is left.

    Fields are those of FIELDS and any others that `counted` names. What a batch's handler finds (acts, errors) may be added by `add`
    and `add_acts`; these take a batch's number, and a number that came before is not added again.
    """

    def __init__(self, name: str = NAME, folders: int = 0, clock: Callable[[], float] = time.time) -> None:
        self.name, self.folders, self.clock = name, folders, clock
        self.began = clock()
        self.counts, self.acts = Counter(), Counter()
        self._lock, self._seen = threading.Lock(), set()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.add(row.asDict(), (str(event.progress.id), event.progress.batchId))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass

    def add(self, counts: dict[str, int | None], batch: object = None) -> bool:
        """Whether the counts were added: those of a batch that was counted are not."""
        with self._lock:
            if batch is not None and batch in self._seen:
                return False
            self._seen.add(batch)
            self.counts.update({f: int(n or 0) for f, n in counts.items()})
            return True

    def batches(self, found: dict[str, Column], handle: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """handle for foreachBatch, whose batches are counted when it has ended."""

        def work(batch: DataFrame, number: int) -> None:
            held = batch.persist()
            try:
                handle(held, number)
                self.add(held.agg(*_sums(held, found)).first().asDict(), number)
            finally:
                held.unpersist()

        return work

    def add_acts(self, done: DataFrame, level: str = "level", act: str = "act", batch: object = None) -> None:
        """Documents of each level and act in a batch; the distinct pairs are the folders of the tree, not the documents."""
        rows = done.where(F.col(act).isNotNull()).groupBy(level, act).count().collect()
        with self._lock:
            if batch is not None and ("acts", batch) in self._seen:
                return
            self._seen.add(("acts", batch))
            self.acts.update({f"{r[level]}/{r[act]}": r["count"] for r in rows})

    def snapshot(self) -> dict:
        """All fields, most common acts (ties by name), shares of 0 to 100, seconds gone and left (None: not known yet)."""
        with self._lock:
            counts, acts = {f: self.counts.get(f, 0) for f in dict.fromkeys((*FIELDS, *self.counts))}, dict(self.acts)
        share = lambda n, of: min(100.0, 100.0 * n / of) if of else 0.0
        done, gone = sum(counts[f] for f in DONE), max(0.0, self.clock() - self.began)
        total = counts["total"]
        if self.folders and 0 < counts["indexed"] < self.folders:
            total = -(-total * self.folders // counts["indexed"])  # folders still to be listed hold as much, each
        left = max(0, total - done) * gone / done if done and gone else None
        return {
            **counts,
            "done": done,
            "percent": share(done, counts["total"]),
            "citations_percent": share(counts["citations_done"], counts["citations"]),
            "acts": sorted(acts.items(), key=lambda a: (-a[1], a[0]))[:TOP],
            "seconds": gone,
            "left_s": left,
        }

    def lines(self) -> list[str]:
        s = self.snapshot()
        left = "-" if s["left_s"] is None else duration(s["left_s"])
        return [
            f"gone {duration(s['seconds'])}, left {left}",
            f"folders {s['indexed']} / {self.folders}, found {s['total']}, fetched {s['downloaded']} + {s['skipped']} there",
            f"done {s['done']} / {s['total']} ({s['percent']:.1f}%), citations {s['citations_done']} / {s['citations']} ({s['citations_percent']:.1f}%)",
            f"organized {s['organized']}, without act {s['without_act']}, passed over {s['passed_over']}, errors {s['errors']}",
            *[f"{n:>7}  {act}" for act, n in s["acts"]],
        ]
