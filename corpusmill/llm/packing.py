"""Lexical retrieval packing: documents fill windows of fixed size with their nearest unused neighbours.

Documents are encoded once. Document frequencies of all terms (token ids) and the mean length cover all documents. Documents
that share their rarer terms are dealt to the same shard: a document's keys are the least of its terms in KEYS fixed random
orders in which a term comes the earlier the rarer it is (exponential clocks at the rate idf**RATE), so two documents have a
key in common as often as they share weight. Keys are dealt to tasks by the ids of their documents, a key with very many to
several; a task's documents are sorted by their keys and cut into shards of about SHARD ids. A shard's task builds a BM25 inverted index over its documents. The first unused document is the seed of a window;
while the window has room, the index returns the seed's best unused neighbours by its TERMS heaviest terms, then by all its
others, which fill it greedily. What a document leaves over opens the next window and its document is that window's seed. If
no document shares a term with the seed, the next unused one in order follows. So only the last window of a shard is shorter
than the window size.

Ids are those of the tokenizers library for its byte-level BPE file with add_special_tokens=False, then id 0 for the end of a
document. They are made by tiktoken from the same vocabulary's ranks, several times faster; the tests hold both against each
other. As in that call, a special token's own text within a document is its one id (`special`: text to id).

Null text: empty, which is packed as its end id. Equal scores: the document that comes first in the shard's order (by keys,
then as they were written). Repeated rows are packed each; keys that very many documents share are split between tasks, by
rows. A document longer than a window spans several; very long texts are one row's work. Empty tables give no rows. Other
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import id_text, materialize, mix

SHARD = 1 << 20  # ids in a shard
MOST_TASKS, SHARDS_A_TASK = 1 << 15, 4
TERMS = 8  # of greatest weight, which a seed asks for first
KEYS, RATE = 3, 3.0
K1, B = 1.2, 0.75
END = 0
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoded(docs: DataFrame, ranks: str, special: dict[str, int]) -> DataFrame:
    """(doc_id, ids, number) of every document, without end ids, written; ids as 16-bit or 32-bit numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, kind = codec(ranks), kind_of(ranks, special)

        def ids(text: str, names: list[str]) -> list[int]:
            while names and names[0] not in text:
                names = names[1:]
            if not names:
                return tool.encode(text)
            out: list[int] = []
            for i, part in enumerate(text.split(names[0])):
                out += [special[names[0]]] * (i > 0) + ids(part, names[1:])
            return out

        for batch in batches:
            told = [np.array(ids(text, list(special)), dtype=kind).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(told, pa.binary())], ["doc_id", "ids"])

    return materialize(id_text(docs).mapInArrow(work, "doc_id long, ids binary").withColumn("number", F.monotonically_increasing_id()), "encoded")


def vocabulary(ranks: str, special: dict[str, int]) -> int:
    return max(len(codec(ranks).size), *(i + 1 for i in special.values()), 1)


def kind_of(ranks: str, special: dict[str, int]) -> str:
    return "<u2" if vocabulary(ranks, special) <= 1 << 16 else "<u4"


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, their bounds) of a binary column."""
    rows = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate([*rows, np.zeros(0, kind)]), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)


@dataclass
class Statistics:
    """Of all documents: how many hold each term, how many there are, how many ids they have (the end not counted)."""

    df: np.ndarray
    docs: int
    ids: int

    @property
    def idf(self) -> np.ndarray:
        return np.log1p((self.docs - self.df + 0.5) / (self.df + 0.5)).astype(np.float32)

    @property
    def mean(self) -> float:
        return max(self.ids / max(self.docs, 1), 1.0)


def statistics(rows: DataFrame, size: int, kind: str) -> Statistics:
    """One row for each term comes back: the vocabulary's size is the bound."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, ids = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            terms, at = flat(batch.column("ids"), kind)
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            df += np.bincount(np.unique(owner * size + terms) % size, minlength=size)
            docs, ids = docs + batch.num_rows, ids + len(terms)
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, [-2, -1])), pa.array(np.append(df[on], [ids, docs]))], ["term", "n"])

    told = rows.select("ids").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = told["term"].to_numpy(), told["n"].to_numpy()
    df = np.zeros(size, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return Statistics(df, int(n[term == -1].sum()), int(n[term == -2].sum()))


def orders(stats: Statistics) -> np.ndarray:
    """KEYS x terms: each term's place in a random order that has rare shared terms first; terms of one document come last."""
    rate = np.where(stats.df > 1, np.maximum(stats.idf, 1e-6).astype(float) ** RATE, 0)
    with np.errstate(divide="ignore"):
        clocks = -np.log(np.random.default_rng(20_250).random((KEYS, len(rate)))) / rate
    places = np.empty((KEYS, len(rate)), np.int32)
    for row, clock in zip(places, clocks, strict=True):
        row[np.argsort(clock, kind="stable")] = np.arange(len(rate))
    return np.where(stats.df > 1, places, len(rate)).astype(np.int32)


class Index:
    """BM25 over documents given as arrays of term numbers, with the statistics of all documents."""

    def __init__(self, docs: list[np.ndarray], stats: Statistics) -> None:
        parts = [np.unique(d, return_counts=True) for d in docs]
        self.at = np.concatenate([[0], np.cumsum([len(t) for t, _ in parts])]).astype(np.int64)
        self.term = np.concatenate([t for t, _ in parts]).astype(np.int64)
        tf = np.concatenate([c for _, c in parts]).astype(np.float32)
        owner = np.repeat(np.arange(len(docs)), np.diff(self.at))
        size = np.array([len(d) for d in docs], dtype=np.float32)
        here = np.bincount(self.term)
        self.weight = stats.idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / stats.mean))
        self.weight[here[self.term] < 2] = 0  # no other document here has it
        order = np.argsort(self.term, kind="stable")
        self.posting, self.score = owner[order], self.weight[order]
        self.first = np.concatenate([[0], np.cumsum(here)])

    def neighbours(self, doc: int, used: np.ndarray, rest: bool = False) -> np.ndarray:
        """Unused documents that share one of doc's TERMS heaviest terms (or of the rest), by falling score, then order."""
        low, high = self.at[doc], self.at[doc + 1]
        weight = self.weight[low:high]
        best = np.argsort(-weight, kind="stable")
        best = best[TERMS:] if rest else best[:TERMS]
        terms = self.term[low + best[weight[best] > 0]]
        if not len(terms):
            return np.zeros(0, np.int64)
        place = [slice(self.first[t], self.first[t + 1]) for t in terms]
        who = np.concatenate([self.posting[p] for p in place])
        score = np.concatenate([self.score[p] for p in place])
        free = ~used[who]
        who, score = who[free], score[free]
        if not len(who):
            return who
        found, inverse = np.unique(who, return_inverse=True)
        return found[np.lexsort((found, -np.bincount(inverse, score)))]


def fill(docs: list[np.ndarray], window: int, stats: Statistics) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; docs: ids with their end id."""
    index = Index([d[:-1] for d in docs], stats)
    used = np.zeros(len(docs), dtype=bool)
    sequence, room, ahead = 0, window, 0
    seed, queue, at, asked = -1, np.zeros(0, np.int64), 0, 0
    while True:
        doc = -1
        while seed >= 0 and doc < 0:
            while at < len(queue) and used[queue[at]]:
                at += 1
            if at < len(queue):
                doc = int(queue[at])
            elif asked < 2:
                queue, at, asked = index.neighbours(seed, used, rest=asked == 1), 0, asked + 1
            else:
                break
        if doc < 0:
            while ahead < len(docs) and used[ahead]:
                ahead += 1
            if ahead == len(docs):
                return
            doc = ahead
        used[doc] = True
        start, n = 0, len(docs[doc])
        if room == window:
            seed, queue, at, asked = doc, queue[:0], 0, 0
        while start < n:
            length = min(room, n - start)
            yield doc, start, length, sequence, window - room
            start, room = start + length, room - length
            if not room:
                sequence, room = sequence + 1, window
                seed, queue, at, asked = (doc if start < n else -1), queue[:0], 0, 0


def pack(docs: DataFrame, ranks: str, window: int = 1024, shard: int = SHARD, special: dict[str, int] | None = None) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit) of each piece."""
    special = special or {}
    rows = encoded(docs, ranks, special)
    kind, size = kind_of(ranks, special), vocabulary(ranks, special)
    stats = statistics(rows, size, kind)
    places = orders(stats)
    names = [f"key{i}" for i in range(KEYS)]

    def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(KEYS x documents, ids of each)."""
        terms, at = flat(batch.column("ids"), kind)
        some = np.flatnonzero(np.diff(at))
        keys = np.full((KEYS, batch.num_rows), size, np.int32)
        if len(some):
            keys[:, some] = np.minimum.reduceat(places[:, terms], at[some], axis=1)
        return keys, np.diff(at)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            keys, n = keys_of(batch)
            total += np.bincount(keys[0], n + 1, size + 1).astype(np.int64)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["key", "n"])

    told = rows.select("ids").mapInArrow(measured, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # a row for each key, the vocabulary's size at most
    load = np.zeros(size + 1, np.int64)
    load[told["key"].to_numpy()] = told["n"].to_numpy()
    first, copies, tasks = dealt(load, max(shard * SHARDS_A_TASK, -(-int(load.sum()) // MOST_TASKS)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = keys_of(batch)
            number = mix(batch.column("number").to_numpy(zero_copy_only=False).astype(np.uint64))
            task = first[keys[0]] + (number % copies[keys[0]].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, keys), pa.array(task)], [*batch.schema.names, *names, "task"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held = TaskContext.get().partitionId() << 32, 0
        owners: list = []
        ids: list[np.ndarray] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base, owners, ids, held
            out: list[tuple] = []
            for doc, start, length, sequence, offset in fill(ids, window, stats):
                out.append((owners[doc], start, length, len(ids[doc]), base + sequence, offset, ids[doc][start : start + length].astype("<u4").tobytes()))
                if len(out) == 1000:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)
            base += sum(map(len, ids)) // window + 1
            owners, ids, held = [], [], 0

        for batch in batches:
            for name, own in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                owners.append(name)
                ids.append(np.append(np.frombuffer(own.as_buffer(), kind), np.array(END, kind)))
                held += len(ids[-1])
                if held >= shard:
                    yield from packed()
        if ids:
            yield from packed()

    told = rows.mapInArrow(keyed, f"doc_id long, ids binary, number long, {', '.join(f'{n} int' for n in names)}, task int")
    return told.repartitionById(tasks, "task").sortWithinPartitions(*names, "number").select("doc_id", "ids").mapInArrow(work, PIECE)


def dealt(load: np.ndarray, goal: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first task of each key, how many tasks it has, tasks in all): neighbouring keys share a task of about goal ids.

    A key with more than goal ids has tasks of its own.
    """
    first, copies = np.zeros(len(load), np.int32), np.ones(len(load), np.int32)
    task, held = 0, 0
    for key in np.flatnonzero(load):
        n = int(load[key])
        if held and held + n > goal:
            task, held = task + 1, 0
        first[key], copies[key] = task, -(-n // goal)
        if n > goal:
            task, held = task + int(copies[key]), 0
        else:
            held += n
    return first, copies, max(task + (held > 0), 1)


def frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(),) * 6 + (pa.binary(),)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
