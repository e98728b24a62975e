"""Substring dedup by recompression: long runs of words that occur more than once, anywhere, are removed.

Words get 64-bit names. Runs of one name, then in ROUNDS rounds pairs of neighbours, get new names that are digests of
what they stand for, so the naming is the same everywhere without a dictionary: a name's bit says for each round whether
it may be the left or the right part of a pair. Whether two neighbours form a pair depends on these two alone, so all
occurrences of a window of WIDTH words share their symbols, but for at most one at each end and round. What is left
inside is computed for each window from its own words; its first symbol at the highest level that has one is the
window's anchor, about seven words long. Windows without such a symbol are their own anchor.

Anchors reveal repeats: each task sends, to the bucket of the anchor, short runs of consecutive windows that share one
(a tag of the anchor and 96 bits for each window), each distinct window once for FLUSH words. What repeats within these words
is known at once. A bucket verifies which windows meet an equal one and returns intervals. Windows are equal if two
digests of their words are, of 112 bits with the tag: words themselves are not compared, and the chance of a false match
among 10^14 windows is about one in a million. Anchors that are frequent in a
sample of documents are spread over buckets by window as well, so that no bucket grows with one passage. Documents meet
their intervals by joins on 128 bits of their doc_id and text; documents that surely have none stay where they are.

Null text: no words. Repeated rows repeat all their windows. Documents of fewer than WIDTH words lose nothing. Windows
don't cross documents. Very long texts and runs of any length of one word: places and counts are 64 bits wide. Ties can't
be: what repeats goes everywhere. Empty tables give no rows. Other columns are dropped by find(), kept by remove().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, buffers, id_text, materialize, mix, word_names

WIDTH, ROUNDS, FLUSH, BUCKET, LEAST_BUCKETS = 35, 6, 500_000, 16 << 20, 64
SAMPLE, SPREAD, FILTER_BITS, MOST_TASKS = 64, 64, 24, 1 << 15
_STEP = 0xD6E8FEB86659FD93 | 1
_OTHER = np.uint64(0x5851F42D4C957F2D)


class _Seq:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 19)
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _STEP, np.uint64)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, pow(_STEP, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
        return cls.up, cls.down


def window_names(names: np.ndarray, width: int) -> np.ndarray:
    up, down = _Seq.to(len(names) + 1)
    sums = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(names * up[: len(names)], out=sums[1:])
    n = len(names) - width + 1
    return mix((sums[width:] - sums[:n]) * down[:n])


def window_codes(names: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each window; the second one is of other names of the same words."""
    return window_names(names, width), window_names(mix(names ^ _OTHER), width)


def by_codes(code: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): an order with equal windows side by side, and whether each equals the one before it."""
    order = np.argsort(code, kind="stable")
    same, also = (np.concatenate([[False], x[order][1:] == x[order][:-1]])[: len(code)] for x in (code, other))
    if (same & ~also).any():
        # one digest is shared by different windows
        order = np.lexsort((other, code))
        same, also = (np.concatenate([[False], x[order][1:] == x[order][:-1]])[: len(code)] for x in (code, other))
    return order, same & also


def anchors(names: np.ndarray, owner: np.ndarray, starts: np.ndarray, codes: np.ndarray, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, its word) of the windows that start at words starts; owner: the document of each word."""
    n = len(names)
    head = np.ones(n, dtype=bool)
    head[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(head)
    run = np.cumsum(head) - 1
    length = np.diff(np.append(first, n)).astype(np.uint64)
    symbol = names[first].copy()
    long = length > 1
    symbol[long] = mix(symbol[long] * np.uint64(0x9FB21C651E98DF25) + length[long])
    low, high = run[starts] + 1, run[starts + width - 1]
    anchor, place = codes.copy(), starts.copy()
    live = np.flatnonzero(low < high)
    low, high = low[live], high[live]
    anchor[live], place[live] = symbol[low], first[low]
    for r in range(rounds):
        if not len(live):
            break
        left = (mix(symbol + np.uint64(0x2545F4914F6CDD1D * (r + 1) % (1 << 64))) & np.uint64(1)) == 0
        low = low + ~left[low]
        high = high - left[high - 1]
        keep = low < high
        live, low, high = live[keep], low[keep], high[keep]
        own = owner[first]
        pair = np.zeros(len(symbol), dtype=bool)  # the symbol is the left part of a pair
        pair[:-1] = left[:-1] & ~left[1:] & (own[:-1] == own[1:])
        stay = np.ones(len(symbol), dtype=bool)
        stay[1:] = ~pair[:-1]
        at = np.flatnonzero(pair)
        named = symbol.copy()
        named[at] = mix(symbol[at] * np.uint64(0x9E3779B97F4A7C15) + mix(symbol[at + 1] + np.uint64(r + 1)))
        fresh = np.cumsum(stay) - 1
        symbol, first = named[stay], first[stay]
        low, high = fresh[low], fresh[high - 1] + 1
        anchor[live], place[live] = symbol[low], first[low]
    return anchor, place


def located(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of texts: (row key: two longs, word, two digests, anchor, anchor's word) of each window, words counted in the row."""
    with np.errstate(over="ignore"):
        for batch in batches:
            one, two = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "row2"))
            for row, counts, names in word_names(*buffers(batch.column("text")), lower=False):
                if len(names) < width:
                    continue
                base = np.concatenate([[0], np.cumsum(counts)])
                owner = np.repeat(np.arange(len(counts)), counts)
                codes, others = window_codes(names, width)
                inside = np.flatnonzero(owner[: len(codes)] == owner[width - 1 :])
                if not len(inside):
                    continue
                anchor, place = anchors(names, owner, inside, codes[inside], width)
                who = owner[inside]
                yield one[row + who], two[row + who], inside - base[who], codes[inside], others[inside], anchor, place - base[who]


def frequent(rows: DataFrame, width: int) -> np.ndarray:
    """Anchors that more than a fiftieth of a part of the documents hold: where windows go, not what is found."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, anchor, place in located(batches, width):
            new = np.ones(len(anchor), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1])
            names, n = np.unique(anchor[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["anchor", "n"])

    some = rows.where(F.pmod(F.col("row"), F.lit(SAMPLE)) == 0)
    n = some.count()
    found = some.mapInArrow(work, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > max(20, n // 50)).orderBy(F.desc("n"), "anchor").limit(10_000)
    return np.sort(np.array([r["anchor"] for r in found.collect()], dtype=np.int64).view(np.uint64))


def intervals(one: np.ndarray, two: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key: two longs, first, count) of the runs of consecutive places of one key."""
    order = np.lexsort((at, two, one))
    one, two, at = one[order], two[order], at[order]
    new = np.ones(len(one), dtype=bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (at[1:] - at[:-1] > 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(one)) - 1 if len(one) else first
    return one[first], two[first], at[first], at[last] - at[first] + 1


SENT = {"keys": "<i8", "keys2": "<i8", "firsts": "<i8", "counts": "<u4", "tags": "<u2", "codes": "u1", "known": "<i8"}


def repeated(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row, row2, spans): of rows (row, row2, text), the runs (first, count) of windows that occur elsewhere as well."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET))
    hot = frequent(rows, width)

    def send(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, key2, at, code, other, anchor, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, same = by_codes(code, other)
        new = ~same
        group = np.cumsum(new) - 1
        many = np.bincount(group) > 1
        double, one = np.zeros(len(code), dtype=bool), np.zeros(len(code), dtype=bool)
        double[order] = many[group]
        one[order[new]] = True
        known = np.stack(intervals(key[double], key2[double], at[double]), axis=1)
        key, key2, at, code, other, anchor, place = (x[one] for x in (key, key2, at, code, other, anchor, place))
        spread = np.isin(anchor, hot) if len(hot) else np.zeros(len(anchor), dtype=bool)
        route = anchor.copy()
        route[spread] = mix(route[spread] + code[spread] % np.uint64(SPREAD))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1]) | (at[1:] - at[:-1] != 1) | (place[1:] != place[:-1]) | (route[1:] != route[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(key)))
        goal = (mix(route[first]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(goal, kind="stable")
        live, cut = np.unique(goal[order], return_index=True)
        packed = np.concatenate([x.view(np.uint8).reshape(-1, 8)[:, :6] for x in (code, other)], axis=1)
        for b, runs, mine in zip(live, np.split(order, cut[1:]), np.array_split(known, len(live)), strict=True):
            n = count[runs]
            # the windows of the runs, one run after the other
            windows = np.repeat(first[runs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            tag = anchor[first[runs]] >> np.uint64(48)
            told = dict(zip(SENT, (key[first[runs]], key2[first[runs]], at[first[runs]], n, tag, packed[windows], mine), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *(pa.array([x.astype(SENT[c]).tobytes()], pa.binary()) for c, x in told.items())], ["bucket", *SENT])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for part in located(batches, width):
            parts.append(part)
            held += len(part[0])
            if held >= FLUSH:
                yield from send(parts)
                parts, held = [], 0
        if parts:
            yield from send(parts)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = None, []

        def told(*spans: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(spans[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[i : i + 100_000])) for x in spans], ["row", "row2", "first", "count"])

        def bucket(parts: list[dict]) -> Iterator[pa.RecordBatch]:
            whole = lambda name: np.concatenate([np.frombuffer(p[name], SENT[name]) for p in parts])
            yield from told(*whole("known").reshape(-1, 4).T)
            n = whole("counts").astype(np.int64)
            raw = np.zeros((2, int(n.sum()), 8), np.uint8)
            raw[:, :, :6] = whole("codes").reshape(-1, 2, 6).transpose(1, 0, 2)
            code, other = raw.view("<u8")[:, :, 0]
            order, same = by_codes(code | np.repeat(whole("tags").astype(np.uint64) << np.uint64(48), n), other)
            if len(same):
                same[:-1] |= same[1:]
            hit = np.sort(order[same])
            run = np.searchsorted(np.cumsum(n), hit, side="right")
            base = np.concatenate([[0], np.cumsum(n)])[run]
            yield from told(*intervals(whole("keys")[run], whole("keys2")[run], whole("firsts")[run] + hit - base))

        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                if r["bucket"] != number and parts:
                    yield from bucket(parts)
                    parts = []
                number = r["bucket"]
                parts.append(r)
        if parts:
            yield from bucket(parts)

    sent = rows.mapInArrow(gather, "bucket long, " + ", ".join(f"{c} binary" for c in SENT))
    # as many tasks as buckets, so that a task's share doesn't grow with the input
    found = sent.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(verify, "row long, row2 long, first long, count long")
    return materialize(found.groupBy("row", "row2").agg(F.collect_set(F.struct("first", "count")).alias("spans")), "repeats")


def flagged(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with `maybe`: whether row may be among ids, by a bitmap of at most 2**FILTER_BITS bits."""
    spot = F.pmod(F.xxhash64("row", "row2"), F.lit(1 << FILTER_BITS)) + 1
    maps = ids.select(spot.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(_x) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = rows.withColumn("_x", spot).join(F.broadcast(maps), F.bitmap_bucket_number("_x") == F.col("bucket"), "left")
    bit = F.getbit(byte, (F.bitmap_bit_position("_x") % 8).cast("int"))
    return met.withColumn("maybe", F.coalesce(bit == 1, F.lit(False))).drop("_x", "bucket", "bits")


def kept_words(text: bytes, spans: list[dict] | None, width: int) -> tuple[int, int, bytes | None]:
    """(words, removed, the kept ones joined by a space, or None if all are kept)."""
    words = text.split()
    if spans is None or not len(spans):
        return len(words), 0, None
    edge = np.zeros(len(words) + 1, np.int64)
    first, count = (np.array([s[c] for s in spans], dtype=np.int64) for c in ("first", "count"))
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count - 1 + width, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return len(words), int(len(words) - keep.sum()), b" ".join(compress(words, keep))


def row_key(rows: DataFrame) -> DataFrame:
    """rows with row and row2, 128 bits of doc_id and text: at very many rows 64 would be shared."""
    both = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")).cast("binary"))
    half = lambda low: F.conv(F.substring(both, low, 16), 16, -10).cast("long")
    return rows.withColumns({"row": half(1), "row2": half(17)})


def met(rows: DataFrame, width: int) -> list[DataFrame]:
    """rows (with row, row2, text) and their spans, in two parts: by a join, and those that surely have none."""
    spans = repeated(rows.select("row", "row2", "text"), width)
    told = flagged(rows, spans.select("row", "row2"))
    return [told.where("maybe").drop("maybe").join(spans, ["row", "row2"], "left"), told.where("not maybe").drop("maybe").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))]


def find(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space) of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            out = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                n, removed, kept = kept_words(text := data[at[i] : at[i + 1]].tobytes(), spans, width)
                out.append((n, removed, (b" ".join(text.split()) if kept is None else kept).decode(errors="replace")))
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept"])

    one, other = (x.select("doc_id", "text", "spans").mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string") for x in met(row_key(id_text(docs)), width))
    return one.union(other)


def remove(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs with all their columns; texts that lose words are their kept words joined by one space."""
    columns = docs.columns
    bounded(docs.sparkSession)

    @F.pandas_udf("string")
    def left(text: pd.Series, spans: pd.Series) -> pd.Series:
        kept = (kept_words(t.encode(), s, width)[2] for t, s in zip(text, spans, strict=True))
        return pd.Series([t if k is None else k.decode() for t, k in zip(text, kept, strict=True)])

    own = row_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("all"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))).drop("doc_id")
    one, other = met(own, width)
    changed = one.withColumn("now", F.when(F.col("spans").isNotNull(), left("text", "spans")).otherwise(F.col("all.text")))
    pick = lambda x, text: x.select(*[(text.alias(c) if c == "text" else F.col("all")[c].alias(c)) for c in columns])
    return pick(changed, F.col("now")).union(pick(other, F.col("all")["text"]))
