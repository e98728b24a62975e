"""Benchmark decontamination by suffix arrays of the training documents.

Documents are shards of about SHARD words, each within one task. A shard has a suffix array: the places of all its words in
the order of the word sequences that start there (prefix doubling over dense word numbers; a document's end is a number of
its own, so no sequence runs on into the next document). Every suffix of every benchmark item is searched in it by binary
search, word by word: the range of places that agree shrinks, and what is left after a whole window are all its locations.
Locations that follow each other on a diagonal (document word minus item word) make up the longest verbatim matches.
Documents with a match are removed.

Words are runs of bytes other than 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F after A-Z are lower-cased: digits, a-z and all that is not
ASCII. They are compared by 64-bit names, so a false match takes as many equal names at once as a window has words. A window
is `width` consecutive words of an item; an item of fewer words, but not none, is one window of all of them.

Items go to every task in blocks of at most BLOCK words (about 30 bytes each); a benchmark of more blocks takes one pass over
the documents for each, with what was found so far written between passes. Items of equal words are searched once.

Null text: no words. Null item_id: the item takes no part. Repeated item_id: each row has its windows, the id counts once.
Repeated documents: each row is judged. A document of more than SHARD words is cut into shards that overlap by a window less one word, so
nothing is lost at the cuts. Empty tables: no document, or none contaminated. Other columns are dropped by find() and kept by
remove(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, buffers, discard, id_text, materialize, word_names

WIDTH, SHARD, BLOCK = 10, 1 << 19, 1 << 22
MATCHES = "array<struct<item:string,at:long,word:long,length:long>>"
_KIND = pa.list_(pa.struct([("item", pa.string()), ("at", pa.int64()), ("word", pa.int64()), ("length", pa.int64())]))
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[0x00:0x30] = _BETWEEN[0x3A:0x61] = _BETWEEN[0x7B:0x80] = True
_BETWEEN[0x41:0x5B] = False  # these become a-z


class Block:
    """Items as word names, one after the other: of each word, how many the item has from there on and its window's width."""

    def __init__(self, items: list[tuple[list[str], np.ndarray]], width: int) -> None:
        sizes = np.array([len(names) for _, names in items], dtype=np.int64)
        self.ids = [ids for ids, _ in items]
        self.names = np.concatenate([np.zeros(0, np.uint64), *(names for _, names in items)])
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.at = np.arange(len(self.names)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.left = sizes[self.item] - self.at
        self.need = np.minimum(sizes, width)[self.item]


def blocks(benchmark: DataFrame, width: int, most: int) -> Iterator[Block]:
    """The items in blocks of at most `most` words (or one longer item), each made when it is asked for."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).where("item is not null")
    own, held = [], 0
    for items, names in distinct_items(rows):
        if held and held + len(names) > most:
            yield Block(own, width)
            own, held = [], 0
        own.append((items, names))
        held += len(names)
    if own:
        yield Block(own, width)


def distinct_items(rows: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """(ids, word names) of the items that have words, those of equal words together; partition by partition to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, counts, names in word_names(*buffers(batch.column("text")), lower=True, space=_BETWEEN):
                out += [x.astype("<u8").tobytes() for x in np.split(names, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(out, pa.binary())], ["item", "names"])

    named = rows.mapInArrow(work, "item string, names binary").where(F.octet_length("names") > 0)
    for r in named.groupBy("names").agg(F.array_sort(F.collect_set("item")).alias("items")).orderBy(F.col("items")[0]).toLocalIterator():
        yield r["items"], np.frombuffer(r["names"], "<u8")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of text in the order of what follows them; the last number of text occurs once, and so do document ends."""
    n = len(text)
    bits = max(int(text.max()).bit_length(), 1)
    step = 62 // bits
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: max(n - k, 0)] |= text[k:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    rank[order] = np.repeat(start, size)
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_):
        # groups that agree so far are ordered by the rank of what comes `step` words later
        place = order[open_]
        key = rank[place] * n + rank[place + step]
        by = np.argsort(key, kind="stable")
        order[open_], key = place[by], key[by]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        rank[order[open_]] = np.repeat(open_[start], size)
        open_ = open_[np.repeat(size > 1, size)]
        step *= 2
    return order


class Shard:
    """A suffix array over the words of some documents."""

    def __init__(self, names: np.ndarray, counts: np.ndarray) -> None:
        docs = len(counts)
        self.vocabulary, number = np.unique(names, return_inverse=True)
        owner = np.repeat(np.arange(docs), counts)
        ends = np.cumsum(counts) + np.arange(docs)
        self.text = np.empty(len(names) + docs, np.int64)
        self.text[ends] = np.arange(docs)
        self.text[np.arange(len(names)) + owner] = number + docs
        self.docs, self.ends = docs, ends
        self.begins = np.concatenate([[0], ends[:-1] + 1])
        self.order = suffix_array(self.text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=docs + len(self.vocabulary)))])

    def numbers(self, names: np.ndarray) -> np.ndarray:
        """-1 for a word that the shard lacks."""
        if not len(self.vocabulary):
            return np.full(len(names), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, names), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == names, at + self.docs, -1)

    def bound(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
        """The first place of each range of the suffix array whose word at depth is not below word."""
        low, high = low.copy(), high.copy()
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            on = low < high
            mid = np.where(on, (low + high) >> 1, 0)
            less = on & (self.text[self.order[mid] + depth * on] < word)
            low = np.where(less, mid + 1, low)
            high = np.where(on & ~less, mid, high)
        return low

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Of every suffix of the items the range of the suffix array that begins with its window; empty if there is none.

        All suffixes go one word deeper at a time, each by two binary searches within the range that is left.
        """
        n = len(block.names)
        number = self.numbers(block.names)
        low_at, high_at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero((number >= 0) & (block.left >= block.need))
        low, high, depth = self.first[number[live]], self.first[number[live] + 1], 1
        while len(live):
            whole = block.need[live] == depth
            low_at[live[whole]], high_at[live[whole]] = low[whole], high[whole]
            live, low, high = live[~whole], low[~whole], high[~whole]
            word = number[live + depth]
            low, high = self.bound(low, high, depth, word), self.bound(low, high, depth, word + 1)
            on = (low < high) & (word >= 0)
            live, low, high, depth = live[on], low[on], high[on], depth + 1
        return low_at, high_at

    def where(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which range, place in the text) of all that the ranges hold."""
        n = high - low
        which = np.repeat(np.arange(len(low)), n)
        return which, self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]

    def occurrences(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, its word, item's word as a place in the block) of every occurrence of a window."""
        low, high = self.search(block)
        on = np.flatnonzero(high > low)
        which, place = self.where(low[on], high[on])
        doc = np.searchsorted(self.ends, place)
        return doc, place - self.begins[doc], on[which]


def shards(data: np.ndarray, offsets: np.ndarray, width: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, whole documents' counts of words, shard documents' rows, first words, names) of runs of rows."""
    for row, counts, names in word_names(data, offsets, lower=True, space=_BETWEEN):
        base = np.concatenate([[0], np.cumsum(counts)])
        doc = 0
        while doc < len(counts):
            # as many documents as a shard holds; one at least, and that in pieces if it is longer
            to = max(int(np.searchsorted(base, base[doc] + size, side="right")) - 1, doc + 1)
            own, whole = names[base[doc] : base[to]], counts[doc:to]
            if len(own) <= size:
                yield row + doc, whole, np.arange(to - doc), np.zeros(to - doc, np.int64), whole, own
            else:
                for at in range(0, len(own), size):
                    piece = own[at : at + size + width - 1]
                    yield row + doc, whole if not at else whole * 0, np.zeros(1, np.int64), np.array([at]), np.array([len(piece)]), piece
            doc = to


def diagonals(doc: np.ndarray, word: np.ndarray, place: np.ndarray, block: Block) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, item's word, document's word, words) of the longest matches that the occurrences make up."""
    order = np.lexsort((word, word - place, doc))
    doc, word, place = doc[order], word[order], place[order]
    new = np.ones(len(doc), dtype=bool)
    if len(doc):
        new[1:] = (doc[1:] != doc[:-1]) | (word[1:] - word[:-1] > 1) | (place[1:] - place[:-1] != word[1:] - word[:-1]) | (block.item[place[1:]] != block.item[place[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    length = word[last] - word[first] + block.need[place[first]]
    return zip(doc[first].tolist(), block.item[place[first]].tolist(), block.at[place[first]].tolist(), word[first].tolist(), length.tolist(), strict=True)


def covered(matches: list[dict]) -> int:
    """Words inside any match."""
    n, end = 0, 0
    for word, length in sorted((m["word"], m["length"]) for m in matches):
        n += max(0, word + length - max(word, end))
        end = max(end, word + length)
    return n


def matched(rows: DataFrame, block: Block, width: int, size: int) -> DataFrame:
    """(doc_id, text, n_words, n_hit, matches) of rows (doc_id, text, matches), with the matches of one more block."""
    sent = rows.sparkSession.sparkContext.broadcast(block)  # BLOCK words at most, or one item

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            matches = [x or [] for x in batch.column("matches").to_pylist()]
            words = np.zeros(batch.num_rows, np.int64)
            found: list[tuple[np.ndarray, ...]] = []
            for row, counts, docs, at, sizes, names in shards(*buffers(batch.column("text")), width, size):
                words[row : row + len(counts)] += counts
                if len(names):
                    doc, word, place = Shard(names, sizes).occurrences(block)
                    found.append((docs[doc] + row, word + at[doc], place))
            doc, word, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            for d, item, first, start, length in diagonals(doc, word, place, block):
                matches[d] += [{"item": i, "at": first, "word": start, "length": length} for i in block.ids[item]]
            hit = pa.array([covered(m) for m in matches], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(words), hit, pa.array(matches, _KIND)], ["doc_id", "text", "n_words", "n_hit", "matches"])

    return rows.mapInArrow(work, f"doc_id long, text string, n_words long, n_hit long, matches {MATCHES}")


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = BLOCK, size: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_hit, items, matches of every document.

    matches: (item, its first word, the document's first word, words) of every longest verbatim match of a window or more;
    items: their distinct ids, sorted as strings; n_hit: words of the document inside any match. most: words of a block of items;
    size: words of a shard; neither changes a result.
    """
    rows = id_text(docs).withColumn("matches", F.array().cast(MATCHES))
    made = blocks(benchmark, width, most)
    written, block = None, next(made, None) or Block([], width)  # without items words are counted all the same
    while block is not None:
        rows, block = matched(rows, block, width, size), next(made, None)
        if block is not None:
            rows = materialize(rows, "matches")
            if written is not None:
                discard(written)
            written = rows

    return rows.select("doc_id", "n_words", "n_hit", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"]))).alias("items"), "matches")


def longest(found: DataFrame) -> DataFrame:
    """item, length, places, doc_id, word, at: of find()'s rows, every item's longest verbatim match over all documents, at how many
    places of documents it stands, and the first of them (least doc_id, then word, then the item's word)."""
    each = found.select("doc_id", F.explode("matches").alias("m")).select("m.item", "m.length", F.struct("doc_id", "m.word", "m.at").alias("w"))
    by = each.groupBy("item", "length").agg(F.count("*").alias("places"), F.min("w").alias("w"))
    best = by.groupBy("item").agg(F.max_by(F.struct("length", "places", "w"), "length").alias("b"))
    return best.select("item", "b.length", "b.places", "b.w.doc_id", "b.w.word", "b.w.at")


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of any item."""
    columns = docs.columns
    bounded(docs.sparkSession)
    for i, block in enumerate(blocks(benchmark, width, BLOCK)):
        if i:
            docs = materialize(docs, "clean")
        docs = docs.where(~holds(block, width)(F.coalesce(F.col("text"), F.lit(""))))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def holds(block: Block, width: int):  # noqa: ANN201
    """A function of a text column: whether a window of the block's items is in it."""

    @F.pandas_udf("boolean")
    def has(text):  # noqa: ANN001, ANN202
        import pandas as pd

        hit = np.zeros(len(text), dtype=bool)
        for row, _, docs, _, sizes, names in shards(*buffers(pa.array(text, pa.string())), width, SHARD):
            if len(names):
                hit[docs[Shard(names, sizes).occurrences(block)[0]] + row] = True
        return pd.Series(hit)

    return has
