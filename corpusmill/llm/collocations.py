"""Phrase collocation mining by compressed position bitmaps (SPAM).

Documents are shards of about SHARD words, each within one task. A shard keeps a bitmap of word places for each frequent word,
as its blocks of 64 places that aren't empty. A phrase's bitmap holds the places of its last word: shifted by one place, without
the places at which a piece begins, and ANDed with the bitmap of another word it is the bitmap of the phrase that goes on with
that word; its bits are counted. Phrases are extended depth-first, a group of first words at a time, and a shard's counts are
added up over all shards by Spark.

Two passes over the documents. The first adds up the counts of the hashes of all words and pairs, as sorted runs of numbers that
meet by hash; hashes that fall together only make a count too large, so no frequent one (`least` times in a language) is lost.
The second pass gets the frequent ones as two bitmaps of 2^BITS bits, which is all that is broadcast, extends frequent words by
frequent pairs to three words, and gives the words themselves; their exact counts decide. Parts are met by joins.

A-Z are lower-cased; texts are cut at `. , ; : ! ?` and 0x0A-0x0D into pieces and those at 0x20 and 0x09 into words. All is per
`lang` (null: `und`). Words are told apart within a shard by 64-bit names and everywhere else by themselves.

Null text: empty. Null doc_id: the document counts. Repeated documents: each counts. Very long texts: one text is one shard at
least; longer ones than SHARD words make larger shards. Ties in score are ordered by count, then by the phrase's bytes. Empty
tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, bounded, buffers, materialize, mix, split_join, word_names

SHARD, CELLS, BITS, TOP, SALTS = 1 << 19, 1 << 20, 26, 2000, 256
BUCKET, LEAST_BUCKETS, MOST_TASKS = 8 << 20, 16, 1 << 15  # bytes of text whose hashes one bucket holds
_BETWEEN, _CUT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_CUT[[*b".,;:!?\n\x0b\x0c\r"]] = True
_BETWEEN[[*b" \t"]] = True
_BETWEEN |= _CUT
_PAIR = 0x9E3779B97F4A7C15 | 1


class Shard:
    """The words of some texts: names (told apart by language), whether each begins a piece, and where they stand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> None:
        names, begins, starts, ends, rows = [], [], [], [], []
        self.lang_names = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.lang_names)}
        self.langs = np.array([number[x] for x in langs], dtype=np.int64)
        tags = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.lang_names], dtype=np.uint64)
        for row, counts, own, start, end in word_names(data, offsets, lower=True, places=True, space=_BETWEEN):
            owner = np.repeat(np.arange(len(counts)), counts) + row
            first = np.ones(len(own), dtype=bool)
            if len(own):
                low, high = int(start[0]), int(end[-1])
                cuts = np.concatenate([[0], np.cumsum(_CUT[data[low:high]])])
                piece = cuts[start - low]
                first[1:] = (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])
            with np.errstate(over="ignore"):
                names.append(mix(own ^ tags[self.langs[owner]]) if len(own) else own)
            begins.append(first)
            starts.append(start)
            ends.append(end)
            rows.append(owner)
        join = lambda x, t: np.concatenate([np.zeros(0, t), *x])
        self.begins, rows = join(begins, bool), join(rows, np.int64)
        # numbers of the distinct words, and of each its count, language and text
        self.names, place, self.word, self.counts = np.unique(join(names, np.uint64), return_index=True, return_inverse=True, return_counts=True)
        self.of_lang = self.langs[rows[place]]
        low, high = join(starts, np.int64)[place], join(ends, np.int64)[place]
        at = np.concatenate([[0], np.cumsum(high - low)])
        raw = data[np.arange(at[-1]) - np.repeat(at[:-1] - low, high - low)]
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        self.texts = pa.Array.from_buffers(pa.large_string(), len(place), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])

    def lang(self, word: np.ndarray) -> pa.Array:
        return pa.array(self.lang_names, pa.string()).take(pa.array(self.of_lang[word]))

    def text(self, word: np.ndarray) -> pa.Array:
        return self.texts.take(pa.array(word))


class Bitmaps:
    """Of every frequent word the blocks of 64 places that hold it: (block, bits), by word and by block."""

    def __init__(self, shard: Shard, live: np.ndarray, cells: int) -> None:
        self.cells = cells
        place = np.flatnonzero(live[shard.word])
        word, block = shard.word[place], place >> 6
        blocks = (len(shard.word) >> 6) + 2
        key = word * blocks + block
        order = np.argsort(key, kind="stable")
        key, bit = key[order], U64(1) << (place[order] & 63).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        self.word, self.block = key[first] // blocks, key[first] % blocks
        # the same rows by block
        self.by_block = np.argsort(self.block, kind="stable")
        self.block_at = np.searchsorted(self.block[self.by_block], np.arange(blocks + 1))
        self.inside = np.zeros(blocks, np.uint64)
        places = np.flatnonzero(~shard.begins)
        at = np.flatnonzero(np.concatenate([[True], (places[1:] >> 6) != (places[:-1] >> 6)])) if len(places) else places
        if len(at):
            self.inside[places[at] >> 6] = np.bitwise_or.reduceat(U64(1) << (places & 63).astype(np.uint64), at)

    def shifted(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every bit one place on, also into the next block, where no piece begins; rows stay ordered by phrase."""
        carry = np.flatnonzero(bits >> U64(63))
        phrase, block = np.concatenate([phrase, phrase[carry]]), np.concatenate([block, block[carry] + 1])
        bits = np.concatenate([bits << U64(1), np.ones(len(carry), np.uint64)])
        bits &= self.inside[block]
        on = np.flatnonzero(bits)
        order = on[np.argsort(phrase[on], kind="stable")]
        return phrase[order], block[order], bits[order]

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(phrase, next word, block, bits) of the bitmaps of all phrases that go on by one word, some phrases at a time."""
        phrase, block, bits = self.shifted(phrase, block, bits)
        size = self.block_at[block + 1] - self.block_at[block]
        cells = np.cumsum(size)
        at = 0
        while at < len(phrase):
            to = max(int(np.searchsorted(cells, (cells[at - 1] if at else 0) + self.cells)), at + 1)
            own = size[at:to]
            row = np.repeat(np.arange(at, to), own)
            slot = self.by_block[np.arange(own.sum()) - np.repeat(np.cumsum(own) - own - self.block_at[block[at:to]], own)]
            both = bits[row] & self.bits[slot]
            on = np.flatnonzero(both)
            yield phrase[row[on]], self.word[slot[on]], block[row[on]], both[on]
            at = to


def counted(*key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys and how many bits each has."""
    order = np.lexsort(key[::-1])
    key = tuple(k[order] for k in key)
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
    first = np.flatnonzero(new)
    n = np.add.reduceat(np.bitwise_count(bits[order]).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return *(k[first] for k in key), n


def hashes(names: np.ndarray, kind: int) -> np.ndarray:
    """63 bits of a name, and one for the kind: 0 for a word, 1 for a pair."""
    return (mix(names.copy()) & ~U64(1)) | U64(kind)


def pair_names(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return one * U64(_PAIR) + other


class Seen:
    """A bitmap of 2^bits bits: which hashes of a kind may be among those of a table."""

    def __init__(self, rows: DataFrame, kind: int, bits: int) -> None:
        """rows: (hash long)."""
        self.mask, self.kind = (1 << bits) - 1, kind
        spot = F.shiftrightunsigned("hash", 1).bitwiseAND(F.lit(self.mask)) + 1
        maps = rows.where(F.col("hash").bitwiseAND(F.lit(1)) == kind).select(spot.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
        whole = np.zeros(((self.mask >> 15) + 2, 4096), np.uint8)
        for r in maps.collect():  # 4 KB each, 2^bits bits in all
            whole[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
        self.bits = whole[1:].ravel()

    def holds(self, names: np.ndarray) -> np.ndarray:
        at = ((hashes(names, self.kind) >> U64(1)) & U64(self.mask)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def shards(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[Shard]:
    """Batches are gathered until they hold about so many words (eight bytes each)."""
    texts, langs, held = [], [], 0

    def made() -> Shard:
        whole = pa.concat_arrays([t.cast(pa.large_string()) for t in texts])
        return Shard(*buffers(whole), langs)

    for batch in batches:
        texts.append(batch.column("text"))
        langs += batch.column("lang").to_pylist()
        held += batch.column("text").nbytes
        if held >= words * 8:
            yield made()
            texts, langs, held = [], [], 0
    if texts:
        yield made()


PIECE = 1 << 18  # rows of a batch that leaves a task


def batches_of(words: int, lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(n), words, np.int32)), lang, phrase, pa.array(n.astype(np.int64))], ["words", "lang", "phrase", "n"])
    for i in range(0, whole.num_rows, PIECE):
        part = whole.slice(i, PIECE)
        yield part.set_column(2, "phrase", part.column("phrase").cast(pa.string()))


SCHEMA = "words int, lang string, phrase string, n long"


def own_texts(docs: DataFrame) -> DataFrame:
    bounded(docs.sparkSession)
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def first_words(maps: Bitmaps, rows: int) -> Iterator[slice]:
    """The bitmaps' rows in groups of about so many, each word's in one."""
    at = 0
    while at < len(maps.word):
        to = int(np.searchsorted(maps.word, maps.word[min(at + rows, len(maps.word) - 1)], side="right"))
        yield slice(at, to)
        at = to


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the counts of each."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def frequent_hashes(rows: DataFrame, least: int, size: int, cells: int) -> DataFrame:
    """(hash) of the words and pairs that occur `least` times, and of some others."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, size):
            keys, counts = [hashes(shard.names, 0)], [shard.counts.astype(np.int64)]
            maps = Bitmaps(shard, np.ones(len(shard.names), dtype=bool), cells)
            for group in first_words(maps, size // 8):
                for one, two, _, bits in maps.extended(maps.word[group], maps.block[group], maps.bits[group]):
                    a, b, n = counted(one, two, bits=bits)
                    keys.append(hashes(pair_names(shard.names[a], shard.names[b]), 1))
                    counts.append(n)
            key, n = added(np.concatenate(keys), np.concatenate(counts))
            # hashes are even, so a bucket is a range of them
            goal = (key >> U64(32)) * U64(buckets) >> U64(32)
            live, cut = np.unique(goal, return_index=True)
            cut = np.append(cut, len(key))
            own = [key[x:y].astype("<u8").tobytes() for x, y in pairwise(cut)]
            many = [n[x:y].astype("<u4").tobytes() for x, y in pairwise(cut)]
            yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int64)), pa.array(own, pa.binary()), pa.array(many, pa.binary())], ["bucket", "keys", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come one after the other; what is held of one is added up as it grows."""
        number, held, keys, counts = None, 0, [], []

        def told() -> pa.RecordBatch:
            key, n = added(np.concatenate(keys), np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array(key[n >= least].view(np.int64))], ["hash"])

        for batch in batches:
            for i in range(batch.num_rows):
                bucket, own, many = (batch.column(c)[i].as_py() for c in ("bucket", "keys", "counts"))
                if bucket != number and keys:
                    yield told()
                    held, keys, counts = 0, [], []
                number = bucket
                keys.append(np.frombuffer(own, "<u8"))
                counts.append(np.frombuffer(many, "<u4").astype(np.int64))
                held += len(keys[-1])
                if held > 4 * size and len(keys) > 1:
                    key, n = added(np.concatenate(keys), np.concatenate(counts))
                    held, keys, counts = len(key) // 2, [key], [n]
        if keys:
            yield told()

    sent = rows.mapInArrow(gather, "bucket long, keys binary, counts binary")
    return materialize(sent.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(add, "hash long"), "hashes")


def frequent_phrases(rows: DataFrame, known: DataFrame, least: int, size: int, cells: int, bits: int) -> DataFrame:
    """(words, lang, phrase, n): the phrases of one to three words with `least` occurrences; no phrase: all words of a language."""
    context = rows.sparkSession.sparkContext
    word_seen, pair_seen = (context.broadcast(Seen(known, kind, bits)) for kind in (0, 1))  # 2^bits bits each

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, size):
            live, names = word_seen.value.holds(shard.names), shard.names
            own = np.flatnonzero(live)
            yield from batches_of(1, shard.lang(own), shard.text(own), shard.counts[own])
            every = np.bincount(shard.of_lang, shard.counts, len(shard.lang_names)).astype(np.int64)
            yield from batches_of(0, pa.array(shard.lang_names, pa.string()), pa.nulls(len(every), pa.large_string()), every)
            maps = Bitmaps(shard, live, cells)
            joined = lambda *w: pc.binary_join_element_wise(*(shard.text(x) for x in w), pa.scalar(" ", pa.large_string()))  # noqa: B023, E731
            for group in first_words(maps, size // 8):
                for one, two, block, map_ in maps.extended(maps.word[group], maps.block[group], maps.bits[group]):
                    on = pair_seen.value.holds(pair_names(names[one], names[two]))
                    one, two, block, map_ = one[on], two[on], block[on], map_[on]
                    a, b, n = counted(one, two, bits=map_)
                    yield from batches_of(2, shard.lang(a), joined(a, b), n)
                    key, phrase = np.unique(one * len(names) + two, return_inverse=True)
                    for p, three, _, more in maps.extended(phrase, block, map_):
                        on = pair_seen.value.holds(pair_names(names[key[p] % len(names)], names[three]))
                        p, three, n = counted(p[on], three[on], bits=more[on])
                        a, b = key[p] // len(names), key[p] % len(names)
                        yield from batches_of(3, shard.lang(a), joined(a, b, three), n)

    total = rows.mapInArrow(work, SCHEMA).groupBy("words", "lang", "phrase").agg(F.sum("n").alias("n"))
    return materialize(total.where((F.col("n") >= least) | (F.col("words") == 0)), "phrases")


def key(phrase: Column) -> Column:
    return F.struct(F.col("lang"), phrase.alias("phrase"))


def first(words: int) -> Column:
    return F.substring_index("phrase", " ", words)


def last(words: int) -> Column:
    return F.substring_index("phrase", " ", -words)


def scored(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one stands for, by their lowest-scoring cut."""
    # a pair inside a phrase of three that has half of its occurrences goes
    longer = triples.select("lang", F.explode(F.array(first(2), last(2))).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    left = pairs.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("n") * 50))
    cut = lambda rows, k, a, b: rows.select(key(F.col("phrase")).alias("whole"), F.col("n").alias("a"), F.lit(k).alias("k"), key(a).alias("left"), key(b).alias("right"))
    cuts = materialize(cut(left, 1, first(1), last(1)).union(cut(triples, 1, first(1), last(2))).union(cut(triples, 2, first(2), last(1))), "cuts")
    counts = words.union(pairs).select(key(F.col("phrase")).alias("part"), "n")
    for side, name in (("left", "l"), ("right", "r")):
        # a common word is a part of very many phrases
        sizes = cuts.groupBy(side).agg(F.count("*").alias("n"))
        cuts = split_join(cuts, counts.select(F.col("part").alias(side), F.col("n").alias(name)), side, sizes, F.col("whole"))
    # 10^14 occurrences at most; more would be an error, not a wrong number
    whole = lambda c: F.col(c).cast("decimal(14,0)")
    exact = cuts.withColumns({"_up": F.lit(1_000_000).cast("decimal(7,0)") * whole("a") * whole("a"), "_down": whole("l") * whole("r")})
    told = exact.withColumn("score", F.expr("_up div _down"))
    best = told.groupBy("whole", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("whole.lang", "whole.phrase", "a", "b.l", "b.r", "b.score")


def top(rows: DataFrame, n: int) -> DataFrame:
    """rows with rank: each language's first n. They are ranked in SALTS parts of a language first, then the parts' first ones."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    few = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= n).drop("salt", "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def collocations(docs: DataFrame, least: int = 10, n: int = TOP, size: int = SHARD, cells: int = CELLS, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first n phrases of two or three words.

    a, l, r: occurrences of the phrase and of the two parts of its lowest-scoring cut; n: all words of the language;
    score: floor(10^6 a^2 / (l r)). A phrase has `least` occurrences, and none of two words lies in one of three with half of its.
    size (words of a shard), cells (bitmap rows met at once) and bits (of what is broadcast; BITS at most) change no result.
    """
    rows = own_texts(docs)
    found = frequent_phrases(rows, frequent_hashes(rows, least, size, cells), least, size, cells, bits)
    totals, words, pairs, triples = (found.where(F.col("words") == k).drop("words") for k in range(4))
    ranked = top(scored(words, pairs, triples), n)
    return ranked.join(totals.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
