"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is that of its 5-word shingles (64-bit names). Equal sets form a class at once, and only a class's
representative (its smallest doc_id) goes on. Each representative branches into FIRST nodes, each chosen by PATH of its
minwise tokens: two sets of similarity s meet in one with probability s**PATH. Within a node:

1. every member is compared with the node's pivot (its smallest id), which links groups of any size by few pairs;
2. after the components of these links are known, only pairs of different components are left. A node in which all but
   LEAST members belong to one component is compared exhaustively: the few against all, in tasks of BLOCK members that
   read the texts and return links alone, of each task only those that join two components;
3. a larger mixed node branches: its members go to BRANCHES child nodes, each chosen by PATH further minwise tokens that
   depend on the node. Less similar sets lose each other from level to level. Nodes that are still large at DEPTH are
   compared exhaustively as well, in chunks of LEAST, so no cap drops a pair.

With similarity 0.75 a pair meets in 13 of 32 independent first nodes on average and misses all with probability 2e-8.
Compared pairs are first estimated from SIGNS minwise tokens of 16 bits, rejecting only what lies MARGIN (over five
standard deviations) below the threshold, then confirmed on the full sets. Components come from distributed star rounds.

Keys that hold many rows (a set's copies, a pivot's pairs, a node's members) are split over tasks by common.split_join.

Null text: empty. Documents without words: empty set, linked with nothing. Null doc_id: linked with nothing, component
null, kept. Very long texts: one row's set is one task's work, at memory in proportion to it. Ties: the smallest doc_id
stands for a group. Rows that repeat a doc_id are one document: with other texts too, they are all linked, but for rows
without words. keep_one keeps one row of such a document, that of the least digest. Empty tables give no rows. Other
columns are dropped by near_duplicates() and kept by keep_one(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, discard, id_text, materialize, mix, run_names, split_join, word_names
from .components import components

WIDTH, SIGNS, FIRST, PATH, BRANCHES, LEAST, BLOCK, DEPTH, MARGIN = 5, 128, 32, 3, 4, 256, 1024, 5, 0.2
FILTER_BITS = 24  # of the bounded bitmap that thins out texts before a join
_dice = np.random.default_rng(20_240)
_MUL = _dice.integers(0, 1 << 31, SIGNS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _dice.integers(0, 1 << 32, SIGNS, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle names) of each text."""
    for row, counts, names in word_names(data, offsets, lower=True):
        runs = run_names(names, WIDTH)
        at = 0
        for k, n in enumerate(counts):
            if n >= WIDTH:
                yield row + k, np.unique(runs[at : at + n - WIDTH + 1])
            else:
                yield row + k, run_names(names[at : at + n], int(n)) if n else np.zeros(0, np.uint64)
            at += n


def minwise(names: np.ndarray) -> np.ndarray:
    """The SIGNS minwise tokens (32 bits) of a set."""
    half = (names >> np.uint64(32)).astype(np.uint32)
    best = np.full(SIGNS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(half), 128):  # blocks that stay in the cache
        block = half[i : i + 128, None] * _MUL
        block += _ADD
        np.minimum(best, block.min(axis=0), out=best)
    return best


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, print (16 bytes for the set, null if empty), signs (16-bit tokens), nodes (first nodes), digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(FIRST, dtype=np.uint64) << np.uint64(32)
        odd = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            size, prints, signs, nodes = [], [], [], []
            for _, names in shingle_sets(*buffers(batch.column("text"))):
                size.append(len(names))
                if not len(names):
                    prints.append(None)
                    signs.append(None)
                    nodes.append(None)
                    continue
                with np.errstate(over="ignore"):
                    sums = [mix(names ^ np.uint64(c)).sum(dtype=np.uint64) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                prints.append(np.array([sums[0], sums[1] + np.uint64(len(names))], np.uint64).tobytes())
                best = minwise(names)
                signs.append((best >> np.uint32(8)).astype(np.uint16).tobytes())
                node = place.copy()
                for step in best[: FIRST * PATH].reshape(PATH, FIRST).astype(np.uint64):
                    with np.errstate(over="ignore"):
                        node = mix(node * odd + step)
                nodes.append(node.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary()), pa.array(nodes, pa.list_(pa.int64())), batch.column("digest")], ["doc_id", "n_shingles", "print", "signs", "nodes", "digest"])

    return id_text(docs).withColumn("digest", digest()).mapInArrow(work, "doc_id long, n_shingles long, print binary, signs binary, nodes array<long>, digest binary")


def digest() -> Column:
    """16 bytes for a row's doc_id and text (not null)."""
    return F.unhex(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")).cast("binary")))


def thinned(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose digest may be among those wanted, by a bitmap of at most 2**FILTER_BITS bits: a bound for what is broadcast."""
    spot = F.pmod(F.xxhash64("digest"), F.lit(1 << FILTER_BITS)) + 1
    maps = wanted.select(spot.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    told = rows.withColumn("_x", spot)
    place = F.bitmap_bit_position("_x")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(_x) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = told.join(F.broadcast(maps), F.bitmap_bucket_number("_x") == F.col("bucket")).where(F.getbit(byte, (place % 8).cast("int")) == 1)
    return met.drop("_x", "bucket", "bits")


def likely(pairs: DataFrame, reps: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose sizes and minwise tokens allow the similarity."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signs").alias(f"s_{c}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (buffers(batch.column(c))[0] for c in ("s_a", "s_b"))
            # signs are 2 * SIGNS bytes in each row
            at_a, at_b = (buffers(batch.column(c))[1] for c in ("s_a", "s_b"))
            n = batch.num_rows
            if n:
                x = np.frombuffer(one[at_a[0] : at_a[-1]].tobytes(), np.uint16).reshape(n, SIGNS)
                y = np.frombuffer(other[at_b[0] : at_b[-1]].tobytes(), np.uint16).reshape(n, SIGNS)
                keep = pa.array((x == y).mean(axis=1) >= share - MARGIN)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    met = split_join(pairs.join(side("b"), "b"), side("a"), "a", pairs.groupBy("a").agg(F.count("*").alias("n")), F.col("b"))
    sized = met.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(share - 1e-9))
    return sized.select("a", "b", "s_a", "s_b").mapInArrow(work, "a long, b long")


def texts_of(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the classes ids (id): one text of each, written."""
    wanted = ids.join(classes.select("id", "digest"), "id")
    # rows that repeat a document meet before the shuffle
    one = thinned(id_text(docs).withColumn("digest", digest()), wanted).groupBy("digest").agg(F.first("text").alias("text"))
    # an inner join: a semi-join would be pushed below the bitmap and shuffle all texts
    return materialize(one.join(wanted, "digest").select("id", "text"), "texts")


def similar(one: np.ndarray, other: np.ndarray, num: int, den: int) -> bool:
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return shared > 0 and den * shared >= num * (len(one) + len(other) - shared)


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * |intersection| >= num * |union| of their full sets; pairs: a written table."""
    texts = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), classes, docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            a_ids, (data, at) = batch.column("a"), buffers(batch.column("t_a"))
            for row, mine in shingle_sets(*buffers(batch.column("t_b"))):
                key = a_ids[row].as_py()
                if key != last:
                    last, held = key, next(s for _, s in shingle_sets(data, at[row : row + 2]))
                keep.append(similar(mine, held, num, den))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t_{c}"))
    met = split_join(pairs.join(side("b"), "b"), side("a"), "a", pairs.groupBy("a").agg(F.count("*").alias("n")), F.col("b")).select("a", "b", "t_a", "t_b")
    edges = materialize(met.mapInArrow(work, "a long, b long"), "links")
    discard(texts)
    return edges


class Chunk:
    """The few of one chunk of a node, in memory, and the components that its links have joined so far.

    A row meets all of them at once by the postings of their shingles. Of the links of one task only those are told that join two
    components: fewer than it has rows, however many of its pairs are similar.
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.up, self.rows, self.names = num, den, {}, [], None

    def hold(self, own: int, root: int, sign: np.ndarray, names: np.ndarray) -> None:
        self.rows.append((own, root, sign, names))

    def close(self) -> list[tuple[int, int]]:
        """All are there: the links among them."""
        ids, roots, signs, sets = zip(*self.rows, strict=True) if self.rows else ((), (), (), ())
        self.rows, self.ids, self.tops = [], np.array(ids, np.int64), np.array(roots, np.int64)
        self.table, self.sizes = np.array(signs, np.uint16).reshape(len(ids), SIGNS), np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.names, self.owners = flat[order], np.repeat(np.arange(len(ids)), self.sizes)[order]
        return [link for row in zip(ids, roots, signs, sets, strict=True) for link in self.links(*row[:3], lambda x=row[3]: x)]

    def links(self, own: int, root: int, sign: np.ndarray, names_of: Callable[[], np.ndarray]) -> list[tuple[int, int]]:
        top = root
        while top in self.up:
            top = self.up[top]
        if top != root:
            self.up[root] = top
        # what is joined already needs no further link
        fit = (self.tops != top) & ((self.table == sign).mean(axis=1) >= self.num / self.den - MARGIN)
        if not fit.any():
            return []
        names = names_of()
        low, high = np.searchsorted(self.names, names), np.searchsorted(self.names, names, side="right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        shared = np.bincount(self.owners[at], minlength=len(self.ids))
        alike = np.flatnonzero(fit & (shared > 0) & (self.den * shared >= self.num * (self.sizes + len(names) - shared)))
        found = []
        for other, k in zip(*np.unique(self.tops[alike], return_index=True), strict=True):
            mate = int(self.ids[alike[k]])
            found.append((min(mate, own), max(mate, own)))
            self.up[int(other)] = top
            self.tops[self.tops == other] = top
        return found


def exhaustive(leaves: DataFrame, classes: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between components of leaf nodes; leaves (node, id, root, major, minor, n): a written table.

    The members outside the major component (the few) are dealt to chunks of about LEAST, all members to blocks of
    about BLOCK. A task holds one chunk of a node and streams one block past it.
    """
    texts = texts_of(leaves.select("id").distinct(), classes, docs)
    chunks, blocks = F.ceil(F.col("minor") / LEAST).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = leaves.withColumn("few", F.col("root") != F.col("major")).withColumn("_c", F.pmod(F.xxhash64("id", "node"), chunks).cast("int")).withColumn("_b", F.pmod(F.xxhash64("node", "id"), blocks).cast("int"))
    goal = lambda c, b, held: F.struct(c.cast("int").alias("c"), b.cast("int").alias("b"), F.lit(held).alias("held"))
    as_few = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: goal(F.col("_c"), b, 0))
    as_member = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: goal(c, F.col("_b"), 1))
    # within a chunk the few meet each other as soon as all are there, so they pass as members only by other chunks
    others = F.when(~F.col("few"), as_member).otherwise(F.filter(as_member, lambda g: g["c"] != F.col("_c")))
    sent = dealt.select("node", "id", "root", F.explode(F.when(F.col("few"), F.concat(as_few, others)).otherwise(others)).alias("g"))
    # one row for each id first, so the dealt rows are shuffled once
    whole = texts.join(classes.select("id", "signs"), "id")
    rows = sent.join(whole, "id").select("node", "g.c", "g.b", "g.held", "id", "root", "signs", "text")

    def told(links: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, found = None, Chunk(num, den), []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("node", "c", "b")), strict=True))
            held, own, root, sign = (batch.column(c).to_pylist() for c in ("held", "id", "root", "signs"))
            data, at = buffers(batch.column("text"))
            for i, key in enumerate(keys):
                if key != now:
                    if chunk.names is None:
                        found += chunk.close()
                    now, chunk = key, Chunk(num, den)
                mine, names_of = np.frombuffer(sign[i], np.uint16), lambda i=i: next(x for _, x in shingle_sets(data, at[i : i + 2]))  # noqa: B023
                if held[i] == 0:
                    chunk.hold(own[i], root[i], mine, names_of())
                    continue
                if chunk.names is None:
                    found += chunk.close()
                found += chunk.links(own[i], root[i], mine, names_of)
            yield told(found)
            found = []
        yield told(found if chunk.names is not None else chunk.close())

    edges = materialize(rows.repartition(F.col("node"), F.col("c"), F.col("b")).sortWithinPartitions("node", "c", "b", "held").mapInArrow(work, "a long, b long").distinct(), "links")
    discard(texts)
    return edges


def children(members: DataFrame, reps: DataFrame, level: int) -> DataFrame:
    """(node, id) of the child nodes of members (node, id)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            data, at = buffers(batch.column("signs"))
            signs = np.frombuffer(data[at[0] : at[-1]].tobytes(), np.uint16).reshape(n, SIGNS).astype(np.uint64)
            node = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            out = []
            with np.errstate(over="ignore"):
                for k in range(BRANCHES):
                    name = mix(node + np.uint64(level * 64 + k + 1))
                    for j in range(PATH):
                        # which token is looked at depends on the node alone
                        which = (mix(name + np.uint64(j)) % np.uint64(SIGNS)).astype(np.int64)
                        name = mix(name * np.uint64(31) + signs[np.arange(n), which])
                    out.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.concat_arrays([batch.column("id")] * BRANCHES)], ["node", "id"])

    return members.select("node", "id").join(reps.select("id", "signs"), "id").mapInArrow(work, "node long, id long")


def crowded(members: DataFrame) -> DataFrame:
    """Members (node, id) of nodes of two members at least, with the node's pivot; written."""
    met = materialize(members.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1"), "nodes")
    out = materialize(split_join(members, met.select("node", "pivot"), "node", met.select("node", "n"), F.col("id")), "members")
    discard(met)
    return out


def same_documents(known: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the classes of documents that have several sets; None if there is no such document."""
    sizes = known.groupBy("doc_id").agg(F.min("print").alias("p"), F.max("print").alias("q"), F.count("*").alias("n")).where("p != q").select("doc_id", "n")
    if sizes.isEmpty():
        return None
    sizes = materialize(sizes, "several")
    met = split_join(known.select("doc_id", "print").distinct(), sizes.select("doc_id"), "doc_id", sizes, F.col("print"))
    met = materialize(split_join(met, classes.select("print", "id"), "print", classes.select("print", "n"), F.col("doc_id")), "several")
    hub = met.groupBy("doc_id").agg(F.min("id").alias("a"))
    return split_join(met, hub, "doc_id", sizes, F.col("id")).where("a != id").select("a", F.col("id").alias("b"))


def grouped(docs: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, digest, print (null without words), component_id of every row."""
    share = num / den
    # a number for each row, written, by which the copies of one set are dealt
    rows = materialize(sketch(docs).withColumn("number", F.monotonically_increasing_id()), "sketches")
    known = rows.where(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    one = F.min_by(F.struct("n_shingles", "signs", "nodes", "digest"), "doc_id").alias("one")
    classes = known.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), one)
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("id"), "print", "least", "n", "one.*"), "classes")
    members = crowded(classes.select(F.explode("nodes").alias("node"), "id"))
    stars = materialize(likely(members.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), classes, share), "pairs")
    links = confirm(stars, classes, docs, num, den)
    same = same_documents(known, classes)
    found = materialize(components(links if same is None else links.union(same)), "components")
    spent = [members, stars]

    # pairs between components that the stars did not compare
    level, now, leaves = 1, members.select("node", "id"), None
    while True:
        labelled = now.join(found, "id", "left").select("node", "id", F.coalesce("root", "id").alias("root"))
        sizes = labelled.groupBy("node", "root").agg(F.count("*").alias("n"))
        nodes = sizes.groupBy("node").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
        nodes = materialize(nodes.select("node", "major", "n", (F.col("n") - F.col("most")).alias("minor")), "nodes")
        mixed = materialize(split_join(labelled, nodes, "node", nodes.select("node", "n"), F.col("id")), "mixed")
        spent += [nodes, mixed]
        leaf = mixed if level == DEPTH else mixed.where(F.col("minor") <= LEAST)
        leaves = leaf if leaves is None else leaves.union(leaf)
        deep = mixed.where(F.col("minor") > LEAST)
        if level == DEPTH or deep.isEmpty():
            break
        level += 1
        spent.append(crowded(children(deep, classes, level).distinct()))
        now = spent[-1].select("node", "id")
    if not leaves.isEmpty():
        more = exhaustive(leaves, classes, docs, num, den)
        if not more.isEmpty():
            found = materialize(components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)), "components")
    # the smallest doc_id of each component
    linked = materialize(classes.select("id", "least").join(found, "id"), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    told = split_join(linked.select("id", "root"), least.select("root", "component_id"), "root", least.select("root", "n"), F.col("id")).select("id", "component_id")
    told = materialize(classes.select("id", "print", "least", "n").join(told, "id", "left").select("print", "n", F.coalesce("component_id", "least").alias("component_id")), "groups")
    for table in [*spent, classes, linked, least]:
        discard(table)  # the result reads the sketches and the groups alone
    rows = rows.select("doc_id", "n_shingles", "digest", "print", "number")
    met = split_join(rows.where("print is not null and doc_id is not null"), told.select("print", "component_id"), "print", told.select("print", "n"), F.col("number"))
    # rows without words, as many as they may be, need no join
    alone = rows.where("print is null or doc_id is null").withColumn("component_id", F.col("doc_id"))
    return met.select(*(columns := ["doc_id", "n_shingles", "digest", "print", "component_id"])).union(alone.select(*columns))


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest linked doc_id, itself included), kept (it is that one)."""
    return grouped(docs, num, den).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """One row of docs for each group, with all its columns; rows without words or doc_id stay."""
    told = materialize(grouped(docs, num, den), "grouped")
    own = told.where("doc_id = component_id and print is not null")
    # a document with several texts, or several times with one, is one document
    one = own.groupBy("doc_id").agg(F.min("digest").alias("digest")).select("digest")
    sizes = told.groupBy("digest").agg(F.count("*").alias("n"))
    all_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    wordy = F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = all_rows.withColumn("digest", digest()).withColumn("number", F.monotonically_increasing_id()).where(wordy).select("all", "digest", "number")
    sizes = materialize(one.join(sizes, "digest"), "kept")
    met = split_join(rows, sizes, "digest", sizes, F.col("number"))
    rest = all_rows.where(~wordy).select("all.*")
    if sizes.where("n > 1").isEmpty():
        return met.select("all.*").union(rest)
    several = met.where("n > 1").select("digest", "all").dropDuplicates(["digest"])
    return met.where("n = 1").select("all.*").union(several.select("all.*")).union(rest)
