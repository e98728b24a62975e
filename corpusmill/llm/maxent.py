"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens are lower-cased (A-Z) words and one end per document. The CLASSES * SLOTS most frequent training tokens form CLASSES
classes by rank, and each class a tree of nodes with 2**FAN branches; all others share one more class, a tree whose depth
follows the number of these tokens, where the first bits of a token's name are its way down. There is a softmax given the
context over the classes and at every node, so each counted token has a class and a slot. Tokens that meet in a leaf (there
are 2**MOST_BITS at most) have their add-one shares of it. So a token's probability is that of its class given the context
times those on its way, and sums to one with one place, in a leaf of its own name, for all unknown tokens.

Features of a context are the previous token, the previous two, and the one before the previous (a skip), hashed into rows
of class weights and with the node into rows of branch weights. The tables of 2**16 and 2**18 rows grow with the fourth root
of the training tokens up to four times as many (table_rows), which bounds what is broadcast: 77 MB. Biases start at the logarithms of the training shares. Training passes over all training tokens once, in ROUNDS disjoint parts: each task makes gradient steps on its share (of
about SHARE bytes, more for larger tables) from the common weights and sends what has changed, in half precision with the
number of its steps on each row; rows are averaged by these numbers, block by block, and make the next weights.

Counts cover every training token. The most frequent ones, at most HEAD of them by a cut on the count, go to every task;
all others are joined by their names (64 bits). Null text: empty (one end token). Null doc_id: in training.
Repeated rows count and are scored each. No training rows: every probability is that of an unknown token, 1. Empty tables
give no rows. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, id_text, materialize, mix, split_join, word_names

CLASSES, FAN, MOST_BITS, MOST_MORE, ROUNDS, RATE = 8, 4, 12, 2, 2, 0.1
SLOTS = 1 << 2 * FAN  # of a class: two levels of nodes
NODES = CLASSES + (CLASSES << FAN)  # of all classes' trees; those of the tree of all others come after them
SHARE, MOST = 32 << 20, np.float32(80)
HEAD, FLUSH, STEP, ROWS_SENT = 1 << 20, 1_000_000, 16_384, 1024
END, START, UNKNOWN = np.uint64(0x1234567887654321), np.uint64(0x0FEDCBA9ABCDEF01), np.uint64(0x7A3C59E1D2B48F60)


def stream(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens with ends, document of each, previous, the one before that)."""
    stop = np.cumsum(counts + 1) - 1
    owner = np.repeat(np.arange(len(counts)), counts + 1)
    tokens = np.full(len(names) + len(counts), END, np.uint64)
    inner = np.ones(len(tokens), dtype=bool)
    inner[stop] = False
    tokens[inner] = names
    first = stop - counts
    one, two = np.empty_like(tokens), np.empty_like(tokens)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    one[first] = START
    two[first] = START
    second = first[counts > 0] + 1
    two[second] = START
    return tokens, owner, one, two


def token_counts(docs: DataFrame) -> DataFrame:
    """(name, n) over all rows of (doc_id, text), written; names as signed longs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, ends = [], 0, 0

        def told(parts: list[np.ndarray], ends: int) -> pa.RecordBatch:
            names, n = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.append(names, END).view(np.int64)), pa.array(np.append(n, ends).astype(np.int64))], ["name", "n"])

        for batch in batches:
            for _, counts, names in word_names(*buffers(batch.column("text")), lower=True):
                parts.append(names)
                held, ends = held + len(names), ends + len(counts)
                if held >= FLUSH:
                    yield told(parts, ends)
                    parts, held, ends = [], 0, 0
        if ends:
            yield told(parts, ends)

    return materialize(docs.mapInArrow(work, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")), "counts")


@dataclass
class Tree:
    """The leaves of all tokens outside the classes: 2**bits of them, by the first bits of a token's name."""

    bits: int
    size: np.ndarray  # add-one counts of each leaf
    bias: np.ndarray  # node x 2**FAN

    @classmethod
    def of(cls, size: np.ndarray) -> Tree:
        bits, used, parts = len(size).bit_length() - 1, 0, []
        while used < bits:
            width = min(FAN, bits - used)
            sums = size.reshape(1 << (used + width), -1).sum(1).reshape(-1, 1 << width)
            with np.errstate(divide="ignore"):
                share = np.maximum(np.log(sums / np.maximum(sums.sum(1, keepdims=True), 1)), -1e4)
            parts.append(np.pad(share, ((0, 0), (0, (1 << FAN) - (1 << width))), constant_values=-1e4))
            used += width
        return cls(bits, size, np.concatenate(parts or [np.zeros((0, 1 << FAN))]).astype(np.float32))

    def leaf_of(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(tokens), np.int64)

    def way(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, branch) on the way to each leaf: level x leaf."""
        used, first, nodes, branches = 0, 0, [], []
        while used < self.bits:
            width = min(FAN, self.bits - used)
            nodes.append(first + (leaf >> (self.bits - used)))
            branches.append((leaf >> (self.bits - used - width)) & ((1 << width) - 1))
            first, used = first + (1 << used), used + width
        return (np.stack(nodes), np.stack(branches)) if nodes else (np.zeros((0, len(leaf)), np.int64),) * 2


@dataclass
class Vocabulary:
    """Training totals, the head's counts (sorted by name) and the modelled tokens with their places (class and slot)."""

    total: int
    distinct: int
    names: np.ndarray
    counts: np.ndarray
    modelled: np.ndarray
    place: np.ndarray
    class_bias: np.ndarray
    node_bias: np.ndarray
    tree: Tree | None = None
    _table: np.ndarray | None = None
    _factor: np.uint64 = np.uint64(1)

    def count_of(self, tokens: np.ndarray) -> np.ndarray:
        """Training counts, -1 for tokens outside the head."""
        if not len(self.names):
            return np.full(len(tokens), -1, np.int64)
        at = np.minimum(np.searchsorted(self.names, tokens), len(self.names) - 1)
        return np.where(self.names[at] == tokens, self.counts[at], -1)

    def place_of(self, tokens: np.ndarray) -> np.ndarray:
        """class * SLOTS + slot; CLASSES * SLOTS for the class of all others."""
        if not len(self.modelled):
            return np.full(len(tokens), CLASSES * SLOTS, np.int64)
        if self._table is None:
            self._spread()
        at = self._table[(tokens * self._factor) >> np.uint64(44)]
        return np.where(self.modelled[at] == tokens, self.place[at], CLASSES * SLOTS)

    def _spread(self) -> None:
        """A table of 2**20 places without collisions, by trying odd factors in turn."""
        factor = 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            while True:
                spot = (self.modelled * np.uint64(factor)) >> np.uint64(44)
                if len(np.unique(spot)) == len(spot):
                    break
                factor = (factor * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1
        self._table, self._factor = np.zeros(1 << 20, np.int16), np.uint64(factor)
        self._table[spot] = np.arange(len(spot))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    both = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = both["n"] or 0, both["v"]
    # counts on a logarithmic scale: the lowest step from which on at most head tokens are left
    step = F.floor(F.log2("n") * 16)
    left, least = 0, 1 << 62
    for r in sorted(counts.groupBy(step.alias("k")).agg(F.count("*").alias("c"), F.min("n").alias("least")).collect(), key=lambda r: -r["k"]):
        left += r["c"]
        if left > head:
            break
        least = r["least"]
    rows = counts.where((F.col("n") >= least) | (F.col("name") == int(END.view(np.int64)))).toArrow()
    names, n = rows["name"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(names)
    names, n = names[order], n[order]
    rank = np.lexsort((names, -n, names != END))[: CLASSES * SLOTS]  # the end first: it is always modelled
    rank = rank[np.lexsort((names[rank], -n[rank]))]
    sums = np.zeros(CLASSES * SLOTS)
    sums[: len(rank)] = n[rank]
    rare = total - int(sums.sum())
    class_bias, node_bias = biases(sums, rare + distinct - len(rank) + 1)
    by_name = np.argsort(names[rank])
    bits = min((distinct - len(rank)).bit_length(), MOST_BITS)
    tree = Tree(bits, np.zeros(1 << bits), np.zeros(0))
    leaf = F.shiftrightunsigned("name", 64 - bits) if bits else F.lit(0).cast("long")
    told = counts.groupBy(leaf.alias("leaf")).agg(F.sum(F.col("n") + 1).alias("n")).toArrow()
    tree.size[told["leaf"].to_numpy()] = told["n"].to_numpy()
    np.subtract.at(tree.size, tree.leaf_of(names[rank]), n[rank] + 1)
    tree.size[tree.leaf_of(np.array([UNKNOWN]))] += 1
    return Vocabulary(total, distinct, names, n, names[rank][by_name], by_name.astype(np.int64), class_bias, node_bias, Tree.of(tree.size))


def biases(sums: np.ndarray, others: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the classes' shares, and of those of each node's branches, by the counts of all places."""
    by_class = np.append(sums.reshape(CLASSES, -1).sum(1), others)
    wide = sums.reshape(-1, 1 << FAN)
    nodes = np.concatenate([wide.sum(1).reshape(CLASSES, -1), wide])
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(by_class / by_class.sum()), -1e4).astype(np.float32), np.maximum(np.log(nodes / np.maximum(nodes.sum(1, keepdims=True), 1)), -1e4).astype(np.float32)


def class_way(place: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """(node, branch) on the way from its class to each modelled place."""
    low = (1 << FAN) - 1
    return (place >> 2 * FAN, place >> FAN & low), (CLASSES + (place >> FAN), place & low)


def context_rows(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hashes of the three features of each context."""
    with np.errstate(over="ignore"):
        return np.stack([mix(one + np.uint64(1)), mix(one * np.uint64(31) + mix(two + np.uint64(2))), mix(two + np.uint64(3))])


def exponentials(z: np.ndarray) -> np.ndarray:
    """z becomes its exponentials; their sums by row come back. Logits are far from MOST, and one in a row is near its bias."""
    np.minimum(z, MOST, out=z)
    np.exp(z, out=z)
    return np.maximum(z @ np.ones(z.shape[1], z.dtype), np.finfo(z.dtype).tiny)


def softmax(z: np.ndarray) -> np.ndarray:
    z /= exponentials(z)[:, None]
    return z


def log_of(z: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The logarithm of each row's softmax at one column."""
    picked = np.minimum(z[np.arange(len(z)), column], MOST).astype(np.float64)
    return picked - np.log(exponentials(z).astype(np.float64))


def added(table: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = table.take(rows[0], axis=0)
    for more in rows[1:]:
        out += table.take(more, axis=0)
    out += bias
    return out


def table_rows(total: int) -> tuple[int, int]:
    """Rows of the class and branch weights for so many training tokens: the fourth root's growth, within bounds."""
    more = min(max((max(total, 1).bit_length() - 23) // 4, 0), MOST_MORE)
    return 1 << 16 + more, 1 << 18 + more


class Weights:
    """outer: rows x (CLASSES + 1), deep: rows x 2**FAN."""

    def __init__(self, outer: np.ndarray, deep: np.ndarray) -> None:
        self.outer, self.deep = outer, deep

    @classmethod
    def zero(cls, total: int) -> Weights:
        return cls(*(np.zeros(shape, np.float32) for shape in zip(table_rows(total), (CLASSES + 1, 1 << FAN), strict=True)))

    def copy(self) -> Weights:
        return Weights(self.outer.copy(), self.deep.copy())

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.outer, self.deep

    def rows(self, context: np.ndarray) -> np.ndarray:
        return (context & np.uint64(len(self.outer) - 1)).astype(np.int64)

    def node_rows(self, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(context ^ (node + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(len(self.deep) - 1)).astype(np.int64)

    def log_place(self, vocab: Vocabulary, context: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Natural log-probability of each place (of the class alone for all others)."""
        out = np.empty(len(place))
        for i in range(0, len(place), STEP):
            c, p = context[:, i : i + STEP], place[i : i + STEP]
            found = log_of(added(self.outer, self.rows(c), vocab.class_bias), p // SLOTS)
            on = np.flatnonzero(p < CLASSES * SLOTS)
            for node, branch in class_way(p[on]):
                found[on] += log_of(added(self.deep, self.node_rows(c[:, on], node), vocab.node_bias[node]), branch)
            out[i : i + STEP] = found
        return out

    def log_leaf(self, tree: Tree, context: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural log-probability of each leaf within the class of all others."""
        out = np.zeros(len(leaf))
        for i in range(0, len(leaf), STEP):
            c = context[:, i : i + STEP]
            for node, branch in zip(*tree.way(leaf[i : i + STEP]), strict=True):
                out[i : i + STEP] += log_of(added(self.deep, self.node_rows(c, NODES + node), tree.bias[node]), branch)
        return out


class Learner:
    """Gradient steps from given weights, with one adaptive rate for each row."""

    def __init__(self, start: Weights) -> None:
        self.weights = start.copy()
        self.squares = [np.full(len(t), 0.1, np.float32) for t in start.tables()]
        self.steps = [np.zeros(len(t), np.int64) for t in start.tables()]
        self._spot = np.zeros(max(map(len, start.tables())), np.int64)

    def _apply(self, k: int, table: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        met = np.zeros(len(table), dtype=bool)
        met[rows.ravel()] = True
        hit = np.flatnonzero(met)
        self._spot[hit] = np.arange(len(hit))
        spots = self._spot[rows]
        # column by column: numpy has no faster sum of rows by key
        sums = np.empty((gradient.shape[1], len(hit)))
        for j, column in enumerate(np.ascontiguousarray(gradient.T, dtype=np.float64)):
            sums[j] = sum(np.bincount(one, column, len(hit)) for one in spots)
        self.squares[k][hit] += np.einsum("ij,ij->j", sums, sums) / len(sums)
        sums *= RATE / np.sqrt(self.squares[k][hit])
        fresh = table.take(hit, axis=0)
        fresh -= np.ascontiguousarray(sums.T, dtype=np.float32)
        whole = np.dtype((np.void, table.itemsize * table.shape[1]))  # rows are put back as single items
        table.view(whole).ravel()[hit] = fresh.view(whole).ravel()
        self.steps[k][hit] += np.bincount(spots.ravel(), minlength=len(hit))

    def _node(self, context: np.ndarray, node: np.ndarray, bias: np.ndarray, branch: np.ndarray) -> None:
        rows = self.weights.node_rows(context, node)
        g = softmax(added(self.weights.deep, rows, bias))
        g[np.arange(len(branch)), branch] -= 1
        self._apply(1, self.weights.deep, rows, g)

    def learn(self, vocab: Vocabulary, context: np.ndarray, place: np.ndarray, tokens: np.ndarray | None = None) -> None:
        """tokens: the names, by which tokens outside the classes find their leaves."""
        for i in range(0, len(place), STEP):
            c, p = context[:, i : i + STEP], place[i : i + STEP]
            rows = self.weights.rows(c)
            g = softmax(added(self.weights.outer, rows, vocab.class_bias))
            g[np.arange(len(p)), p // SLOTS] -= 1
            self._apply(0, self.weights.outer, rows, g)
            on, off = np.flatnonzero(p < CLASSES * SLOTS), np.flatnonzero(p == CLASSES * SLOTS)
            if len(on):
                for node, branch in class_way(p[on]):
                    self._node(c[:, on], node, vocab.node_bias[node], branch)
            if tokens is not None and len(off):
                for node, branch in zip(*vocab.tree.way(vocab.tree.leaf_of(tokens[i + off])), strict=True):
                    self._node(c[:, off], NODES + node, vocab.tree.bias[node], branch)


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Weights:
    spark = docs.sparkSession
    weights = Weights.zero(vocab.total)
    if not len(vocab.modelled):
        return weights
    # as many tasks as the text asks for, however many partitions it comes in: each sends all it has changed
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, -(-size // (SHARE * len(weights.deep) >> 18)))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((*weights.tables(), vocab.modelled, vocab.place, vocab.class_bias, vocab.node_bias, vocab.tree))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            outer, deep, modelled, place, class_bias, node_bias, tree = sent.value  # noqa: B023
            none = np.zeros(0, np.uint64)
            known = Vocabulary(0, 0, none, none, modelled, place, class_bias, node_bias, tree)
            start = Weights(outer, deep)
            learner = Learner(start)
            for batch in batches:
                for _, counts, names in word_names(*buffers(batch.column("text")), lower=True):
                    tokens, _, one, two = stream(names, counts)
                    learner.learn(known, context_rows(one, two), known.place_of(tokens), tokens)
            for k, (new, old) in enumerate(zip(learner.weights.tables(), (outer, deep), strict=True)):
                for b in range(0, len(new), ROWS_SENT):
                    n = learner.steps[k][b : b + ROWS_SENT]
                    if n.any():
                        change = (new[b : b + ROWS_SENT] - old[b : b + ROWS_SENT]).astype("<f2")
                        yield pa.RecordBatch.from_arrays([pa.array([(k << 20) + b]), pa.array([n.astype("<i8").tobytes()], pa.binary()), pa.array([change.tobytes()], pa.binary())], ["block", "n", "change"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks come sorted; one block's sums are held at a time."""
            block, n, total = None, None, None

            def told() -> pa.RecordBatch:
                mean = (total / np.maximum(n, 1)[:, None]).astype("<f4")
                return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([mean.tobytes()], pa.binary())], ["block", "change"])

            for batch in batches:
                for r in batch.to_pylist():
                    steps = np.frombuffer(r["n"], "<i8")
                    change = np.frombuffer(r["change"], "<f2").reshape(len(steps), -1).astype(np.float64)
                    if r["block"] != block:
                        if block is not None:
                            yield told()
                        block, n, total = r["block"], np.zeros(len(steps), np.int64), np.zeros(change.shape)
                    n = n + steps
                    total += change * steps[:, None]
            if block is not None:
                yield told()

        part = docs.where(F.pmod(F.shiftright(F.xxhash64("doc_id", "text"), 8), F.lit(rounds)) == turn)
        changes = part.coalesce(tasks).mapInArrow(work, "block long, n binary, change binary").repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(average, "block long, change binary")
        weights = weights.copy()
        told = changes.toArrow()  # the tables once, whatever the data
        for block, packed in zip(told["block"].to_pylist(), told["change"], strict=True):
            table, b = weights.tables()[block >> 20], block & 0xFFFFF
            change = np.frombuffer(packed.as_buffer(), "<f4").reshape(-1, table.shape[1])
            table[b : b + len(change)] += change
        sent.unpersist()
    return weights


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; rows for which held_out holds don't train."""
    spark = docs.sparkSession
    own = id_text(docs).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    training = own.where(~F.col("held_out")).select("doc_id", "text")
    counts = token_counts(training)
    vocab = vocabulary(counts)
    weights = train(training, vocab)
    sent = spark.sparkContext.broadcast((vocab, *weights.tables()))
    base_size = vocab.total + vocab.distinct + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *tables = sent.value
        model = Weights(*tables)
        unknown = known.tree.leaf_of(np.array([UNKNOWN]))
        for batch in batches:
            for row, counts, names in word_names(*buffers(batch.column("text")), lower=True):
                tokens, owner, one, two = stream(names, counts)
                n = len(counts)
                distinct, inverse = np.unique(tokens, return_inverse=True)
                count, place = known.count_of(distinct), known.place_of(distinct)
                share = np.log10(np.maximum(count, 0) + 1)  # a token outside the head adds the rest by the join
                leaf = known.tree.leaf_of(distinct)
                within = share - np.log10(np.maximum(known.tree.size[leaf], 1))
                context = context_rows(one, two)
                logs = model.log_place(known, context, place[inverse]) / np.log(10)
                rare = np.flatnonzero((place == CLASSES * SLOTS)[inverse])
                own = model.log_leaf(known.tree, context[:, rare], leaf[inverse[rare]]) / np.log(10) + within[inverse[rare]]
                # a token outside the head counts as unknown; lead is what it gains if the join finds it
                out = count[inverse[rare]] < 0
                none = model.log_leaf(known.tree, context[:, rare[out]], np.repeat(unknown, out.sum())) / np.log(10) - np.log10(known.tree.size[unknown])
                lead = own[out] - none
                own[out] = none
                logs[rare] += own
                base = (share - np.log10(base_size))[inverse]
                tail = np.flatnonzero(count[inverse] < 0)
                pair, which, again = np.unique(owner[tail] * len(distinct) + inverse[tail], return_inverse=True, return_counts=True)
                lead = np.bincount(which, lead, len(again)).astype(np.float64)  # without any token, numpy counts in integers
                cut = np.searchsorted(pair, np.arange(n + 1) * len(distinct)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), x) for x in (pa.array(distinct[pair % max(len(distinct), 1)].view(np.int64)), pa.array(again.astype(np.int32)), pa.array(lead))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n), batch.column("held_out").slice(row, n), pa.array(np.bincount(owner, minlength=n)), pa.array(np.bincount(owner, count[inverse] > 0, n).astype(np.int64)), pa.array(np.bincount(owner, base, n)), pa.array(np.bincount(owner, logs, n)), *lists],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "names", "again", "lead"],
                )

    told = own.mapInArrow(work, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, names array<long>, again array<int>, lead array<double>")
    told = materialize(told.withColumn("row", F.monotonically_increasing_id()), "scores")  # written, so that row numbers stay
    tail = told.select("row", F.explode(F.arrays_zip("names", "again", "lead")).alias("t")).select("row", F.col("t.names").alias("name"), F.col("t.again").alias("again"), F.col("t.lead").alias("lead"))
    # a token that is frequent in held-out texts alone would be one task's work
    found = split_join(tail, counts, "name", tail.groupBy("name").agg(F.count("*").alias("n")), F.col("row")).groupBy("row").agg(F.sum("again").alias("more"), F.sum(F.col("again") * F.log10(F.col("n") + 1)).alias("add"), F.sum("lead").alias("gain"))
    add = F.coalesce("add", F.lit(0.0))
    return told.join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + add).alias("base_score"),
        (F.col("score") + add + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
