"""Toxicity by a classifier chain over hashed words and word beginnings.

Categories are predicted in order. Each has a linear (logistic) model over the presence of hashed features, with the
probabilities of the categories before it as further inputs; in training those are out-of-fold predictions, so that a
later model sees them as they are at scoring. Words are lower-cased (A-Z) runs without white space, without the ASCII
punctuation at their ends, however much there is. Each gives three features: the whole word, and its first four and first
six bytes. Words of more than LONG bytes, as in scripts without white space, also give every run of GRAM code points.

Fitting uses a bounded sample: the MAX_TRAIN labelled documents of least xxhash64(doc_id), one text of each, and of the DIMS
hashed features the PICK that tell a category apart best, the first ALWAYS in any case and more by LEAST_Z standard deviations at least (without that bound, features
of chance crowd in: 116 of 144 toxic documents are found in the English half of sf0.1 instead of 133). A model and its out-of-fold models are fitted at the same time
by as many tasks, to which the sample's features are sent. Every document is scored over its whole text.

Null text: empty (the models' intercepts alone). Null labels or doc_id: not used for fitting. Repeated labels of a
document: the largest counts. Labels of documents that aren't in the table count nowhere. Repeated rows of a labelled document:
the least text is learnt from; all rows are scored and stay. Ties between features go to the smaller number. Very long texts: one
row is one task's work. Without evidence nothing is flagged: if the last category has no labels or only one class of them, if no
feature tells anything, or if no cut of the held-out probabilities does better than flagging every document, the threshold is
infinite and the probabilities are the share of positives. Empty tables give no rows. Other columns are dropped by score() and
kept by keep_clean(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, buffers, discard, id_text, materialize, range_names, word_names

DIMS, MAX_TRAIN, PICK, FOLDS, STEPS, L2, LEAST_Z, ALWAYS = 1 << 20, 16_384, 4096, 4, 150, 2e-4, 3.5, 64
LONG, GRAM = 24, 3
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def bare(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which words are left, starts, ends) without the punctuation at their ends."""
    if not len(starts):
        return np.zeros(0, np.int64), starts, ends
    low = int(starts[0])
    inside = np.flatnonzero(~_PUNCT[data[low : int(ends[-1])]]) + low
    if not len(inside):
        return np.zeros(0, np.int64), starts[:0], ends[:0]
    after = np.searchsorted(inside, starts)
    first = inside[np.minimum(after, len(inside) - 1)]
    live = np.flatnonzero((after < len(inside)) & (first < ends))
    last = inside[np.searchsorted(inside, ends[live]) - 1] + 1
    return live, first[live], last


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, feature): distinct within a row, sorted by row and feature."""
    for row, counts, _, starts, ends in word_names(data, offsets, lower=True, places=True):
        live, starts, ends = bare(data, starts, ends)
        owner = np.repeat(np.arange(len(counts)), counts)[live]
        found = []

        def put(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, kind: int) -> None:
            names = range_names(data, starts, ends, lower=True)
            found.append((names + np.uint64(kind)) % np.uint64(DIMS) + (owner.astype(np.uint64) << np.uint64(24)))  # noqa: B023

        with np.errstate(over="ignore"):
            put(starts, ends, owner, 0)
            for size in (4, 6):
                on = np.flatnonzero(ends - starts >= size)
                put(starts[on], starts[on] + size, owner[on], size)
            for k in np.flatnonzero(ends - starts > LONG):
                # code points start where a byte is no continuation; invalid bytes can't come from a string
                at = np.flatnonzero((data[starts[k] : ends[k]] & 0xC0) != 0x80) + starts[k]
                at = np.append(at, ends[k])
                put(at[:-GRAM], at[GRAM:], np.full(len(at) - GRAM, owner[k]), 9)
        both = np.unique(np.concatenate(found))
        yield row, len(counts), (both >> np.uint64(24)).astype(np.int64), (both & np.uint64((1 << 24) - 1)).astype(np.int64)


@dataclass
class Model:
    """Chained linear models over picked features; bounded by PICK features for each category."""

    categories: list[str]
    picked: np.ndarray  # sorted feature numbers
    weights: np.ndarray  # category x picked
    chain: np.ndarray  # category x earlier category
    bias: np.ndarray
    threshold: float

    def logits(self, rows: int, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.picked, feature)
        hit = at < len(self.picked)
        hit[hit] = self.picked[at[hit]] == feature[hit]
        return self.combine(rows, owner[hit], at[hit])

    def combine(self, rows: int, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.categories), rows))
        for c in range(len(self.categories)):
            out[c] = self.bias[c] + np.bincount(owner, self.weights[c][at], rows) + self.chain[c, :c] @ squash(out[:c])
        return out


def squash(logit: np.ndarray) -> np.ndarray:
    """What a later model sees of an earlier one: its probability."""
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_linear(rows: int, owner: np.ndarray, at: np.ndarray, n: int, extra: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by full-batch Adam; extra: dense inputs (rows x k)."""
    k = extra.shape[1]
    w, first, second = np.zeros(n + k + 1), np.zeros(n + k + 1), np.zeros(n + k + 1)
    share = min(max(y.mean() if rows else 0.0, 1e-4), 1 - 1e-4)
    w[-1] = np.log(share / (1 - share))
    if not rows or y.min() == y.max():
        return w[:n], w[n : n + k], float(w[-1])
    for step in range(1, STEPS + 1):
        p = squash(np.bincount(owner, w[:n][at], rows) + extra @ w[n : n + k] + w[-1])
        g = (p - y) / rows
        grad = np.concatenate([np.bincount(at, g[owner], n), g @ extra, [g.sum()]])
        grad[:-1] += L2 * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return w[:n], w[n : n + k], float(w[-1])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of greatest F1 on out-of-fold probabilities, halfway between neighbours; infinite without evidence for one.

    A cut flags all that have its probability, so it lies where two differ; one that flags every document is no evidence.
    """
    if not len(y) or y.min() == y.max():
        return float("inf")
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order[:-1]] == p[order[1:]]] = -1
    i = int(np.argmax(f1))
    if i == len(y) - 1:
        return float("inf")
    return float(min(max((p[order[i]] + p[order[i + 1]]) / 2, 0.05), 0.9))


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_train: int = MAX_TRAIN) -> Model:
    """categories: name -> SQL expression of 0/1 over labels, in the order of the chain."""
    names = list(categories)
    sample = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), *[F.expr(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())]).dropna()
    sample = sample.groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    labelled = id_text(docs).join(F.broadcast(sample), "doc_id")  # max_train rows of a few numbers
    # one text of a document, however often it comes: written, as it is read three times
    rows = materialize(labelled.groupBy("doc_id", *[f"y{i}" for i in range(len(names))]).agg(F.min("text").alias("text")), "sample")
    k = len(names)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, DIMS), np.int32)
        for batch in batches:
            y = np.array([batch.column(f"y{i}").to_pylist() for i in range(k)], dtype=np.int32).reshape(k, -1)
            for row, _, owner, feature in features(*buffers(batch.column("text"))):
                sums[k] += np.bincount(feature, minlength=DIMS).astype(np.int32)
                for i in range(k):
                    sums[i] += np.bincount(feature[y[i][owner + row] > 0], minlength=DIMS).astype(np.int32)
        on = np.flatnonzero(sums[k])
        for i in range(0, len(on), 100_000):
            part = on[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(s[part].astype(np.int64)) for s in sums)], ["feature", *[f"y{i}" for i in range(k)], "n"])

    n_rows = rows.agg(F.count("*").alias("n"), *[F.sum(f"y{i}").alias(f"y{i}") for i in range(k)]).first()
    total = n_rows["n"]
    counts = materialize(rows.mapInArrow(tally, f"feature int, {', '.join(f'y{i} long' for i in range(k))}, n long").groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(f"y{i}").alias(f"y{i}") for i in range(k)]), "tally")  # a row for each feature, DIMS at most
    picked: set[int] = set()
    for i in range(k):
        pos = float(n_rows[f"y{i}"] or 0)
        if not pos or pos == total:
            continue
        share = (F.col(f"y{i}") + F.lit(pos / total)) / (F.col("n") + 1)
        z = F.abs(share - pos / total) * F.sqrt(F.col("n")) / float(np.sqrt(pos / total * (1 - pos / total)))
        best = counts.where(F.col("n") >= 3).select("feature", z.alias("z")).orderBy(F.desc("z"), "feature").limit(PICK).collect()
        picked |= {r["feature"] for j, r in enumerate(best) if j < ALWAYS or r["z"] >= LEAST_Z}
    discard(counts)
    chosen = np.array(sorted(picked), dtype=np.int64)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b""] * batch.num_rows
            for row, n, owner, feature in features(*buffers(batch.column("text"))):
                at = np.searchsorted(chosen, feature)
                hit = at < len(chosen)
                hit[hit] = chosen[at[hit]] == feature[hit]
                cut = np.searchsorted(owner[hit], np.arange(n + 1))
                at = at[hit].astype(np.uint16)
                for j in range(n):
                    out[row + j] = at[cut[j] : cut[j + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(f"y{i}") for i in range(k)), pa.array(out, pa.binary())], ["doc_id", *[f"y{i}" for i in range(k)], "at"])

    got = rows.mapInArrow(gather, f"doc_id long, {', '.join(f'y{i} int' for i in range(k))}, at binary").collect() if len(chosen) else []  # max_train rows
    discard(rows)
    got = sorted(got, key=lambda r: r["doc_id"])
    lists = [np.frombuffer(r["at"], np.uint16).astype(np.int64) for r in got]
    sample = Sample(np.repeat(np.arange(len(got)), [len(x) for x in lists]), np.concatenate([*lists, np.zeros(0, np.int64)]), len(chosen), np.array([r["doc_id"] % FOLDS for r in got], dtype=np.int64))
    before = np.zeros((len(got), 0))
    weights, chain, bias, threshold = np.zeros((k, len(chosen))), np.zeros((k, k)), np.zeros(k), float("inf")
    for i in range(k):
        y = np.array([r[f"y{i}"] for r in got], dtype=float)
        if got:
            (weights[i], chain[i, :i], bias[i]), held = fit_folds(docs, sample, before, y)
        else:
            share = min(max(float(n_rows[f"y{i}"] or 0) / max(total, 1), 1e-4), 1 - 1e-4)
            bias[i], held = np.log(share / (1 - share)), np.zeros(0)
        before = np.column_stack([before, squash(held)])
        if i == k - 1:
            threshold = best_threshold(squash(held), y)
    return Model(names, chosen, weights, chain, bias, threshold)


@dataclass
class Sample:
    """The learnt documents' features: owner and place (among n picked ones) of each, and every document's fold."""

    owner: np.ndarray
    at: np.ndarray
    n: int
    fold: np.ndarray

    def fitted(self, which: int, before: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        """(weights, chain, bias) learnt without fold `which` (all folds: -1), and every document's logit by them."""
        learn = self.fold != which
        place, mine = np.cumsum(learn) - 1, learn[self.owner]
        w, c, b = fit_linear(int(learn.sum()), place[self.owner[mine]], self.at[mine], self.n, before[learn], y[learn])
        return w, c, b, np.bincount(self.owner, w[self.at], len(y)) + before @ c + b


def fit_folds(docs: DataFrame, sample: Sample, before: np.ndarray, y: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, float], np.ndarray]:
    """The model over all documents, and out-of-fold logits, each model by a task of its own."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((sample, before, y))  # bounded by MAX_TRAIN documents of 2 * PICK features

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, before, y = sent.value
        for batch in batches:
            for which in batch.column("id").to_pylist():
                w, c, b, logit = sample.fitted(which, before, y)
                yield pa.RecordBatch.from_arrays([pa.array([which]), *(pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (w, c, np.array([b]), logit))], ["id", "w", "c", "b", "logit"])

    told = {r["id"]: {c: np.frombuffer(r[c], "<f8") for c in "wcb"} | {"logit": np.frombuffer(r["logit"], "<f8")} for r in spark.range(-1, FOLDS, 1, FOLDS + 1).mapInArrow(work, "id long, w binary, c binary, b binary, logit binary").collect()}
    sent.unpersist()
    held = np.zeros(len(y))
    for f in range(FOLDS):
        held[sample.fold == f] = told[f]["logit"][sample.fold == f]
    return (told[-1]["w"], told[-1]["c"], float(told[-1]["b"][0])), held


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_<category> of each category, flagged: the last category's probability reaches the threshold."""
    names = model.categories

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros((len(names), batch.num_rows))
            for row, n, owner, feature in features(*buffers(batch.column("text"))):
                p[:, row : row + n] = squash(model.logits(n, owner, feature))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in p), pa.array(p[-1] >= model.threshold)], ["doc_id", *[f"p_{n}" for n in names], "flagged"])

    return id_text(docs).mapInArrow(work, f"doc_id long, {', '.join(f'p_{n} double' for n in names)}, flagged boolean")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that the chain does not flag."""
    columns = docs.columns
    bounded(docs.sparkSession)

    @F.pandas_udf("boolean")
    def clean(text):  # noqa: ANN001, ANN202
        import pandas as pd

        data, offsets = buffers(pa.array(text.fillna(""), pa.string()))
        keep = np.ones(len(text), dtype=bool)
        for row, n, owner, feature in features(data, offsets):
            keep[row : row + n] = squash(model.logits(n, owner, feature))[-1] < model.threshold
        return pd.Series(keep)

    return docs.where(clean(F.col("text"))).select(*columns)
