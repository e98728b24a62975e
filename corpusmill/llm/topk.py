"""Exact top-k inner-product search over norm-sorted vectors with SVD-rotated partial sums.

Vectors are rotated by the singular directions of all of them (from a dim x dim matrix of products, added up on the
executors), so that their first coordinates hold most of each length. Candidates lie in blocks of falling norm. A query
starts with the block of the longest vectors, which gives it a threshold: its k-th best score so far. By
Cauchy-Schwarz a block whose longest vector times the query's length stays below the threshold is skipped; in the blocks
that remain, a partial sum over the first HEAD rotated coordinates plus the product of both residual lengths bounds each
score, and only candidates whose bound reaches the threshold get their exact integer score. Rounding of the rotation is
covered by SLACK. Scores are exact: where the product of both lengths is below 2^53 every partial sum is a whole number that a
double holds; where it may be more, products are added up as whole numbers of any size, and a score beyond a long is an error.

Components are floor(scale * x). Queries meet candidates block by block: a block pair is one row, never a vector pair.
Blocks hold BLOCK vectors at any size, each component in as few bytes as the block's greatest takes (1, 2, 4 or 8). The driver sees two numbers of each block of candidates (16 bytes for BLOCK vectors: 24 MB
for 3 * 10^9 vectors) and the dim x dim matrix.

Blocks that many groups ask for are dealt to several tasks.

Vectors that are null, or hold a null or a non-finite component, take no part, as a query or as a candidate. Vectors of another
number of components are searched among their own: each number is a search of its own, one after the other. Vectors without
components have score 0. Ties go to the smaller vec_id. Null vec_id: no part. Repeated vec_id: each row is a candidate, other
than the query's own vec_id. Fewer than k candidates: all of them. Very long vectors: the dim x dim matrix bounds them. Empty
tables give no rows. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, split_join

BLOCK, QUERIES, HEAD = 2048, 1024, 16
EXACT = float(1 << 53)  # whole numbers below it are exact as doubles
SLACK = 1e-6
KINDS = {b"b": "i1", b"h": "i2", b"i": "i4", b"d": "f8"}
BLOCK_SCHEMA = "longest double, ids binary, vectors binary"


def integral(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, dim, v: whole vectors as floor(scale * x); one without components counts as a single 0."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    scaled = F.transform("v", lambda x: _floor(x * F.lit(float(scale))))
    return whole.select("vec_id", F.size("v").alias("dim"), F.when(F.size("v") == 0, F.array(F.lit(0.0))).otherwise(scaled).alias("v"))


def _floor(x: Column) -> Column:
    """floor() as a double; from 2^53 on a double is whole, and a long would end at 2^63."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def rotation(own: DataFrame) -> np.ndarray:
    """The right singular vectors of all vectors, by falling singular value."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch.column("v"), batch.num_rows)
            if len(x):
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = own.select("v").mapInArrow(gram, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    dim = max((r["i"] for r in rows), default=0) + 1
    total = np.zeros((dim, dim))
    for r in rows:
        total[r["i"], r["j"]] = r["x"]
    values, vectors = np.linalg.eigh(total)
    return vectors[:, np.argsort(-values)]


def packed(x: np.ndarray) -> bytes:
    """Whole vectors as one byte that names the smallest kind that holds them, then their components."""
    most = np.abs(x).max(initial=0.0)
    kind = next((k for k, top in ((b"b", 1 << 7), (b"h", 1 << 15), (b"i", 1 << 31)) if most < top), b"d")
    return kind + x.astype("<" + KINDS[kind]).tobytes()


def unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<" + KINDS[data[:1]], offset=1).astype("f8").reshape(-1, dim)


def blocked(own: DataFrame, key: Column, size: int) -> DataFrame:
    """Rows of whole blocks (longest, ids, vectors): runs of size vectors of each range partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0

        def block(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            longest = float(np.sqrt((x * x).sum(1)).max())
            return pa.RecordBatch.from_arrays([pa.array([longest]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([packed(x)], pa.binary())], ["longest", "ids", "vectors"])

        for batch in batches:
            ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False))
            rows.append(matrix(batch.column("v"), batch.num_rows))
            held += batch.num_rows
            while held >= size:
                all_ids, x = np.concatenate(ids), np.concatenate([r for r in rows if len(r)])
                yield block(all_ids[:size], x[:size])
                ids, rows, held = [all_ids[size:]], [x[size:]], held - size
        if held:
            yield block(np.concatenate(ids), np.concatenate([r for r in rows if len(r)]))

    return own.sortWithinPartitions(key).mapInArrow(work, BLOCK_SCHEMA)


def merge_best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query, by falling score, then id."""
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def scores(c: np.ndarray, q: np.ndarray, reach: float) -> np.ndarray:
    """Inner products of the rows of c with q as longs; reach: a bound of their sizes by both lengths."""
    if reach < EXACT:
        return (c @ q).astype(np.int64)
    whole = [int(x) for x in q]
    exact = [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in c]
    if any(abs(x) >= 1 << 63 for x in exact):
        raise OverflowError("an inner product is beyond a long; a smaller scale would hold it")
    return np.array(exact, dtype=np.int64)


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, turn: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each query's k best of the block at least, leaving out scores below its floor."""
    head = min(HEAD, c.shape[1])
    # rotated heads and what is left of each length
    qh, ch = q @ turn[:, :head], c @ turn[:, :head]
    q_rest = np.sqrt(np.maximum((q * q).sum(1) - (qh * qh).sum(1), 0))
    c_rest = np.sqrt(np.maximum((c * c).sum(1) - (ch * ch).sum(1), 0))
    q_all, c_all = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    bound = qh @ ch.T + np.outer(q_rest, c_rest) + SLACK * (1 + np.outer(q_all, c_all))
    out = []
    for i in range(len(q)):
        live = np.flatnonzero(bound[i] >= floor[i])
        if len(live) > 8 * k:
            # the best bounds first: their exact scores raise the threshold for the others
            first = live[np.argpartition(-bound[i][live], 4 * k)[: 4 * k]]
            exact = scores(c[first], q[i], q_all[i] * c_all[first].max())
            exact = exact[c_ids[first] != q_ids[i]]
            if len(exact) >= k:
                live = live[bound[i][live] >= np.partition(exact, len(exact) - k)[len(exact) - k]]
        live = live[c_ids[live] != q_ids[i]]
        out.append(merge_best(scores(c[live], q[i], q_all[i] * c_all[live].max(initial=0.0)), c_ids[live], k))
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each row for which queries holds, against all other rows."""
    spark = vectors.sparkSession
    bounded(spark)
    own = materialize(integral(vectors, scale), "vectors")
    dims = [(r["dim"], r["count"]) for r in own.groupBy("dim").count().orderBy("dim").collect()]  # numbers of components
    found = [top_k_of(own.where(F.col("dim") == dim).select("vec_id", "v"), n, queries, k) for dim, n in dims]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def top_k_of(own: DataFrame, n: int, queries: Column, k: int) -> DataFrame:
    """top_k() of n vectors with the same number of components."""
    spark, size = own.sparkSession, BLOCK
    parts = max(1, n // (size * 4))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    turn = rotation(own)
    by_norm = own.withColumn("norm", length).repartitionByRange(parts, F.desc("norm"), F.col("vec_id"))
    blocks = materialize(blocked(by_norm, F.desc("norm"), size).withColumn("block", F.monotonically_increasing_id()), "blocks")
    norms = blocks.select("block", "longest").orderBy(F.desc("longest"), "block").toArrow()
    asked = blocked(own.where(queries).withColumn("norm", length).repartition(max(1, parts), "vec_id"), F.desc("norm"), QUERIES)
    asked = asked.select(F.monotonically_increasing_id().alias("group"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    asked = materialize(asked, "queries")
    dim = turn.shape[0]
    sent = spark.sparkContext.broadcast((norms["block"].to_numpy(), norms["longest"].to_numpy()))
    first = int(sent.value[0][0])

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The threshold of each query from the block of the longest vectors, and the blocks that may still reach it."""
        names, longest = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q = np.frombuffer(r["q_ids"], "<i8"), unpacked(r["q_vectors"], dim)
                c_ids, c = np.frombuffer(r["ids"], "<i8"), unpacked(r["vectors"], dim)
                best = search_block(q_ids, q, c_ids, c, turn, k, np.full(len(q), -np.inf))
                floor = np.array([s[k - 1] if len(s) == k else -np.inf for s, _ in best])
                reach = np.sqrt((q * q).sum(1))
                need = np.where(floor > 0, floor / np.maximum(reach, 1e-9), -np.inf).min()
                more = names[longest * (1 + SLACK) >= need]
                yield pa.RecordBatch.from_arrays([pa.array([r["group"]], pa.int64()), pa.array([r["q_ids"]], pa.binary()), pa.array([r["q_vectors"]], pa.binary()), pa.array([floor.astype("<f8").tobytes()], pa.binary()), pa.array([more], pa.list_(pa.int64()))], ["group", "q_ids", "q_vectors", "floor", "more"])

    head = blocks.where(F.col("block") == first).select("ids", "vectors", F.lit(1).alias("one"))  # one row
    opened = materialize(asked.withColumn("one", F.lit(1)).join(F.broadcast(head), "one").drop("one").mapInArrow(opening, "group long, q_ids binary, q_vectors binary, floor binary, more array<long>"), "opened")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                q_ids, q = np.frombuffer(r["q_ids"], "<i8"), unpacked(r["q_vectors"], dim)
                c_ids, c = np.frombuffer(r["ids"], "<i8"), unpacked(r["vectors"], dim)
                best = search_block(q_ids, q, c_ids, c, turn, k, np.frombuffer(r["floor"], "<f8"))
                counts = np.array([len(s) for s, _ in best], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([r["group"]], pa.int64()), pa.array([r["q_ids"]], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([np.concatenate([i for _, i in best]).astype("<i8").tobytes()], pa.binary()), pa.array([np.concatenate([s for s, _ in best]).astype("<i8").tobytes()], pa.binary())], ["group", "q_ids", "counts", "ids", "scores"])

    asked = opened.select("group", "q_ids", "q_vectors", "floor", F.explode("more").alias("block"))
    # every group asks for the blocks of the longest vectors
    sizes = opened.select(F.explode("more").alias("block")).groupBy("block").agg(F.count("*").alias("n"))
    pairs = split_join(asked, blocks.select("block", "ids", "vectors"), "block", sizes, F.col("group"))
    partial = pairs.mapInArrow(search, "group long, q_ids binary, counts binary, ids binary, scores binary")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Partitions hold whole query groups, sorted: one group's best are folded as its parts come by."""
        group, q_ids, best = None, None, []
        for frame in batches:
            for r in frame.itertuples():
                if r.group != group:
                    if group is not None:
                        yield ranked(q_ids, best)
                    group, q_ids = r.group, np.frombuffer(r.q_ids, "<i8")
                    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)
                cut = np.concatenate([[0], np.cumsum(np.frombuffer(r.counts, np.int32))])
                ids, scores = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.scores, "<i8")
                best = [merge_best(np.concatenate([s, scores[a:b]]), np.concatenate([i, ids[a:b]]), k) for (s, i), a, b in zip(best, cut[:-1], cut[1:], strict=True)]
        if group is not None:
            yield ranked(q_ids, best)

    def ranked(q_ids: np.ndarray, best: list) -> pd.DataFrame:
        sizes = [len(s) for s, _ in best]
        return pd.DataFrame({"query_id": np.repeat(q_ids, sizes), "rank": np.concatenate([np.arange(1, n + 1) for n in sizes]).astype(np.int32), "vec_id": np.concatenate([i for _, i in best]), "score": np.concatenate([s for s, _ in best])})

    return partial.repartition(F.col("group")).sortWithinPartitions("group").mapInPandas(merge, "query_id long, rank int, vec_id long, score long")
