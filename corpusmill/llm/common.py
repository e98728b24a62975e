"""What the operators of this subpackage share: shared-folder tables, Arrow buffers and vectorised word hashing.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's 64-bit name is a polynomial over its
bytes modulo 2**64, mixed; the name of a run of words is a polynomial over the words' names, mixed again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

CHUNK = 1 << 20  # bytes of text handled at once by the vectorised code
BATCH = 2 << 20  # bytes of a batch of rows
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SEQ = 0xD6E8FEB86659FD93 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only in local mode without that setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = local_folder()
    return found.rstrip("/")


@lru_cache(maxsize=1)
def local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="corpusmill-")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that no pending result reads."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._corpusmill_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


HEAVY, LEAST_HEAVY = 10_000, 100


def split_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, salt: Column, how: str = "inner", total: int | None = None) -> DataFrame:
    """left joined with right (one row for each key) so that no key's rows of left meet in one task.

    sizes: (key, n), how many rows of left each key has at most; total: their sum, if it is known. Keys with more than a HEAVY-th of all rows, so HEAVY at most by
    counting, are sent to every task; their rows are dealt by salt (a number that a row keeps when a task runs again) to as
    many copies of the right row as it takes. Both sides are shuffled: Spark's estimate of exploded rows is that of the rows before, by
    which it would take a side of any size for one that fits the driver.
    """
    total = (sizes.agg(F.sum("n")).first()[0] or 0) if total is None else total
    bar = max(LEAST_HEAVY, total // HEAVY)
    heavy = F.broadcast(sizes.where(F.col("n") > bar).select(F.col(key).alias("_key"), F.ceil(F.col("n") / bar).cast("int").alias("_copies")))  # HEAVY rows at most
    dealt = left.join(heavy, F.col(key) == F.col("_key"), "left").withColumn("_part", F.when(F.col("_copies").isNotNull(), F.pmod(F.xxhash64(salt), F.col("_copies"))).otherwise(F.lit(0)).cast("int")).drop("_key", "_copies")
    copies = right.join(heavy, F.col(key) == F.col("_key"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_key", "_copies")
    return dealt.join(copies.hint("merge"), [key, "_part"], how).drop("_part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id (long) and text (null: empty); extra or clashing columns go no further."""
    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def bounded(spark: SparkSession) -> None:
    """Rows reach Python in batches of about BATCH bytes, which bounds a worker's memory; no result depends on it.

    Executors get the package as well, however the operator was called.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH:
        spark.conf.set(name, str(BATCH))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; nulls count as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class _Powers:
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, CHUNK + 4096)
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)
                cls.down = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, inverse, np.uint64)]), dtype=np.uint64)
        return cls.up, cls.down


def _hash_piece(data: np.ndarray, breaks: np.ndarray, lower: bool, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, starts, ends) of the words of data; breaks: positions at which a document starts."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _Powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + U64(1)) * up[: len(data)], out=sums[1:])
        names = mix((sums[ends] - sums[starts]) * down[starts])
    return names, starts, ends


def range_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """Names of the byte ranges [starts, ends) of data, as words have them; starts must not fall."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(int(np.searchsorted(starts, starts[at] + CHUNK)), at + 1)
        low, high = int(starts[at]), int(ends[at:to].max())
        piece = data[low:high]
        up, down = _Powers.to(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(((_LOWER[piece] if lower else piece).astype(np.uint64) + U64(1)) * up[: len(piece)], out=sums[1:])
            out[at:to] = mix((sums[ends[at:to] - low] - sums[starts[at:to] - low]) * down[starts[at:to] - low])
        at = to
    return out


def word_names(data: np.ndarray, offsets: np.ndarray, lower: bool, places: bool = False, space: np.ndarray = _SPACE) -> Iterator[tuple]:
    """For runs of rows of about CHUNK bytes: (first row, counts of words, names[, starts, ends as bytes of data]).

    space: which bytes separate words. A row longer than CHUNK is handled alone, in pieces cut at such bytes.
    """
    n, row = len(offsets) - 1, 0
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1
        to = min(max(to, row + 1), n)
        low, high = int(offsets[row]), int(offsets[to])
        if to == row + 1 and high - low > CHUNK:
            parts, at = [], low
            while at < high:
                cut = min(at + CHUNK, high)
                if cut < high:
                    back = np.flatnonzero(space[data[at:cut]])
                    if len(back):
                        cut = at + int(back[-1]) + 1
                    else:
                        while cut < high and not space[data[cut]]:
                            cut += 1
                names, starts, ends = _hash_piece(data[at:cut], np.zeros(0, np.int64), lower, space)
                parts.append((names, starts + at, ends + at))
                at = cut
            names, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
            counts = np.array([len(names)])
        else:
            names, starts, ends = _hash_piece(data[low:high], offsets[row:to] - low, lower, space)
            starts, ends = starts + low, ends + low
            counts = np.diff(np.searchsorted(starts, offsets[row : to + 1]))
        yield (row, counts, names, starts, ends) if places else (row, counts, names)
        row = to


def run_names(names: np.ndarray, width: int) -> np.ndarray:
    """Names of every run of width words (they cross documents; the caller drops those)."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out *= U64(_SEQ)
            out += names[k : k + n]
        return mix(out + U64(width))


def long_column(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64), pa.int64())
