"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph ends after line feeds; its leaves end after sentences, so that an edit within a long paragraph is located as
well (at most LEAF code points each). Runs of paragraphs form sections that end at blank lines or after a paragraph whose
digest is divisible by SPAN, so that an edit moves no later section border; the root is over the sections. All digests have
128 bits, and every one above the leaves is made of the digests of its branches alone, so a fingerprint can be checked from
itself. Equal roots mean equal texts; differing sections, then paragraphs, then leaves, locate edits. A fingerprint reads
`root:section[paragraph(leaf leaf ...)paragraph(...)]section[...]`, all in hex.

Likeness of two fingerprints: 1 for equal roots, else the leaves that both hold (with multiplicity) over the leaves of
the larger; sections, then paragraphs, that both hold are compared by their digests alone. An empty text has no leaf and
likeness 0 to any other.

Null text: empty. Next document: ascending doc_id (null first), ties by text; after the last comes the first, which
for a single row is itself. Ids are compared as longs throughout, beside nulls as well. A null or repeated id of many rows is cut
into parts by the first six bytes of its texts; rows that are equal so far are ordered in one task. Very long texts: one row and
its next are held by one task at a time. Repeated rows stay. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

LEAF, SPAN, MAX_PARTS = 512, 8, 1 << 16
_CUT = re.compile(r"[^\n.!?]*(?:[.!?]+[ \t]*|\n+|\Z)\n*")
_SECTION, _PARAGRAPH = re.compile(r"([0-9a-f]{32})\[(.*?)\]"), re.compile(r"([0-9a-f]{32})\(([0-9a-f ]*)\)")


def leaves(text: str) -> list[str]:
    """The text cut after sentence ends and line feeds, whole when joined."""
    out = []
    for piece in _CUT.findall(text):
        if len(piece) <= LEAF:
            if piece:
                out.append(piece)
        else:
            out += [piece[i : i + LEAF] for i in range(0, len(piece), LEAF)]
    return out


def digest(level: bytes, parts: bytes) -> bytes:
    """16 bytes; the level keeps a leaf's text from passing for a list of digests."""
    return hashlib.blake2b(parts, digest_size=16, person=level).digest()


def fingerprint(text: str) -> str:
    sections: list[tuple[bytes, str]] = []
    names, told, own = [], [], []
    cut = leaves(text)
    for i, leaf in enumerate(cut):
        own.append(digest(b"leaf", leaf.encode()))
        last = i == len(cut) - 1
        if last or leaf[-1] == "\n":
            name = digest(b"paragraph", b"".join(own))
            names.append(name)
            told.append(f"{name.hex()}({' '.join(d.hex() for d in own)})")
            own = []
            if last or name[0] % SPAN == 0 or leaf.endswith("\n\n"):
                sections.append((digest(b"section", b"".join(names)), "".join(told)))
                names, told = [], []
    root = digest(b"root", b"".join(name for name, _ in sections))
    return root.hex() + ":" + "".join(f"{name.hex()}[{inside}]" for name, inside in sections)


def branches(print_: str) -> list[tuple[str, list[tuple[str, list[str]]]]]:
    """Sections with their paragraphs with their leaves."""
    return [(name, [(p, own.split()) for p, own in _PARAGRAPH.findall(inside)]) for name, inside in _SECTION.findall(print_)]


def holds(print_: str) -> bool:
    """Whether every digest of a fingerprint follows from its branches."""
    own = branches(print_)
    over = lambda level, names: digest(level, bytes.fromhex("".join(names))).hex()
    return print_[:32] == over(b"root", [s for s, _ in own]) and all(s == over(b"section", [p for p, _ in ps]) and all(p == over(b"paragraph", own) for p, own in ps) for s, ps in own)


def unshared(one: list, other: list) -> tuple[list, list, list]:
    """(branches that both hold by their digests, those of one alone, those of other alone), with multiplicity."""
    left, met, rest = Counter(name for name, _ in one), [], []
    for branch in other:
        if left[branch[0]] > 0:
            left[branch[0]] -= 1
            met.append(branch)
        else:
            rest.append(branch)
    mine = []
    for branch in reversed(one):
        if left[branch[0]] > 0:
            left[branch[0]] -= 1
            mine.append(branch)
    return met, mine[::-1], rest


def likeness(one: str, other: str) -> float:
    if one[:32] == other[:32]:
        return 1.0
    a, b = branches(one), branches(other)
    count = lambda sections: sum(len(own) for _, ps in sections for _, own in ps)
    total = max(count(a), count(b))
    if not total:
        return 0.0
    met, a, b = unshared(a, b)
    shared = count(met)
    met, a, b = unshared([p for _, ps in a for p in ps], [p for _, ps in b for p in ps])
    shared += sum(len(own) for _, own in met)
    return (shared + (Counter(d for _, own in a for d in own) & Counter(d for _, own in b for d in own)).total()) / total


def edits(one: str, other: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, leaf) of the leaves of one that other lacks; branches that both hold aren't opened."""
    a, b = branches(one), branches(other)
    known, parts = Counter(name for name, _ in b), Counter(name for _, ps in b for name, _ in ps)
    left = Counter(d for _, ps in b for _, own in ps for d in own)
    shut: list[str] = []
    out = []
    for name, ps in a:
        if known[name] > 0:
            known[name] -= 1
            shut += [p for p, _ in ps]
            left.subtract(d for _, own in ps for d in own)
    parts.subtract(shut)
    known = Counter(name for name, _ in b)
    for i, (name, ps) in enumerate(a):
        if known[name] > 0:
            known[name] -= 1
            continue
        for j, (p, own) in enumerate(ps):
            if parts[p] > 0:
                parts[p] -= 1
                left.subtract(own)
                continue
            for k, leaf in enumerate(own):
                if left[leaf] > 0:
                    left[leaf] -= 1
                else:
                    out.append((i, j, k))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(fingerprint, batch.column("text").to_pylist()), pa.string())], ["doc_id", "fingerprint"])

    return id_text(docs).mapInArrow(work, "doc_id long, fingerprint string")


def text_key(text: Column) -> Column:
    """The first six bytes as a number: never falling in the order of texts."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("long")


def with_next(docs: DataFrame, per: int = 1024) -> DataFrame:
    """Rows (part, place, doc_id, text) in which each document is followed, in order within its part, by the next one.

    Parts are ranges of (doc_id, text) of about per rows, at most MAX_PARTS of them: ranges of doc_id, null apart, and an id
    (or null) that fills a part by itself is cut on by its texts' beginnings. The first document of a part is sent to the part
    before it as well (place 1), so no text moves twice but these. What the driver sees is one row for each part.
    """
    own = id_text(docs)
    rows, nulls = own.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    parts = min(MAX_PARTS, max(1, -(-rows // per)))
    told = own.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    cuts = sorted(told or [])
    # an id that several cuts fall on is a part of its own
    hot = {a for a, b in pairwise(cuts) if a == b}
    cuts = np.array(sorted(set(cuts) | {h + 1 for h in hot if h < (1 << 63) - 1}), dtype=np.int64)

    def range_of(name: str) -> Column:
        """0 for null, else 1 and more: pandas sees longs without a null, so every id is exact."""

        @F.pandas_udf("int")
        def at(doc: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, doc.to_numpy(np.int64), side="right").astype(np.int32) + 1)

        return F.when(F.col(name).isNotNull(), at(F.coalesce(F.col(name), F.lit(0)))).otherwise(0)

    own = own.withColumn("range", range_of("doc_id"))
    heavy = sorted({int(np.searchsorted(cuts, h, side="right")) + 1 for h in hot} | ({0} if nulls > per else set()))
    begins: dict[int, np.ndarray] = {}
    if heavy:
        # one row for each such id, with about as many cuts as it has parts
        rank = [i / 64 for i in range(1, 64)]
        for r in own.where(F.col("range").isin(heavy)).groupBy("range").agg(F.percentile_approx(text_key(F.col("text")), rank, 10_000).alias("cuts")).collect():
            begins[r["range"]] = np.array(sorted(set(r["cuts"])), dtype=np.int64)
    bases = np.concatenate([[0], np.cumsum([1 + len(begins.get(i, ())) for i in range(len(cuts) + 2)])])

    @F.pandas_udf("int")
    def part_of(range_: pd.Series, key: pd.Series) -> pd.Series:
        where, key = range_.to_numpy(np.int64), key.to_numpy(np.int64)
        part = bases[where]
        for i, own_cuts in begins.items():
            on = where == i
            part[on] += np.searchsorted(own_cuts, key[on], side="right")
        return pd.Series(part.astype(np.int32))

    key = F.when(F.col("range").isin(heavy), text_key(F.col("text"))).otherwise(0) if heavy else F.lit(0).cast("long")
    own = own.withColumn("key", key).select(part_of("range", "key").alias("part"), "doc_id", "text", "key")
    # of each part its first id and text's beginning, and the part before; rows that tie with them go along
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "key"))
    firsts = sorted(((r["part"], r["first"]["doc_id"], r["first"]["key"]) for r in own.groupBy("part").agg(least.alias("first")).collect()), key=lambda x: x[0])
    told = [(*one, firsts[i - 1][0]) for i, one in enumerate(firsts)]  # before the first comes the last
    before = F.broadcast(docs.sparkSession.createDataFrame(told, "part int, first long, begin long, back int"))  # a row for each part
    is_first = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("key") == F.col("begin"))
    goals = F.when(is_first, F.array("part", "back")).otherwise(F.array("part"))
    return own.join(before, "part").select(F.posexplode(goals).alias("place", "part"), "doc_id", "text")


def edited_pairs(docs: DataFrame, per: int = 1024) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs, per)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (part, doc_id, text, fingerprint) that waits for its next document
        done = None  # part whose own documents all have their next
        for batch in batches:
            out: list[tuple] = []
            for part, place, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "doc_id", "text")), strict=True):
                if done == part:
                    continue
                own = fingerprint(text)
                if last is not None and last[0] == part:
                    half = len(last[2]) // 2
                    edited = last[2][: len(last[2]) - half] + text[:half]
                    changed = fingerprint(edited)
                    out.append((last[1], len(last[2]), edited, last[3], changed, likeness(last[3], changed), likeness(last[3], own)))
                if place:
                    done, last = part, None
                else:
                    last = (part, doc, text, own)
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    shuffled = rows.repartition(F.col("part")).sortWithinPartitions("part", "place", F.asc_nulls_first("doc_id"), "text")
    return shuffled.mapInArrow(work, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
