"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is encoded by halves down to leaves of at most LEAF code points; two encoded neighbours are joined by encoding a
window around the seam again and keeping the tokens outside it. The window grows until each end is the start or end of
the joined text or lies between a character that is no white space and white space. No match of the pattern has white
space after another character, so there every context has a match boundary: the matches before and after don't
depend on the window, and matches are encoded separately. Tokens outside are therefore final. Decoding concatenates the
bytes of the halves.

Null text: empty. An empty text has no ids. Very long texts: one row is one task's work, at memory in proportion to it.
Repeated rows and equal ids: each row has its own result. Other columns are dropped.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text

LEAF = 8192
_EDGE = re.compile(r"\S(?=\s)")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


class Codec:
    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.flat = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = [0] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        return self.flat.encode_ordinary(text) if len(text) <= leaf else self._tree(text, 0, len(text), leaf)

    def _tree(self, text: str, low: int, high: int, leaf: int) -> list[int]:
        if high - low <= leaf:
            return self.flat.encode_ordinary(text[low:high])
        seam = (low + high) // 2
        return self.join(text, low, seam, high, self._tree(text, low, seam, leaf), self._tree(text, seam, high, leaf))

    def join(self, text: str, low: int, seam: int, high: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[low:high] from those of text[low:seam] and text[seam:high]."""
        start = end = None
        reach = 32
        while start is None or end is None:
            if start is None:
                at = max(low, seam - reach)
                # an edge needs a character on each side inside the left half
                found = _EDGE.search(text, at, seam)
                start = found.end() if found else low if at == low else None
            if end is None:
                to = min(high, seam + reach)
                found = _EDGE.search(text, seam, to)
                end = found.end() if found else high if to == high else None
            reach *= 2
        return left[: len(left) - self._count(reversed(left), text[start:seam])] + self.flat.encode_ordinary(text[start:end]) + right[self._count(right, text[seam:end]) :]

    def _count(self, ids: Iterator[int] | list[int], text: str) -> int:
        """How many of the ids cover text exactly."""
        rest, n = len(text.encode()), 0
        for token in ids:
            if rest <= 0:
                break
            rest -= self.size[token]
            n += 1
        if rest:
            raise AssertionError("a window must end between tokens")
        return n

    def decode(self, ids: list[int], leaf: int = 1 << 16) -> bytes:
        if len(ids) <= leaf:
            return self.flat.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


def encode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids: the ids of every whole text by the ranks at path."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                ids = [np.array(tool.encode(x, leaf), dtype=np.int32) for x in part.column("text").to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "ids"])

    return id_text(docs).mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded (binary) for rows of doc_id and ids; null ids decode to no bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                out = [tool.decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, decoded binary")
