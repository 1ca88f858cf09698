"""Byte-level BPE over a tree of text halves.

The ids of a text are a monoid: halves are encoded on their own and joined by encoding a window
around the cut anew. The window ends at places where every text that holds them is cut, so tokens
outside it cannot change. Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.batches import small_batches

#: Characters up to which a text is encoded whole, and of the first window at a cut.
LEAF, WINDOW = 8192, 64


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, for the tasks. A vocabulary is a fixed file of under a megabyte."""
    with open(path, "rb") as file:
        return file.read()


class TreeBpe:
    """Encodes and decodes with the merges of a rank file (base64 token, rank) and a split pattern."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        lines = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}
        )
        self.lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.lengths[rank] = len(token)
        self.leaf, self.window = leaf, window

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self._plain(text)
        cut = len(text) // 2
        return self._join(self.encode(text[:cut]), self.encode(text[cut:]), text, cut)

    def _join(self, left: np.ndarray, right: np.ndarray, text: str, cut: int) -> np.ndarray:
        width = self.window
        while True:
            start = self._boundary(text, max(0, cut - width), cut, last=True)
            end = self._boundary(text, cut + 1, min(len(text), cut + width), last=False)
            if (start is not None or width >= cut) and (end is not None or width >= len(text) - cut):
                break
            width *= 2
        start, end = start or 0, end or len(text)
        head = self._keep(left, len(text[start:cut].encode()), from_end=True)
        tail = self._keep(right, len(text[cut:end].encode()), from_end=False)
        return np.concatenate([head, self._plain(text[start:end]), tail])

    @staticmethod
    def _boundary(text: str, low: int, high: int, last: bool) -> int | None:
        """A place in [low, high) before white space and after something else.

        No match of the pattern holds such a pair, and none looks past it, so every text is cut
        there, whatever stands on either side.
        """
        places = range(high - 1, max(low, 1) - 1, -1) if last else range(max(low, 1), high)
        for i in places:
            if text[i] in " \n" and not text[i - 1].isspace():
                return i
        return None

    def _keep(self, ids: np.ndarray, size: int, from_end: bool) -> np.ndarray:
        """``ids`` without those of the ``size`` bytes at one end."""
        if not size:
            return ids
        count = 64
        while True:
            part = ids[-count:][::-1] if from_end else ids[:count]
            sums = np.cumsum(self.lengths[part])
            if sums[-1] >= size:
                drop = int(np.searchsorted(sums, size)) + 1
                return ids[: len(ids) - drop] if from_end else ids[drop:]
            count *= 4

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids.tolist())
        cut = len(ids) // 2
        return self.decode(ids[:cut]) + self.decode(ids[cut:])


@functools.lru_cache(maxsize=2)
def _codec(ranks: bytes, pattern: str) -> TreeBpe:
    return TreeBpe(ranks, pattern)


def _encoder(ranks, pattern):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            ids = [codec.encode(text or "") for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].array,
                "n_tokens": [len(x) for x in ids],
                "ids": [x.astype("<u4").tobytes() for x in ids],
            })

    return run


def _decoder(ranks, pattern):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            yield batch.assign(
                decoded=[codec.decode(np.frombuffer(x or b"", "<u4")) for x in batch["ids"]]
            )

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` per row of ``docs`` (doc_id, text); ids are packed little-endian
    unsigned 32-bit integers.

    Null and empty texts have no ids. Rows are independent: repeated rows come back repeated, a
    null doc_id stays null, other columns are ignored, no rows give no rows. No shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(_encoder(ranks, pattern), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``encode`` with their bytes as ``decoded``; null ids decode to no bytes."""
    spark = encoded.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInPandas(
        _decoder(ranks, pattern), "doc_id long, n_tokens long, ids binary, decoded binary"
    )
