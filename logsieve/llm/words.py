"""Words and shingles of a text, as bytes and 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash


def words(text: str | None) -> list[bytes]:
    """The runs of bytes other than ASCII white space, with A-Z in lower case. Null has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Hashes of the distinct ``n``-word shingles, ascending.

    A text with fewer words is one shingle, one without words has none.
    """
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = min(n, len(found))
    out = np.full(len(found) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(31) + hashes[i : len(found) - n + 1 + i])
    return np.unique(out)
