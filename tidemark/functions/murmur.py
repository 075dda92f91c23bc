"""Murmur3, 32 bits, seed 0. Spark's own hash() is another variant, so this one is built from column arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants of the published algorithm. Fixed values.
C1, C2, M5, N = 0xCC9E2D51, 0x1B873593, 5, 0xE6546B64
F1, F2 = 0x85EBCA6B, 0xC2B2AE35


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def murmur3(values: list[bytes]) -> np.ndarray:
    """Hashes of byte strings; strings of one length are hashed together, a word of all of them at a time."""
    out = np.zeros(len(values), dtype=np.uint32)
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join(values[i].ljust(-(-size // 4) * 4, b"\0") for i in at), dtype="<u4").reshape(len(at), -1)
        h = np.zeros(len(at), dtype=np.uint32)
        for w in range(raw.shape[1]):
            k = _rotated(raw[:, w] * np.uint32(C1), 15) * np.uint32(C2)
            h ^= k
            if 4 * (w + 1) <= size:
                h = _rotated(h, 13) * np.uint32(M5) + np.uint32(N)
        h ^= np.uint32(size)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(F1)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(F2)
        out[at] = h ^ (h >> np.uint32(16))
    return out


def murmur3_of(column: Column) -> Column:
    """The hash of a string column as a long (it is unsigned); null stays null."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            h = pd.Series(murmur3([x.encode() if x is not None else b"" for x in s]).astype(np.int64))
            yield h.where(s.notna().to_numpy())

    return hashed(column)
