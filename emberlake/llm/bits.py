"""A set of 64-bit hashes as a table of bits of bounded size: it lets no member slip, and few others in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bits for each hash, and the largest table, 16 MB.
BITS_PER_HASH, MOST_BITS = 64, 1 << 27


def places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a table of ``size`` bits, a power of two."""
    m = np.uint64(size - 1)
    return (hashes & m).astype(np.int64), ((hashes >> np.uint64(32)) & m).astype(np.int64)


def among(hashes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    one, two = places(hashes, len(packed) * 8)
    return (packed[one >> 3] >> (7 - (one & 7)).astype(np.uint8)) & (packed[two >> 3] >> (7 - (two & 7)).astype(np.uint8)) & 1 == 1


def bit_table(hashes: DataFrame, n: int) -> np.ndarray:
    """The packed table of the column ``seed`` of about ``n`` hashes; at most MOST_BITS whatever it holds.

    Eight tasks fill a table each; the driver sees one of them at a time.
    """
    size = 1 << min(MOST_BITS.bit_length() - 1, max(16, (max(1, n) * BITS_PER_HASH - 1).bit_length()))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(size, bool)
        for b in batches:
            for at in places(b["seed"].to_numpy(np.int64).view(np.uint64), size):
                table[at] = True
        yield pd.DataFrame({"bits": [np.packbits(table).tobytes()]})

    total = np.zeros(size // 8, np.uint8)
    for row in hashes.select("seed").coalesce(8).mapInPandas(fill, "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], np.uint8)
    return total
