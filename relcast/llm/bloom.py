"""A Bloom filter built by Spark and sized by its keys, up to a fixed number of bits: what may be sent to every task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix

MOST_BITS = 28  # 2**28 bits: 32 MB
MOST_KEYS = (1 << MOST_BITS) // 16  # with 16 bits a key and three bits set, one foreign key in some 200 passes
SALTS = (0x51ED270B3A5F1C29, 0x2545F4914F6CDD1D, 0x6A09E667F3BCC909)


def _positions(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(keys ^ np.uint64(s)) >> np.uint64(64 - bits) for s in SALTS]


def build(keys: DataFrame, col: str, n: int) -> np.ndarray:
    """Filter words (uint64) of a long column of ``n`` keys, at most MOST_KEYS; at most n / 4 + 1,024 words reach the driver."""
    if n > MOST_KEYS:
        raise ValueError(f"{n} keys; a filter holds {MOST_KEYS}")
    bits = min(MOST_BITS, max(16, (16 * n).bit_length()))

    def run(batches):
        import pandas as pd
        for b in batches:
            pos = np.unique(np.concatenate(_positions(b["k"].to_numpy(np.int64).view(np.uint64), bits)))
            bit = (np.uint64(1) << (pos & np.uint64(63))).view(np.int64)
            yield pd.DataFrame({"word": (pos >> np.uint64(6)).astype(np.int64), "bits": bit})

    rows = (keys.select(F.col(col).alias("k")).where("k is not null").mapInPandas(run, "word long, bits long")
            .groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas())
    out = np.zeros(2 ** bits // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def contains(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for pos in _positions(keys, (64 * len(words)).bit_length() - 1):
        hit &= (words[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63))) & np.uint64(1) == 1
    return hit
