"""Five-word shingles of Arrow string batches, hashed with numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, after lower-casing
A-Z.  A text with fewer than ``width`` words is one shingle (its whole word
sequence); a text without words, or a null, has none.  Shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1 = np.uint64(0xBF58476D1CE4E5B9)  # splitmix64 constants
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_POWERS = {"p": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    p = _POWERS["p"]
    if len(p) < n:
        p = np.full(max(n, 256), 0x100000001B3, np.uint64)
        p[0] = 1
        p = _POWERS["p"] = np.multiply.accumulate(p)
    return p


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    buf = col.buffers()
    off = np.frombuffer(buf[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and len(buf[2]) else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of every text, in order."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    keep = np.flatnonzero(~space)
    if not len(keep):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.zeros(len(data), bool)
    first[1:] = space[:-1]
    first[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(first[keep])
    low = data[keep].astype(np.uint64)
    low[(low >= 65) & (low <= 90)] += np.uint64(32)
    lens = np.diff(np.append(starts, len(keep)))
    pos = np.arange(len(keep)) - np.repeat(starts, lens)
    word = np.add.reduceat((low + np.uint64(1)) * _powers(int(lens.max()) + 1)[pos], starts)
    row = np.searchsorted(off, keep[starts], side="right") - 1
    return mix(word + lens.astype(np.uint64) * np.uint64(_STEP)), row


def shingle_hashes(col: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle occurrence, row by row."""
    word, row = word_hashes(*string_buffers(col))
    n = len(word)
    counts = np.bincount(row, minlength=len(col)) if n else np.zeros(len(col), np.int64)
    mult = [np.uint64((_STEP * (2 * i + 1)) % 2**64 | 1) for i in range(width)]
    if n >= width:
        full = np.flatnonzero(row[:n - width + 1] == row[width - 1:])
        h = np.zeros(len(full), np.uint64)
        for i, m in enumerate(mult):
            h += mix(word[full + i] + m)  * m
        h, r = mix(h), row[full]
    else:
        h, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = np.cumsum(counts) - counts
        extra = counts[short].astype(np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += mix(word[at[short[has]] + k] + mult[k]) * mult[k]
        h, r = np.concatenate([h, mix(extra)]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def distinct_per_row(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) sorted by row, then hash."""
    if not len(h):
        return h, r
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def list_column(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """list<int64> column with ``values`` grouped by ``rows`` (sorted)."""
    off = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]) if n else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64), pa.int64()))
