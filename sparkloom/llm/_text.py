"""Vectorised helpers over Arrow string columns: slices of bytes, words and 64-bit word hashes.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. All functions look at whole texts; a slice holds as many
whole rows as fit in `max_bytes`, and a longer row is a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_STEP = 0x9E3779B97F4A7C15 | 1
_GRAM = np.random.default_rng(7).integers(1, 2**62, 64, dtype=np.int64).astype(np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; other seeds give other orders of the same values."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) over a string column; nulls count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + max_bytes, "right")) - 1)
        last = min(last, len(column))
        yield first, last, buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def word_spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of some rows."""
    if not len(buf):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    word = ~space[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offs] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    rows = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, rows


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _U(_STEP), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, piece: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word; with `lower`, A-Z count as a-z."""
    table = _BYTE[_LOWER] if lower else _BYTE
    out = np.zeros(len(starts), dtype=np.uint64)
    for a in range(0, len(starts), piece):
        s, n = starts[a : a + piece], (ends[a : a + piece] - starts[a : a + piece])
        head = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(head, n)
        values = table[buf[inside + np.repeat(s, n)]] * _powers(int(n.max()))[inside]
        out[a : a + piece] = np.add.reduceat(values, head) + n.astype(np.uint64)
    return mix(out)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct k-word shingle, ordered by row; a row of fewer words is one shingle."""
    count = np.bincount(rows, minlength=n_rows)
    if len(words) >= k:
        at = np.flatnonzero(rows[: len(words) - k + 1] == rows[k - 1 :])
        grams = np.zeros(len(at), dtype=np.uint64)
        for j in range(k):
            grams += words[at + j] * _GRAM[j]
        gram_rows = rows[at]
    else:
        grams, gram_rows = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        head = np.cumsum(count) - count
        whole = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            whole[has] += words[head[short[has]] + j] * _GRAM[j]
        grams = np.concatenate([grams, whole + count[short].astype(np.uint64)])
        gram_rows = np.concatenate([gram_rows, short])
    grams = mix(grams, 3)
    order = np.lexsort((grams, gram_rows))
    grams, gram_rows = grams[order], gram_rows[order]
    keep = np.ones(len(grams), dtype=bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (gram_rows[1:] != gram_rows[:-1])
    return gram_rows[keep], grams[keep]


def texts_to_shingles(column: pa.Array, k: int):
    """Yield (first row, rows in the slice, row of each shingle, hash of each shingle)."""
    for first, last, buf, offs in slices(column):
        starts, ends, rows = word_spans(buf, offs)
        hashes = word_hashes(buf, starts, ends)
        r, h = shingle_hashes(hashes, rows, last - first, k)
        yield first, last - first, r, h
