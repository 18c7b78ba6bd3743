"""Word and shingle hashes of whole texts, vectorised over Arrow batches.

A word is a run of bytes other than space and \\x09-\\x0D; A-Z count as a-z. A
word's hash is a sum of per-byte random numbers weighted by powers of an odd
number, read off prefix sums, so that no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240613)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_LANES = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, max_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows with about so many bytes; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and at which of them each text begins (one more number at the end)."""
    n = len(data)
    ink = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins, ends = ink.copy(), ink.copy()
    if n > 1:
        begins[1:] &= ~ink[:-1] | edge[1:n]
        ends[:-1] &= ~ink[1:] | edge[1:n]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers = np.ones(n, dtype=np.uint64)
    back = np.ones(n, dtype=np.uint64)
    powers[1:], back[1:] = _ODD, _INVERSE
    np.cumprod(powers, out=powers)
    np.cumprod(back, out=back)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers, out=sums[1:])
    hashes = (sums[ends] - sums[begins]) * back[begins] + (ends - begins).astype(np.uint64)
    return mixed(hashes), np.searchsorted(begins, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, or of its whole sequence where it is shorter; and where each text begins."""
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begins = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(counts, out=begins[1:])
    at = np.arange(begins[-1]) - np.repeat(begins[:-1], counts) + np.repeat(first[:-1], counts)
    width = np.repeat(np.minimum(n, k), counts)
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, dtype=np.uint64)])
    for j in range(k):
        out += np.where(width > j, padded[at + j] * _LANES[j], np.uint64(0))
    return mixed(out + width.astype(np.uint64)), begins


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for _, _, data, offsets in text_slices(column):
        hashes, begins = shingles(*words(data, offsets), k)
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            yield np.unique(hashes[a:b])
