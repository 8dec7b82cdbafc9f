"""Hashes of words and word n-grams of a whole Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

#: An odd multiplier, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Bytes of text whose hashes are made together; a longer text is a block of its own.
BLOCK_BYTES = 2_000_000


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``limit`` bytes in ``column``, or of one row."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(batch):
        before = ends[first] - sizes[first]
        stop = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(first, stop - first)
        first = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text and at the end).

    Words are runs of other bytes than space, tab, LF, VT, FF and CR.
    """
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    begins = solid.copy()
    begins[1:] &= first[1:] | ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= first[1:] | ~solid[1:]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # A word's polynomial is a difference of prefix sums, shifted to exponent 0.
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    words = mix((sums[b] - sums[a]) * _powers(_INVERSE, len(data))[a] + (b - a).astype(np.uint64))
    return words, np.searchsorted(a, offsets)


def gram_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``n`` words within a text, number of runs before each text and at the end)."""
    total = max(len(words) - n + 1, 0)
    grams = np.zeros(total, np.uint64)
    for k in range(n):
        grams = mix(grams * np.uint64(_BASE) + words[k : k + total])
    owner = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    inside = owner[:total] == owner[n - 1 : n - 1 + total]
    sizes = np.maximum(np.diff(counts) - n + 1, 0)
    return grams[inside], np.concatenate([[0], np.cumsum(sizes)])


def unique_grams(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct grams, in order, with the counts of those."""
    owner = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    g, o = g[new], o[new]
    return g, np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(counts) - 1))]).astype(np.int64)
