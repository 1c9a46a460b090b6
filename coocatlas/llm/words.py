"""Vectorised tokens and hashes over an Arrow batch of texts.

A batch is one byte buffer. Words, their 64-bit hashes and shingle hashes are found with
whole-buffer NumPy operations, so the cost per byte does not depend on the number or
length of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Most text bytes handled at once; a single longer text is handled alone.
BATCH_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

# Bytes that separate words: white space only, and everything but letters, digits and non-ASCII.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _CACHE or len(_CACHE["up"]) < n:
        size = max(n, BATCH_BYTES // 4)
        _CACHE["up"], _CACHE["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _CACHE["up"][:n], _CACHE["down"][:n]


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    """Words of a batch in order: owning document, byte span in ``data``, 64-bit hash."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    n_docs: int

    @property
    def bounds(self) -> np.ndarray:
        """Words of document d are ``bounds[d]`` to ``bounds[d + 1]``."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 document offsets; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, separators: np.ndarray = SPACES) -> Words:
    """Words of each text after ASCII lower-casing, cut at the given separator bytes."""
    data, offsets = buffer_of(texts)
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    # a document boundary ends a word even between two word bytes
    edges = np.diff(inside)
    starts, ends = edges[:-1] == 1, edges[1:] == -1
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    starts[joined] = True
    ends[joined - 1] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, doc, start, end, span_hash(data, start, end), len(offsets) - 1)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span: a polynomial taken from prefix sums, moved to exponent 0, then mixed."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    raw = (sums[end] - sums[start]) * down[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``size`` words that lies in one document."""
    n = len(found.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * 0xBF58476D1CE4E5B9 & _MASK
        total += found.hash[k:k + n] * np.uint64(factor | 1)
    first = np.flatnonzero(found.doc[:n] == found.doc[size - 1:])
    return first, mix(total[first])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the text of each stays near ``limit`` bytes."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            base = total[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop
