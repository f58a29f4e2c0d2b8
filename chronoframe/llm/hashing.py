"""Vectorised words and fingerprints over Arrow string columns.

A word is a maximal run of bytes other than the six ASCII blanks
(``[^\\x20\\x09-\\x0D]+``). Everything here works on whole Arrow batches with
numpy; a batch is cut into slices of ``SLICE_BYTES`` first, so the temporary
arrays stay small however large the batch or a single text is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C55  # odd: a unit modulo 2**64
_MUL1, _MUL2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def give_back() -> None:
    """Return freed memory to the system. Python workers live on, idle or for
    other stages, and would hold the most that any of their tasks needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(_MUL1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_MUL2)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def string_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.dtype(np.int64 if large else np.int32)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind, n + 1, col.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def _spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of non-blank bytes."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.empty(len(raw) + 2, np.int8)
    edge[0] = edge[-1] = 0
    edge[1:-1] = ~blank
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _slices(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hashed_words(col, lower: bool = False, table: np.ndarray | None = None,
                 head: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of a string column, and for each row where
    its words start (length ``rows + 1``). ``lower`` folds A-Z first; a
    ``table`` of 256 bytes replaces every byte first. With ``head`` only the
    first so many bytes of a word count."""
    raw, off = string_buffers(col)
    hashes, counts = [], [np.zeros(0, np.int64)]
    for i, j in _slices(off, SLICE_BYTES):
        part, at = raw[off[i]:off[j]], off[i:j + 1] - off[i]
        if table is not None:
            part = table[part]
        elif lower:
            part = part + ((part >= 65) & (part <= 90)).astype(np.uint8) * np.uint8(32)
        # a row's text ends its last word: look at each row with a blank behind it
        rows = j - i
        padded = np.full(len(part) + rows, 32, np.uint8)
        padded[np.arange(len(part)) + np.repeat(np.arange(rows), np.diff(at))] = part
        start, end = _spans(padded)
        ends_at = at[1:] + np.arange(1, rows + 1)  # just behind each row's blank
        upto = np.searchsorted(start, ends_at, "left")
        counts.append(np.diff(upto, prepend=0))
        if len(start):
            length = end - start if head is None else np.minimum(end - start, head)
            inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            value = padded[np.repeat(start, length) + inside].astype(np.uint64) + np.uint64(1)
            value *= powers(_BASE, int(length.max()))[inside]
            hashes.append(mix64(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64)))
    at = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), at


def windows(words: np.ndarray, at: np.ndarray, width: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every run of ``width`` words inside one row, and where
    each row's runs start. Rows with fewer words have none."""
    n = np.maximum(np.diff(at) - (width - 1), 0)
    start = np.concatenate([[0], np.cumsum(n)])
    if len(words) < width or start[-1] == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    factor = powers((_BASE * (2 * seed + 1)) % (1 << 64), width + 1)
    m = len(words) - width + 1
    total = np.zeros(m, np.uint64)
    for k in range(width):
        total += words[k:k + m] * factor[k + 1]
    keep = np.repeat(at[:-1] - start[:-1], n) + np.arange(int(start[-1]))
    return mix64(total[keep]), start
