"""Array kernels over Arrow string columns: words, lines, shingles.

A batch of texts is one byte buffer with offsets.  Words are maximal runs of
characters other than space and U+0009 to U+000D; in UTF-8 those bytes occur
only as those characters, so all work is done on bytes.  Hashes are 64 bits
wide: a polynomial over a fixed odd base, taken from prefix sums, then mixed.
Work goes in blocks of a few MB, whatever the batch or text lengths.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MUL = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def tidy() -> None:
    """Give freed memory back to the system; two workers share what an executor's heap leaves."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; longer tables than a block's are not kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    tables = []
    for b in (_BASE, _INVERSE):
        t = np.full(max(n, BLOCK_BYTES + 1), b, dtype=np.uint64)
        t[0] = 1
        np.multiply.accumulate(t, out=t)
        tables.append(t)
    if n <= BLOCK_BYTES + 1:
        _powers[:] = tables
    return tables


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts near a size."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True, cut where a text begins."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:stop] for each span; spans may be empty."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * _MUL[15])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, stop) of every word, and the first word index of each text (with an end)."""
    if lower:
        data = _LOWER[data]
    start, stop = _runs(~_SPACE[data], offsets)
    first = np.searchsorted(start, offsets)
    return span_hashes(data, start, stop), start, stop, first


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``words`` with A-Z lower-cased, for words of the bytes that a table of 256 flags names."""
    data = _LOWER[data]
    start, stop = _runs(inside[data], offsets)
    return span_hashes(data, start, stop), start, stop, np.searchsorted(start, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop) of every line (texts split at U+000A), and each text's first line index (with an end)."""
    n = len(offsets) - 1
    feed = np.flatnonzero(data == 10)
    text = np.searchsorted(offsets, feed, "right") - 1
    count = np.bincount(text, minlength=n) + 1
    first = np.concatenate(([0], np.cumsum(count)))
    start = np.empty(first[-1], np.int64)
    stop = np.empty(first[-1], np.int64)
    rank = np.arange(len(feed)) + text
    stop[rank] = feed
    start[rank + 1] = feed + 1
    start[first[:-1]] = offsets[:-1]
    stop[first[1:] - 1] = offsets[1:]
    return start, stop, first


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside a text: (start index, hash)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = np.repeat(first[1:], np.diff(first))[: n - width + 1]
    at = np.flatnonzero(np.arange(n - width + 1) + width <= left)
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out += hashes[at + j] * _MUL[j]
    return at, mix(out)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and each text's first index (with an end).

    Words are lower-cased (A-Z).  A text of fewer words than ``width`` has one
    shingle, its whole sequence; a text without words has none.
    """
    hashes, _, _, first = words(data, offsets, lower=True)
    n = len(offsets) - 1
    count = np.diff(first)
    at, value = windows(hashes, first, width)
    text = np.searchsorted(first, at, "right") - 1
    values, texts = [value], [text]
    for size in range(1, width):
        short = np.flatnonzero(count == size)
        if len(short):
            h = np.full(len(short), _MUL[8 + size], np.uint64)
            for j in range(size):
                h += hashes[first[short] + j] * _MUL[j]
            values.append(mix(h))
            texts.append(short)
    value, text = np.concatenate(values), np.concatenate(texts)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        value, text = value[new], text[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n))))
