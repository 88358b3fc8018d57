"""Vectorised numpy kernels over the UTF-8 bytes of an Arrow text column.

Everything here works on a chunk of whole rows (never a prefix of one): ``data`` is the
bytes of the rows laid end to end and ``offsets`` the n+1 row bounds. A null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel works on at once; one longer row is a chunk of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Word bytes: ASCII letters and digits, and every byte of a non-ASCII character.
IS_WORD = np.zeros(256, bool)
IS_WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        p = np.full(size, base, _U)
        p[0] = 1
        have = np.cumprod(p, dtype=_U)
        if size <= 16 * CHUNK_BYTES:  # one very long row must not stay in memory
            _pow[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string or binary column; nulls are empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    n = len(col)
    _, off, buf = col.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunked(col: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a column into runs of whole rows of about ``size`` bytes: (first, last, bytes, offsets)."""
    data, offsets = column_bytes(col)
    first, n = 0, len(col)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of data[:i], modulo 2**64."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free hashes of the byte ranges [starts, ends)."""
    return mix((prefix[ends] - prefix[starts]) * _powers(_BASE_INV, len(prefix))[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of word bytes within a row), ASCII letters folded to lower case.

    Returns (hash, start, end, bounds): bounds[i]:bounds[i+1] are the words of row i.
    """
    if not len(data):
        e = np.zeros(0, np.int64)
        return e.astype(_U), e, e, np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IS_WORD[low]
    start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    start[cut] |= inside[1:-1][cut]
    end[cut - 1] |= inside[1:-1][cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return range_hash(prefix_hash(low), starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive words, within rows.

    A row of fewer words (but at least one) has the single shingle of all its words; a row
    without words has none. Returns (hash, first word, bounds by row).
    """
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], count) + np.arange(out_bounds[-1])
    acc = np.zeros(len(first), _U)
    room = np.repeat(bounds[1:], count) - first
    for j in range(width):
        at = np.minimum(first + j, max(len(hashes) - 1, 0))
        step = acc * _U(0xD6E8FEB86659FD93 | 1) + hashes[at] if len(hashes) else acc
        acc = step if not np.any(room <= j) else np.where(room > j, step, acc)
    return mix(acc), first, out_bounds
