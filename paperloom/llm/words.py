"""Words of many UTF-8 texts at once, as numpy arrays of starts, ends and 64-bit hashes.

A word is a run of bytes of a class. Bytes from 0x80 belong to letters outside ASCII and
are always inside words, so classes of ASCII characters need no decoding.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa

from paperloom.llm.common import worker_state

BLOCK = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_JOIN = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# The bytes of words of letters and digits, and of words between blanks.
ALNUM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
SOLID = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])


class Words(NamedTuple):
    """Words of the rows ``first`` to ``last`` (exclusive).

    ``bounds[i]`` is the first word of row ``first + i``, ``origin[i]`` that row's first byte.
    """

    first: int
    last: int
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    origin: np.ndarray


def utf8_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of the rows; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least ``n`` of them."""
    tables = worker_state("word powers", dict)
    size = max(BLOCK, n)
    if size not in tables:
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        up, down = np.full(size, _STEP), np.full(size, inverse)
        up[0] = down[0] = 1
        tables.clear()
        tables[size] = np.cumprod(up), np.cumprod(down)
    return tables[size]


def _piece(data: np.ndarray, lo: int, hi: int, cuts: np.ndarray, inside: np.ndarray):
    """Words in bytes lo..hi; ``cuts`` are row borders in between, which no word crosses."""
    bytes_ = data[lo:hi]
    member = inside[bytes_]
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    inner = cuts[(cuts > lo) & (cuts < hi)] - lo
    begins[inner] = member[inner]
    stops = member.copy()
    stops[:-1] &= ~member[1:]
    stops[inner - 1] = member[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _power_tables(hi - lo)
    running = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[bytes_]] * up[: hi - lo], out=running[1:])
    return start + lo, end + lo, mixed((running[end] - running[start]) * down[start])


def _cut_before(data: np.ndarray, lo: int, hi: int, end: int, inside: np.ndarray) -> int:
    """A place near hi that is not within a word."""
    if hi >= end:
        return end
    gaps = np.flatnonzero(~inside[data[lo:hi]])
    if len(gaps):
        return lo + int(gaps[-1]) + 1
    while hi < end and inside[data[hi]]:  # one word longer than a block
        hi += 1
    return hi


def word_blocks(texts: pa.Array, inside: np.ndarray) -> Iterator[tuple[np.ndarray, Words]]:
    """Words of consecutive groups of rows, each group of about a block of bytes or of one long row."""
    data, offsets = utf8_rows(texts)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1)
        lo, end, parts = int(offsets[first]), int(offsets[last]), []
        while lo < end:
            hi = _cut_before(data, lo, min(lo + BLOCK, end), end, inside)
            parts.append(_piece(data, lo, hi, offsets[first : last + 1], inside))
            lo = hi
        start, end_, code = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        yield data, Words(first, last, start, end_, code, np.searchsorted(start, offsets[first : last + 1]), offsets[first : last + 1])
        first = last


def window_hashes(code: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of ``length`` words, whatever rows they lie in."""
    n = len(code) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(length))
    for k in range(length):
        out = (out + code[k : k + n]) * _JOIN
    return mixed(out)
