"""Vectorised scanning of text batches: words, lines, hashes and word shingles, with numpy over the raw UTF-8 bytes.

A word is a maximal run of bytes other than the six ASCII white-space characters; ASCII white space never occurs inside
a multi-byte character, so byte runs and character runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space.
WHITE = (9, 10, 11, 12, 13, 32)
#: Bytes of text handled at once; bounds the temporary arrays.
PIECE = 1 << 20
SHINGLE = 5

IS_WORD = np.ones(256, bool)
IS_WORD[list(WHITE)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _rng.integers(1, (1 << 64) - 1, 256, dtype=np.uint64)
_STEP = _rng.integers(1, (1 << 64) - 1, SHINGLE, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, PIECE), _powers(_BASE_INVERSE, PIECE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the offsets between them; a null text has no bytes."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
    return buf, offsets - offsets[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of text; a longer text has a range of its own."""
    _, offsets = texts(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def runs(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are ``inside``; no run crosses a text's end."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    on = inside[buf]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    first[cuts] |= on[cuts]
    last[cuts - 1] |= on[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes. Spans are in order and don't overlap; prefix sums are taken piece by piece."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
        n = int(ends[stop - 1]) - begin
        if n > PIECE:  # one span longer than a piece: its parts are chained
            value = np.uint64(n)
            for k in range(begin, begin + n, PIECE):
                part = _BYTE[buf[k : min(k + PIECE, begin + n)]] * _UP[: min(PIECE, begin + n - k)]
                with np.errstate(over="ignore"):
                    value = mix(np.array([value + part.sum(dtype=np.uint64)], np.uint64))[0]
            out[at] = value
        else:
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[buf[begin : begin + n]] * _DOWN[:n], out=total[1:])
            s, e = starts[at:stop] - begin, ends[at:stop] - begin
            length = (e - s).astype(np.uint64)
            out[at:stop] = mix((total[e] - total[s]) * _UP[np.minimum(s, PIECE - 1)] + length * np.uint64(0x9E3779B97F4A7C15))
        at = stop
    return out


def words_of(buf: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and each text's first word (one more at the end)."""
    starts, ends = runs(buf, offsets)
    hashes = span_hashes(LOWER[buf] if lower else buf, starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all windows of five consecutive words; fewer words give none."""
    k = len(hashes) - SHINGLE + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:k] * _STEP[0]
    for i in range(1, SHINGLE):
        total += hashes[i : i + k] * _STEP[i]
    return mix(total)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct 5-word shingles of a text's words; with fewer words, the whole sequence as one."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    if len(hashes) < SHINGLE:
        value = np.uint64(len(hashes))
        with np.errstate(over="ignore"):
            for h in hashes:
                value = mix(np.array([value * np.uint64(0x9E3779B97F4A7C15) + h], np.uint64))[0]
        return np.array([value], np.uint64)
    return np.unique(windows(hashes))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's shingle set, in order."""
    for a, b in pieces(column):
        buf, offsets = texts(column.slice(a, b - a))
        _, _, hashes, first = words_of(buf, offsets)
        for i in range(b - a):
            yield shingles(hashes[first[i] : first[i + 1]])
