"""Hashed words and word shingles of whole texts, vectorised over an Arrow buffer.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z taken as a-z.  A word's hash is a polynomial over
random 64-bit values of its bytes; a shingle's hash is a polynomial over the words' hashes; both are mixed at the end.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes handled at once; the working memory is about 40 times this, and faster where it fits the processor's cache.
PIECE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """hashes, start and end byte of each word; words bounds[d] to bounds[d + 1] are those of text d."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the texts' bounds in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return buf[bounds[0] : bounds[-1]], bounds - bounds[0]


def _cuts(buf: np.ndarray, bounds: np.ndarray) -> list[int]:
    """Positions, about PIECE apart, at which no word is cut."""
    cuts, at = [0], PIECE
    while at < len(buf):
        stop = int(bounds[np.searchsorted(bounds, at)])
        look = at
        while look < stop:
            found = np.flatnonzero(_SPACE[buf[look : min(stop, look + 4096)]])
            if len(found):
                stop = look + int(found[0])
                break
            look += 4096
        if stop > cuts[-1]:
            cuts.append(stop)
        at = max(stop, at) + PIECE
    return [*cuts, len(buf)]


def word_table(buf: np.ndarray, bounds: np.ndarray) -> Words:
    parts = []
    power = np.ones(1, np.uint64)
    for a, b in zip((c := _cuts(buf, bounds))[:-1], c[1:], strict=True):
        x = buf[a:b]
        if not len(x):
            continue
        space = _SPACE[x]
        begin = np.empty(len(x), bool)
        begin[0] = True
        begin[1:] = space[:-1]
        inside = bounds[np.searchsorted(bounds, a) : np.searchsorted(bounds, b)] - a
        begin[inside] = True
        begin &= ~space
        letters = np.flatnonzero(~space)
        if not len(letters):
            continue
        first = np.flatnonzero(begin[letters])
        size = np.diff(first, append=len(letters))
        place = np.arange(len(letters)) - np.repeat(first, size)
        if (longest := int(size.max())) > len(power):
            with np.errstate(over="ignore"):
                power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(longest, _P)])
        with np.errstate(over="ignore"):
            hashes = np.add.reduceat(_BYTE[x[letters]] * power[place], first)
            hashes = mix(hashes ^ size.astype(np.uint64) * _Q)
        starts = letters[first] + a
        parts.append((hashes, starts, starts + size))
    if parts:
        hashes, starts, ends = (np.concatenate(p) for p in zip(*parts, strict=True))
    else:
        hashes, starts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Words(hashes, starts, ends, np.searchsorted(starts, bounds))


def shingle_table(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and each text's bounds in them; a text of fewer words is one shingle."""
    n = np.diff(words.bounds)
    m = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    bounds = np.r_[0, np.cumsum(m)]
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    at = np.arange(bounds[-1]) + np.repeat(words.bounds[:-1] - bounds[:-1], m)
    out = np.zeros(len(at), np.uint64)
    short = np.repeat(n, m) < width
    count = len(words.hashes)
    weight = np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(width):
            part = words.hashes[np.minimum(at + i, count - 1)] * weight
            if short.any():
                part[short & (np.repeat(n, m) <= i)] = 0
            out += part
            weight = weight * _P
        return mix(out + np.minimum(np.repeat(n, m), width).astype(np.uint64) * _Q), bounds


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the ascending distinct shingle hashes, as signed integers."""
    hashes, bounds = shingle_table(word_table(*text_buffer(column)), width)
    hashes = hashes.view(np.int64)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
