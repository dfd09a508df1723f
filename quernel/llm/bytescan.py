"""Vectorised word scanning over the raw UTF-8 bytes of an Arrow string column.

Words are runs of bytes of a class; every class used here either keeps or
drops all bytes from 0x80 on, so that whole code points stay together.  A word's
64-bit hash is a polynomial over per-byte random numbers, taken from one running
sum, then mixed; it doesn't depend on where the word stands.  Work is done in
pieces of a few megabytes that are cut between words, so memory follows the
number of words and not the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

#: Bytes that belong to words: everything but white space; letters, digits and all beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, _U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * PIECE:
            _powers[kind] = have
    return have[:n]


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if array.null_count:
        array = array.fill_null("")
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = PIECE):
    """Row ranges whose bytes come to about ``most``; a longer text stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, offs: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; words end with their text."""
    inside = members[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offs[:-1][offs[:-1] < len(data)]
    first[starts] = inside[starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offs[1:][offs[1:] > 0] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """The hash of each word."""
    out, table, i = np.empty(len(starts), _U), _BYTE[fold], 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        piece = data[a : int(ends[j - 1])]
        total = np.zeros(len(piece) + 1, _U)
        np.cumsum(table[piece] * _power("up", _BASE, len(piece)), out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * _power("down", _INVERSE, len(piece) + 1)[s] + (e - s).astype(_U))
        i = j
    return out


def scan(data: np.ndarray, offs: np.ndarray, members: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts and ends, and the index of each text's first word (and one past the last)."""
    s, e = spans(data, offs, members)
    return hashes(data, s, e, fold), s, e, np.searchsorted(s, offs)


def runs(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and the index of each run's first word."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.full(m, k, _U)
    for j in range(k):
        h = h * _U(0xD6E8FEB86659FD93) + words[j : j + m]
    whole = np.ones(m, bool)
    for cut in first[1:-1]:
        whole[max(0, cut - k + 1) : cut] = False
    at = np.flatnonzero(whole)
    return mix(h[at]), at


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and each run's text; a shorter text that has words is one run."""
    h, at = runs(words, first, k)
    n = np.diff(first)
    who = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        for size in range(1, k):
            own = short[n[short] == size]
            x = np.full(len(own), size, _U)
            for j in range(size):
                x = x * _U(0xD6E8FEB86659FD93) + words[first[own] + j]
            h, who = np.concatenate([h, mix(x)]), np.concatenate([who, own])
        order = np.argsort(who, kind="stable")
        h, who = h[order], who[order]
    return h, who
