"""Vectorised byte and word hashing shared by the text operators (numpy only).

All hashes are 64-bit, seedless and equal on every executor.  Nothing here holds
more than one block of a text at a time: long texts are cut into blocks of
``BLOCK`` bytes, words at white space and windows with an overlap, so memory is
bounded by the block and not by the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_MIX1 = _U(0xBF58476D1CE4E5B9)
_MIX2 = _U(0x94D049BB133111EB)
_RADIX = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_RADIX_INV = pow(_RADIX, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        have = _POW[base] = _powers(base, max(n, 1 << 12))
    return have[:n]


#: Bytes that end a word: space and the controls 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, all other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Mixed value of each byte, so that polynomial hashes start from random digits.
DIGIT = mix64(np.arange(1, 257, dtype=np.uint64) * _MUL)


def word_hashes(raw: bytes, lower: bool = True) -> np.ndarray:
    """Hash of each white-space separated word of ``raw``, in order."""
    parts = [_block_words(piece, lower) for piece in _cut_at_space(raw)]
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _cut_at_space(raw: bytes) -> Iterator[np.ndarray]:
    data = np.frombuffer(raw, dtype=np.uint8)
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):  # grow to the next white space
            stop = np.flatnonzero(SPACE[data[end : end + BLOCK]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(len(data), end + BLOCK)
        yield data[at:end]
        at = end


def _block_words(data: np.ndarray, lower: bool) -> np.ndarray:
    starts, ends = word_bounds(data)
    return span_hashes(LOWER[data] if lower else data, starts, ends)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[starts[i]:ends[i]] for disjoint, ascending, non-empty spans."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.zeros(len(starts), dtype=np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    total = int(lengths.sum())
    place = np.arange(total, dtype=np.int64)
    rel = place - np.repeat(first, lengths)
    table = powers(_RADIX, 1 << 12)
    value = DIGIT[data[rel + np.repeat(starts, lengths)]] * table[rel & 4095]
    return mix64(np.add.reduceat(value, first) + lengths.astype(np.uint64) * _MUL)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of every run of ``size`` words; fewer words give one for them all."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    table = powers(_RADIX, size)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        out += words[j : n - width + 1 + j] * table[j]
    return mix64(out + _U(width * int(_MUL) & 0xFFFFFFFFFFFFFFFF))


class WindowHasher:
    """Hashes of substrings of one block by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = powers(_RADIX_INV, n + 1)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(DIGIT[data] * powers(_RADIX, n), out=self.prefix[1:])

    def all_of(self, size: int) -> np.ndarray:
        """mix64 of the hash of data[i:i+size] for every i."""
        n = len(self.prefix) - size
        return mix64((self.prefix[size:] - self.prefix[:n]) * self.inverse[:n])

    def at(self, starts: np.ndarray, sizes) -> np.ndarray:
        return mix64((self.prefix[starts + sizes] - self.prefix[starts]) * self.inverse[starts])


def leftmost_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost place of the least of values[i:i+width].

    Two running minima over blocks of ``width`` give each window's minimum from
    the tail of one block and the head of the next.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    place = np.arange(rows * width, dtype=np.int32).reshape(rows, width)
    grid = padded.reshape(rows, width)
    head = np.minimum.accumulate(grid, axis=1)
    fresh = np.ones_like(grid, dtype=bool)
    fresh[:, 1:] = grid[:, 1:] < head[:, :-1]
    head_at = np.maximum.accumulate(np.where(fresh, place, -1), axis=1).ravel()
    back = grid[:, ::-1]
    tail = np.minimum.accumulate(back, axis=1)
    record = back == tail  # ties go to the left
    tail_at = np.minimum.accumulate(np.where(record, place[:, ::-1], np.iinfo(np.int32).max), axis=1)[:, ::-1].ravel()
    tail = tail[:, ::-1].ravel()
    head = head.ravel()
    start = np.arange(n)
    end = start + width - 1
    return np.where(tail[start] <= head[end], tail_at[start], head_at[end]).astype(np.int64)
