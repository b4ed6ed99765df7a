"""Vectorised scanning of Arrow string batches: code points, character classes, words, hashes.

All functions work on whole texts. A batch is cut between rows into slices of about SLICE_BYTES of
UTF-8 (a longer text is a slice of its own), so that memory stays bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

SLICE_BYTES = 1 << 19
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
LOWER, UPPER = 1, 2
_MULT = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point, by Unicode category (L, N) and the White_Space property."""
    out = np.zeros(0x110000, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                out[low + m.start() : low + m.end()] = kind
    return out


@lru_cache(maxsize=1)
def letter_cases() -> np.ndarray:
    """LOWER (Ll), UPPER (Lu) or 0 of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for kind, pattern in ((LOWER, r"\p{Ll}+"), (UPPER, r"\p{Lu}+")):
            for m in regex.finditer(pattern, every):
                out[low + m.start() : low + m.end()] = kind
    return out


@lru_cache(maxsize=1)
def lower_map() -> np.ndarray:
    """Lower case of every code point that has one of a single code point; others map to themselves."""
    out = np.arange(0x110000, dtype=np.uint32)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for m in regex.finditer(r"[\p{Lu}\p{Lt}\p{Changes_When_Lowercased}]", every):
        low = m[0].lower()
        if len(low) == 1:
            out[ord(m[0])] = ord(low)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown when needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
            size = 1 << max(20, (n - 1).bit_length())
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _MULT)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = Powers()


def slices(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, byte offsets of the rows from 0 on); null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    buffer = col.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    if col.null_count:  # a null row may cover bytes
        valid = np.asarray(col.is_valid().to_numpy(zero_copy_only=False), bool)
        if (np.diff(offsets)[~valid] > 0).any():
            yield from slices(col.fill_null(""))
            return
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets of the rows counted in code points."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    if data.max() < 0x80:
        return data.astype(np.uint32), offsets.astype(np.int64)
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return cps, before[offsets]


def hash_points(points: list[int]) -> int:
    """The word hash of a list of code points, as words() computes it."""
    out, power = 0, 1
    for c in points:
        out = (out + (((c + 1) * int(_M2)) & (2**64 - 1)) * power) & (2**64 - 1)
        power = (power * int(_MULT)) & (2**64 - 1)
    return int(mix(np.array([out], np.uint64))[0])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of letters and digits, lower-cased) of a slice.

    Returns the words' 64-bit hashes, the row of each, start and end in code points, and the code points.
    Lower-casing is that of a word alone: the capital sigma at its end and the dotted capital I,
    whose lower case is not one code point by itself, are treated word by word.
    """
    cps, rows = code_points(data, offsets)
    n = len(cps)
    inside = np.zeros(n + 2, bool)
    kinds = char_classes()[cps]
    inside[1:-1] = (kinds == LETTER) | (kinds == NUMBER)
    joined = inside[1:] & inside[:-1]  # position i: char i continues char i-1
    joined[rows[(rows < n)]] = False
    start = np.flatnonzero(inside[1:-1] & ~joined[:-1])
    end = np.flatnonzero(inside[1:-1] & ~joined[1:]) + 1
    up, down = _powers.get(n + 1)
    low = lower_map()[cps]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _M2 * up[:n], out=total[1:], dtype=np.uint64)
    hashes = mix((total[end] - total[start]) * down[start])
    odd = np.flatnonzero((cps == 0x130) | (cps == 0x3A3))
    if len(odd):
        for w in np.unique(np.searchsorted(start, odd, side="right") - 1):
            if w >= 0 and start[w] <= odd.max():
                text = cps[start[w] : end[w]].tobytes().decode("utf-32-le").lower()
                hashes[w] = hash_points([ord(c) for c in text])
    return hashes, np.searchsorted(rows, start, side="right") - 1, start, end, cps


@lru_cache(maxsize=8)
def _window_factors(size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=np.uint64) * _MULT) | np.uint64(1)


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a row, and the index of each run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j, f in enumerate(_window_factors(size)):
        total += hashes[j : j + n] * f
    first = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return mix(total[first]), first
