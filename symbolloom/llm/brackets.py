"""Pairing of brackets with the fewest edits, however many there are.

A bracket without a partner is one edit, and so is a pair of which one has to be replaced. Intervals are solved
from their ends on, as in folding: the first bracket of an interval stays alone or takes a partner, which
splits the rest. Two things keep that from looking at all partners of all intervals, and lose no solution:
partners that a split at their place already equals are not tried again, and intervals that can't be part of a
pairing as good as a known one are left out, by what the heights alone cost within and around them.
"""

from __future__ import annotations

import numpy as np


def _pairs_of(odd: np.ndarray | int) -> np.ndarray | int:
    return (odd + 1) >> 1


def _by_height(opens: list[bool], kind: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """(edits, pairs) where kinds don't matter; opening brackets that stay alone make pairs, and closing ones."""
    stack, lone, pairs, edits = [], [], [], 0
    for i, is_open in enumerate(opens):
        if is_open:
            stack.append(i)
        elif stack:
            pairs.append((stack.pop(), i))
            edits += kind[pairs[-1][0]] != kind[i]
        else:
            lone.append(i)
    for rest in (lone, stack):
        pairs += zip(rest[::2], rest[1::2], strict=False)
        edits += _pairs_of(len(rest))
    return edits, pairs


def _greedily(opens: list[bool], kind: list[int]) -> int:
    """Edits where each closing bracket takes the last opening one of its kind."""
    stack, held, edits = [], dict.fromkeys(kind, 0), 0
    for is_open, c in zip(opens, kind, strict=True):
        if is_open:
            stack.append(c)
            held[c] += 1
        elif held[c]:
            while (top := stack.pop()) != c:
                held[top] -= 1
                edits += 1
            held[c] -= 1
        else:
            edits += 1
    return edits + len(stack)


def _in_order(opens: list[bool], kind: list[int]) -> int:
    """The most pairs of equal kinds, each kind by itself."""
    held, pairs = dict.fromkeys(kind, 0), 0
    for is_open, c in zip(opens, kind, strict=True):
        if is_open:
            held[c] += 1
        elif held[c]:
            held[c] -= 1
            pairs += 1
    return pairs


#: Costs of so many intervals with one beginning are kept as steps of -1, 0 or 1 from each to the next, four a byte, but
#: for the RECENT beginnings, which are asked for most.
PACKED, RECENT = 8192, 256
_STEPS = np.array([[(byte >> 2 * i & 3) - 1 for i in range(4)] for byte in range(256)], np.int8)


class _Packed:
    """Costs that begin with 0."""

    def __init__(self, row: np.ndarray) -> None:
        self.size, self.type = len(row), row.dtype
        digits = np.zeros((len(row) + 2) // 4 * 4, np.uint8)
        digits[: len(row) - 1] = np.diff(row) + 1
        self.bytes = digits[::4] | digits[1::4] << 2 | digits[2::4] << 4 | digits[3::4] << 6

    def row(self) -> np.ndarray:
        out = np.zeros(self.size, self.type)
        np.cumsum(_STEPS[self.bytes].ravel()[: self.size - 1], dtype=self.type, out=out[1:])
        return out

    def __getitem__(self, i: int) -> int:
        return int(_STEPS[self.bytes[: (i + 3) // 4]].ravel()[:i].sum(dtype=np.int64))


def _packed(row: np.ndarray) -> np.ndarray | _Packed:
    return _Packed(row) if len(row) >= PACKED and row[0] == 0 and np.abs(np.diff(row)).max(initial=0) <= 1 else row


#: From so many brackets on, a pairing by heights that reaches a lower bound is taken as it is; it is one of those with
#: the fewest edits, but not always the one that the intervals give.
MANY = 256


def pair(opens: np.ndarray, kind: np.ndarray) -> list[tuple[int, int]]:
    """(bracket, its partner or -1) for each that is alone or comes first; ``kind`` is equal for both of a pair.

    Of several pairings with the fewest edits, the one whose first brackets have partners, the nearest ones.
    Takes memory in proportion to n**2 where kinds are mixed at random, and little where few edits are needed.
    """
    n = len(opens)
    flat = opens.tolist(), kind.tolist()
    most, pairs = _by_height(*flat)
    height = np.concatenate([np.zeros(1, np.int32), np.cumsum(np.where(opens, 1, -1), dtype=np.int32)])
    total = int(height[-1])
    before, after = np.minimum.accumulate(height), np.minimum.accumulate(height[::-1])[::-1]
    if n > MANY and most == max(_pairs_of(-int(before[-1])) + _pairs_of(total - int(before[-1])), _pairs_of(n - 2 * _in_order(*flat))):
        partner = dict(pairs)
        seconds = set(partner.values())
        return [(i, partner.get(i, -1)) for i in range(n) if i not in seconds]
    most = min(most, _greedily(*flat))

    none = most + 1  # for all that costs more
    small = np.int16 if 2 * none + 2 < 1 << 15 else np.int32
    every, by_height = np.arange(n + 1), np.argsort(height, kind="stable")
    sorted_heights = height[by_height]
    ends: list = [None] * n + [slice(n, None)]  # of the intervals that begin at each place
    cost: list = [None] * n + [np.zeros(1, small)]
    tried: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # partners, and the edits up to them
    low, alone, paired = height.copy(), np.full(n + 1, none, small), np.full(n + 1, none, small)
    for a in range(n - 1, -1, -1):
        np.minimum(low[a:], height[a], out=low[a:])  # the least height from a on
        first, last = np.searchsorted(sorted_heights, [height[a] + total // 2 - most, height[a] + total // 2 + most + 2])
        b = every[a:] if 2 * (last - first) > n - a else np.sort(by_height[first:last])
        b = b[np.searchsorted(b, a) :]
        net = height[b] - height[a]
        lowest = np.minimum(before[a], after[b] - net)
        outside = _pairs_of(-lowest) + _pairs_of(total - net - lowest)
        room = most - outside
        fits = np.flatnonzero(_pairs_of(height[a] - low[b]) + _pairs_of(height[b] - low[b]) <= room)
        b, room = b[fits], room[fits]

        inner, k = cost[a + 1], every[ends[a + 1]]
        alone[k] = np.minimum(inner + 1, none)
        if k.size and k[-1] == n:
            inner, k = inner[:-1], k[:-1]
        edits = inner + (np.where(opens[k], 1, kind[k] != kind[a]) if opens[a] else 1 + opens[k]).astype(small)
        tries = np.flatnonzero((edits <= most) & (edits <= alone[k + 1]))
        paired[a:] = none
        for x, c in zip(k[tries].tolist(), edits[tries].tolist(), strict=True):
            if c < paired[x + 1]:
                to = ends[x + 1]
                rest = cost[x + 1].row() if isinstance(cost[x + 1], _Packed) else cost[x + 1]
                paired[to] = np.minimum(paired[to], rest + small(c))
                tried[a].append((x, c))
        paired[a] = 0
        found = np.minimum(paired[b], alone[b])
        alone[every[ends[a + 1]]] = none
        fits = np.flatnonzero(found <= room)
        cost[a], ends[a] = found[fits], slice(a, None) if len(fits) == n + 1 - a else b[fits].astype(np.int32)
        if a + RECENT <= n and isinstance(ends[a + RECENT], slice):
            cost[a + RECENT] = _packed(cost[a + RECENT])

    def known(a: int, b: int) -> int:
        places = every[ends[a]]
        i = int(np.searchsorted(places, b))
        return int(cost[a][i]) if i < len(places) and places[i] == b else none

    out, waiting = [], [(0, n)]
    while waiting:
        a, b = waiting.pop()
        if a >= b:
            continue
        least, k = min(((c + known(x + 1, b), x) for x, c in tried[a] if x < b), default=(none, -1))
        if least <= min(known(a + 1, b) + 1, most):
            out.append((a, k))
            waiting += [(a + 1, k), (k + 1, b)]
        else:
            out.append((a, -1))
            waiting.append((a + 1, b))
    return out
