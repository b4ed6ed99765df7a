"""A minimal acyclic transducer from words (UTF-8) to token id lists, in flat arrays.

The words are compiled in sorted order into a minimal automaton (equal suffixes share states). Each
arc carries the number of words that sort before those behind it, so the sum along a word is its rank;
the rank selects its id list. The arcs lie in a double array: arc of state ``s`` for byte ``b`` is slot
``base[s] + b``, which belongs to ``s`` if ``owner`` says so. One file holds all arrays and is
memory-mapped, so the workers of a machine share its pages.
"""

from __future__ import annotations

import numpy as np

_NAMES = ("base", "final", "owner", "target", "skip", "id_start", "ids")


def compile_words(pairs: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the minimal transducer of ``pairs`` (non-empty words only)."""
    words = sorted(w for w in pairs if w)
    arcs: list[dict[int, int]] = [{}]  # of the states that may still change, by depth on the last word's path
    finals = [False]
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    counts: list[int] = []

    def freeze(depth: int, last: bytes) -> None:
        """Replaces the states deeper than ``depth`` on the last word's path by registered ones."""
        for d in range(len(last), depth, -1):
            key = (finals[d], tuple(arcs[d].items()))
            state = register.get(key)
            if state is None:
                state = register[key] = len(states)
                states.append(key)
                counts.append(int(finals[d]) + sum(counts[t] for t in arcs[d].values()))
            arcs[d - 1][last[d - 1]] = state
        del arcs[depth + 1 :], finals[depth + 1 :]

    last = b""
    for word in words:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        freeze(shared, last)
        for _ in word[shared:]:
            arcs.append({})
            finals.append(False)
        finals[len(word)] = True
        last = word
    freeze(0, last)
    root = len(states)
    states.append((False, tuple(arcs[0].items())))

    n_arcs = sum(len(a) for _, a in states)
    owner = np.full(1024 + 512 * (1 + n_arcs // 256), -1, np.int32)
    target, skip = np.zeros_like(owner), np.zeros_like(owner)
    base, free_from = np.zeros(len(states), np.int32), 256
    for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
        out = states[s][1]
        if not out:
            continue
        codes = np.array([b for b, _ in out])
        while free_from < len(owner) and owner[free_from] >= 0:
            free_from += 1
        at, low = -1, free_from
        while at < 0:
            while low + 5120 >= len(owner):
                owner = np.concatenate([owner, np.full(len(owner), -1, np.int32)])
                target, skip = (np.concatenate([x, np.zeros(len(x), np.int32)]) for x in (target, skip))
            spots = low + np.flatnonzero(owner[low : low + (16 if len(codes) == 1 else 4096)] < 0) - codes[0]
            fit = spots if len(codes) == 1 else spots[(owner[spots[:, None] + codes] < 0).all(axis=1)]
            if len(fit):
                at = int(fit[0])
            else:
                low += 16 if len(codes) == 1 else 4096
        base[s] = at
        before = int(states[s][0])
        for b, t in out:
            owner[at + b], target[at + b], skip[at + b] = s, t, before
            before += counts[t]
    used = int(np.flatnonzero(owner >= 0).max(initial=0)) + 257
    owner, target, skip = (np.concatenate([x, np.full(512, -1, np.int32)])[:used] for x in (owner, target, skip))
    lengths = np.array([0] + [len(pairs[w]) for w in words], np.int32)
    # the root gets number 0, so that a traversal can start from zeros
    swap = np.arange(len(states), dtype=np.int32)
    swap[[0, root]] = swap[[root, 0]]
    final = np.array([f for f, _ in states], np.uint8)
    return {
        "base": base[swap], "final": final[swap], "owner": np.where(owner >= 0, swap[owner], -1).astype(np.int32), "target": swap[target], "skip": skip,
        "id_start": np.cumsum(lengths, dtype=np.int32), "ids": np.array([i for w in words for i in pairs[w]], np.int32),
    }


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """One block: a header of lengths, then the arrays, each as 32-bit integers."""
    head = np.array([len(arrays[n]) for n in _NAMES], np.int32)
    return head.tobytes() + b"".join(np.ascontiguousarray(arrays[n].astype(np.int32)).tobytes() for n in _NAMES)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file written from to_bytes(), memory-mapped."""
    flat = np.memmap(path, np.int32, "r")
    out, at = {}, len(_NAMES)
    for name, n in zip(_NAMES, flat[:at].tolist(), strict=True):
        out[name] = flat[at : at + n]
        at += n
    return out


def look_up(arrays: dict[str, np.ndarray], data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rank of each word data[start:end], or -1 for words that the transducer doesn't hold.

    All words advance together, one byte a step; those that fall off drop out.
    """
    base, final, owner, target, skip = (arrays[n] for n in _NAMES[:5])
    rank = np.full(len(start), -1, np.int32)
    live = np.arange(len(start))
    at, stop = start.astype(np.int64), end
    state, total = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
    while len(live):
        done = at == stop
        if done.any():
            ended = np.flatnonzero(done)
            ended = ended[final[state[ended]] > 0]
            rank[live[ended]] = total[ended]
            keep = np.flatnonzero(~done)
            live, at, stop, state, total = live[keep], at[keep], stop[keep], state[keep], total[keep]
        slot = base[state] + data[at]
        hit = np.flatnonzero(owner[slot] == state)
        slot = slot[hit]
        live, at, stop = live[hit], at[hit] + 1, stop[hit]
        state, total = target[slot], total[hit] + skip[slot]
    return rank
