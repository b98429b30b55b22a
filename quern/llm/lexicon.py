"""A minimal acyclic transducer: words in, a number for each word out, ends of words shared.

States are built from sorted words so that equal ends become one state at once. Every transition carries how many words
come before the ones it leads to, so the sum along a word's path is its place among the sorted words. The transitions lie
in one table by base + byte (rows laid over each other), which is kept in a file and memory-mapped by every worker, with
the ids of word n at ids[offsets[n]:offsets[n + 1]].
"""

from __future__ import annotations

import functools

import numpy as np

_MAGIC = 0x4C58


def _states(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """States as byte to state, and which are ends of words. State 0 is the start; words must be sorted and distinct."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]
    before = b""

    def settle(down_to: int) -> None:
        while len(path) - 1 > down_to:
            state = path.pop()
            key = (final[state], *edges[state].items())
            if (same := known.setdefault(key, state)) != state:
                edges[path[-1]][before[len(path) - 1]] = same
                edges[state] = {}

    for word in words:
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        settle(shared)
        before = word
        for byte in word[shared:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][byte] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
    settle(0)
    return edges, final


def _counts(edges: list[dict[int, int]], final: list[bool]) -> dict[int, int]:
    """How many words each reachable state leads to."""
    counts: dict[int, int] = {}
    todo = [0]
    while todo:
        state = todo[-1]
        if missing := [s for s in edges[state].values() if s not in counts]:
            todo += missing
        else:
            todo.pop()
            counts[state] = final[state] + sum(counts[s] for s in edges[state].values())
    return counts


def compiled(entries: dict[bytes, list[int]]) -> bytes:
    """The file of a lexicon: word to ids. Empty words are left out; an empty lexicon knows no word."""
    words = sorted(w for w in entries if w)
    edges, final = _states(words)
    counts = _counts(edges, final)
    order = sorted(counts, key=lambda s: -len(edges[s]))
    taken = bytearray(2048)
    base: dict[int, int] = {}
    free, tries = 512, 0  # places below are left to the large bytes of the first rows
    for state in order:
        keys = sorted(edges[state])
        if len(keys) == 1 and tries >= 0:
            free, tries = 512, -1  # rows of one byte fill what the larger ones left
        at = free - 1
        while keys:
            # The next free place that the row's first byte can have, with room for the others.
            at = taken.find(b"\0", at + 1)
            if at < 0 or at + 1024 > len(taken):
                at = free - 1
                taken += bytes(len(taken))
            elif not any(taken[at - keys[0] + k] for k in keys[1:]):
                break
            elif (tries := tries + 1) % 64 == 0:
                free += 128  # a stretch with few holes is left behind
                at = max(at, free - 1)
        base[state] = at - keys[0] if keys else 0
        for k in keys:
            taken[base[state] + k] = 1
        if len(keys) == 1:
            free = at
    used = taken.rfind(b"\1") + 513
    # Of a place: the state it belongs to, the next state's number, and the words before it.
    number = {state: i for i, state in enumerate([0, *(s for s in order if s != 0)])}
    owner, target, before = np.full(used, -1, np.int32), np.zeros(used, np.int32), np.zeros(used, np.int32)
    bases, ends = np.zeros(len(number), np.int32), np.zeros(len(number), np.int32)
    for state, n in number.items():
        bases[n], ends[n] = base[state], final[state]
        seen = int(final[state])
        for byte in sorted(edges[state]):
            place, to = base[state] + byte, edges[state][byte]
            owner[place], target[place], before[place] = n, number[to], seen
            seen += counts[to]
    lengths = [len(entries[w]) for w in words]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    ids = np.array([i for w in words for i in entries[w]], np.int32)
    parts = [owner, target, before, bases, ends, offsets, ids]
    return np.concatenate([np.array([_MAGIC, *map(len, parts)], np.int32), *parts]).tobytes()


class Lexicon:
    """A compiled lexicon; from a path it is memory-mapped, so the workers of a machine share its pages."""

    def __init__(self, source: str | bytes):
        raw = np.frombuffer(source, np.int32) if isinstance(source, bytes) else np.memmap(source, np.int32, "r")
        if raw[0] != _MAGIC:
            raise ValueError("not a lexicon")
        parts, at = [], 8
        for n in raw[1:8]:
            parts.append(np.asarray(raw[at : at + n]))
            at += int(n)
        self.owner, self.target, self.before, self.bases, self.ends, self.offsets, self.ids = parts

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word data[starts:ends], -1 for those unknown. All words go through the states together,
        a byte at a time."""
        out = np.full(len(starts), -1, np.int32)
        live = np.flatnonzero(ends > starts)
        at, left = starts[live].astype(np.int64), (ends - starts)[live].astype(np.int32)
        state, total = np.zeros(len(live), np.int32), np.zeros(len(live), np.int32)
        while len(live):
            place = self.bases[state] + data[at]
            keep = self.owner[place] == state
            place, live, at, left = place[keep], live[keep], at[keep] + 1, left[keep] - 1
            total, state = total[keep] + self.before[place], self.target[place]
            done = left == 0
            if done.any():
                ok = done & (self.ends[state] == 1)
                out[live[ok]] = total[ok]
                go = ~done
                live, at, left, total, state = live[go], at[go], left[go], total[go], state[go]
        return out


@functools.lru_cache(2)
def opened(path: str) -> Lexicon:
    return Lexicon(path)
