"""Suffix arrays of many short strings by two-stage sorting.

Only suffixes smaller than their successors are sorted directly; scanning the buckets from the
smallest first character up induces the place of every other suffix from its successor. Then the
common prefixes of neighbours are computed. Order and prefixes are exact to `depth` characters.
"""

from __future__ import annotations

import numpy as np

from codelode.llm.flat import Rolling

PACKED = 7  # characters of nine bits in one key


class Strings:
    """Strings of bytes, each followed by an end mark that is smaller than every byte."""

    def __init__(self, parts: list[bytes]):
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.ends = np.cumsum(lengths)  # one past the end mark
        self.starts = self.ends - lengths
        self.symbols = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
        self.symbols[self.ends - 1] = 0
        n = len(self.symbols)
        padded = np.r_[self.symbols, np.zeros(PACKED + 1, np.int64)]
        self.keys = np.zeros(n, np.int64)
        for j in range(PACKED):
            self.keys |= padded[j : j + n] << (9 * (PACKED - 1 - j))
        # whether an end mark is among a key's characters
        mark = np.r_[0, np.cumsum(self.symbols == 0)]
        self.ended = mark[np.minimum(np.arange(n) + PACKED, n)] > mark[:n]
        self.rolling = Rolling(self.symbols)
        # smaller than its successor: decided by the next character that differs
        step = np.sign(padded[1 : n + 1] - self.symbols)
        step[self.ends - 1] = 1
        known = np.where(step != 0, np.arange(n), n)
        self.rising = step[np.minimum.accumulate(known[::-1])[::-1].clip(max=n - 1)] > 0


def _direct(s: Strings, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their suffixes. Suffixes that agree up to `depth` keep any order."""
    order = np.argsort(s.keys[at], kind="stable")
    at = at[order]
    k = s.keys[at]
    total = len(s.symbols)
    window = s.rolling.of(at, np.minimum(at + depth, total))
    slot = np.arange(len(at))
    head = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    open_ = ~s.ended[at]
    group = np.cumsum(head) - 1
    done = 0
    todo = slot
    while len(todo):
        size = np.bincount(group)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        same = np.minimum.reduceat(window, first) == np.maximum.reduceat(window, first)
        live = open_ & ((size > 1) & ~same)[group]
        todo, group, window = todo[live], group[live], window[live]
        done += PACKED
        if done >= depth or not len(todo):
            break
        own = at[todo]
        k = s.keys[own + done]
        order = np.lexsort((k, group))
        at[todo] = own = own[order]
        k, window, g = k[order], window[order], group[order]
        open_ = ~s.ended[own + done]
        group = np.cumsum(np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])]) - 1
    return at


def suffix_array(s: Strings, need: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that start at the first need[i] places of string i, sorted; and those after
    them up to the next one that is smaller than its successor, which the scans start from."""
    n = len(s.symbols)
    rise = np.where(s.rising, np.arange(n), n)
    following = np.minimum.accumulate(rise[::-1])[::-1]
    last = following[s.starts + need - 1]  # end marks count as smaller than what follows
    taken = np.zeros(n + 1, np.int64)
    np.add.at(taken, s.starts, 1)
    np.add.at(taken, last + 1, -1)
    taken = np.cumsum(taken)[:n] > 0
    seeds = _direct(s, np.flatnonzero(taken & s.rising), depth)
    bounds = np.searchsorted(s.symbols[seeds], np.arange(258))
    queues: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    inner = np.ones(n, bool)
    inner[s.starts] = False
    for c in range(257):
        waves = queues[c]
        wave = np.concatenate(waves) if waves else seeds[:0]
        falling = [wave]
        while len(wave):  # predecessors in the same bucket follow in the order of the scan
            before = wave[inner[wave]] - 1
            wave = before[s.symbols[before] == c]
            falling.append(wave)
        scan = np.concatenate([*falling, seeds[bounds[c] : bounds[c + 1]]])
        out.append(scan)
        before = scan[inner[scan]] - 1
        first = s.symbols[before]
        up = first > c
        before, first = before[up], first[up]
        order = np.argsort(first.astype(np.uint16), kind="stable")
        before, first = before[order], first[order]
        kinds, begin = np.unique(first, return_index=True)
        for x, part in zip(kinds.tolist(), np.split(before, begin[1:])):
            queues[x].append(part)
        queues[c] = []
    return np.concatenate(out)


def common_prefixes(s: Strings, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in the suffix array the length, up to depth, that it shares with the one
    before it; end marks match nothing. Neighbours whose first `depth` characters differ in their
    hash can't share as much, and get 0."""
    out = np.zeros(len(order), np.int64)
    window = s.rolling.of(order, np.minimum(order + depth, len(s.symbols)))
    todo = np.flatnonzero(window[1:] == window[:-1]) + 1
    a, b = order[todo - 1], order[todo]
    done = 0
    while len(todo) and done < depth:
        x, y = s.keys[a + done], s.keys[b + done]
        alike = (x == y) & ~s.ended[a + done]
        rest = ~alike
        if rest.any():
            d, e = a[rest] + done, b[rest] + done
            extra, going = np.zeros(len(d), np.int64), np.ones(len(d), bool)
            for j in range(PACKED):
                i = np.minimum(d + j, len(s.symbols) - 1)
                k = np.minimum(e + j, len(s.symbols) - 1)
                going &= (s.symbols[i] == s.symbols[k]) & (s.symbols[i] > 0)
                extra += going
            out[todo[rest]] = done + extra
        todo, a, b = todo[alike], a[alike], b[alike]
        done += PACKED
    out[todo] = depth
    return np.minimum(out, depth)
