"""Graph algorithms for one task: used where a graph is known to be small, and as the tests' yardstick."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Hashable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Edge = tuple[Hashable, Hashable]


def strong_components(edges: Iterable[Edge]) -> dict:
    """Node -> smallest node of its strongly connected component."""
    out: dict = defaultdict(list)
    nodes: dict = {}
    for a, b in edges:
        out[a].append(b)
        nodes[a] = nodes[b] = None
    number: dict = {}
    low: dict = {}
    stack, on_stack, label = [], set(), {}
    for start in nodes:
        if start in number:
            continue
        work = [(start, iter(out[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        on_stack.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in number:
                    number[nxt] = low[nxt] = len(number)
                    stack.append(nxt)
                    on_stack.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on_stack:
                    low[node] = min(low[node], number[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while True:
                        members.append(stack.pop())
                        on_stack.discard(members[-1])
                        if members[-1] == node:
                            break
                    first = min(members)
                    label.update(dict.fromkeys(members, first))
    return label


def coded(source: pa.ChunkedArray, target: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids in order, and both ends as places among them."""
    both = pa.chunked_array([*source.chunks, *target.chunks], source.type).dictionary_encode("encode").combine_chunks()
    both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
    order = pc.sort_indices(both.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    codes = place[both.indices.to_numpy()]
    return both.dictionary.take(pa.array(order)), codes[: len(source)], codes[len(source) :]


def _rows(n: int, key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in the order of their keys, and where each key's begin."""
    return value[np.argsort(key)], np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n))])


def peeled(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The round in which each of n nodes has lost all its targets: 0 without any, else 1 + the
    largest of its targets'; -1 for nodes on a cycle or on a way to one. A round touches only the
    edges that lead to the nodes of the one before, so all rounds touch an edge once."""
    missing = np.bincount(source, minlength=n)
    users, start = _rows(n, target, source)
    level = np.full(n, -1, np.int64)
    ready, at = np.flatnonzero(missing == 0), 0
    while len(ready):
        level[ready] = at
        many = start[ready + 1] - start[ready]
        total = int(many.sum())
        touched = users[np.repeat(start[ready] - (np.cumsum(many) - many), many) + np.arange(total)]
        np.subtract.at(missing, touched, 1)
        ready, at = np.unique(touched[missing[touched] == 0]), at + 1
    return level


def component_codes(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The smallest node of each node's strongly connected component. Nodes without a way to or
    from a cycle are peeled off; the rest is walked once."""
    label = np.arange(n)
    other = source != target
    source, target = source[other], target[other]
    for a, b in ((0, 1), (1, 0)):
        ends = source, target
        left = peeled(n, ends[a], ends[b]) < 0
        inner = left[source] & left[target]
        source, target = source[inner], target[inner]
    if not len(source):
        return label
    ids = np.unique(np.concatenate([source, target]))
    s, t = np.searchsorted(ids, source), np.searchsorted(ids, target)
    label[ids] = ids[_walked(len(ids), s, t)]
    return label


def _walked(n: int, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Tarjan's walk over nodes 0 to n - 1."""
    out, start = (x.tolist() for x in _rows(n, source, target))
    nxt, number, low, label = start[:n], [0] * n, [0] * n, [-1] * n  # number 0: not met; label -1: not done
    stack: list[int] = []
    met = 0
    for root in range(n):
        if number[root]:
            continue
        met += 1
        number[root] = low[root] = met
        stack.append(root)
        path = [root]
        while path:
            node = path[-1]
            at, end = nxt[node], start[node + 1]
            while at < end:
                b = out[at]
                at += 1
                if not number[b]:
                    met += 1
                    number[b] = low[b] = met
                    stack.append(b)
                    path.append(b)
                    break
                if label[b] < 0 and number[b] < low[node]:
                    low[node] = number[b]
            nxt[node] = at
            if path[-1] != node:
                continue
            path.pop()
            if path and low[node] < low[path[-1]]:
                low[path[-1]] = low[node]
            if low[node] == number[node]:
                members = [stack.pop()]
                while members[-1] != node:
                    members.append(stack.pop())
                first = min(members)
                for m in members:
                    label[m] = first
    return np.array(label)


def layer_codes(n: int, source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component and level of each node: 0 for what leads nowhere else, else one more than the
    highest level it leads to; a component's nodes share a level."""
    label = component_codes(n, source, target)
    s, t = label[source], label[target]
    between = s != t
    return label, peeled(n, s[between], t[between])[label]


def longest_depth(edges: Iterable[Edge]) -> dict:
    """Node -> 0 without outgoing edges, else 1 + the largest of its targets; for acyclic graphs."""
    out, users, missing = defaultdict(set), defaultdict(set), {}
    for a, b in edges:
        if a != b:
            out[a].add(b)
            users[b].add(a)
    for n in {*out, *users}:
        missing[n] = len(out[n])
    depth = {n: 0 for n, k in missing.items() if not k}
    ready = list(depth)
    while ready:
        node = ready.pop()
        for user in users[node]:
            depth[user] = max(depth.get(user, 0), depth[node] + 1)
            missing[user] -= 1
            if not missing[user]:
                ready.append(user)
    return depth


def elementary_circuits(edges: Iterable[Edge], most: int, counted: bool = False) -> tuple[list[list], int]:
    """Elementary circuits, each from its smallest node on, at most `most` of them, and how many
    were met: all there are if `counted`. From each start only its component among the nodes that
    aren't smaller is walked; a start's removal leaves other components as they are. As Johnson has
    it, a node from which no circuit was closed stays shut until a node that it leads to is left
    after one: between two circuits the walk takes an edge a bounded number of times."""
    own: dict = defaultdict(list)
    pairs = sorted(set(edges))
    label = strong_components(pairs)
    for a, b in pairs:
        if label[a] == label[b]:
            own[label[a]].append((a, b))
    waiting = list(own.items())  # (smallest node, its component's edges)
    heapq.heapify(waiting)
    found: list[list] = []
    total = 0
    while waiting:
        start, inner = heapq.heappop(waiting)
        out: dict = defaultdict(list)
        for a, b in inner:
            out[a].append(b)
        opens: dict = defaultdict(set)  # node -> what it opens when it is opened
        path, shut, walk, closed = [start], {start}, [iter(out[start])], [False]
        while walk:
            nxt = next(walk[-1], None)
            if nxt is None:
                node = path.pop()
                walk.pop()
                if closed.pop():
                    if closed:
                        closed[-1] = True
                    opened = [node]
                    while opened:
                        n = opened.pop()
                        if n in shut:
                            shut.discard(n)
                            opened += opens.pop(n, ())
                else:
                    for n in out[node]:
                        opens[n].add(node)
            elif nxt == start:
                total += 1
                closed[-1] = True
                if len(found) < most:
                    found.append(list(path))
                elif not counted:
                    return found, total
            elif nxt not in shut:
                path.append(nxt)
                shut.add(nxt)
                walk.append(iter(out[nxt]))
                closed.append(False)
        rest = [(a, b) for a, b in inner if a != start and b != start]
        label = strong_components(rest)
        parts: dict = defaultdict(list)
        for a, b in rest:
            if label[a] == label[b]:
                parts[label[a]].append((a, b))
        for part in parts.items():
            heapq.heappush(waiting, part)
    return found, total
