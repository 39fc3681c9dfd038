"""Suffix arrays by linear grouping, for many short strings side by side.

Phase 1 starts with groups of suffixes by first symbol and processes the groups in descending order.
For every suffix of the group, the previous-smaller pointer leads to the nearest earlier suffix of a
lower group; a suffix that k members point to belongs right above its old group, above those with fewer.
In the end the groups are the suffixes with equal Lyndon prefixes, in order.  Phase 2 walks the array
from its smallest suffix and places, for each suffix, the chain of previous-smaller pointers from its
left neighbour into the next free places of their groups.  No names are computed recursively.

The strings are independent *lanes*: every numpy step processes the current group of each lane.
"""

from __future__ import annotations

import numpy as np

from .common import ranges


def _grouped(symbols: np.ndarray, lane: np.ndarray, base: np.ndarray, ends: np.ndarray):
    """Phase 1: the final group start of every position, and its previous-smaller pointer (-1: none)."""
    n = len(symbols)
    perm = np.lexsort((symbols, lane)).astype(np.int32)
    inv = np.empty(n, np.int32)
    inv[perm] = np.arange(n, dtype=np.int32)
    new = np.ones(n, bool)
    new[1:] = (symbols[perm[1:]] != symbols[perm[:-1]]) | (lane[perm[1:]] != lane[perm[:-1]])
    starts = np.flatnonzero(new)
    group = np.empty(n, np.int32)
    size = np.zeros(n, np.int32)
    size[starts] = np.diff(np.append(starts, n))
    group[perm] = np.repeat(starts, size[starts])
    prev = np.arange(-1, n - 1, dtype=np.int32)
    prev[base] = -1
    done, pointed = np.zeros(n, bool), np.zeros(n, bool)
    high, low = ends.copy(), base
    while len(high):
        first = group[perm[high - 1]]
        members = perm[ranges(first, high - first)]
        done[members] = True
        # chase pointers through processed suffixes; members that point at each other jump together
        active = members
        while True:
            at = prev[active]
            on = at >= 0
            on[on] = done[at[on]]
            if not on.any():
                break
            active = active[on]
            prev[active] = prev[at[on]]
        targets = prev[members]
        targets = targets[targets >= 0]
        if len(targets):
            targets, count = np.unique(targets, return_counts=True)
            own = group[targets]
            order = np.lexsort((count, own))
            targets, count, own = targets[order], count[order], own[order]
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            k = np.diff(np.append(head, len(own)))
            before = size[own[head]]
            slots = ranges(own[head] + before - k, k)  # the last places of each group
            pointed[targets] = True
            occupants = perm[slots]
            moved = occupants[~pointed[occupants]]
            if len(moved):
                left = inv[targets]
                # places that targets leave and that others take, in the same order of groups
                vacated = left[left < np.repeat(own[head] + before - k, k)]
                perm[vacated] = moved
                inv[moved] = vacated
            pointed[targets] = False
            perm[slots] = targets
            inv[targets] = slots
            run = np.append(True, (own[1:] != own[:-1]) | (count[1:] != count[:-1]))
            heads = np.flatnonzero(run)
            size[own[head]] = before - k
            size[slots[heads]] = np.diff(np.append(heads, len(own)))
            group[targets] = np.repeat(slots[heads], np.diff(np.append(heads, len(own))))
        more = first > low
        high, low = first[more], low[more]
    return group, prev


def _emitted(group: np.ndarray, prev: np.ndarray, base: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Phase 2: positions in suffix order, each lane in its own range."""
    n = len(group)
    out = np.zeros(n, np.int32)
    free = np.arange(n, dtype=np.int32)
    placed = np.zeros(n, bool)
    out[base] = ends - 1
    free[base] += 1
    placed[ends - 1] = True
    at, low, high = base.copy(), base, ends
    now = ends - 2
    now[now < low] = -1
    while len(at):
        # lanes whose chain has ended go on to the next suffix of the array
        rest = np.flatnonzero((now < 0) | placed[now])
        if len(rest):
            own = at[rest] + 1
            at[rest] = own
            inside = own < high[rest]
            first = out[own[inside]] - 1
            own = rest[inside]
            first[first < low[own]] = -1
            now[own] = first
            if len(own) < len(rest):
                keep = at < high
                at, low, high, now = at[keep], low[keep], high[keep], now[keep]
        go = np.flatnonzero((now >= 0) & ~placed[now])
        s = now[go]
        g = group[s]
        place = free[g]
        out[place] = s
        free[g] = place + 1
        placed[s] = True
        now[go] = prev[s]
    return out


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix order of every lane.

    ``symbols`` holds the lanes one after the other; each ends with a symbol smaller than all others in
    its lane.  Returns positions in ``symbols``, each lane's in its own range.
    """
    if not len(symbols):
        return np.zeros(0, np.int32)
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths).astype(np.int32)
    base = (ends - lengths).astype(np.int32)
    lane = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    group, prev = _grouped(np.asarray(symbols), lane, base, ends)
    return _emitted(group, prev, base, ends)
