"""Suffix arrays by linear grouping, for many short strings at once.

First phase: suffixes are grouped by a prefix, at first by one symbol. Groups are taken in descending
order. For each suffix of the taken group the previous-smaller pointer is found (the nearest suffix to its
left in a smaller group); the suffixes pointed to by l members move into a new group right above
their own, those with larger l higher. In the end each group holds the suffixes that share their
longest Lyndon prefix. Second phase: suffixes are emitted in ascending order; each one emitted
brings the suffixes whose Lyndon prefix ends where it begins, found by following the pointers, to
the front of their groups. Nothing is renamed or sorted again.

The strings are independent, so each step takes one group of every string, as numpy operations over
all of them; strings of like length keep the number of steps low.
"""

from __future__ import annotations

import numpy as np


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """symbols: the strings end to end, values from 0 to 65533; bounds: where each starts, and the end. The starts of
    the suffixes of each string, as places in symbols, in order, string after string."""
    lengths = np.diff(bounds)
    strings = len(lengths)
    # each string lies between a guard, below every group, and a least symbol; place 0 of string r is first[r]
    first = bounds[:-1] + 2 * np.arange(strings) + 1
    total = int(bounds[-1]) + 2 * strings
    inside = _spread(first, lengths)
    text = np.zeros(total, np.int64)
    text[inside] = symbols.astype(np.int64) + 2
    text[first + lengths] = 1
    slots = _spread(first, lengths + 1)
    owner = np.repeat(np.arange(strings), lengths + 1)
    key = owner * 65536 + text[slots]
    order = np.argsort(key, kind="stable")
    sa, isa = np.zeros(total, np.int64), np.zeros(total, np.int64)
    sa[slots] = slots[order]
    isa[sa[slots]] = slots
    key = key[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(new, append=len(key))
    group, size = np.full(total, -1, np.int64), np.zeros(total, np.int64)
    group[sa[slots]] = np.repeat(slots[new], count)
    size[slots[new]] = count
    previous = np.full(total, -1, np.int64)
    _group(sa, isa, group, size, previous, first, first + lengths)
    out = _emit(group, previous, first, lengths)
    kept = out[_spread(first + 1, lengths)]
    return kept - np.repeat(first - bounds[:-1], lengths)


def _group(sa: np.ndarray, isa: np.ndarray, group: np.ndarray, size: np.ndarray, previous: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
    total = len(sa)
    times, last, marked = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
    live = end > first
    floor, end = first[live], end[live]
    while len(end):
        start = group[sa[end]]
        counts = end - start + 1
        s = sa[_spread(start, counts)]
        mine = np.repeat(start, counts)
        p = s - 1
        above = np.flatnonzero(group[p] > mine)
        while len(above):
            jumped = previous[p[above]]
            p[above] = jumped
            above = above[group[jumped] > mine[above]]
        previous[s] = p
        same = np.flatnonzero(group[p] == mine)
        while len(same):
            jumped = previous[p[same]]
            p[same] = jumped
            previous[s[same]] = jumped
            same = same[group[jumped] == mine[same]]
        q = p[group[p] >= 0]
        if len(q):
            np.add.at(times, q, 1)
            at = np.arange(len(q))
            last[q] = at
            q = q[last[q] == at]
            n = times[q]
            times[q] = 0
            most = int(n.max())
            if most == 1:
                _raise(q, sa, isa, group, size, marked)
            else:
                for level in np.unique(n)[::-1]:
                    _raise(q[n == level], sa, isa, group, size, marked)
        end = start - 1
        live = end > floor
        if not live.all():
            floor, end = floor[live], end[live]


def _raise(x: np.ndarray, sa: np.ndarray, isa: np.ndarray, group: np.ndarray, size: np.ndarray, marked: np.ndarray) -> None:
    """Moves the suffixes x, group by group, into new groups right above their own."""
    own = group[x]
    order = np.argsort(own, kind="stable")
    x, own = x[order], own[order]
    head = np.flatnonzero(np.diff(own, prepend=-1))
    old = own[head]
    count = np.diff(head, append=len(own))
    part = count < size[old]  # a group that moves as a whole stays as it is
    if not part.all():
        x = x[np.repeat(part, count)]
        old, count = old[part], count[part]
        if not len(x):
            return
    new = old + size[old] - count
    tail = _spread(new, count)
    marked[x] = True
    there = sa[tail]
    stay = marked[there]
    marked[x] = False
    beginning = np.repeat(new, count)
    at = isa[x]
    move = at < beginning
    out, free, into = there[~stay], at[move], tail[~stay]
    x_moved = x[move]
    sa[into], isa[x_moved] = x_moved, into
    sa[free], isa[out] = out, free
    group[x] = beginning
    size[new] = count
    size[old] -= count


def _emit(group: np.ndarray, previous: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = len(group)
    out, front = np.zeros(total, np.int64), np.arange(total)
    done = np.zeros(total, bool)
    done[first - 1] = True
    out[first] = first + lengths
    done[first + lengths] = True
    order = np.argsort(-lengths, kind="stable")
    first, lengths = first[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0] + 1 if len(lengths) else 0), side="right")
    for step, n in enumerate(active):
        s = out[first[:n] + step] - 1
        s = s[~done[s]]
        while len(s):
            g = group[s]
            at = front[g]
            out[at] = s
            front[g] = at + 1
            done[s] = True
            s = previous[s]
            s = s[~done[s]]
    return out
