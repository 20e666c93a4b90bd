"""Suffix sorting by linear grouping (no renaming, no recursion), for many sets of byte strings in step.

Phase 1 groups suffixes by their Lyndon prefix. Every suffix starts in the group of its first byte; the groups of
a set are processed in descending order. Each suffix i of the group of word u is absorbed by its previous smaller
suffix p, found by pointers that skip what was absorbed: p's word grows by u, and all that grow from one word by
the same u, equally often, form a new group directly above the one they leave. Groups are segments of one array,
so the next group down is always the one that holds the element below.

Phase 2 emits the groups in ascending order: a suffix i with word w is followed by the suffix i + |w|, which is
smaller and has been emitted, so its place orders the group. Members that follow one another come in layers.

One numpy step handles the current group of every set that is not finished, so short sets cost little each. The
number of steps is the number of distinct words of the richest set.
"""

from __future__ import annotations

import numpy as np

from .exchange import edges, gaps


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ...; sizes may be 0."""
    if len(start) == 1:
        return np.arange(start[0], start[0] + size[0])
    if not len(start):
        return np.zeros(0, np.int64)
    ends = size.cumsum()
    out = np.arange(ends[-1])
    out += (start - ends + size).repeat(size)
    return out


def _order(x: np.ndarray) -> np.ndarray:
    """Stable order of small numbers from 0 on, sixteen bits at a time."""
    order = np.argsort(x.astype(np.uint16), kind="stable")
    return order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")] if len(x) and x.max() >> 16 else order


def suffix_order(data: np.ndarray, sizes: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of the strings in lexicographic order, set by set.

    data is the concatenation (uint8) of strings of these sizes; sets numbers the set of each string and must not
    fall. A string's end is smaller than every byte; suffixes equal up to their ends keep an arbitrary order.
    Empty strings have no suffix. No strings give no suffixes.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    full = sizes > 0
    which = np.repeat(sets, sizes)
    which = np.cumsum(np.r_[0, which[1:] != which[:-1]])  # numbered without gaps
    left = np.arange(-1, n - 1)
    left[(ends - sizes)[full]] = -1

    # the first groups: one for each first byte of a set
    sa = np.argsort(data, kind="stable")
    sa = sa[_order(which[sa])]
    at = edges(which[sa] * 256 + data[sa])
    count = len(at)
    low, high, word = (np.empty(count + n + 1, np.int64) for _ in range(3))  # segment and word length of a group
    low[:count], high[:count], word[:count] = at, np.r_[at[1:], n], 1
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(np.arange(count), high[:count] - at)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    base = edges(which[sa])
    top = np.r_[base[1:], n]
    open_sets = np.arange(len(base))
    grown_by = np.zeros(len(base), np.int64)
    done = np.zeros(n + 1, bool)  # done[-1] stays false: no suffix on the left
    moving = np.zeros(n, bool)

    while len(open_sets):
        g = group[sa[top - 1]]
        s = low[g]
        mine = sa[ranges(s, top - s)]
        done[mine] = True
        p = left[mine]
        far = done[p].nonzero()[0]
        while len(far):
            p[far] = left[p[far]]
            left[mine[far]] = p[far]  # pointers of one group double
            far = far[done[p[far]]]
        p = p[p >= 0]
        if len(p):
            grown_by[open_sets] = word[g]
            p.sort()
            cut = edges(p)
            times = gaps(cut, len(p))
            p = p[cut]
            old = group[p]
            most = int(times.max())
            order = (old * (most + 1) + times if most > 1 else old).argsort()
            p, old, times = p[order], old[order], times[order]
            cut = edges(old)
            num = gaps(cut, len(p))
            src = old[cut]
            begin = high[src] - num
            tail = ranges(begin, num)
            was = place[p]
            moving[was] = True
            stay = tail[~moving[tail]]
            if len(stay):
                free = was[was < begin.repeat(num)]
                other = sa[stay]
                sa[free] = other
                place[other] = free
            moving[was] = False
            sa[tail] = p
            place[p] = tail
            high[src] = begin
            if most > 1:
                new = np.zeros(len(p), bool)
                new[cut] = True
                new[1:] |= times[1:] != times[:-1]
                cut = new.nonzero()[0]
                num = gaps(cut, len(p))
            ids = np.arange(count, count + len(cut))
            count += len(cut)
            low[ids] = tail[cut]
            high[ids] = tail[cut] + num
            word[ids] = word[old[cut]] + times[cut] * grown_by[which[p[cut]]]
            group[p] = ids.repeat(num)
        alive = s > base
        if alive.all():
            top = s
        else:
            top, base, open_sets = s[alive], base[alive], open_sets[alive]

    # Phase 2. Groups of one suffix are in place. rank: twice the place and one more, -1 before it is known; what
    # follows the last word of a string ranks below all of its set.
    cut = edges(group[sa])
    g = group[sa[cut]]
    size = high[g] - cut
    begin = edges(which)
    follow = np.arange(n) + word[group]
    at_end = (follow >= np.repeat(ends, sizes)).nonzero()[0]
    follow[at_end] = n + which[at_end]
    rank = np.full(n + len(begin), -1)
    rank[n:] = 2 * begin
    one = cut[size == 1]
    rank[sa[one]] = 2 * one + 1
    many = size > 1
    cut, g, size = cut[many], g[many], size[many]
    owner = which[sa[cut]]
    turn = np.arange(len(owner)) - np.repeat(edges(owner), gaps(edges(owner), len(owner)))
    for step in np.split(_order(turn), np.cumsum(np.bincount(turn))[:-1]) if len(turn) else ():
        lo, num = cut[step], size[step]
        mine = sa[ranges(lo, num)]
        nxt = follow[mine]
        by = rank[nxt]
        ready = by >= 0
        slot = None if ready.all() else np.arange(len(step)).repeat(num)
        while slot is not None:
            now, num = mine[ready], np.bincount(slot[ready], minlength=len(step))
            spot = ranges(lo, num)
            now = now[by[ready].argsort()]
            sa[spot] = now
            rank[now] = 2 * spot + 1
            lo = lo + num
            wait = ~ready
            mine, nxt, slot = mine[wait], nxt[wait], slot[wait]
            by = rank[nxt]
            ready = by >= 0
            if ready.all():
                num, slot = np.bincount(slot, minlength=len(step)), None
        mine = mine[by.argsort()]
        spot = ranges(lo, num)
        sa[spot] = mine
        rank[mine] = 2 * spot + 1
    return sa


def equal_runs(data: np.ndarray, sizes: np.ndarray, sets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all length-byte strings, those of equal bytes (in one set) adjacent, and the run each is in.

    Neighbours in suffix order are compared byte by byte, eight at once.
    """
    order = suffix_order(data, sizes, sets)
    stop = np.repeat(np.cumsum(sizes), sizes)
    order = order[order + length <= stop[order]]
    if not len(order):
        return order, order
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    which = np.repeat(sets, sizes)[order]
    same = which[1:] == which[:-1]
    if length >= 8:
        view = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
        offsets = [*range(0, length - 7, 8), length - 8]
    else:
        view, offsets = data, list(range(length))
    for o in dict.fromkeys(offsets):
        at = same.nonzero()[0]
        if 2 * len(at) > len(same):
            x = view[order + o]
            same &= x[1:] == x[:-1]
        else:
            same[at] = view[order[at] + o] == view[order[at + 1] + o]
    return order, np.cumsum(np.r_[0, ~same])
