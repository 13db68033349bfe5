"""Suffix arrays of many short texts at once, by linear grouping.

A suffix's group is named by the Lyndon word it starts with.  Phase one takes
the groups of a text in descending order.  Each suffix of the group looks up,
by its previous-smaller pointer, the nearest suffix before it that lies in a
lower group; that suffix's Lyndon word grows by the group's word, as often as
the pointer is hit, and it moves to a new group right above its old one.  Every
suffix is taken once and no group is renamed.  Phase two emits the groups in
ascending order: inside a group the order is that of the suffixes that follow
the common Lyndon word, which lie in lower groups and have their ranks already,
or, after repetitions of the word, of their number first.

The step of one text is a few array operations, so all texts of a batch take
their steps together; the number of steps is that of the batch's text with the
most groups.  Batch texts of similar length.
"""

from __future__ import annotations

import numpy as np


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo[0] .. lo[0] + n[0] - 1, lo[1] .. and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + n, n)


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions in ``symbols`` so that those of text t stand at
    ``bounds[t]:bounds[t + 1]`` in the order of their suffixes in the text.
    Symbols are from 0 to 2 ** 16; a text's end is smaller than every symbol."""
    n, texts = int(bounds[-1]), len(bounds) - 1
    if not n:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    first = owner * 65537 + symbols
    sa = np.argsort(first, kind="stable")
    pos = np.empty(n, np.int64)
    pos[sa] = np.arange(n)
    heads = np.flatnonzero(np.concatenate([[True], first[sa][1:] != first[sa][:-1]]))
    groups = len(heads)
    start, size, length = (np.zeros(groups + n + 1, np.int64) for _ in range(3))
    start[:groups], size[:groups], length[:groups] = heads, np.diff(np.append(heads, n)), 1
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(np.arange(groups), size[:groups])

    done = np.zeros(n + 1, bool)              # taken; n stands for "none"
    pointer = np.arange(-1, n)
    pointer[bounds[:-1][bounds[:-1] < n]] = n
    moved = np.zeros(n, bool)
    low, top = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64).copy()
    live = np.flatnonzero(top > low)
    while len(live):
        g = group[sa[top[live] - 1]]
        many = top[live] - start[g]
        taken = sa[_ranges(start[g], many)]
        top[live] = start[g]
        live = live[top[live] > low[live]]
        done[taken] = True
        p = pointer[taken]
        while (far := done[p]).any():
            p[far] = pointer[p[far]]
            pointer[taken] = p
        pointer[taken] = p
        there = p < n
        p, word = p[there], np.repeat(length[g], many)[there]
        if not len(p):
            continue
        order = np.argsort(p, kind="stable")
        p, word = p[order], word[order]
        cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        times = np.diff(np.append(cut, len(p)))
        p, word = p[cut], word[cut]
        old = group[p]
        order = np.argsort(old * (n + 1) + times, kind="stable")
        p, word, times, old = p[order], word[order], times[order], old[order]
        by_old = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        count = np.diff(np.append(by_old, len(p)))
        slots = start[old[by_old]] + size[old[by_old]] - count   # the moved ones go to their group's end
        to = _ranges(slots, count)
        moved[p] = True
        here = sa[to]
        pushed = here[~moved[here]]
        freed = pos[p][pos[p] < np.repeat(slots, count)]
        moved[p] = False
        sa[freed], pos[pushed] = pushed, freed
        sa[to], pos[p] = p, to
        size[old[by_old]] -= count
        new = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])]))
        ids = groups + np.arange(len(new))
        if groups + len(new) > len(start):
            start, size, length = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (start, size, length))
        start[ids], size[ids] = to[new], np.diff(np.append(new, len(p)))
        length[ids] = length[old[new]] + times[new] * word[new]
        group[p] = np.repeat(ids, size[ids])
        groups += len(new)
    return _emit(sa, pos, group, start, size, length, owner, bounds)


def _emit(sa, pos, group, start, size, length, owner, bounds) -> np.ndarray:
    """Phase two: orders the groups of more than one suffix, lowest first."""
    n = len(sa)
    after = np.arange(n) + length[group]
    end = bounds[1:][owner]
    after = np.where(after < end, after, n)
    repeats = np.ones(n + 1, np.int64)
    out = np.append(after, n)
    wide = np.append(group, -1)
    again = np.append(wide[after] == group, False)
    out[:-1][again[:-1]] = after[again[:-1]]
    reach = np.where(again, out, n + 1)       # next repetition of the word, or none
    leave = np.where(again, -1, np.append(after, n))
    while (walk := np.flatnonzero(leave < 0)).size:
        q = reach[walk]
        known = leave[q] >= 0
        repeats[walk] += repeats[q]
        leave[walk] = np.where(known, leave[q], -1)
        reach[walk] = np.where(known, n + 1, reach[np.minimum(q, n)])
    alive = np.unique(group)
    alive = alive[size[alive] > 1]
    alive = alive[np.argsort(start[alive])]
    of = owner[sa[start[alive]]]
    nth = np.arange(len(alive)) - np.searchsorted(of, of)
    step = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[step], np.arange((nth.max() + 1 if len(nth) else 0) + 1))
    rank = np.append(pos + 1, 0)
    for a, b in zip(cuts, cuts[1:]):
        g = alive[step[a:b]]
        places = _ranges(start[g], size[g])
        some = sa[places]
        key = repeats[some] * (n + 1) + rank[leave[some]]
        some = some[np.lexsort((key, np.repeat(np.arange(len(g)), size[g])))]
        sa[places] = some
        rank[some] = places + 1
    return sa
