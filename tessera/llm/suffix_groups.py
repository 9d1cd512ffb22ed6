"""Suffix sorting by linear grouping.

Phase 1 groups the suffixes by their longest Lyndon prefixes. Groups are processed in descending
order; each suffix of the group points to the nearest suffix before it in a smaller group (its
previous-smaller pointer), and the suffixes that are pointed to move to new groups right after
their old ones: those pointed to more often come later. Phase 2 walks the sorted order from its
smallest suffix and, along the pointers, emits the next place of each group. Names are never
given anew, and there is no recursion.
"""

from __future__ import annotations

from array import array

#: Longer sequences are kept in packed arrays (a fifth of the memory, somewhat slower).
PACKED = 100_000


def suffix_array(symbols: list[int]) -> list[int] | array:
    """Order of the suffixes of a sequence whose last symbol is its only smallest one."""
    n = len(symbols)
    if n < 2:
        return list(range(n))
    # groups are ranges of ``order``, named by their first place
    packed = (lambda x: array("q", x)) if n > PACKED else list
    order = packed(sorted(range(n), key=symbols.__getitem__))
    place, group, stop = packed([0]) * n, packed([0]) * n, packed([0]) * n
    begin = 0
    for k, s in enumerate(order):
        place[s] = k
        if symbols[s] != symbols[order[begin]]:
            stop[begin] = k
            begin = k
        group[s] = begin
    stop[begin] = n
    smaller, jump = packed([-1]) * n, packed([-1]) * n
    high = n
    while high > 0:
        g = group[order[high - 1]]
        members = order[g:high]
        if len(members) > 1:
            members = sorted(members)
        hits: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = jump[p]
            smaller[s] = jump[s] = p
            q = s - 1  # shorten the way for later walks
            while q > p:
                q, jump[q] = jump[q], p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        if len(hits) == 1:
            rounds = [list(hits)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, k in hits.items():
                by_count.setdefault(k, []).append(p)
            rounds = [by_count[k] for k in sorted(by_count, reverse=True)]
        for moved in rounds:
            sets: dict[int, list[int]] = {}
            for p in moved:
                sets.setdefault(group[p], []).append(p)
            for old, some in sets.items():
                end = stop[old]
                new = end - len(some)
                if new == old:
                    continue  # the whole group moves: nothing changes
                at = end
                for p in some:  # swap to the end of the old range
                    at -= 1
                    k, other = place[p], order[at]
                    if other != p:
                        order[k], place[other] = other, k
                        order[at], place[p] = p, at
                for p in some:
                    group[p] = new
                stop[new], stop[old] = end, new
        high = g
    out, following, done = packed([-1]) * n, packed(range(n)), bytearray(n)
    out[0], done[n - 1] = n - 1, 1
    following[group[n - 1]] += 1
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[following[g]] = s
            following[g] += 1
            done[s] = 1
            s = smaller[s]
    return out
