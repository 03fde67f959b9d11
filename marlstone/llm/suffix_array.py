"""Suffix sorting by grouping over Lyndon prefixes, in linear time.

First phase: suffixes are grouped by their first symbol and the groups taken
from the highest down.  When a group is taken, its suffixes agree on their
longest Lyndon prefix and it is where it belongs.  Each member points to the
nearest earlier suffix of a lower group (its previous smaller suffix), found
along the pointers of what has been taken before.  Those suffixes are extended
by the group's prefix, so they move up inside their own group, further up the
more members in a row they precede.  Second phase: going up through the order,
each suffix brings the one before it, and what that one points to in turn, to
the next free place of their group.  No names are ever given to substrings.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of text in ascending order."""
    n = len(text)
    if n == 0:
        return []
    n += 1  # an end symbol below all others stands at position n - 1
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    rank = [0] * n  # a suffix's group, named by the place where the group starts
    held: list[list[int] | None] = [None] * (n + 1)  # by start: candidates in ascending order; who has left shows in rank
    size = [0] * (n + 1)
    start_of = [0] * (n + 1)  # by the place after a group's end: its start
    held[0], size[0], start_of[1] = [n - 1], 1, 0
    at = 1
    for c in sorted(first):
        members = first[c]
        for i in members:
            rank[i] = at
        held[at], size[at] = members, len(members)
        start_of[at + len(members)] = at
        at += len(members)

    prev = [-1] * n
    end = n
    while end > 0:
        g = start_of[end]
        times: dict[int, int] = {}
        members = held[g]
        held[g] = None
        for s in members:
            if rank[s] != g:
                continue
            p = s - 1
            while p >= 0 and rank[p] > g:
                p = prev[p]
            if p >= 0 and rank[p] == g:
                p = prev[p]  # a brother just taken: they share what they point to
            prev[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        end = g
        if not times:
            continue
        most = max(times.values())
        if most == 1:
            levels = [times]
        else:
            by: dict[int, list[int]] = {}
            for p, k in times.items():
                by.setdefault(k, []).append(p)
            levels = [by[k] for k in sorted(by, reverse=True)]
        for level in levels:
            moved: dict[int, list[int]] = {}
            for p in level:
                h = rank[p]
                if h in moved:
                    moved[h].append(p)
                else:
                    moved[h] = [p]
            for h, ps in moved.items():
                k = len(ps)
                if k == size[h]:
                    held[h] = ps
                    continue
                size[h] -= k
                to = h + size[h]
                held[to], size[to] = ps, k
                start_of[to + k] = to
                start_of[to] = h
                for p in ps:
                    rank[p] = to

    order = [-1] * n
    free = list(range(n + 1))  # by group: its next free place
    placed = bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            r = rank[s]
            order[free[r]] = s
            free[r] += 1
            placed[s] = 1
            s = prev[s]
    return order[1:]


def repeated_starts(text: list[int], length: int) -> list[int]:
    """Positions at which a string of `length` symbols starts that also starts elsewhere in text."""
    order = suffix_array(text)
    n, out, hit = len(text), [], bytearray(len(text))
    for a, b in zip(order, order[1:]):
        if a + length <= n and b + length <= n and text[a] == text[b] and text[a : a + length] == text[b : b + length]:
            hit[a] = hit[b] = 1
    out = [i for i, h in enumerate(hit) if h]
    return out
