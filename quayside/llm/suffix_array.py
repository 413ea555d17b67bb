"""A suffix array by linear grouping.

Suffixes start in groups by first symbol. Groups are handled in descending order; a group's suffixes share a Lyndon
prefix. Each one points to the nearest suffix before it in a smaller group (its previous smaller one), and the
suffixes pointed at move up into groups of their own, ordered by how many they were pointed at by: their prefix has
grown by that many copies. When all groups are handled, each is a set of suffixes with one Lyndon prefix, and a
single walk along the pointers emits every group's members in order. Nothing is renamed or recursed into.
"""

from __future__ import annotations

from collections import Counter


def suffix_array(s: list[int]) -> list[int]:
    """Start positions in suffix order of s, a list of small non-negative integers whose last one, 0, occurs once."""
    n = len(s)
    if n <= 1:
        return list(range(n))
    count = [0] * (max(s) + 1)
    for c in s:
        count[c] += 1
    first, at = [], 0
    for c in count:
        first.append(at)
        at += c
    group = [first[c] for c in s]  # a group is named by its first place in the order
    order, place, size = [0] * n, [0] * n, [0] * n
    for i, g in enumerate(group):
        place[i] = p = g + size[g]
        order[p] = i
        size[g] += 1
    prev = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        members = order[start:end]
        if len(members) > 1:
            members.sort()
        pointed = []
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed.append(p)
        end = start
        if not pointed:
            continue
        if len(pointed) == 1:
            levels = [pointed]
        else:
            times = Counter(pointed)
            most = max(times.values())
            if most == 1:
                levels = [pointed]
            else:
                by = {}
                for p, k in times.items():
                    by.setdefault(k, []).append(p)
                levels = [by[k] for k in sorted(by, reverse=True)]
        for level in levels:
            moved = {}
            for p in level:
                g = group[p]
                moved[g] = k = moved.get(g, 0) + 1
                last = g + size[g] - k  # the tail of the group takes those that move up
                q, at = order[last], place[p]
                order[at], place[q] = q, at
                order[last], place[p] = p, last
            for g, k in moved.items():
                if k == size[g]:
                    continue
                size[g] -= k
                size[g + size[g]] = k
            for p in level:
                g = group[p]
                if place[p] >= g + size[g]:
                    group[p] = g + size[g]
    out, nxt, done = [0] * n, {}, bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            p = nxt.get(g, g)
            out[p] = j
            nxt[g] = p + 1
            done[j] = 1
            j = prev[j]
    return out
