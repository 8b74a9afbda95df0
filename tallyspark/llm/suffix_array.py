"""Suffix arrays in linear time by grouping (Baier, 2016).

Suffixes are grouped by their Lyndon prefixes: groups are processed from the
highest down, each sorting the suffixes that its members' previous-smaller
pointers lead to into finer groups. The order inside the groups is then
emitted in one pass along the same pointers; nothing is renamed or recursed.
"""

from __future__ import annotations

import numpy as np


def group_suffixes(symbols: list[int]) -> tuple[list[int], list[int]]:
    """(group, prev): for each suffix, the rank of the first place of its
    group, and the nearest earlier suffix of a lower group (-1: none).

    The last symbol must be smaller than all others.
    """
    n = len(symbols)
    order = np.argsort(np.asarray(symbols), kind="stable")
    ranked = np.asarray(symbols)[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    sizes = np.diff(np.append(first, n))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    groups = np.empty(n, np.int64)
    groups[order] = np.repeat(first, sizes)
    size_of = np.zeros(n + 1, np.int64)
    size_of[first] = sizes
    array, place, group, size_of = order.tolist(), place.tolist(), groups.tolist(), size_of.tolist()
    prev = [-1] * n
    end = n
    while end:
        begin = group[array[end - 1]]
        # Previous smaller suffixes of the members; higher groups know theirs.
        if end - begin == 1:
            i = array[begin]
            j = i - 1
            while j >= 0 and group[j] >= begin:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                move(((j,),), array, place, group, size_of)
        else:
            times: dict[int, int] = {}
            for i in sorted(array[begin:end]):
                j = i - 1
                while j >= 0 and group[j] >= begin:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            most = max(times.values(), default=0)
            if most == 1:
                move((times,), array, place, group, size_of)
            elif most:
                # Followed by more copies of the group's prefix: larger, so moved first.
                by: dict[int, list[int]] = {}
                for j, k in times.items():
                    by.setdefault(k, []).append(j)
                move([by[k] for k in sorted(by, reverse=True)], array, place, group, size_of)
        end = begin
    return group, prev


def move(sets, array, place, group, size_of) -> None:
    """Put each set's suffixes into new groups, right above their old ones."""
    for chosen in sets:
        if len(chosen) == 1:
            (j,) = chosen
            g = group[j]
            last = g + size_of[g] - 1
            if last > g:
                x, at = array[last], place[j]
                array[at], place[x] = x, at
                array[last], place[j] = j, last
                group[j] = last
                size_of[g] -= 1
                size_of[last] = 1
            continue
        moved: dict[int, int] = {}
        for j in chosen:
            g = group[j]
            k = moved[g] = moved.get(g, 0) + 1
            to, at = g + size_of[g] - k, place[j]
            x = array[to]
            array[at], place[x] = x, at
            array[to], place[j] = j, to
        for j in chosen:
            g = group[j]
            group[j] = g + size_of[g] - moved[g]
        for g, k in moved.items():
            size_of[g] -= k
            size_of[g + size_of[g]] = k


def suffix_array(symbols: list[int]) -> np.ndarray:
    """The order of the suffixes of ``symbols``, whose last symbol must be
    smaller than all others."""
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    group, prev = group_suffixes(symbols)
    out = [0] * n
    free = list(range(n))  # by group: its next place
    emitted = bytearray(n)
    out[0] = n - 1
    emitted[n - 1] = 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not emitted[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            emitted[j] = 1
            j = prev[j]
    return np.asarray(out, np.int64)
