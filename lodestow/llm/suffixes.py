"""Suffix arrays by linear grouping (Baier, 2016).

First all suffixes are grouped by their first symbol. Groups are then taken in descending order. For each suffix i of the
group, prev(i) is the nearest place before i in a lower group; all suffixes that are prev of the same number of members
and share a group leave it for a new group right behind it, because the group's Lyndon prefix has become part of theirs.
At the end each group holds the suffixes with one Lyndon prefix. Second, going up the array, every suffix whose next
smaller suffix is the current one gets the next free place of its group. Nothing is renamed or sorted recursively.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of symbols in lexicographic order; a suffix comes before those it is a prefix of."""
    text = [*symbols, min(symbols, default=0) - 1]  # a last symbol below all others
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)  # members of a group are neighbours here
    place, group, stop = [0] * n, [0] * n, [0] * (n + 1)  # a group's number is its first place in order
    first = 0
    for k, i in enumerate(order):
        if text[i] != text[order[first]]:
            stop[first], first = k, k
        place[i], group[i] = k, first
    stop[first] = n
    prev = [-1] * n

    top = n
    while top > 0:
        g = group[order[top - 1]]
        members = sorted(order[g:top])
        counts: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, k in counts.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            ends: dict[int, int] = {}
            for p in by_count[k]:
                old = group[p]
                if old not in ends:
                    ends[old] = stop[old]
                last = stop[old] = stop[old] - 1
                here, other = place[p], order[last]
                order[here], order[last], place[other], place[p] = other, p, here, last
            for old, end in ends.items():
                new = stop[old]
                stop[new] = end
                for at in range(new, end):
                    group[order[at]] = new
        top = g

    array, free, placed = [0] * n, list(range(n)), bytearray(n)
    array[0], placed[n - 1] = n - 1, 1
    for k in range(n):
        j = array[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            array[free[g]], placed[j] = j, 1
            free[g] += 1
            j = prev[j]
    return array[1:]


def neighbour_matches(symbols: list[int], widths: list[int]) -> list[int]:
    """For each place, the longest match of its suffix with any other suffix, as the sum of the matched symbols' widths."""
    array, n = suffix_array(symbols), len(symbols)
    rank, sums = [0] * n, [0]
    for k, i in enumerate(array):
        rank[i] = k
    for w in widths:
        sums.append(sums[-1] + w)
    best, h = [0] * n, 0
    for i in range(n):  # Kasai: the match with the suffix before it in the array shrinks by one symbol at most
        if rank[i] == 0:
            h = 0
            continue
        j = array[rank[i] - 1]
        while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
            h += 1
        if h:
            best[i], best[j] = max(best[i], sums[i + h] - sums[i]), max(best[j], sums[j + h] - sums[j])
            h -= 1
    return best
