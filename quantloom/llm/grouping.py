"""Suffix arrays by linear grouping: suffixes are gathered in groups that share their Lyndon prefix,
taking the groups in descending order; then one left-to-right pass emits the order inside each group."""

from __future__ import annotations

import numpy as np


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers. A sentinel below all of them stands at the end and is not
    part of the result.

    First a group is all suffixes with one first symbol; a group is known by the place in the order where
    it begins. For each suffix of the group in hand, the previous smaller pointer leads to the nearest
    suffix on its left in a lower group; suffixes that are led to equally often by this group, and share a
    group, form a new group right behind their old one. In the end suffixes are emitted by the rule that
    the smallest unplaced of a group is the one whose remainder behind its Lyndon prefix comes first.
    """
    text = np.append(np.asarray(data, np.int64) + 1, 0)
    n = len(text)
    first = np.argsort(text, kind="stable")
    order = first.tolist()
    place = np.empty(n, np.int64)
    place[first] = np.arange(n)
    place = place.tolist()
    begins = np.searchsorted(text[first], text)
    group = begins.tolist()
    size = [0] * n
    for b, c in zip(*np.unique(begins, return_counts=True), strict=True):
        size[b] = int(c)
    prev = [-2] * n  # not known yet
    end = n - 1
    while end >= 0:
        g = group[order[end]]
        if g == end:
            i = order[end]
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                h = group[p]
                size[h] -= 1
                if size[h]:
                    new = h + size[h]
                    a, x = place[p], order[new]
                    order[a], place[x] = x, a
                    order[new], place[p] = p, new
                    group[p] = new
                    size[new] = 1
                else:
                    size[h] = 1
            end -= 1
            continue
        led: dict[int, int] = {}
        for start in order[g : end + 1]:
            if prev[start] != -2:
                continue
            path = [(start, start - 1)]  # a pointer waits for those of its group that it leads over
            while path:
                i, p = path.pop()
                while p >= 0 and group[p] >= g:
                    if prev[p] == -2:
                        path += [(i, p), (p, p - 1)]
                        break
                    p = prev[p]
                else:
                    prev[i] = p
                    if p >= 0:
                        led[p] = led.get(p, 0) + 1
        most = max(led.values(), default=0)
        by: list[dict[int, list[int]]] = [{} for _ in range(most + 1)]
        for p, c in led.items():
            by[c].setdefault(group[p], []).append(p)
        for c in range(most, 0, -1):
            for h, moved in by[c].items():
                left = size[h] - len(moved)
                if not left:
                    continue
                new = h + left
                size[h] = left
                size[new] = len(moved)
                for at, p in enumerate(moved, new):
                    a, x = place[p], order[at]
                    order[a], place[x] = x, a
                    order[at], place[p] = p, at
                    group[p] = new
        end = g - 1
    free = list(range(n))
    out = [-1] * n
    out[0] = n - 1
    done = [False] * n
    done[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = prev[s]
    return np.array(out[1:], np.int64)
