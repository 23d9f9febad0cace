"""Suffix arrays by grouping: linear-time construction without recursion (after Baier, CPM 2016)."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes of an array of positive integers; the end counts as smaller than any symbol.

    First part: suffixes are grouped by their first symbol, and groups are processed from the
    highest down. For each suffix of a group, prev is the nearest suffix to its left in a lower
    group; the suffixes thus met move to a group of their own right above the rest of their old
    one, those met more often higher. In the end a group holds the suffixes with one and the same
    Lyndon prefix. Second part: suffixes are taken in ascending order; the suffix before each one,
    and those that its prev pointers lead to, come next in their groups.
    """
    n = len(symbols) + 1
    text = np.zeros(n, np.int64)
    text[:-1] = symbols
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    first = np.repeat(heads, np.diff(np.r_[heads, n]))
    group_of = np.empty(n, np.int64)
    group_of[order] = first
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sizes = np.zeros(n, np.int64)
    sizes[heads] = np.diff(np.r_[heads, n])
    sa, group, at, size, prev = order.tolist(), group_of.tolist(), place.tolist(), sizes.tolist(), [-1] * n

    def lift(p: int) -> int:
        """Moves p to the end of what its group still has; a later call may put it into a group."""
        g = group[p]
        last = g + size[g] - 1
        i, q = at[p], sa[last]
        sa[i], sa[last], at[q], at[p] = q, p, i, last
        size[g] -= 1
        return last

    end = n - 1
    while end > 0:
        g = group[sa[end]]
        if g == end:
            s = sa[end]
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[s] = p
            if p >= 0 and size[group[p]] > 1:
                head = lift(p)
                group[p], size[head] = head, 1
        else:
            met: dict[int, int] = {}
            for s in sorted(sa[g : end + 1]):
                p = s - 1
                while p >= 0 and group[p] >= g:
                    p = prev[p]
                prev[s] = p
                if p >= 0:
                    met[p] = met.get(p, 0) + 1
            by_count: dict[int, list[int]] = {}
            for p, times in met.items():
                by_count.setdefault(times, []).append(p)
            for times in sorted(by_count, reverse=True):
                heads_of: dict[int, int] = {}
                for p in by_count[times]:
                    heads_of[group[p]] = lift(p)
                for head in heads_of.values():
                    size[head] = 0
                for p in by_count[times]:
                    head = heads_of[group[p]]
                    group[p] = head
                    size[head] += 1
        end = g - 1

    ready, following = [False] * n, list(range(n))
    sa[0] = n - 1
    ready[n - 1] = True
    for i in range(n):
        s = sa[i] - 1
        while s >= 0 and not ready[s]:
            g = group[s]
            k = following[g]
            sa[k] = s
            following[g] = k + 1
            ready[s] = True
            s = prev[s]
    return np.array(sa[1:], np.int64)


def _members(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the ranges first[i] .. first[i] + counts[i] - 1, one after the other."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]


def suffix_arrays(rows: np.ndarray) -> np.ndarray:
    """The suffix arrays of many short strings at once, one a row: symbols from 1 on, 0 at the end of each row only.

    The same two parts as suffix_array, in steps that all rows take together: step k of the first
    part processes the k-th highest group of every row that has one. Cells are numbered through all rows.
    """
    count, n = rows.shape
    base = np.arange(count) * n
    flat = rows.ravel()
    sa = (np.argsort(rows, axis=1, kind="stable") + base[:, None]).ravel()
    rank = np.arange(count * n)
    ranked = flat[sa]
    is_head = np.r_[True, ranked[1:] != ranked[:-1]]
    is_head[base] = True
    heads = np.flatnonzero(is_head)
    head_at = np.repeat(heads, np.diff(np.r_[heads, count * n]))  # of each rank
    size = np.zeros(count * n, np.int64)
    size[heads] = np.diff(np.r_[heads, count * n])
    group, at = np.empty(count * n, np.int64), np.empty(count * n, np.int64)
    group[sa], at[sa] = head_at, rank
    prev = np.full(count * n, -1)
    met_now = np.zeros(count * n, bool)

    end, low = base + n - 1, base  # the last rank of each row that isn't processed, the row's first cell
    while len(end):
        g = head_at[end]
        owner, places = _members(g, end - g + 1)
        s, lowest, own = sa[places], low[owner], g[owner]
        p = s - 1
        going = np.flatnonzero((p >= lowest) & (group[np.maximum(p, 0)] > own))
        while len(going):
            p[going] = prev[p[going]]
            q = p[going]
            going = going[(q >= lowest[going]) & (group[np.maximum(q, 0)] > own[going])]
        p[p < lowest] = -1
        prev[s] = p
        same = np.flatnonzero((p >= 0) & (group[np.maximum(p, 0)] == own))
        while len(same):  # a member's own pointer, once that has left the group
            p[same] = prev[p[same]]
            prev[s[same]] = p[same]
            same = same[(p[same] >= 0) & (group[np.maximum(p[same], 0)] == own[same])]
        found = np.sort(p[p >= 0])
        if len(found):
            first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            met, times = found[first], np.diff(np.r_[first, len(found)])
            order = np.lexsort((times, group[met]))
            met, times = met[order], times[order]
            old = group[met]
            new_old = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
            olds, many = old[new_old], np.diff(np.r_[new_old, len(met)])
            tails = olds + size[olds] - many
            _, slots = _members(tails, many)
            met_now[met] = True
            moved = sa[slots]
            moved = moved[~met_now[moved]]
            met_now[met] = False
            holes = at[met]
            holes = holes[holes < np.repeat(tails, many)]
            sa[holes], at[moved] = moved, holes
            sa[slots], at[met] = met, slots
            new_class = np.flatnonzero(np.r_[True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])])
            members = np.diff(np.r_[new_class, len(met)])
            size[olds] -= many
            size[slots[new_class]] = members
            group[met] = np.repeat(slots[new_class], members)
            head_at[slots] = group[met]
        end = g - 1
        left = end > low
        end, low = end[left], low[left]

    ready, following = np.zeros(count * n, bool), rank
    sa[base] = base + n - 1
    ready[base + n - 1] = True
    for i in range(n):
        s = sa[base + i] - 1
        s = s[s >= base]
        s = s[~ready[s]]
        while len(s):
            g = group[s]
            sa[following[g]] = s
            following[g] += 1
            ready[s] = True
            s = prev[s]
            s = s[s >= 0]
            s = s[~ready[s]]
    return sa.reshape(count, n) - base[:, None]
