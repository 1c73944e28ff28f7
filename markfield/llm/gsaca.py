"""Suffix arrays by linear grouping: suffixes are grouped by their longest Lyndon prefix, groups are processed in
descending order with previous-smaller pointers, then each group's order is emitted.  No recursion, no renaming.

Many texts are sorted at once, in step: every step takes the highest group left of every text, so the work of a step is
on arrays.  Texts that are too long for their number (over LONG characters for each of them) go one by one.  Groups are
intervals of one array; a suffix's group is named by the interval's first place, so comparing names compares groups, and splitting off
the upper part of an interval keeps all other names."""

from __future__ import annotations

import numpy as np

#: Characters a text of those in step beyond which texts go one by one, and of all that are sorted in step.
LONG, STEP = 700, 1 << 19


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, .. of every interval, one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def suffix_arrays(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of all suffixes of texts that stand one after another in codes (whole numbers from 1; ends: their ends, none
    empty): the suffixes of the first text in their order, then those of the second, and so on.  The end of a text counts
    as smaller than all."""
    out = np.empty(len(codes), np.int64)
    ends = np.asarray(ends, np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    size = ends - begins
    order = np.argsort(size, kind="stable")  # texts of like size end together
    cuts = np.flatnonzero(np.diff(np.cumsum(size[order]) // STEP)) + 1
    for some in np.split(order, cuts) if len(order) else []:
        if size[some[-1]] > LONG * len(some):
            for t in some:
                out[begins[t] : ends[t]] = np.array(one_suffix_array(codes[begins[t] : ends[t]].tolist()), np.int64) + begins[t]
        else:
            places = ranges(begins[some], size[some])
            out[places] = places[_in_step(codes[places], np.cumsum(size[some]))]
    return out


def _in_step(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """suffix_arrays of texts of like size."""
    n = len(codes)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    of = np.repeat(np.arange(len(ends)), ends - begins)
    # Initial groups: by first character.
    members = np.lexsort((codes, of))
    where = np.empty(n, np.int64)
    where[members] = np.arange(n)
    sorted_codes, sorted_of = codes[members], of[members]
    new = np.concatenate([[True], (sorted_codes[1:] != sorted_codes[:-1]) | (sorted_of[1:] != sorted_of[:-1])])
    names = np.flatnonzero(new)
    size = np.zeros(n + 1, np.int64)
    size[names] = np.diff(np.append(names, n))
    group = np.empty(n + 1, np.int64)
    group[members] = np.repeat(names, size[names])
    group[n] = -1  # what has no place, in no group
    previous = np.full(n + 1, n, np.int64)
    first = np.append(begins, n)[of]  # the text's first place of every place
    _refine(members, where, group, size, previous, begins, ends.astype(np.int64), first)
    return _emit(group, previous, begins, ends.astype(np.int64))


def _refine(members, where, group, size, previous, begins, ends, first) -> None:
    """Phase 1: from the highest group of every text down."""
    none = len(members)
    end, begin = ends.copy(), begins
    while len(end):
        g = group[members[end - 1]]
        inside = members[ranges(g, end - g)]
        name = np.repeat(g, end - g)
        end = g
        # The nearest place to the left that is in a lower group.  Those of the own group are resolved among each other.
        p = np.where(inside > first[inside], inside - 1, none)
        open_ = np.flatnonzero(group[p] > name)
        while len(open_):
            p[open_] = previous[p[open_]]
            open_ = open_[group[p[open_]] > name[open_]]
        previous[inside] = p
        open_ = np.flatnonzero(group[p] == name)
        while len(open_):
            p[open_] = previous[inside[open_]] = previous[p[open_]]
            open_ = open_[group[p[open_]] == name[open_]]
        # Suffixes with more followers in this group are larger: they go to the upper end of their group, by their number.
        p = np.sort(p[p < none])
        if len(p):
            starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            times, p = np.diff(np.append(starts, len(p))), p[starts]
            _split(p, times, members, where, group, size)
        going = end > begin
        if not going.all():
            end, begin = end[going], begin[going]


def _split(p, times, members, where, group, size) -> None:
    h = group[p]
    order = np.lexsort((times, h))
    p, times, h = p[order], times[order], h[order]
    lead = np.concatenate([[True], h[1:] != h[:-1]])
    at = np.flatnonzero(lead)
    names, moved = h[at], np.diff(np.append(at, len(h)))
    rest = size[names] - moved
    to = ranges(names + rest, moved)  # the upper places of every group, as many as move
    at_top = np.repeat(names + rest, moved)
    old = where[p]
    # Who stands on them and does not move takes the places below that become free.
    stays = np.ones(len(to), bool)
    inside = old >= at_top
    stays[np.searchsorted(to, np.sort(old[inside]))] = False
    who, free = members[to[stays]], old[~inside]
    members[free], where[who] = who, free
    members[to], where[p] = p, to
    # Groups of equal numbers get the names of their first places.
    new = lead | np.concatenate([[True], times[1:] != times[:-1]])
    start = np.flatnonzero(new)
    name, count = to[start], np.diff(np.append(start, len(p)))
    size[names] = rest
    size[name] = count
    group[p] = np.repeat(name, count)


def _emit(group, previous, begins, ends) -> np.ndarray:
    """Phase 2: every suffix, in order, places those it precedes at the front of their groups."""
    n = len(group) - 1
    out = np.full(n, n, np.int64)
    front = group  # next free place of a group, by the name; -1 once a suffix is placed
    free = np.arange(n + 1)
    begin, end = begins, ends
    i, j = begins - 1, ends - 1
    while len(i):
        g = front[j]
        put = g >= 0
        if put.any():
            jp, gp = j[put], g[put]
            out[free[gp]] = jp
            free[gp] += 1
            front[jp] = -1
            j[put] = previous[jp]
        rest = np.flatnonzero(~put)
        i[rest] += 1
        done = i[rest] == end[rest]
        if done.any():
            keep = np.ones(len(i), bool)
            keep[rest[done]] = False
            i, j, begin, end, put = i[keep], j[keep], begin[keep], end[keep], put[keep]
            rest = np.flatnonzero(~put)
        x = out[i[rest]]
        j[rest] = np.where(x > begin[rest], x - 1, n)
    return out


def suffix_array(text: list[int]) -> list[int]:
    """Order of all suffixes of one text."""
    return suffix_arrays(np.array(text, np.int64), np.array([len(text)])).tolist() if text else []


def one_suffix_array(text: list[int]) -> list[int]:
    """Order of all suffixes of one long text (whole numbers from 1), suffix by suffix."""
    n = len(text)
    if not n:
        return []
    # Initial groups: by first character.
    places = [0] * (max(text) + 2)
    for c in text:
        places[c + 1] += 1
    for c in range(1, len(places)):
        places[c] += places[c - 1]
    first = places[:]
    members = [0] * n
    where = [0] * n
    group = [0] * n
    size = [0] * n
    for i, c in enumerate(text):
        p = places[c]
        members[p] = i
        where[i] = p
        places[c] = p + 1
        g = first[c]
        group[i] = g
        size[g] += 1
    # Phase 1: refine, from the highest group down.
    previous = [-1] * n
    end = n
    while end > 0:
        g = group[members[end - 1]]
        inside = members[g:end]
        end = g
        if len(inside) > 1:
            inside.sort()
        times: dict[int, int] = {}
        for i in inside:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if not times:
            continue
        # Suffixes with more followers in this group are larger: they go to the upper end of their group first.
        if len(times) == 1:
            order = [list(times)]
        else:
            by: dict[int, list[int]] = {}
            for p, k in times.items():
                by.setdefault(k, []).append(p)
            order = [by[k] for k in sorted(by, reverse=True)]
        for some in order:
            moved: dict[int, int] = {}
            for p in some:  # to the end of the interval, one by one
                h = group[p]
                m = moved.get(h, 0) + 1
                moved[h] = m
                to = h + size[h] - m
                at = where[p]
                other = members[to]
                members[at], where[other] = other, at
                members[to], where[p] = p, to
            for h, m in moved.items():
                rest = size[h] - m
                if rest:  # else the whole group moved and keeps its name
                    new = h + rest
                    size[h] = rest
                    size[new] = m
                    for k in range(new, new + m):
                        group[members[k]] = new
    # Phase 2: every suffix, in order, places those it precedes at the front of their groups.
    out = [-1] * n
    front = group  # next free place of a group, kept at the place of its name
    free = list(range(n))
    j = n - 1
    i = -1
    while True:
        while j >= 0:
            g = front[j]
            if g < 0:
                break
            out[free[g]] = j
            free[g] += 1
            front[j] = -1
            j = previous[j]
        i += 1
        if i == n:
            return out
        j = out[i] - 1
