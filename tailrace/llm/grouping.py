"""Suffix arrays of many strings at once by linear grouping construction.

Suffixes are held in groups that share their longest Lyndon prefix as far as it is known, at first their
first symbol. Groups are taken from the highest down. A group's suffixes find their previous-smaller
pointer, the nearest position to the left in a lower group, over the pointers of positions in between;
the pointed-at suffixes get a longer known prefix, so they leave their groups for new ones right above,
in the order of how many of the group's suffixes point at them. Once all groups are taken they stand in
the order of their Lyndon prefixes, and the array is emitted from the lowest suffix up: each emitted
suffix places the one before it, and that one's pointer chain, at the front of what is left of their
groups. Nothing is renamed and no recursion is needed.

The strings of a call are independent and advance together, one group (or one emitted suffix) of each
string in each step of numpy operations, so short strings cost their total length and not a step each.
"""

from __future__ import annotations

import numpy as np


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each length, end to end."""
    total = int(length.sum())
    steps = np.ones(total, np.int64)
    if total:
        first = np.cumsum(length) - length
        full = length > 0
        steps[first[full]] = begin[full]
        steps[first[full][1:]] -= (begin[full] + length[full])[:-1] - 1
    return np.cumsum(steps)


def suffix_arrays(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of all suffixes, string by string, each string's in ascending order.

    symbols: numbers of at least 1, strings end to end; string i is symbols[at[i]:at[i + 1]]. Suffixes end
    with their string, and an end is smaller than any symbol. The result has the strings in their order.
    """
    count = len(at) - 1
    sizes = np.diff(at)
    # Every string gets an end symbol of 0; positions below are those of the extended strings.
    edge = at[:-1] + np.arange(count)
    n = len(symbols) + count
    ends = edge + sizes
    text = np.zeros(n, np.int64)
    inner = np.ones(n, bool)
    inner[ends] = False
    text[inner] = symbols
    string = np.repeat(np.arange(count), sizes + 1)

    # Groups are intervals of `order`; group[s] is the first place of the interval that s is in.
    order = np.lexsort((text, string))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    key = string[order] * (int(text.max(initial=0)) + 1) + text[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(start, np.diff(np.append(start, n)))
    stop = np.zeros(n + 1, np.int64)  # by first place of a group: the place after its last
    stop[start] = np.append(start[1:], n)

    previous = np.arange(-1, n - 1)  # for suffixes not yet taken: their left neighbour
    is_parent = np.zeros(n, bool)
    top = ends + 1  # place after the highest group that is not taken
    live = np.flatnonzero(sizes > 0)
    while len(live):
        low = group[order[top[live] - 1]]
        length = top[live] - low
        members = order[_ranges(low, length)]
        bound = np.repeat(low, length)
        pointer = previous[members]
        open_ = np.arange(len(members))
        while True:
            open_ = open_[group[pointer[open_]] >= bound[open_]]
            if not len(open_):
                break
            previous[members[open_]] = pointer[open_] = previous[pointer[open_]]
        top[live] = low
        # A pointer below the string's first position ends at the end symbol of the string before.
        parents = pointer[pointer >= np.repeat(edge[live], length)]
        live = live[low > edge[live] + 1]  # the end symbol alone is the lowest group
        if not len(parents):
            continue
        parents = np.sort(parents)
        new = np.ones(len(parents), bool)
        new[1:] = parents[1:] != parents[:-1]
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(parents)))
        parents = parents[first]
        old = group[parents]
        rank = np.lexsort((times, old))
        parents, times, old = parents[rank], times[rank], old[rank]
        # Of each old group the parents take the last places, by how often they were pointed at.
        new = np.ones(len(parents), bool)
        new[1:] = old[1:] != old[:-1]
        first = np.flatnonzero(new)
        taken = np.diff(np.append(first, len(parents)))
        groups = old[first]
        begin = stop[groups] - taken
        target = _ranges(begin, taken)
        held = place[parents]
        hole = held[held < np.repeat(begin, taken)]
        if len(hole):
            is_parent[parents] = True
            stay = order[target]
            stay = stay[~is_parent[stay]]
            order[hole] = stay
            place[stay] = hole
            is_parent[parents] = False
        order[target] = parents
        place[parents] = target
        stop[groups] = begin
        split = new.copy()
        split[1:] |= times[1:] != times[:-1]
        head = np.flatnonzero(split)
        size = np.diff(np.append(head, len(parents)))
        group[parents] = np.repeat(target[head], size)
        stop[target[head]] = target[head] + size

    return _emitted(group, previous, edge, ends, n, string, at)


def _emitted(group, previous, edge, ends, n, string, at) -> np.ndarray:
    """The order of all suffixes from their final groups and pointers."""
    result = np.full(n, -1, np.int64)
    front = np.arange(n)  # by first place of a group: the place of its next suffix
    result[edge] = ends  # the end symbol alone comes first in each string
    live = np.flatnonzero(ends > edge)
    step = edge.copy()
    done = np.zeros(n, bool)
    done[ends] = True
    while len(live):
        s = result[step[live]] - 1
        base = edge[live]
        open_ = np.flatnonzero((s >= base))
        while len(open_):
            own = s[open_]
            fresh = ~done[own]
            open_, own = open_[fresh], own[fresh]
            if not len(open_):
                break
            done[own] = True
            g = group[own]
            result[front[g]] = own
            front[g] += 1
            s[open_] = own = previous[own]
            open_ = open_[own >= base[open_]]
        step[live] += 1
        live = live[step[live] < ends[live]]
    inner = np.ones(n, bool)
    inner[edge] = False
    return result[inner] - string[inner]
