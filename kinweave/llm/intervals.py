"""Which long strings occur more than once in a set of texts: a Burrows-Wheeler transform and its intervals, in numpy.

Texts are joined with terminators, each of which sorts before all bytes and by the text that it ends. Suffixes are sorted by
prefix doubling. Interval expansion then goes breadth first: the intervals of suffixes that share a string of length l
are known; those of length l + 1 arise from putting each byte before it, which the transform maps to a run of places. So
the places between neighbouring suffixes get their common prefixes in increasing order, first all of 0, then all of 1,
and the expansion stops at the minimum length: what no cut has separated by then has at least that much in common.

A cut inside an interval makes new cuts only where it parts two neighbouring occurrences of the same preceding byte, and
one of the two is outside the interval's largest part. So only the smaller parts are read, each place about log n times."""

from __future__ import annotations

import numpy as np


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, bytes as 1 to 256 and a 0 after each text, and where each text begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    out = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    places = np.arange(len(out))
    places = np.delete(places, starts + sizes)
    out[places] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    return out, starts


#: Symbols that one long holds: suffixes are first sorted by so many, and their common prefixes below that follow.
WIDTH = 7


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes in their order, equal ones up to a terminator in the order of the texts; and the common
    prefix of each suffix with the one before, if it is shorter than WIDTH symbols, else WIDTH."""
    n, width = len(symbols), WIDTH
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(width):  # seven symbols of nine bits; nothing after a terminator
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - j)] = symbols[j:]
        key = (key << 9) | np.where(alive, ahead, 0)
        alive &= ahead != 0
    order = np.argsort(key)
    sorted_key = key[order]
    ends = np.flatnonzero(~alive[order])  # suffixes with their terminator in the key: equal ones go by text
    order[ends] = order[ends][np.lexsort((order[ends], sorted_key[ends]))]
    head = np.ones(n + 1, bool)
    head[1:n] = (sorted_key[1:] != sorted_key[:-1]) | ~alive[order[1:]]
    common = np.full(n, WIDTH, np.int32)
    differ = sorted_key[1:] ^ sorted_key[:-1]
    for j in range(WIDTH - 1, -1, -1):
        common[1:][(differ >> (9 * (WIDTH - 1 - j))) != 0] = j
    if len(ends):  # terminators differ: two suffixes share what is before the nearer one
        left = np.zeros(n, np.int64)
        for j in range(WIDTH):
            left[ends] += (sorted_key[ends] >> (9 * (WIDTH - 1 - j)) & 511) != 0
        common[ends] = np.minimum(common[ends], left[ends])
    common[:1] = 0
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    open_ = np.flatnonzero(~(head[:n] & head[1:]))
    while len(open_):
        at = order[open_]
        key = (rank[at] << 32) | rank[at + width]
        turn = np.argsort(key)
        at, key = at[turn], key[turn]
        order[open_] = at
        head[open_[1:]] |= key[1:] != key[:-1]
        rank[at] = np.maximum.accumulate(np.where(head[open_], open_, 0))
        open_ = open_[~(head[open_] & head[open_ + 1])]
        width *= 2
    return order, common


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges with these beginnings and sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def alone(x: np.ndarray) -> np.ndarray:
    """Sorted numbers without repeats."""
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def classes(symbols: np.ndarray, order: np.ndarray, known: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and last place, in the suffixes' order, of the intervals of two or more suffixes that share `least` symbols,
    and the common prefixes of neighbours (with the one before), -1 where they are `least` or more. known: these as far as
    they are below WIDTH, from where the expansion goes on."""
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    first = symbols[order]
    before = np.where(order > 0, symbols[order - 1], 0)
    there = before != 0  # others begin a text
    to = np.where(there, place[order - 1], 0)  # where the suffix with one more symbol before it is
    # places of the last and the next suffix with the same symbol before it
    back = place[np.minimum(order + 1, n - 1)]
    same = np.zeros(n + 1, bool)
    same[1:n] = first[1:] == first[:-1]
    last = np.where(there & same[to], back[to - 1], -1)
    next_ = np.where(there & same[to + 1], back[np.minimum(to + 1, n - 1)], n)
    del back, place, before

    done = min(least, WIDTH)
    common = np.full(n + 1, -1, np.int32)
    common[:n][known < done] = known[known < done]
    common[0] = common[n] = 0
    cuts = np.flatnonzero(common[:n] == done - 1)
    cuts = cuts[cuts > 0]
    bounds = np.union1d(np.flatnonzero((common[:n] >= 0) & (common[:n] < done - 1)), [0])
    right, fresh = np.zeros(n, np.int64), np.zeros(0, np.int64)  # where the interval that begins there ends; bounds not merged yet
    right[bounds] = np.append(bounds[1:], n) - 1
    for length in range(done, least + 1):
        if not len(cuts):
            break
        heads = bounds[np.searchsorted(bounds, cuts) - 1]
        if len(fresh):
            heads = np.maximum(heads, np.where(cuts > fresh[0], fresh[np.searchsorted(fresh, cuts) - 1], 0))
        heads = alone(heads)
        parts = np.sort(np.concatenate([heads, cuts]), kind="stable")
        of = np.searchsorted(heads, parts, "right") - 1
        ends = np.empty(len(parts), np.int64)
        ends[:-1] = parts[1:] - 1
        is_last = np.append(of[1:] != of[:-1], True)
        ends[is_last] = right[heads]
        sizes = ends - parts + 1
        if length < least:
            group = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            largest = np.maximum.reduceat(sizes, group)[of] == sizes
            nth = np.cumsum(largest)
            largest &= nth == (nth[group] - largest[group] + 1)[of]  # one of equal ones is left out
            small = np.flatnonzero(~largest)
            at = spread(parts[small], sizes[small])
            low, high = np.repeat(parts[small], sizes[small]), np.repeat(ends[small], sizes[small])
            ok = there[at]
            lower, upper = at[ok & (last[at] < low)], at[ok & (next_[at] > high)]
            found = np.concatenate([to[lower], to[upper] + 1])
            found = alone(np.sort(found[common[found] == -1]))
            common[found] = length
        right[parts] = ends
        fresh = np.sort(np.concatenate([fresh, cuts]), kind="stable")
        if len(fresh) > 4096 + len(bounds) // 8:
            bounds, fresh = np.sort(np.concatenate([bounds, fresh]), kind="stable"), fresh[:0]
        if length < least:
            cuts = found
    bounds = np.sort(np.concatenate([bounds, fresh]), kind="stable")
    begin = bounds[right[bounds] > bounds]
    return begin, right[begin], common[:n]


def repeated(texts: list[bytes], owned: np.ndarray, weights: np.ndarray, least: int) -> list[np.ndarray]:
    """For each text the starts, among its first `owned` ones, of strings of `least` bytes that occur more than once.

    Only owned starts count, each as often as its text's weight says, and each has `least` bytes after it in its text."""
    symbols, begins = joined(texts)
    order, known = suffix_order(symbols)
    times = np.zeros(len(symbols), np.int64)
    times[spread(begins, owned)] = np.repeat(weights, owned)
    begin, end, _ = classes(symbols, order, known, least)
    counted = times[order]
    hit = counted > 1
    if len(begin):
        sums = np.concatenate([[0], np.cumsum(np.minimum(counted, 2))])
        often = sums[end + 1] - sums[begin] > 1
        inside = spread(begin[often], (end - begin + 1)[often])
        hit[inside] |= counted[inside] > 0
    places = np.sort(order[hit])
    cut = np.searchsorted(places, begins)
    return [part - b for part, b in zip(np.split(places, cut[1:]), begins, strict=True)]
