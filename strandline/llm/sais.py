"""Suffix arrays by induced sorting, and permuted longest common prefixes, on numpy arrays.

Over small alphabets a bucket is induced at a time, all its suffixes in one vector step; over the large alphabets of
the recursion suffixes are induced one by one. Both are linear in the length of the string.
"""

from __future__ import annotations

import numpy as np

_SMALL = 1024


def classify(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the next (S type). The last one, the end mark, is."""
    edge = np.flatnonzero(t[1:] != t[:-1])  # last places of runs of equal symbols
    up = np.append(t[edge] < t[edge + 1], True)
    return np.repeat(up, np.diff(np.concatenate(([-1], edge, [len(t) - 1]))))


def _induce_buckets(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    n = len(t)
    sa = np.full(n, -1, np.int32)
    size = np.bincount(t, minlength=k)
    end = np.cumsum(size)
    start = end - size
    order = np.argsort(t[lms], kind="stable")
    seeds = lms[order].astype(np.int32)
    first = np.searchsorted(t[seeds], np.arange(k + 1))
    head, tail = start.copy(), end.copy()

    def place(p: np.ndarray, at: np.ndarray, step: int) -> None:
        c = t[p]
        o = np.argsort(c, kind="stable")
        c = c[o]
        m = np.bincount(c, minlength=k)
        rank = np.arange(len(c)) - np.repeat((np.cumsum(m) - m)[m > 0], m[m > 0])
        sa[at[c] + rank if step > 0 else at[c] - 1 - rank] = p[o]
        at += step * m

    for c in np.flatnonzero(size):
        i = start[c]
        while i < head[c]:
            p = sa[i : head[c]] - 1
            i = head[c]
            p = p[p >= 0]
            p = p[~s[p]]
            if len(p):
                place(p, head, 1)
        p = seeds[first[c] : first[c + 1]] - 1
        p = p[p >= 0]
        p = p[~s[p]]
        if len(p):
            place(p, head, 1)
    sa[0] = n - 1
    tail[t[n - 1]] -= 1
    for c in np.flatnonzero(size)[::-1]:
        hi = end[c]
        while tail[c] < hi:
            p = sa[tail[c] : hi][::-1] - 1
            hi = tail[c]
            p = p[p >= 0]
            p = p[s[p]]
            if len(p):
                place(p, tail, -1)
        p = sa[start[c] : head[c]][::-1] - 1
        p = p[p >= 0]
        p = p[s[p]]
        if len(p):
            place(p, tail, -1)
    return sa


def _induce_one_by_one(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    n = len(t)
    size = np.bincount(t, minlength=k)
    end = np.cumsum(size)
    head, tail = (end - size).tolist(), end.tolist()
    text, less = t.tolist(), s.tolist()
    sa = [-1] * n
    for j in reversed(lms.tolist()):
        c = text[j]
        tail[c] -= 1
        sa[tail[c]] = j
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not less[j]:
            c = text[j]
            sa[head[c]] = j
            head[c] += 1
    tail = end.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and less[j]:
            c = text[j]
            tail[c] -= 1
            sa[tail[c]] = j
    sa[0] = n - 1
    return np.array(sa, dtype=np.int32)


def _names(t: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each leftmost-smaller substring, in text order; equal ones share it. How many there are."""
    length = np.zeros(len(t), np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ranked[:-1], ranked[1:]
    same = length[a] == length[b]
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[length[a[live]] > k]
        equal = t[a[live] + k] == t[b[live] + k]
        same[live[~equal]] = False
        live = live[equal]
        k += 1
    name = np.zeros(len(t), np.int32)
    name[ranked] = np.concatenate(([0], np.cumsum(~same)))
    return name[lms], int((~same).sum()) + 1


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """t: symbols below ``k``; the last is 0 and the only 0."""
    if len(t) == 1:
        return np.zeros(1, np.int32)
    induce = _induce_buckets if k <= _SMALL else _induce_one_by_one
    s = classify(t)
    leftmost = np.zeros(len(t), bool)
    leftmost[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(leftmost)
    ranked = induce(t, s, lms, k)
    ranked = ranked[leftmost[ranked]]
    name, distinct = _names(t, lms, ranked)
    order = ranked if distinct == len(lms) else lms[suffix_array(name.astype(np.int32), distinct)]
    return induce(t, s, order, k)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): of each suffix, in text order, how long it agrees with the one before it in the array, and which
    that is. Only where the symbol before differs has a value to be compared out; it then falls by one a place."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    own = (phi < 0) | (i == 0) | (phi == 0)
    own[1:] |= t[i[1:] - 1] != t[np.maximum(phi[1:], 1) - 1]
    own[1:] |= phi[1:] != phi[:-1] + 1
    at = np.flatnonzero(own & (phi >= 0))
    x = np.concatenate((t.astype(np.uint64), np.zeros(8, np.uint64)))
    word = np.zeros(n, np.uint64)
    for b in range(4):  # symbols are below 65536 here
        word |= x[b : b + n] << np.uint64(16 * b)
    value = np.zeros(n, np.int64)
    live, length = at, np.zeros(len(at), np.int64)
    where = np.arange(len(at))
    while len(live):
        a, b = live + length[where], phi[live] + length[where]
        inside = (a < n) & (b < n)
        diff = np.where(inside, word[np.minimum(a, n - 1)] ^ word[np.minimum(b, n - 1)], np.uint64(1))
        low = diff & (~diff + np.uint64(1))
        equal = diff == 0
        length[where] += np.where(equal, 4, np.bitwise_count(low - np.uint64(1)) >> 4)
        live, where = live[equal], where[equal]
    value[at] = length
    last = np.maximum.accumulate(np.where(own, i, 0))
    return np.maximum(value[last] - (i - last), 0), phi
