"""Suffix arrays by induced sorting, and permuted common prefixes, over bytes.

Leftmost-smaller (LMS) substrings are sorted and named, equal ones alike. The names form a string of at most half the
length, which is sorted by the same induction, recursively, until all names differ. The order of the LMS suffixes then
induces that of all others. The bytes' own level works bucket by bucket with vector operations: a bucket's suffixes are
known when it is reached, and what they induce is appended to later buckets in one step.
"""

from __future__ import annotations

import numpy as np


def s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. ``t`` ends with its only smallest value."""
    n = len(t)
    ends = np.flatnonzero(np.append(t[:-1] != t[1:], True))     # last positions of runs of equal values
    after = np.append(t[ends[1:]] if len(ends) > 1 else t[:0], t[-1])
    smaller = t[ends] < after
    smaller[-1] = True
    return np.repeat(smaller, np.diff(np.append(-1, ends)))[:n]


def lms_positions(s: np.ndarray) -> np.ndarray:
    return (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)


def _groups(values: np.ndarray, chars: np.ndarray):
    """(char, values in order) of every char."""
    order = np.argsort(chars, kind="stable")        # radix sort: chars are 16-bit
    chars, values = chars[order], values[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for part, c in zip(np.split(values, cuts), chars[np.append(0, cuts)].tolist()):
        yield c, part


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in the order that ``lms`` induces; ``lms`` is ordered within its buckets."""
    none = np.zeros(0, np.int32)
    seeds = [none] * sigma
    for c, part in _groups(lms, t[lms]):
        seeds[c] = part
    arrived: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    larger: list[np.ndarray] = [none] * sigma
    for c in range(sigma):                          # larger-type suffixes, buckets ascending
        waves, front = [], np.concatenate(arrived[c]) if arrived[c] else none
        while len(front):
            waves.append(front)
            front = front[front > 0] - 1
            front = front[(t[front] == c) & ~s[front]]
        arrived[c] = []
        larger[c] = np.concatenate(waves) if waves else none
        before = np.concatenate([larger[c], seeds[c]])
        before = before[before > 0] - 1
        chars = t[before]
        before = before[(chars > c) & ~s[before]]
        if len(before):
            for d, part in _groups(before, t[before]):
                arrived[d].append(part)
    out: list[np.ndarray] = []
    for c in range(sigma - 1, -1, -1):              # smaller-type suffixes, buckets descending
        waves, front = [], np.concatenate(arrived[c]) if arrived[c] else none
        while len(front):
            waves.append(front)
            front = front[front > 0] - 1
            front = front[(t[front] == c) & s[front]]
        arrived[c] = []
        smaller = np.concatenate(waves) if waves else none
        out.append(smaller)
        out.append(larger[c][::-1])
        before = np.concatenate([smaller, larger[c][::-1]])
        before = before[before > 0] - 1
        chars = t[before]
        before = before[(chars < c) & s[before]]
        if len(before):
            for d, part in _groups(before, t[before]):
                arrived[d].append(part)
    order = np.concatenate(out)[::-1]
    # the last position holds the only smallest value and is induced by nothing
    return order if len(order) == len(t) else np.append(np.int32(len(t) - 1), order)


def _names(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Name of each LMS substring, in text order: its rank, equal for equal substrings.

    Substrings are compared by value and type, smaller-type being the greater one. Then none is the start of another,
    and several places are compared at once, as one packed number. Only ties go on.
    """
    size = np.append(lms[1:], lms[-1]) - lms + 1
    bits = (2 * int(t.max()) + 1).bit_length()
    step = 63 // bits
    k = len(lms)
    order = np.arange(k)
    live = np.arange(k)                             # places in ``order`` that are not settled
    group = np.zeros(k, np.int64)                   # first place of the tie that each place belongs to
    top = len(t) - 1
    depth = 0
    while len(live):
        own = order[live]
        at, left = lms[own] + depth, size[own] - depth
        key = np.zeros(len(live), np.int64)
        for i in range(step):
            place = np.minimum(at + i, top)
            key = (key << bits) | np.where(left > i, 2 * t[place].astype(np.int64) + s[place], 0)
        by = np.lexsort((key, group[live]))
        own, key = own[by], key[by]
        order[live] = own                           # ties stay together: live places of a tie follow each other
        first = np.ones(len(live), bool)
        first[1:] = (key[1:] != key[:-1]) | (group[live][1:] != group[live][:-1])
        run = np.flatnonzero(first)
        size_of = np.diff(np.append(run, len(live)))
        group[live] = np.repeat(live[run], size_of)
        depth += step
        live = live[np.repeat(size_of, size_of) > 1]
        live = live[size[order[live]] > depth]
    name = np.empty(k, np.int64)
    name[order] = np.cumsum(np.append(0, group[1:] != group[:-1]))
    return name


def _sort_names(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names (the last is the only smallest), by induced sorting.

    There are about as many buckets as suffixes here, so the two scans are plain loops; all else, and the
    naming, is vector work.
    """
    n = len(t)
    s = s_types(t)
    lms = lms_positions(s)
    ends = np.cumsum(np.bincount(t))
    heads, tails = np.append(0, ends[:-1]).tolist(), ends.tolist()
    # bucket into which position i puts i - 1, or -1; the entry behind the last serves empty places
    before = np.append(t[:-1], 0)
    down = np.full(n + 1, -1)
    down[1:n] = np.where(s[:-1], -1, before[:-1])
    up = np.full(n + 1, -1)
    up[1:n] = np.where(s[:-1], before[:-1], -1)
    down, up = down.tolist(), up.tolist()

    def induced(lms: np.ndarray) -> np.ndarray:
        start = np.full(n, -1)
        chars = t[lms]                              # ascending buckets, in order within them
        last = np.flatnonzero(np.append(chars[1:] != chars[:-1], True))
        size = np.diff(np.append(-1, last))
        start[ends[chars] - np.repeat(size, size) + np.arange(len(lms)) - np.repeat(last - size + 1, size)] = lms
        sa = start.tolist()
        head = heads[:]
        for i in sa:                                # grows to the right while it is read
            c = down[i]
            if c >= 0:
                h = head[c]
                sa[h] = i - 1
                head[c] = h + 1
        tail = tails[:]
        r = n
        while r:
            r -= 1
            i = sa[r]
            c = up[i]
            if c >= 0:
                h = tail[c] - 1
                sa[h] = i - 1
                tail[c] = h
        return np.array(sa)

    return induced(_lms_order(t, s, lms))


def _lms_order(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """LMS positions in the order of their suffixes: by the names of their substrings, recursively where names repeat."""
    if len(lms) < 2:
        return lms
    name = _names(t, s, lms)
    if int(name.max()) + 1 < len(lms):
        return lms[_sort_names(name)]
    order = np.empty(len(lms), np.int64)
    order[name] = np.arange(len(lms))
    return lms[order]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a byte array, in order."""
    if not len(text):
        return np.zeros(0, np.int64)
    t = np.append(text.astype(np.uint16) + 1, np.uint16(0))
    s = s_types(t)
    lms = lms_positions(s)
    return _induce(t, s, _lms_order(t, s, lms), 257)[1:]


def permuted_lcp(text: np.ndarray, sa: np.ndarray, limit: int, starts: np.ndarray | None = None) -> np.ndarray:
    """For each position, its common prefix with the suffix before it in ``sa`` (0 for the first).

    Exact where ``limit - (distance from the last of starts)`` is not exceeded; larger ones are at least
    that. A position whose left neighbours differ is compared from scratch, eight bytes a step, up to
    ``limit``; any other has the value of its left neighbour less one.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    i = np.flatnonzero(phi > 0)
    i = i[i > 0]
    fresh[i] = text[i - 1] != text[phi[i] - 1]
    if starts is not None:
        fresh[starts] = True
    padded = np.concatenate([text, np.zeros(limit + 16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + limit + 8, 8), (1, 1))
    at = np.flatnonzero(fresh & (phi >= 0))
    a, b = at, phi[at]
    most = np.minimum(limit, n - np.maximum(a, b))
    lcp = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    depth = 0
    while len(live) and depth < limit:
        x = np.ascontiguousarray(words[a[live] + depth]).view("<u8").ravel()
        y = np.ascontiguousarray(words[b[live] + depth]).view("<u8").ravel()
        d = x ^ y
        differ = d != 0
        low = d[differ] & (~d[differ] + np.uint64(1))
        lcp[live[differ]] = depth + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[~differ]
        depth += 8
        lcp[live] = depth
        live = live[most[live] > depth]
    lcp = np.minimum(lcp, most)
    value = np.full(n, -1, np.int32)
    value[at] = lcp
    value[phi < 0] = 0
    known = value >= 0
    last = np.maximum.accumulate(np.where(known, np.arange(n, dtype=np.int32), 0))
    return np.maximum(value[last] - (np.arange(n, dtype=np.int32) - last), 0)
