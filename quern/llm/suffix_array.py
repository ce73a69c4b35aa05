"""Suffix arrays by induced sorting, vectorised over buckets, and permuted common prefixes.

Suffixes are classified smaller (S) or larger (L) than their successor; leftmost-S positions (LMS) are sorted by
an induced pass, named, and ordered by recursion on the string of names; a second induced pass
gives the suffix array. A bucket induces its predecessors at one go: what a run of one letter puts into its
own bucket is known from the run's length, and all else goes to later buckets. So a pass costs a few array
operations for each letter of the alphabet, whatever the text.

So that alphabets stay short in the recursion, a name is written as two digits to the base of the square root of the number of
names (one digit below DIGIT names); at most every other position is leftmost-S, so no level is longer than the one
above. A name that stands once and follows another such name is left out of it: no comparison gets there. A string of
at most SHORT names ends the recursion: runs of 1, 2, 4, ... names are ranked until all differ.

Common prefixes use the permuted order: where text[i-1] equals the byte before i's neighbour, the
value is the previous one less one, so only the other (irreducible) positions are compared.
"""

from __future__ import annotations

import numpy as np

#: Names that one digit holds; names that are sorted without a further level.
DIGIT, SHORT = 512, 3 << 17


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end is smaller than all."""
    n = len(t)
    less = np.zeros(n, bool)
    less[:-1] = t[:-1] < t[1:]
    at = np.full(n, n - 1, np.int32)  # the last of each run of one letter decides
    differs = np.flatnonzero(t[:-1] != t[1:]).astype(np.int32)
    at[differs] = differs
    return less[np.minimum.accumulate(at[::-1])[::-1]]


def _place(sa: np.ndarray, ptr: np.ndarray, chars: np.ndarray, items: np.ndarray, step: int) -> None:
    """Append items to their buckets, in order, upwards (step 1) or downwards (-1)."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    counts = np.bincount(c, minlength=len(ptr))
    shift = ptr - (np.cumsum(counts) - counts) if step > 0 else ptr - 1 + (np.cumsum(counts) - counts)
    rank = np.arange(len(c))
    sa[shift[c] + rank if step > 0 else shift[c] - rank] = items[order]
    ptr += step * counts


def _own_runs(t: np.ndarray, begin: np.ndarray, cur: np.ndarray, c: int) -> np.ndarray:
    """What the suffixes `cur` of bucket c and what they induce there put into bucket c: first all positions one before, then two ..."""
    j = cur[cur > 0]
    j = j[t[j - 1] == c]
    if not len(j):
        return j
    back = j - begin[j - 1]
    most = int(back.max())
    if most == 1:
        return j - 1
    if most <= 16:
        return np.concatenate([j[back >= k] - k for k in range(1, most + 1)])
    k = np.arange(back.sum()) - np.repeat(np.cumsum(back) - back, back) + 1
    order = np.argsort(k, kind="stable")
    return (np.repeat(j, back) - k)[order]


def _induce(t: np.ndarray, size: int, begin: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffixes in the order that the given order of the LMS positions induces. begin: where the run of
    one letter that holds a position begins."""
    n = len(t)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    begins = ends - counts
    sa = np.empty(n, np.int32)
    first = t[lms]
    lms_at = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=size))])
    lms = lms[np.argsort(first, kind="stable")]
    head = begins.copy()
    _place(sa, head, t[n - 1 :], np.array([n - 1], np.int32), 1)  # the end induces the last suffix, of type L
    some = np.flatnonzero(counts)
    for c in some.tolist():
        b, h = int(begins[c]), int(head[c])
        if h > b:
            own = _own_runs(t, begin, sa[b:h], c)
            sa[h : h + len(own)] = own
            head[c] = h = h + len(own)
        cur = np.concatenate([sa[b:h], lms[lms_at[c] : lms_at[c + 1]]])
        pred = cur[cur > 0] - 1
        chars = t[pred]
        up = chars > c
        if up.any():
            _place(sa, head, chars[up], pred[up], 1)
    tail = ends.copy()
    for c in some[::-1].tolist():
        e, s = int(ends[c]), int(tail[c])
        if s < e:
            own = _own_runs(t, begin, sa[s:e][::-1], c)
            sa[s - len(own) : s] = own[::-1]
            tail[c] = s = s - len(own)
        cur = np.concatenate([sa[s:e][::-1], sa[begins[c] : head[c]][::-1]])
        pred = cur[cur > 0] - 1
        chars = t[pred]
        down = chars < c
        if down.any():
            _place(sa, tail, chars[down], pred[down], -1)
    return sa


def _equal(t: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n letters from a and from b are the same."""
    same = np.ones(len(a), bool)
    open_ = np.arange(len(a))
    for k in range(24):
        open_ = open_[k < n[open_]]
        if not len(open_):
            return same
        ok = t[a[open_] + k] == t[b[open_] + k]
        same[open_[~ok]] = False
        open_ = open_[ok]
    for i in open_.tolist():
        same[i] = np.array_equal(t[a[i] + 24 : a[i] + n[i]], t[b[i] + 24 : b[i] + n[i]])
    return same


def _doubled(names: np.ndarray) -> np.ndarray:
    """The suffixes of a short string of names, sorted by ranks of runs of 1, 2, 4, ... names."""
    n, k = len(names), 1
    bits = np.int64(n.bit_length())  # a key and a place in one number, as 3 * bits < 63
    rank = (np.cumsum(np.bincount(names) > 0) - 1)[names]
    place = np.arange(n, dtype=np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        both = np.sort((rank * (n + 1) + after) << bits | place)
        order, key = both & ((1 << bits) - 1), both >> bits
        new = np.zeros(n, np.int64)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        if new[-1] == n - 1:
            return order
        rank[order] = new
        k *= 2


def _order(names: np.ndarray, many: int) -> np.ndarray:
    """The suffixes of a string of names 0..many-1, all of which occur, sorted."""
    counts = np.bincount(names, minlength=many)
    once = counts[names] == 1
    kept = np.ones(len(names), bool)
    kept[1:] = ~(once[1:] & once[:-1])
    at = np.flatnonzero(kept)
    short = names[at]
    if len(short) <= SHORT:
        by = at[_doubled(short)]
    elif many > DIGIT:
        base = int(np.ceil(np.sqrt(many)))
        digits = np.empty(2 * len(short), np.int16)
        digits[::2], digits[1::2] = short // base, short % base
        by = suffix_array(digits, base)
        by = at[by[(by & 1) == 0] >> 1]
    else:
        by = at[suffix_array(short.astype(np.int16), many)]
    out = np.empty(len(names), np.int32)
    firsts = np.cumsum(counts) - counts
    gone = np.flatnonzero(~kept)
    out[firsts[names[gone]]] = gone
    there = np.ones(len(names), bool)
    there[firsts[names[gone]]] = False
    out[there] = by  # in the order of their names, as suffixes are
    return out


def suffix_array(t: np.ndarray, size: int = 256) -> np.ndarray:
    """t: letters 0..size-1. Positions of all suffixes, sorted."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    t = t.astype(np.int16)
    small = _types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    new = np.zeros(n, np.int32)
    cut = np.flatnonzero(t[1:] != t[:-1]).astype(np.int32) + 1
    new[cut] = cut
    begin = np.maximum.accumulate(new)
    sa = _induce(t, size, begin, lms)
    if len(lms) > 1:
        by = sa[is_lms[sa]]
        # an LMS substring ends with the first letter of the next one; the last one is like no other
        span = np.zeros(n, np.int32)
        span[lms[:-1]] = np.diff(lms) + 1
        a, b = by[:-1], by[1:]
        same = (span[a] == span[b]) & (span[a] > 0)
        at = np.flatnonzero(same)
        same[at] = _equal(t, a[at], b[at], span[a[at]])
        name = np.empty(n, np.int32)
        name[by] = np.concatenate([[0], np.cumsum(~same)])
        many = int(name[by[-1]]) + 1
        lms = by if many == len(lms) else lms[_order(name[lms], many)]
        sa = _induce(t, size, begin, lms)
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the length that it shares with the suffix sorted before it (0 for the first)."""
    n = len(t)
    prev = np.full(n, -1, np.int32)
    prev[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    # the neighbour of i-1 must also have a neighbour for the value to follow
    follows[1:] = (prev[1:] > 0) & (prev[:-1] >= 0)
    r = np.flatnonzero(follows)
    follows[r] = t[r - 1] == t[prev[r] - 1]
    out = np.zeros(n, np.int32)
    own = np.flatnonzero(~follows & (prev >= 0))
    a, b = own.astype(np.int64), prev[own].astype(np.int64)
    most = n - np.maximum(a, b)
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    eight = np.ndarray((n + 1,), "<u8", padded, 0, (1,))
    k = np.zeros(len(own), np.int64)
    open_ = np.arange(len(own))
    while len(open_):
        x = eight[a[open_] + k[open_]] ^ eight[b[open_] + k[open_]]
        same = x == 0
        low = x & (~x + np.uint64(1))
        k[open_] += np.where(same, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
        open_ = open_[same & (k[open_] < most[open_])]
    out[own] = np.minimum(k, most)
    last = np.maximum.accumulate(np.where(follows, 0, np.arange(n, dtype=np.int32)))
    at = np.flatnonzero(follows)
    out[at] = out[last[at]] - (at - last[at])
    return out
