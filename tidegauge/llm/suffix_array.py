"""Suffix arrays by induced sorting and permuted common prefixes, vectorised with numpy.

The suffixes are classified as smaller (S) or larger (L) than their successor. The leftmost S suffixes (LMS) are sorted
through their substrings: one induction from the LMS positions sorts the substrings, equal ones get the same
name, and the string of names is sorted recursively when names repeat. A second induction from the sorted LMS
suffixes gives the whole array. Inductions run bucket by bucket: all members of a bucket that are known at a time
place their predecessors in one step, in order, so the work is linear and done in array operations.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last suffix (smallest symbol, unique) is S."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # at these, the next symbol decides
    up = text[change + 1] > text[change]
    s = np.ones(n, bool)
    if len(change):
        at = np.searchsorted(change, np.arange(n - 1))
        inside = at < len(change)
        s[: n - 1][inside] = up[at[inside]]
    return s


def _induce(text: np.ndarray, s: np.ndarray, lms: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The suffix order induced from LMS positions that are ordered within each first symbol."""
    n, k = len(text), len(first)
    sa = np.full(n, -1, np.int64)
    by = text[lms]
    lms_at = np.searchsorted(by, np.arange(k + 1)) if len(by) < 2 or (by[1:] >= by[:-1]).all() else None
    if lms_at is None:
        order = np.argsort(by, kind="stable")
        lms, by = lms[order], by[order]
        lms_at = np.searchsorted(by, np.arange(k + 1))
    head, larger = first.copy(), ~s
    for c in range(k):
        done = first[c]
        while done < head[c]:  # L suffixes of this bucket in order; each step may add some
            now = sa[done : head[c]]
            done = head[c]
            _place(_append, sa, head, now, larger, text)
        _place(_append, sa, head, lms[lms_at[c] : lms_at[c + 1]], larger, text)
    tail = last.copy()  # one past the next free place, from the right
    for c in range(k - 1, -1, -1):
        done = last[c]
        while tail[c] < done:
            now = sa[tail[c] : done][::-1]
            done = tail[c]
            _place(_prepend, sa, tail, now, s, text)
        _place(_prepend, sa, tail, sa[first[c] : head[c]][::-1], s, text)
    if s[n - 1] and n > 1:
        sa[0] = n - 1  # the end symbol has no successor to induce it
    return sa


def _place(put, sa: np.ndarray, edge: np.ndarray, now: np.ndarray, wanted: np.ndarray, text: np.ndarray) -> None:
    """Put the predecessors that are of the wanted type into their buckets."""
    before = now[now > 0] - 1
    before = before[wanted[before]]
    if len(before):
        put(sa, edge, before, text[before])


def _spread(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]]))
    count = np.diff(np.append(start, len(symbols)))
    rank = np.arange(len(symbols)) - np.repeat(start, count)
    return order, sorted_symbols, rank, np.column_stack([sorted_symbols[start], count])


def _append(sa: np.ndarray, head: np.ndarray, places: np.ndarray, symbols: np.ndarray) -> None:
    order, symbol, rank, counts = _spread(symbols)
    sa[head[symbol] + rank] = places[order]
    head[counts[:, 0]] += counts[:, 1]


def _prepend(sa: np.ndarray, tail: np.ndarray, places: np.ndarray, symbols: np.ndarray) -> None:
    order, symbol, rank, counts = _spread(symbols)
    sa[tail[symbol] - 1 - rank] = places[order]
    tail[counts[:, 0]] -= counts[:, 1]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of an integer string whose last symbol is smaller than all others and occurs once."""
    text = np.ascontiguousarray(text)
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    k = int(text.max()) + 1
    count = np.bincount(text, minlength=k)
    last = np.cumsum(count)
    first = last - count
    if k > max(1000, n // 64):
        return _many_symbols(text)
    if k <= 1 << 16:
        text = text.astype(np.uint16)  # sorted by radix
    s = _types(text)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    sa = _induce(text, s, lms, first, last)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]  # LMS positions by their substrings
    number = np.cumsum(is_lms) - 1  # of the LMS positions, by place
    names = np.zeros(len(lms), np.int64)
    end = np.append(lms[1:], n - 1)
    length = end - lms + 1
    own = number[ordered]
    differs = _differ(text, ordered, length[own])
    names[own] = np.cumsum(np.concatenate([[0], differs])) if len(ordered) else 0
    if len(lms) > 1:
        sub = suffix_array(names) if names.max() + 1 < len(lms) else np.argsort(names)
        lms = lms[sub]
    return _induce(text, s, lms, first, last)


def _differ(text: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each LMS substring differs from the one before it in order."""
    out = length[1:] != length[:-1]
    left = np.flatnonzero(~out)
    i = 0
    while len(left):
        a, b = at[left] + i, at[left + 1] + i
        unequal = text[a] != text[b]
        out[left[unequal]] = True
        i += 1
        left = left[~unequal & (i < length[left])]
    return out


def _many_symbols(text: np.ndarray) -> np.ndarray:
    """Order of the string of names, the base of the recursion: with so many symbols buckets are too small to be worth a
    step each. Ranks are refined over doubled lengths; places whose rank is already unique drop out."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    start = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))  # the first place of the group in order
    width = 1
    while True:
        alone = start & np.append(start[1:], True)
        at = np.flatnonzero(~alone)  # places in order that are not settled
        if not len(at):
            return order
        own = order[at]
        after = np.minimum(own + width, n - 1)
        nxt = np.where(own + width < n, rank[after], -1)
        group = rank[own]
        key = group * (n + 1) + nxt + 1
        sub = np.argsort(key, kind="stable")
        order[at] = own[sub]
        key = key[sub]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start[at] = new
        rank[order[at]] = np.maximum.accumulate(np.where(new, at, 0))
        width *= 2


def permuted_lcp(text: np.ndarray, sa: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): for every position the position before it in suffix order (-1: none), and their common prefix.

    A common prefix is one less than that of the position to the left when the symbols before both are equal; only
    the others are compared, symbol by symbol up to ``cap`` symbols. Values from ``cap`` on are lower bounds.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    known = (place > 0) & (phi > 0)
    known[known] = text[place[known] - 1] == text[phi[known] - 1]
    known &= np.concatenate([[False], phi[:-1] == phi[1:] - 1])
    start = np.flatnonzero(~known)
    lcp = np.zeros(len(start), np.int64)
    left = np.flatnonzero(phi[start] >= 0)
    a, b = start[left], phi[start[left]]
    # lengths are compared up to the cap plus the chain that hangs on them
    chain = np.diff(np.append(start, n))
    want = cap + chain[left]
    i = 0
    while len(left):
        inside = (np.maximum(a, b) + i < n) & (i < want)
        left, a, b, want = left[inside], a[inside], b[inside], want[inside]
        same = text[a + i] == text[b + i]
        left, a, b, want = left[same], a[same], b[same], want[same]
        i += 1
        lcp[left] = i
    out = np.repeat(lcp, chain) - (place - np.repeat(start, chain))
    return phi, np.maximum(out, 0)
