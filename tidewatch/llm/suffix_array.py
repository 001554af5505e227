"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Induced sorting classifies suffixes as larger (L) or smaller (S) than their successors, sorts the
substrings between leftmost smaller positions (LMS), names them, sorts the string of names
recursively and induces the whole order from that of the LMS suffixes.  The two induction
scans go bucket by bucket: all suffixes of a bucket give their predecessors at once, and a bucket is
scanned again only for predecessors that fall into itself (runs of one symbol).

A string of names with a large alphabet for its length (few suffixes in a bucket) is sorted by doubling instead.
"""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 1 << 12


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S.  The last symbol is the unique smallest."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    at = np.searchsorted(differs, np.arange(n - 1))
    out = np.ones(n, bool)
    rises = t[:-1] < t[1:]
    out[:-1] = rises[differs[at]]
    return out


def _scan(t: np.ndarray, wanted: np.ndarray, known: list[np.ndarray], counts: np.ndarray, symbols: range) -> np.ndarray:
    """The suffixes ``wanted`` in the order of induction, grouped by symbol in the order of ``symbols``.

    ``known``: for each symbol the suffixes of the other type in that bucket, in scan order.
    ``counts``: how many wanted suffixes each bucket has.
    """
    begin = np.zeros(len(counts), np.int64)
    order = np.fromiter(symbols, np.int64, len(counts))
    begin[order] = np.cumsum(counts[order]) - counts[order]
    out = np.empty(int(counts.sum()), np.int64)
    at = begin.copy()
    for c in order.tolist():
        low, done = int(begin[c]), int(begin[c])
        # runs of c: a scan of the bucket extends the bucket
        while done < at[c]:
            source = out[done : at[c]]
            done = int(at[c])
            before = source[source > 0] - 1
            before = before[wanted[before] & (t[before] == c)]
            out[done : done + len(before)] = before
            at[c] += len(before)
        source = np.concatenate([out[low:done], known[c]])
        before = source[source > 0] - 1
        before = before[wanted[before]]
        symbol = t[before]
        far = symbol != c
        before, symbol = before[far], symbol[far]
        if len(before):
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            first = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
            size = np.diff(np.append(first, len(symbol)))
            out[np.repeat(at[symbol[first]] - first, size) + np.arange(len(symbol))] = before
            at[symbol[first]] += size
    return out


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """The order of all suffixes (LMS substrings, at first) induced from that of ``lms``."""

    def split(suffixes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        return np.split(suffixes, np.cumsum(counts)[:-1])

    by = np.argsort(t[lms], kind="stable")
    known = split(lms[by], np.bincount(t[lms], minlength=alphabet))
    n_large, n_small = np.bincount(t[~small], minlength=alphabet), np.bincount(t[small], minlength=alphabet)
    large = _scan(t, ~small, known, n_large, range(alphabet))
    large_of = split(large, n_large)
    down = _scan(t, small, [x[::-1] for x in large_of], n_small, range(alphabet - 1, -1, -1))
    # the sentinel has no successor that could induce it
    down_of = split(down, n_small[::-1])[::-1]
    parts: list[np.ndarray] = [np.array([len(t) - 1])]
    for c in range(1, alphabet):
        parts += [large_of[c], down_of[c][::-1]]
    return np.concatenate(parts)


def _by_doubling(t: np.ndarray) -> np.ndarray:
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    n, step = len(t), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


def _same_substrings(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` symbols from ``a`` and from ``b`` are equal."""
    equal = np.ones(len(a), bool)
    alive = np.arange(len(a))
    k = 0
    while len(alive):
        differ = t[a[alive] + k] != t[b[alive] + k]
        equal[alive[differ]] = False
        alive = alive[~differ]
        k += 1
        alive = alive[size[alive] > k]
    return equal


def _sorted_suffixes(t: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array of ``t``, whose last symbol is 0 and occurs nowhere else."""
    n = len(t)
    if n < 3 or alphabet > SMALL_ALPHABET or alphabet > n:
        return _by_doubling(t)
    small = _types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    order = _induce(t, small, lms, alphabet)
    ranked = order[is_lms[order]]
    size = np.zeros(n, np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    size[lms[-1]] = 1
    a, b = ranked[:-1], ranked[1:]
    same = size[a] == size[b]
    same[same] = _same_substrings(t, a[same], b[same], size[a[same]])
    names = np.concatenate([[0], np.cumsum(~same)])
    name = np.empty(n, np.int64)
    name[ranked] = names
    if names[-1] + 1 < len(lms):
        ranked = lms[_sorted_suffixes(name[lms], int(names[-1]) + 1)]
    return _induce(t, small, ranked, alphabet)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of an array of bytes or other small non-negative integers."""
    data = np.asarray(data)
    if not len(data):
        return np.empty(0, np.int64)
    used = np.unique(data)
    code = np.zeros(int(used[-1]) + 1, np.int16 if len(used) < 1 << 14 else np.int64)
    code[used] = np.arange(1, len(used) + 1)
    t = np.append(code[data], code.dtype.type(0))
    return _sorted_suffixes(t, len(used) + 1)[1:]


def permuted_common_prefixes(data: np.ndarray, order: np.ndarray, symbols: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix, in text order: its predecessor in ``order`` (-1: none) and their common prefix's length.

    A suffix whose predecessor has the same symbol before it has one less in common than the
    suffix before it; only the others are compared, eight bytes at a time.  ``symbols``: what
    ``order`` was made from, where it tells more than the bytes in ``data``.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    prefix = np.zeros(n, np.int64)
    if n < 2:
        return before, prefix
    at = np.arange(n)
    symbols = data if symbols is None else symbols
    left, right = symbols[at - 1], symbols[before - 1]
    follows = (at > 0) & (before > 0) & (left == right)
    # words of eight bytes from each place; zeros after the end, told apart by the length
    longer = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.zeros(n + 8, np.uint64)
    for k in range(8):
        word |= longer[k : n + 8 + k].astype(np.uint64) << np.uint64(8 * k)
    heads = np.flatnonzero(~follows)
    alive = heads[before[heads] >= 0]
    length = np.zeros(n, np.int64)
    while len(alive):
        a, b = alive + length[alive], before[alive] + length[alive]
        ok = (a < n) & (b < n)
        differ = np.ones(len(alive), np.uint64)
        differ[ok] = word[a[ok]] ^ word[b[ok]]
        full = ok & (differ == 0)
        length[alive[full]] += 8
        part = ok & ~full
        low = differ[part] & (~differ[part] + np.uint64(1))
        length[alive[part]] += (np.log2(low.astype(np.float64)) // 8).astype(np.int64)
        alive = alive[full]
    length[heads] = np.minimum(length[heads], n - np.maximum(heads, before[heads]))
    head = np.maximum.accumulate(np.where(follows, 0, at))
    return before, np.maximum(length[head] - (at - head), 0)
