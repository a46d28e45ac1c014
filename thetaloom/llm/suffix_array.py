"""Suffix arrays by induced sorting and permuted common prefixes, as whole-array steps.

A suffix is S if it is smaller than the next one and L if greater; an S suffix after an L suffix is leftmost-smaller
(LMS). Sorted LMS suffixes induce all L suffixes in one pass over the buckets of first symbols and all S suffixes in one
pass back, so the work is linear. Here a bucket is one step: what its suffixes induce is placed at once, and only
suffixes that fall into the bucket itself (runs of one symbol) take further steps.

LMS substrings are sorted by the same induction and named; the string of names is sorted recursively. Where names are
nearly as many as symbols, buckets hold a few suffixes each, and ranks of doubled length finish the recursion instead.
"""

from __future__ import annotations

import numpy as np

FEW = 48
"""Symbols of a recursive string per distinct name, below which ranks are doubled."""


def types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last one, which the empty suffix precedes, is L."""
    size = len(text)
    rising = np.zeros(size, bool)
    edges = np.flatnonzero(text[1:] != text[:-1])
    run = np.diff(np.r_[-1, edges, size - 1])
    kind = np.r_[text[edges] < text[edges + 1], False]
    rising[:] = np.repeat(kind, run)
    return rising


def _induced(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix order that LMS suffixes, given in order, induce."""
    size = len(text)
    counts = np.bincount(text, minlength=sigma)
    lows = np.cumsum(counts) - counts
    highs = lows + counts
    smalls = np.bincount(text[small], minlength=sigma)
    order = np.full(size, -1, np.int32)
    # L suffixes, from the least bucket on. Each bucket's seeds come after its L suffixes.
    heads = lows.copy()
    by_symbol = seeds[np.argsort(text[seeds], kind="stable")]
    seed_ends = np.cumsum(np.bincount(text[seeds], minlength=sigma))
    seed_starts = np.r_[0, seed_ends[:-1]]

    def place_large(found: np.ndarray, symbol: int) -> None:
        before = found[found > 0] - 1
        before = before[~small[before]]
        symbols = text[before]
        # Those of the same symbol continue this bucket; both kinds keep the order of what induced them.
        put = np.argsort(symbols, kind="stable")
        before, symbols = before[put], symbols[put]
        if len(before):
            edges = np.r_[0, np.flatnonzero(symbols[1:] != symbols[:-1]) + 1]
            lengths = np.diff(np.r_[edges, len(symbols)])
            firsts = symbols[edges]
            order[np.repeat(heads[firsts] - edges, lengths) + np.arange(len(symbols))] = before
            heads[firsts] += lengths

    last = size - 1
    order[heads[text[last]]] = last
    heads[text[last]] += 1
    for symbol in np.flatnonzero(counts):
        done = lows[symbol]
        while done < heads[symbol]:
            upto = heads[symbol]
            place_large(order[done:upto], symbol)
            done = upto
        if seed_ends[symbol] > seed_starts[symbol]:
            place_large(by_symbol[seed_starts[symbol] : seed_ends[symbol]], symbol)
    # S suffixes, from the greatest bucket back; the seeds are placed anew.
    tails = highs.copy()

    def place_small(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[small[before]]
        symbols = text[before]
        put = np.argsort(symbols, kind="stable")
        before, symbols = before[put], symbols[put]
        if len(before):
            edges = np.r_[0, np.flatnonzero(symbols[1:] != symbols[:-1]) + 1]
            lengths = np.diff(np.r_[edges, len(symbols)])
            firsts = symbols[edges]
            order[np.repeat(tails[firsts] + edges, lengths) - np.arange(len(symbols)) - 1] = before
            tails[firsts] -= lengths

    for symbol in np.flatnonzero(counts)[::-1]:
        done = highs[symbol]
        while done > tails[symbol]:
            upto = tails[symbol]
            place_small(order[upto:done][::-1])
            done = upto
        large = counts[symbol] - smalls[symbol]
        if large:
            place_small(order[lows[symbol] : lows[symbol] + large][::-1])
    return order


def doubled(names: np.ndarray) -> np.ndarray:
    """The suffix order of a string by ranks of doubled length."""
    size, length = len(names), 1
    rank = names.astype(np.int64)
    while True:
        following = np.zeros(size, np.int64)
        following[: size - length] = rank[length:] + 1
        key = rank * (following.max() + 1) + following
        order = np.argsort(key, kind="stable")
        sorted_keys = key[order]
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(np.r_[False, sorted_keys[1:] != sorted_keys[:-1]])
        if rank[order[-1]] == size - 1 or length >= size:
            return order.astype(np.int32)
        length *= 2


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` (integers in [0, sigma)) in order."""
    size = len(text)
    if size < 2:
        return np.arange(size, dtype=np.int32)
    small = types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        # Any order of the seeds sorts the LMS substrings.
        order = _induced(text, small, lms, sigma)
        is_lms = np.zeros(size, bool)
        is_lms[lms] = True
        sorted_lms = order[is_lms[order]]
        names = np.zeros(size, np.int64)
        new = ~_equal_substrings(text, lms, sorted_lms)
        names[sorted_lms] = np.cumsum(np.r_[False, new])
        reduced = names[lms]
        distinct = int(reduced.max()) + 1
        if distinct < len(lms):
            places = suffix_array(reduced, distinct) if distinct * FEW <= len(lms) else doubled(reduced)
            sorted_lms = lms[places]
        lms = sorted_lms
    return _induced(text, small, lms, sigma)


def _equal_substrings(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each LMS substring but the first equals the one before it in ``order``. A substring reaches to the next
    LMS place, which counts; the last one reaches to the end and equals none."""
    size = len(text)
    length = np.zeros(size, np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    a, b = order[:-1], order[1:]
    equal = (length[a] == length[b]) & (length[a] > 0)
    left = np.flatnonzero(equal)
    step = 0
    while len(left):
        match = text[a[left] + step] == text[b[left] + step]
        equal[left[~match]] = False
        left = left[match]
        step += 1
        left = left[length[a[left]] > step]
    return equal


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, wanted: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each place of ``wanted`` (a mask) how many bytes its suffix shares with the one before
    it in ``order``, at most ``most``; 0 elsewhere. Whole words are compared, and only of places that still agree."""
    size = len(data)
    before = np.full(size, -1, np.int32)
    before[order[1:]] = order[:-1]
    out = np.zeros(size, np.int32)
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    words = np.ndarray((size + most,), "<u8", buffer=padded, strides=(1,))
    left = np.flatnonzero(wanted & (before >= 0))
    for step in range(0, most, 8):
        differ = words[left + step] ^ words[before[left] + step]
        stop = differ != 0
        first = differ[stop]
        out[left[stop]] = step + np.bitwise_count((first & (~first + np.uint64(1))) - np.uint64(1)) // 8
        left = left[~stop]
    out[left] = most
    return np.minimum(out, most)
