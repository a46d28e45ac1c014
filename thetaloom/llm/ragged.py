"""Texts of an Arrow batch as bytes with offsets, and words, hashes and runs on them, in whole-array steps.

A null text is an empty one. Work goes over slices of whole rows of about ``SLICE`` bytes, so that the arrays of a step
stay small however many rows a batch has; a single longer row is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1_000_000
"""Bytes of text that one step works on."""

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after another, and the offset of each row and of the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kept = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(kept):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = kept.buffers()
    offsets = np.frombuffer(places, np.int64)[kept.offset : kept.offset + len(kept) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return content[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes together, at least one row each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _grown(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for at, base in enumerate((_BASE, _INVERSE)):
            column = np.full(max(size, SLICE + SLICE // 4), base, U64)
            column[0] = 1
            _powers[at] = np.multiply.accumulate(column)
    return _powers[0], _powers[1]


def forget() -> None:
    """Drop the kept powers."""
    _powers[:] = [np.ones(1, U64), np.ones(1, U64)]


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross rows: starts, ends, and per row the index of its first run."""
    size = len(member)
    if not size:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    inner = offsets[(offsets > 0) & (offsets < size)]
    first[inner] = member[inner]
    last[inner - 1] = member[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    up, down = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def windows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive hashes."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, U64)
    total = hashes[:count].copy()
    for at in range(1, size):
        total = mixed(total + U64(at)) + hashes[at : at + count]
    return mixed(total)


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of many ranges, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def joined_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted half-open ranges with overlapping and touching ones made one."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.flatnonzero(starts[1:] > reach[:-1]) + 1
    return starts[np.r_[0, new]], reach[np.r_[new - 1, len(starts) - 1]]


class Memo:
    """Results by hash that a Python worker keeps from batch to batch, so that a frequent word is worked out once. At
    most ``most`` hashes are kept; when they are reached it starts anew, which changes the cost and no result."""

    def __init__(self, most: int = 250_000):
        self.most = most
        self._keys, self._places = np.zeros(0, U64), np.zeros(0, np.int64)

    def places(self, keys: np.ndarray, make) -> np.ndarray:
        """The place of each of the sorted distinct ``keys``; ``make(indices, fresh)`` works out those it hasn't, whose
        places follow those of before, or start at 0 where ``fresh``."""
        at = np.minimum(np.searchsorted(self._keys, keys), max(len(self._keys) - 1, 0))
        new = np.flatnonzero(self._keys[at] != keys) if len(self._keys) else np.arange(len(keys))
        fresh = len(self._keys) + len(new) > self.most
        if fresh:
            self._keys, self._places, new = np.zeros(0, U64), np.zeros(0, np.int64), np.arange(len(keys))
        if len(new) or fresh:
            make(new, fresh)
            added = len(self._keys) + np.arange(len(new))
            order = np.searchsorted(self._keys, keys[new])
            self._places = np.insert(self._places, order, added)
            self._keys = np.insert(self._keys, order, keys[new])
        return self._places[np.searchsorted(self._keys, keys)]
