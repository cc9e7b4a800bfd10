"""Whole columns of text as numpy arrays of words, hashes and shingles.

Words are the maximal runs outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z, which can be
found on UTF-8 bytes. A word's 64-bit hash comes from prefix sums of a polynomial over the bytes,
so that a block of texts costs a fixed number of vector passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True

_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets between them; a null is an empty text."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:  # filling copies the texts, so only where it must be
        column = pc.fill_null(column, "")
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    body, at = buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last, body[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words begin (one more entry than texts)."""
    return located_words(body, at)[:2]


def located_words(body: np.ndarray, at: np.ndarray, fold: bool = True, tails: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, with the places in ``body`` where every word begins and ends.

    Without ``fold`` the hashes tell A-Z from a-z. ``tails`` marks bytes that, as the last of a word
    behind an ASCII letter or digit, are no part of it.
    """
    n = len(body)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), none, none
    low, gap = _LOWER[body] if fold else body, _GAP[body]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    before |= edge[:n]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after |= edge[1:]
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    first = np.searchsorted(starts, at)
    if tails is not None:
        ends -= tails[body[ends - 1]] & (ends - starts > 1) & _PLAIN[body[np.maximum(ends - 2, 0)]]
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, first, starts, ends


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which distinct hash each is, the distinct hashes in order, a place of each of them)."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(hashes), np.int64)
    which[order] = np.cumsum(new) - 1
    return which, ordered[new], order[new]


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word shingle in order, and where each text's begin.

    A text of fewer words has its whole sequence as the one shingle, a text without words none.
    """
    n = len(hashes)
    count = np.diff(first)
    out = np.zeros(n, np.uint64)
    if n >= k:
        h = hashes[: n - k + 1].copy()
        for j in range(1, k):
            h = mix(h * np.uint64(_BASE) + hashes[j : n - k + 1 + j])
        out[: n - k + 1] = h
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    for d in np.flatnonzero((count > 0) & (count < k)):
        h = np.uint64(count[d])
        for x in hashes[first[d] : first[d + 1]]:
            h = _chain(int(h), int(x))
        out[first[d]] = h
    begin = np.zeros(len(first), np.int64)
    np.cumsum(size, out=begin[1:])
    keep = np.repeat(first[:-1] - begin[:-1], size) + np.arange(begin[-1])
    return out[keep], begin


def _chain(h: int, x: int) -> np.uint64:
    h = (h * _BASE + x) & 0xFFFFFFFFFFFFFFFF
    h = ((h ^ (h >> 30)) * int(_M1)) & 0xFFFFFFFFFFFFFFFF
    h = ((h ^ (h >> 27)) * int(_M2)) & 0xFFFFFFFFFFFFFFFF
    return np.uint64(h ^ (h >> 31))


def give_back() -> None:
    """Hand freed memory back to the system: workers are kept, and the next task's arrays differ."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """A function for ``mapInArrow`` that gives its memory back when its partition is done."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped
