"""Words and word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from loomlog.llm.arrays import CHUNK_BYTES, flat, mix

BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**64, 256, np.uint64, endpoint=False), rng.integers(1, 2**64, 64, np.uint64, endpoint=False) | np.uint64(1)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i < n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b)]), dtype=np.uint64) for b in (BASE, inverse)]
    own = _powers[0], _powers[1]
    if n > 2 * CHUNK_BYTES:  # for a single very long word or text; not kept
        _powers.clear()
    return own


#: Bytes that words are made of: all but blanks; letters and digits (and what isn't ASCII); all but line ends.
VISIBLE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
ALPHANUMERIC = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
IN_LINE = np.array([b != 10 for b in range(256)])


def words(column: pa.Array, ink: np.ndarray = VISIBLE, fold: bool = True, most: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, runs of ``ink`` bytes, A-Z in lower case if ``fold``; where each row's words begin (one more
    for the end); the byte in the column at which each word begins.

    Long texts are read in parts of ``most`` bytes, cut between words, so memory follows the words and not the bytes."""
    data, at = flat(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64)
    hashes, begins, a = [], [], 0
    while a < len(data):
        b = min(a + most, len(data))
        while b < len(data) and not len(gaps := np.flatnonzero(~ink[data[a:b]])):  # a word longer than a part stays whole
            b = min(b + most, len(data))
        if b < len(data):
            b = a + int(gaps[-1]) + 1
        low, high = np.searchsorted(at, (a, b), "right")
        h, start = _words(data[a:b], np.concatenate([[0], at[low:high] - a, [b - a]]), ink, fold)
        hashes.append(h)
        begins.append(start + a)
        a = b
    starts = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(starts, at), starts


def _words(data: np.ndarray, at: np.ndarray, ink: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32) if fold else data
    ink = ink[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # words end with their text
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_constants()[0][low] * up[: len(low)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on (fewer places by k - 1)."""
    factors, n = _constants()[1], len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out += hashes[j : j + n] * factors[j]
    return mix(out)


def sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; of fewer words, the whole sequence as one."""
    hashes, at, _ = words(column)
    every, factors, out = grams(hashes, k), _constants()[1], []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            own = hashes[a:b] * factors[32 : 32 + b - a]
            out.append(mix(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
