"""Words of whole texts as 64-bit hashes, for many texts at once (numpy, inside tasks).

A word is a run of ``[^\\x20\\x09-\\x0D]``. A word's hash is a polynomial of its bytes, mixed; a window's
hash is a weighted sum of its words' hashes, mixed. Neither depends on where the text lies in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text handled at once; a longer text is handled alone
PIECE = 1 << 18  # the same where two workers share an executor's memory with much else: some 60 bytes are held for each

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all (the splitmix64 finalizer)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BASE = 0x9E3779B97F4A7C15  # odd
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = {lower: randoms(256, 11)[_LOWER if lower else np.arange(256)] for lower in (False, True)}
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = (1 << max(n - 2, 0).bit_length()) + 1  # at least ``n``; ``CHUNK + 1`` for a chunk
        base = np.full(size, _BASE if which == "up" else _INVERSE, dtype=_U)
        base[0] = 1
        have = np.cumprod(base, dtype=_U)
        if n <= CHUNK + 1:
            _powers[which] = have
    return have


class Words(NamedTuple):
    """Words of the rows ``lo`` to ``hi`` of a batch: their hashes, byte ranges in ``data``, first word of each row."""

    lo: int
    hi: int
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # one more than rows
    data: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def word_chunks(texts: pa.Array, lower: bool = False, most: int = CHUNK) -> Iterator[Words]:
    """Cut a string column (nulls count as empty) into pieces of about ``most`` bytes and hash their words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield _words(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower)
        lo = hi


def _words(lo: int, hi: int, data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(lo, hi, none.astype(_U), none, none, np.zeros(hi - lo + 1, dtype=np.int64), data)
    ink = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | cut[1:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(_BYTES[lower][data] * _power("up", n)[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _power("down", n + 1)[start])
    return Words(lo, hi, hashes, start, end, np.searchsorted(start, offsets), data)


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``k`` successive words; ``len(hashes) - k + 1`` values (none if there are fewer words)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    factors = randoms(k, 1000 * seed + k) | _U(1)
    out = hashes[:n] * factors[0]
    for j in range(1, k):
        out += hashes[j : n + j] * factors[j]
    return mix(out)


def within(first: np.ndarray, k: int) -> np.ndarray:
    """Which windows of ``k`` words, over the words of many rows, lie in a single row."""
    n = max(0, int(first[-1]) - k + 1)
    ok = np.ones(n, dtype=bool)
    for cut in range(1, k):
        at = first[1:-1] - cut
        ok[at[(at >= 0) & (at < n)]] = False
    return ok
