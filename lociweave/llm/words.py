"""Words of UTF-8 text as 64-bit hashes, for whole batches of documents at a time.

A word is a run of word bytes inside one document. Its hash is a polynomial in an
odd multiplier modulo 2**64, taken from one running sum over the batch, and mixed.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C55
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: A-Z become a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space separates: all but \x20 and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of lower-cased letters, digits and non-ASCII characters.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown in steps and kept by the worker."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        factors = np.full(1 << max(21, int(n - 1).bit_length()), base, np.uint64)
        factors[0] = 1
        kept = _powers[base] = np.cumprod(factors, dtype=np.uint64)
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each document the index of its first word (one more at the end).

    data, offsets: the documents' bytes and where each begins. ASCII letters count as lower case.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = word_bytes[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1] | first[1:-1]
    ends_here = inside.copy()
    ends_here[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_power(_MULTIPLIER, n) * (LOWER[data].astype(np.uint64) + np.uint64(1)), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power(_INVERSE, n)[starts])
    return hashes, np.searchsorted(starts, offsets)


def ragged_arange(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
