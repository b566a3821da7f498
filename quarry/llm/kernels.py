"""Vectorised text kernels: words, 64-bit hashes of words and of word sequences.

A sequence x has the hash sum(t(x[i]) * B**i) mod 2**64 with B odd, so that
the hash of any stretch comes from two prefix sums and a multiplication by the
inverse power; a finaliser then mixes all bits. Two different sequences agree
with a probability of about 2**-60.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 3
_MASK = (1 << 64) - 1
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: White space of the word contracts: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything in ASCII but letters and digits.
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Everything in ASCII but letters.
NON_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _grow(base: int, n: int, old: np.ndarray) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[: len(old)] = old
    have = len(old)
    while have < n:  # out[have + i] = base**have * out[i]
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        _pow = _grow(_BASE, size, _pow)
        _inv = _grow(pow(_BASE, -1, 1 << 64), size, _inv)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words of all texts; text d has words first[d] to first[d + 1]."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~sep[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches units[start:end]; the length takes part."""
    n = len(units)
    pow_, inv = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(units * pow_[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE[data], starts, ends)


def gram_hashes(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each run of k words inside one text; starts ascend."""
    n = np.diff(first)
    ok = np.ones(len(word), bool)
    tail = np.minimum(n, k - 1)
    idx = np.repeat(first[1:] - tail, tail) + (np.arange(int(tail.sum())) - np.repeat(np.cumsum(tail) - tail, tail))
    ok[idx] = False
    at = np.flatnonzero(ok)
    return span_hashes(word, at, at + k), at
