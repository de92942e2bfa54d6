"""The binary Golay code of 23 bits as a fuzzy hash.

Every 23-bit vector lies within 3 bits of exactly one of 4,096 codewords. The keys of a vector are the
codewords within 4 bits: its own one, and five more where its own is 3 bits away. Two vectors that
differ in 2 bits or fewer have a midpoint 1 bit from each, whose codeword is within 4 bits of both: they
share a key. If they differ in 1 bit or none, each one's own codeword is among the other's keys.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, CHECK = 23, 11
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
MOST = 6


def _remainder(v: int) -> int:
    for b in range(BITS - 1, CHECK - 1, -1):
        if v >> b & 1:
            v ^= GENERATOR << (b - CHECK)
    return v


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the lower 12 and upper 11 bits, and for each syndrome its patterns of 4 bits or fewer (the lightest first, -1 where none)."""
    single = [_remainder(1 << b) for b in range(BITS)]

    def linear(bits: list[int]) -> np.ndarray:
        out = np.zeros(1, dtype=np.int32)
        for s in bits:
            out = np.concatenate([out, out ^ s])
        return out

    patterns = np.full((1 << CHECK, MOST), -1, dtype=np.int64)
    used = [0] * (1 << CHECK)
    for weight in range(5):
        for at in combinations(range(BITS), weight):
            s = 0
            for b in at:
                s ^= single[b]
            if weight < 4 or used[s] and bin(patterns[s, 0]).count("1") == 3:
                patterns[s, used[s]] = sum(1 << b for b in at)
                used[s] += 1
    return linear(single[:12]), linear(single[12:]), patterns


def keys(v: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords that are v's keys, its own one first, -1 where there are fewer."""
    low, high, patterns = _tables()
    v = np.asarray(v, dtype=np.int64)
    flips = patterns[low[v & 0xFFF] ^ high[v >> 12]]
    return np.where(flips >= 0, (v[:, None] ^ flips) >> CHECK, -1)
