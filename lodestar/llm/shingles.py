"""Word and shingle hashes of whole texts with numpy: a few array passes, no Python loop over words."""

from __future__ import annotations

import numpy as np

_P, _Q, _MASK = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, (1 << 64) - 1
#: Powers of a base that a worker keeps (8 bytes each); texts of up to so many bytes need no more.
HELD = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int, name: str) -> np.ndarray:
    """base^0 .. base^n modulo 2^64; up to HELD of them are kept in the worker, longer tables are not."""
    import sys

    held = sys.modules.setdefault("_lodestar_held", type(sys)("_lodestar_held"))
    p = getattr(held, name, None)
    if p is None or len(p) <= n:
        p = np.full(1 << max(16, int(n + 1).bit_length()), base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        if len(p) <= HELD:
            setattr(held, name, p)
    return p


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of each word (divided at U+0020 and U+0009 to U+000D) of UTF-8 text."""
    if not raw:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = _powers(_P, len(b), "word_powers")
    inverse = _powers(pow(_P, -1, 1 << 64), len(b), "word_inverse")
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_byte_values()[b] * power[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Ranges:
    """Hashes of any runs of consecutive words."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * _powers(_Q, self.n, "range_powers")[: self.n], out=self.sums[1:])
        self.inverse = _powers(pow(_Q, -1, 1 << 64), self.n, "range_inverse")

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def all(self, k: int) -> np.ndarray:
        """Every run of k words, in order."""
        at = np.arange(max(0, self.n - k + 1))
        return self(at, at + k)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles in order; a text of 1 to k-1 words is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    r = Ranges(words)
    return r.all(k) if len(words) >= k else r(np.array([0]), np.array([len(words)]))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1])
