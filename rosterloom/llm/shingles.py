"""Word shingles of whole texts as 64-bit hashes, a block of texts at a time in numpy.

Words are runs of characters other than the space and U+0009 to U+000D, with
A-Z in lower case.  A text's set holds its distinct five-word shingles; a text
of one to four words has its whole sequence as its only element.  Elements are
64-bit hashes; two different elements share one with a probability of about
2^-64, which is the only respect in which the sets are not the texts' own.
"""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])
        return self.up, self.down


_POWERS = _Powers()


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct element hashes of each text."""
    if not texts:
        return []
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in texts]
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    n = max(0, len(words) - SHINGLE_WORDS + 1)
    windows = words[:n] * _PLACE[0]
    for k in range(1, SHINGLE_WORDS):
        windows += words[k : k + n] * _PLACE[k]
    windows = mix(windows)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE_WORDS:
            part = np.sort(windows[a : b - SHINGLE_WORDS + 1])
            out.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
        elif b > a:
            whole = np.uint64(b - a)
            whole = mix(np.array([whole + (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)], np.uint64) ^ _M2)
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_hash(elements: np.ndarray) -> int:
    """A signed 64-bit hash of a set, alike for equal sets."""
    total = (3 * int(mix(elements ^ _M1).sum(dtype=np.uint64)) + len(elements)) % (1 << 64)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
