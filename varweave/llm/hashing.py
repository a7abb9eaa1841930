"""Vectorised hashes of the words of many texts at once."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1
_NOT_WORD = re.compile(r"[^\x00-\x7f]")

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n."""
    inverse = pow(_P, -1, 1 << 64)
    out = []
    for base in (_P, inverse):
        p = np.full(n + 1, np.uint64(base), np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[start:end], equal for equal bytes."""
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def plain_words(text: str) -> bytes:
    """The text in lower case, where exactly the bytes of WORD_BYTES are letters and digits."""
    low = text.lower()
    if not low.isascii():
        low = _NOT_WORD.sub(lambda m: m[0] if m[0].isalnum() else " ", low)
    return low.encode("utf-8", "replace")


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in order, and the number of words before each text (one entry more)."""
    parts = [plain_words(t) for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    inside = WORD_BYTES[data]
    flips = np.flatnonzero(np.diff(np.r_[False, inside].view(np.int8)))
    starts, ends = flips[0::2], flips[1::2]
    borders = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=borders[1:])
    return span_hashes(data, starts, ends), np.searchsorted(starts, borders)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, by the position of its first."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = words[:m].copy()
    for j in range(1, n):
        h *= np.uint64(_Q)
        h += words[j : m + j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))
