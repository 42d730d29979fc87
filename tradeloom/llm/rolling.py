"""Rabin-Karp hashes of windows of words, in numpy.

A word has two independent 64-bit values (both halves of its XXH3-128). Window hashes are polynomials of them modulo 2^64 with odd bases, so
powers have inverses and all windows follow from one running sum. Over a window's few words such a polynomial loses 13 bits at worst
(alternating words in Thue-Morse order), whatever the words; over a word's bytes it would lose them all.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed odd numbers: bases of windows and of their parts, and mixing factors.
MIX_MORE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
ANCHOR_BASE = 0xC2B2AE3D27D4EB4F
MIX = 0xBF58476D1CE4E5B9
#: Powers in the tables that are kept.
CHUNK = 1 << 22

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a base and of its inverse modulo 2^64; tables up to CHUNK are kept."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        length = max(1 << 14, 1 << (n - 1).bit_length())
        tables = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(length - 1, b, dtype=np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
        if length > CHUNK:
            return tables[0][:n], tables[1][:n]
        _POWERS[base] = tables
    return _POWERS[base][0][:n], _POWERS[base][1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_MORE)
    return h ^ (h >> np.uint64(31))


def windows(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """The polynomial hash of every ``size`` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, len(values))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up)])
    return (sums[size:] - sums[:-size]) * down[:n]


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype="<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def content_hashes(words: list[bytes], starts: np.ndarray, size: int) -> np.ndarray:
    """XXH3-64 of the bytes of the windows at ``starts`` (ascending), their words joined by one space."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh3_64_intdigest
    spans = zip(begins[starts].tolist(), ends[starts + size - 1].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b]) for a, b in spans), dtype=np.uint64, count=len(starts))


def running_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
