"""Exact division of many amounts in two: subset sums met in the middle, or all reachable sums as bits of one number."""

from __future__ import annotations

import numpy as np

#: Up to so many amounts halves are enumerated: a million sums each.
MIDDLE = 40
#: Beyond, sums are bits: so many bits in all (128 MB).
MOST_BITS = 1 << 30
EPS = 1e-9


def _scores(s: np.ndarray, total: int, targets: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Largest relative deviation and sum of gaps where the first side has ``s`` cents."""
    a, b = np.abs(s / 100 - targets[0]), np.abs((total - s) / 100 - targets[1])
    return np.maximum(a / max(targets[0], EPS), b / max(targets[1], EPS)), a + b


def _ideal(total: int, targets: list[float]) -> float:
    """Cents of the first side where both deviations are alike; the score grows on both sides of it."""
    one, other = (max(t, EPS) for t in targets)
    return 100 * (targets[0] * other + (total / 100 - targets[1]) * one) / (one + other)


def _all_sums(cents: list[int]) -> np.ndarray:
    """The sum of every subset, by mask."""
    out = np.zeros(1, dtype=np.int64)
    for c in cents:
        out = np.concatenate([out, out + c])
    return out


def _nearest(highs: np.ndarray, high_sums: np.ndarray, low_sums: np.ndarray, lows: np.ndarray, total: int, targets: list[float]) -> tuple | None:
    """The best of ``highs`` with any low subset: scores and masks."""
    if not len(highs) or not len(lows):
        return None
    sums, first = np.unique(low_sums, return_index=True)  # of equal sums the smallest mask
    at = np.searchsorted(sums, _ideal(total, targets) - high_sums)
    best = None
    for p in (at - 1, at):
        p = np.clip(p, 0, len(sums) - 1)
        worst, gaps = _scores(high_sums + sums[p], total, targets)
        least = np.flatnonzero(worst == worst.min())
        least = least[gaps[least] == gaps[least].min()]
        i = least[np.lexsort((lows[first[p[least]]], highs[least]))[0]]
        found = (float(worst[i]), float(gaps[i]), int(highs[i]), int(lows[first[p[i]]]))
        best = found if best is None or found < best else best
    return best


def _by_bits(cents: list[int], total: int, targets: list[float]) -> int | None:
    """The mask of the best subset, from the sums that the first i amounts reach, for each i."""
    reached = [1]
    for c in cents:
        reached.append(reached[-1] | reached[-1] << c)
    ideal = min(max(int(_ideal(total, targets)), 0), total)
    below, above = reached[-1] & ((1 << ideal + 1) - 1), reached[-1] >> ideal + 1
    sums = [s for s in ([below.bit_length() - 1] if below else []) + ([(above & -above).bit_length() + ideal] if above else [])]
    best = None
    for s in sums:
        mask, left = 0, s
        for i in range(len(cents) - 1, -1, -1):
            if not reached[i] >> left & 1:
                mask |= 1 << i
                left -= cents[i]
        if not mask and 0 in cents:
            mask = 1 << cents.index(0)
        if 0 < mask < (1 << len(cents)) - 1:
            worst, gaps = _scores(np.array([s]), total, targets)
            found = (float(worst[0]), float(gaps[0]), mask)
            best = found if best is None or found < best else best
    return best and best[2]


def two_sides(costs: list[float], targets: list[float]) -> list[int] | None:
    """The side (0 or 1) of each amount (in cents) with the least score, none empty; of equal scores the one whose first side has the smallest
    mask. None if the amounts are too many and too large for an exact answer, or are fewer than two."""
    n, cents = len(costs), [round(c * 100) for c in costs]
    total = sum(cents)
    if n < 2:
        return None
    if n > MIDDLE:
        mask = _by_bits(cents, total, targets) if min(cents) >= 0 and (total + 1) * n <= MOST_BITS else None
    else:
        half = n // 2
        low, high = _all_sums(cents[:half]), _all_sums(cents[half:])
        lows, highs = np.arange(len(low)), np.arange(len(high))
        # neither side may be empty: no high amount goes with any low one, all high ones not with all low ones
        found = [
            _nearest(highs[1:-1], high[1:-1], low, lows, total, targets),
            _nearest(highs[:1], high[:1], low[1:], lows[1:], total, targets),
            _nearest(highs[-1:], high[-1:], low[:-1], lows[:-1], total, targets),
        ]
        best = min(f for f in found if f)
        mask = best[2] << half | best[3]
    return None if mask is None else [1 - (mask >> i & 1) for i in range(n)]
