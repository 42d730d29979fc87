"""Readings of a page put together when they don't agree: the best one's lines, then the sensible lines that only others have.

Lines are compared by difflib's ratio. Its upper bounds come first: from the lengths, then from the letters in common, which are counted against all
lines of a fitting length at once; so few pairs are compared in full.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import DataFrame

from tradeloom.operators.common import streamed
from tradeloom.operators.ordering import Reading, _by_variant, _plain

MOST_ALIKE = 0.80


def sensible(line: str, how: Reading = Reading()) -> bool:
    """Whether a line reads like an invoice's: a price, a number with words or alone, or words long enough and few other signs."""
    line = line.strip()
    if len(line) < 4:
        return False
    if re.search(how.price, line):
        return True
    if re.search(r"\d{2,}", line) and (re.search("[A-Za-z]{2,}", line) or len(line) < 30 and re.fullmatch(r"[\d\s.,-]+", line)):
        return True
    sizes = [len(w) for w in re.findall("[A-Za-z]+", line)]
    if not sizes or sum(sizes) < 4 * len(sizes) or max(sizes) < 6 and len(sizes) < 3:
        return False
    return sum(c.isalnum() or c.isspace() for c in line) >= 0.60 * len(line)


class Alike:
    """Texts, and whether one is like another: a ratio of more than ``most``."""

    def __init__(self, most: float = MOST_ALIKE):
        self.most = most
        self.exact: set[str] = set()
        self.lengths: list[int] = []
        self.texts: list[str] = []  # by length
        self.letters = np.zeros((0, 64), dtype=np.int32)

    @staticmethod
    def _letters(text: str) -> np.ndarray:
        return np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) & 63, minlength=64).astype(np.int32)

    def add(self, text: str) -> None:
        if text in self.exact:
            return
        self.exact.add(text)
        at = bisect_right(self.lengths, len(text))
        self.lengths.insert(at, len(text))
        self.texts.insert(at, text)
        self.letters = np.insert(self.letters, at, self._letters(text), axis=0)

    def has_like(self, text: str) -> bool:
        if text in self.exact:
            return True  # a ratio of one
        n, most = len(text), self.most
        # a ratio is at most twice the shorter length over both
        first, last = bisect_left(self.lengths, int(n * most / (2 - most))), bisect_right(self.lengths, int(n * (2 - most) / most) + 1)
        if first == last:
            return False
        common = np.minimum(self.letters[first:last], self._letters(text)).sum(axis=1)
        bound = 2.0 * common / (n + np.array(self.lengths[first:last]))
        matcher = SequenceMatcher(None, text)
        for i in np.flatnonzero(bound > most).tolist():
            matcher.set_seq2(self.texts[first + i])
            if matcher.quick_ratio() > most and matcher.ratio() > most:
                return True
        return False


def merged(lines: dict[str, list[tuple[int, str]]], priority: dict[str, int], how: Reading = Reading(), most: float = MOST_ALIKE) -> list[str]:
    """Lines of the reading with most prices (then the longest, of the highest priority, of the greatest name), then of each other one, by name, the
    sensible lines that no line so far is like."""
    if not lines:
        return []
    price = re.compile(how.price)
    base = max(lines, key=lambda v: (sum(len(price.findall(t)) for _, t in lines[v]), sum(len(t) + 1 for _, t in lines[v]), priority.get(v, 0), v))
    known, out = Alike(most), [t for _, t in lines[base]]
    for t in out:
        known.add(_plain(t))
    for v in sorted(lines):
        for _, t in lines[v] if v != base else []:
            plain = _plain(t)
            if sensible(t, how) and not known.has_like(plain):
                known.add(plain)
                out.append(t.strip())
    return out


def super_text(lines: DataFrame, priority: dict[str, int], how: Reading = Reading()) -> DataFrame:
    """doc_id, line and text of each document's merged readings (doc_id, variant, line_no, text). Blank and null lines don't count. One document is one
    group."""

    def merge(rows: list[tuple]) -> list[tuple]:
        return [(rows[0][0], i, t) for i, t in enumerate(merged(_by_variant(rows), priority, how))]

    return streamed(lines, "doc_id", ["doc_id", "variant", "line_no", "text"], ["variant", "line_no"], merge, "doc_id long, line int, text string")
