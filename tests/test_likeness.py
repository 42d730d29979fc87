from __future__ import annotations

import random
from difflib import SequenceMatcher

from tradeloom.operators import ordering as O


def by_definition(own, rows, least):
    best, at = 0.0, None
    for n, t in rows:
        if (like := SequenceMatcher(None, own, O._plain(t)).ratio()) > best:
            best, at = like, n
    return at if best >= least else None


def test_lines_are_compared_only_where_they_may_win(monkeypatch):
    """The same line is found without a comparison, another one by a few."""
    rng, looked = random.Random(6), []
    plain = O.ratio
    monkeypatch.setattr(O, "ratio", lambda a, b: looked.append(1) or plain(a, b))
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(300)]
    lines = [" ".join(rng.choices(words, k=9)) for _ in range(80)] + ["same line", "Same  line"]
    other = [(i, t.translate(str.maketrans("oe", "0c")) if i % 2 else t.upper()) for i, t in enumerate(lines)]
    rows, left = O._Free(other), list(other)
    for t in lines:
        expected = by_definition(O._plain(t), left, 0.55)
        taken = rows.most_like(O._plain(t), 0.55)
        assert (taken and taken[0]) == expected
        left = [r for r in left if r[0] != expected]
    assert len(looked) < 400  # there are over 3,000 pairs
