"""Order-dependent operators: nearest rows, islands, ranks, distribution of wholes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.operators.common import streamed, streamed_together, winners
from tradeloom.operators.subsets import two_sides


def filled_down(rows: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with each of ``columns`` taken from the nearest row above that has it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def islands(pages: DataFrame, group: str, order: str, ident: str) -> DataFrame:
    """``pages`` with ``island``: a new one where an identity differs from the one before; pages without one stay with it."""
    w = Window.partitionBy(group).orderBy(order)
    known = filled_down(pages.withColumn("__id", F.col(ident)), group, [order], ["__id"])
    fresh = ~F.col("__id").eqNullSafe(F.lag("__id").over(w)) & F.col("__id").isNotNull() & F.lag("__id").over(w).isNotNull()
    return known.withColumn("__new", fresh.cast("int")).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__id", "__new")


def blocks(lines: DataFrame, group: str, order: str, starts: Column) -> DataFrame:
    """``lines`` with ``block``: the number of starting lines so far; lines before the first are dropped."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(starts.cast("int")).over(w)).filter("block > 0")


def best_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return winners(rows, [key], *order)


def newest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order: a top-k report."""
    return rows.orderBy(*order).limit(n)


def exclusive_claims(claims: DataFrame, claimed: str, *order: Column) -> DataFrame:
    """Each claimed thing goes to the first claimant in the order."""
    return winners(claims, [claimed], *order)


def largest_remainder(rows: DataFrame, group: str, whole: str, weight: str, *order: str) -> DataFrame:
    """``rows`` with ``share``: whole numbers that add up to the group's ``whole``, by floors and largest fractions (ties by order)."""
    total = Window.partitionBy(group)
    exact = (F.col(whole) * F.col(weight) / F.sum(weight).over(total)).cast("decimal(28,10)")
    out = rows.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact"))
    left = F.col(whole) - F.sum("__floor").over(total)
    rank = F.row_number().over(total.orderBy((F.col("__exact") - F.col("__floor")).desc(), *order))
    return out.withColumn("__left", left).withColumn("__rank", rank).withColumn("share", (F.col("__floor") + (F.col("__rank") <= F.col("__left")).cast("int")).cast("bigint")).drop("__exact", "__floor", "__left", "__rank")


def units_dealt(items: DataFrame, parts: int, item: str, quantity: str, order: str) -> DataFrame:
    """Units of each item dealt in turn to ``parts`` declarations: item, part, units. Computed from running sums, without a row a unit."""
    w = Window.partitionBy("invoice_id").orderBy(order)
    whole = F.floor(quantity)
    out = items.withColumn("__n", whole).withColumn("__before", F.coalesce(F.sum(whole).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    shift = F.pmod(F.col("part") - F.col("__before"), F.lit(parts))
    return out.withColumn("units", F.greatest(F.floor((F.col("__n") - shift + parts - 1) / parts), F.lit(0))).filter("units > 0").select("invoice_id", item, "part", "units")


def deviation(sums: list[float], targets: list[float]) -> tuple[float, float]:
    """Largest relative deviation, then the sum of gaps; smaller is better."""
    gaps = [abs(s - t) for s, t in zip(sums, targets, strict=True)]
    return max(g / max(t, 1e-9) for g, t in zip(gaps, targets, strict=True)), sum(gaps)


#: Assignments of the first items that are looked at together.
AT_ONCE = 1 << 16


def _all_ways(costs: list[float], targets: list[float]) -> tuple[tuple[float, float], list[int]]:
    """The best score and the first way that has it, over all ways that leave no declaration empty, the first item's changing fastest."""
    n, full = len(targets), (1 << len(targets)) - 1
    low = 0
    sums, used, ways = np.zeros((1, n)), np.zeros(1, dtype=np.int64), np.zeros((1, 0), dtype=np.int8)
    while low < len(costs) and len(sums) * n <= AT_ONCE:
        step = np.zeros((n, n))
        np.fill_diagonal(step, costs[low])
        sums = (step[:, None, :] + sums[None]).reshape(-1, n)  # the new item changes slowest
        used = ((1 << np.arange(n))[:, None] | used[None]).reshape(-1)
        ways = np.concatenate([np.tile(ways, (n, 1)), np.repeat(np.arange(n, dtype=np.int8), len(ways))[:, None]], axis=1)
        low += 1
    best: tuple[tuple[float, float], list[int]] | None = None
    # a way that beats one already known has all of its sums near their targets
    wanted, base = np.array(targets), np.maximum(targets, 1e-9)
    known = _improved(costs, targets, _one_by_one(costs, targets))
    by_first, grows = np.argsort(sums[:, 0], kind="stable"), min(costs, default=0) >= 0
    ascending = sums[by_first, 0]
    for rest in product(range(n), repeat=len(costs) - low):
        rest = rest[::-1]
        held = np.array(_sums(costs[low:], rest, n))
        slack = known * base * (1 + 1e-9) + 1e-6
        if grows and (held > wanted + slack).any():
            continue
        window = np.searchsorted(ascending, [wanted[0] - slack[0] - held[0], wanted[0] + slack[0] - held[0]])
        rows = by_first[window[0] : window[1] + 1]
        for d in range(1, n):
            rows = rows[np.abs(sums[rows, d] + (held[d] - wanted[d])) <= slack[d]]
        if not len(rows):
            continue
        rows = np.sort(rows)
        here, mask = sums[rows], used[rows]
        for cost, d in zip(costs[low:], rest, strict=True):
            here[:, d] += cost
            mask |= 1 << d
        gaps = np.abs(here - targets)
        worst = np.where(mask == full, (gaps / np.maximum(targets, 1e-9)).max(axis=1), np.inf)
        first = worst.min()
        if not np.isfinite(first) or best and first > best[0][0]:
            continue
        close = np.flatnonzero(worst == first)
        total = np.zeros(len(close))
        for d in range(n):
            total += gaps[close, d]
        at = int(np.argmin(total))
        if best is None or (first, total[at]) < best[0]:
            best = ((float(first), float(total[at])), [*ways[rows[close[at]]].tolist(), *rest])
            known = min(known, float(first))
    return best or ((math.inf, math.inf), [])


def _sums(costs: list[float], way, n: int) -> list[float]:
    out = [0.0] * n
    for cost, d in zip(costs, way, strict=True):
        out[d] += cost
    return out


def _improved(costs: list[float], targets: list[float], way: list[int]) -> float:
    """The largest deviation that moving and swapping items leads to from ``way``; infinite if a declaration stays empty."""
    n, score = len(targets), deviation(_sums(costs, way, len(targets)), targets)
    moved = True
    while moved:
        moved = False
        for i, j in product(range(len(costs)), range(-n, len(costs))):
            other = list(way)
            if j < 0:
                other[i] = j + n
            else:
                other[i], other[j] = way[j], way[i]
            found = deviation(_sums(costs, other, n), targets)
            if found < score and len(set(other)) == n:
                way, score, moved = other, found, True
    return score[0] if len(set(way)) == n else math.inf


def divided(costs: list[float], targets: list[float], exhaustive: int = 15) -> list[int]:
    """The declaration of each item. All ways for few items and declarations, none left empty (of equally good ones the first; for two
    declarations the ways are counted by the items of the first one). Two declarations of any number of items are divided exactly, too (see
    ``subsets``, which says when that isn't possible); otherwise the largest first, each where the score grows least."""
    n = len(targets)
    if n <= len(costs) <= exhaustive and n <= 4:
        if n == 2:
            return [1 - d for d in _all_ways(costs, targets[::-1])[1]]
        return _all_ways(costs, targets)[1]
    if n == 2 and (exact := two_sides(costs, targets)):
        return exact
    return _one_by_one(costs, targets)


#: Ways of one division up to which many are judged together, and sums held at once.
FEW_WAYS, SUMS_AT_ONCE = 1 << 18, 1 << 19


@lru_cache(maxsize=64)
def _ways(items: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All ways that leave no declaration empty, the first item's changing fastest, and their places among all ways."""
    code = np.arange(n**items)
    ways = np.stack([code // n**i % n for i in range(items)], axis=1).astype(np.int8)
    full = np.flatnonzero(np.logical_and.reduce([(ways == d).any(axis=1) for d in range(n)]))
    return ways[full], full


def _all_ways_together(costs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """What ``_all_ways`` finds, for many divisions (rows) of as many items and declarations."""
    (many, items), n = costs.shape, targets.shape[1]
    ways, full = _ways(items, n)
    sums = np.zeros((n, many, 1))
    for i in range(items):
        sums = np.repeat(sums[:, :, None, :], n, axis=2)
        for d in range(n):
            sums[d, :, d, :] += costs[:, i, None]
        sums = sums.reshape(n, many, -1)
    worst, total = np.zeros((many, len(full))), np.zeros((many, len(full)))
    for d in range(n):
        gaps = np.abs(sums[d][:, full] - targets[:, d, None])
        worst = np.maximum(worst, gaps / np.maximum(targets[:, d, None], 1e-9))
        total += gaps
    return ways[np.where(worst == worst.min(axis=1, keepdims=True), total, np.inf).argmin(axis=1)]


def divided_together(asked: list[tuple[list[float], list[float]]], exhaustive: int = 15) -> list[list[int]]:
    """``divided`` of many (costs, targets): those with equally many items and declarations are judged by the same array operations."""
    out: list[list[int]] = [[] for _ in asked]
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (costs, targets) in enumerate(asked):
        n = len(targets)
        if 2 <= n <= len(costs) <= exhaustive and n <= 4 and n ** len(costs) <= FEW_WAYS and all(map(math.isfinite, (*costs, *targets))):
            alike.setdefault((len(costs), n), []).append(i)
        else:
            out[i] = divided(costs, targets, exhaustive)
    for (items, n), places in alike.items():
        step = max(SUMS_AT_ONCE // (n ** (items + 1)), 1)
        for at in range(0, len(places), step):
            part = places[at : at + step]
            costs, targets = np.array([asked[i][0] for i in part]), np.array([asked[i][1] for i in part])
            found = 1 - _all_ways_together(costs, targets[:, ::-1]) if n == 2 else _all_ways_together(costs, targets)
            for i, way in zip(part, found.tolist(), strict=True):
                out[i] = way
    return out


def _one_by_one(costs: list[float], targets: list[float]) -> list[int]:
    n = len(targets)
    sums, out = [0.0] * n, [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: -costs[i]):
        out[i] = min(range(n), key=lambda d: deviation([s + (costs[i] if k == d else 0) for k, s in enumerate(sums)], targets))
        sums[out[i]] += costs[i]
    return out


def unreliable(score: float, targets: list[float], least_target: float = 1.0, most_score: float = 5.0) -> bool:
    """Whether a partition isn't to be trusted: a target near nothing, or even the best way far off."""
    return not targets or min(targets) < least_target or score > most_score


def partitioned(items: DataFrame, targets: list[float]) -> DataFrame:
    """invoice_id, seq, declaration of each item and unreliable (of its invoice); ``targets`` are the declarations' shares of an invoice's cost.

    One invoice is one group; its items are bounded by the document.
    """

    def split(groups: list[list[tuple]]) -> Iterator[tuple]:
        asked = []
        for rows in groups:
            costs = [float(r[2]) for r in rows]
            whole = sum(costs)
            asked.append((costs, [t * whole for t in targets]))
        for rows, (costs, wanted), found in zip(groups, asked, divided_together(asked), strict=True):
            sums = [sum(c for c, d in zip(costs, found, strict=True) if d == k) for k in range(len(targets))]
            bad = unreliable(deviation(sums, wanted)[0], wanted)
            for (ident, seq, _), d in zip(rows, found, strict=True):
                yield ident, seq, d, bad

    return streamed_together(items, "invoice_id", ["invoice_id", "seq", "total_cost"], ["seq"], split, "invoice_id long, seq int, declaration int, unreliable boolean")


def redistributed(packages: list[int], total: int) -> list[int]:
    """Whole packages that add up to ``total``, at least one each: extras by largest remainder to those with more than one,
    surplus trimmed from the largest."""
    if total <= len(packages):
        return [1] * len(packages)
    out, extra = list(packages), total - sum(packages)
    if extra > 0:
        takers = [i for i, p in enumerate(packages) if p > 1] or list(range(len(packages)))
        weight = sum(packages[i] for i in takers) or 1
        shares = {i: packages[i] * extra / weight for i in takers}
        for i, s in shares.items():
            out[i] += int(s)
        for i in sorted(takers, key=lambda i: -(shares[i] - int(shares[i])))[: extra - sum(int(s) for s in shares.values())]:
            out[i] += 1
    while extra < 0:
        at = max(range(len(out)), key=out.__getitem__)
        trim = min(out[at] - 1, -extra)
        if trim <= 0:
            break
        out[at] -= trim
        extra += trim
    return out


def packages_redistributed(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``group``, ``order`` and packages of each row after redistribution to the group's bl_total. One shipment is one group."""

    def deal(rows: list[tuple]) -> list[tuple]:
        return [(g, o, p) for (g, o, _, _), p in zip(rows, redistributed([r[2] for r in rows], int(rows[0][3])), strict=True)]

    return streamed(rows, group, [group, order, "packages", "bl_total"], [order], deal, f"{group} long, {order} long, packages long")


def capped(packages: list[int], most: int) -> list[int]:
    """Packages that add up to ``most`` at most, one each at least: the largest (the first of equals) is cut to what is left over, then the next."""
    out = [1] * len(packages) if most < len(packages) else list(packages)
    surplus = sum(out) - most
    while surplus > 0 and max(out) > 1:
        at = out.index(max(out))
        cut = min(out[at] - 1, surplus)
        out[at], surplus = out[at] - cut, surplus - cut
    return out


def packages_capped(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``group``, ``order`` and packages after the cap of the group: the bill's total, else the manifest's; without either all stay. No or zero
    packages count as one."""

    def cut(rows: list[tuple]) -> list[tuple]:
        own = [r[2] or 1 for r in rows]
        most = rows[0][3] if rows[0][3] is not None else rows[0][4]
        return [(r[0], r[1], p) for r, p in zip(rows, own if most is None else capped(own, int(most)), strict=True)]

    return streamed(rows, group, [group, order, "packages", "bill_packages", "manifest_packages"], [order], cut, f"{group} long, {order} long, packages long")


def token_votes(tokens: DataFrame) -> DataFrame:
    """doc_id, pos and the token that most variants read there; ties by engine priority, then by the token. Where the readings of a place are columns of
    one row, ``votes_across`` needs no shuffle."""
    dealt = tokens.select("doc_id", "pos", "token", "priority").repartition("doc_id", "pos")  # counting and choosing both stay within a place
    counted = dealt.groupBy("doc_id", "pos", "token").agg(F.count("*").alias("votes"), F.max("priority").alias("priority"))
    return winners(counted, ["doc_id", "pos"], F.col("votes").desc(), F.col("priority").desc(), F.col("token")).select("doc_id", "pos", "token", "votes")


def votes_across(places: DataFrame, readings: list[tuple[Column, int]]) -> DataFrame:
    """``places`` (a row each) with token and votes as in ``token_votes``, of ``readings``: a token and a priority each. They are compared within the
    row, two by two: readings should be few."""
    if not readings:
        raise ValueError("no readings")
    names = [f"__t{i}" for i in range(len(readings))]
    out = places.withColumns({n: c for n, (c, _) in zip(names, readings, strict=True)})
    alike = lambda n, m: F.col(n).eqNullSafe(F.col(m))
    for i, n in enumerate(names):
        votes, rank = F.lit(0).cast("long"), F.lit(readings[i][1])
        for m, (_, priority) in zip(names, readings, strict=True):
            votes = votes + alike(n, m).cast("long")
            rank = F.greatest(rank, F.when(alike(n, m), priority).otherwise(F.lit(readings[i][1])))
        out = out.withColumns({f"__v{i}": votes, f"__r{i}": rank})
    token, votes, rank = F.col("__t0"), F.col("__v0"), F.col("__r0")
    for i in range(1, len(names)):
        t, v, r = F.col(f"__t{i}"), F.col(f"__v{i}"), F.col(f"__r{i}")
        before = (t.isNull() & token.isNotNull()) | F.coalesce(t < token, F.lit(False))
        better = (v > votes) | ((v == votes) & ((r > rank) | ((r == rank) & before)))
        out = out.withColumn("__better", better).withColumns({"__token": F.when(F.col("__better"), t).otherwise(token), "__votes": F.when(F.col("__better"), v).otherwise(votes), "__rank": F.when(F.col("__better"), r).otherwise(rank)})
        token, votes, rank = F.col("__token"), F.col("__votes"), F.col("__rank")
    return out.select(*places.columns, token.alias("token"), votes.alias("votes"))


@dataclass(frozen=True)
class Reading:
    """How readings of a page are put together (fixed values)."""

    like: float = 0.55
    price: str = r"\$?(\d+\.\d{2})\b"
    number: str = r"^\$?\d+(?:\.\d+)?$"
    token: str = r"\$?\d+(?:[.,]\d+)*|[A-Za-z]+|[^\s\w]"


def _plain(line: str) -> str:
    return " ".join(line.lower().split())


def clusters_of(lines: dict[str, list[tuple[int, str]]], priority: dict[str, int], how: Reading = Reading()) -> list[list[tuple[str, int, str]]]:
    """Clusters (variant, line number, line) of like lines. The skeleton is the variant of the highest priority, then of most prices, then of the
    least sum of its name's characters. Each of its lines, in order, takes the most like free line of each other variant, if that is
    like enough; a line that no other variant has is dropped unless there is one variant only."""
    if not lines:
        return []
    price = re.compile(how.price)
    lead = max(lines, key=lambda v: (priority.get(v, 0), sum(len(price.findall(t)) for _, t in lines[v]), -sum(map(ord, v))))
    free = {v: _Free(rows) for v, rows in lines.items() if v != lead}
    out = []
    for n, line in lines[lead]:
        cluster, own = [(lead, n, line)], _plain(line)
        for v, rows in free.items():
            if (taken := rows.most_like(own, how.like)) is not None:
                cluster.append((v, *taken))
        if len(cluster) > 1 or len(lines) == 1:
            out.append(cluster)
    return out


def ratio(own: str, other: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, own, other).ratio()


class _Free:
    """Lines of a variant that are not taken yet."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.rows = {n: t for n, t in rows}
        self.place = {n: i for i, n in enumerate(self.rows)}
        self.plain = {n: _plain(t) for n, t in self.rows.items()}
        self.chars = {n: Counter(p) for n, p in self.plain.items()}
        self.same: dict[str, list[int]] = {}
        for n, p in self.plain.items():
            self.same.setdefault(p, []).append(n)

    def most_like(self, own: str, least: float) -> tuple[int, str] | None:
        """The number and text of the line most like ``own`` (of equals the first), taken out; None if none is like enough.

        Lines are looked at by a bound of their likeness (characters in common), the highest first, until none can be better; an equal one needs no look.
        """
        best, at = 0.0, None
        if self.same.get(own):
            best, at = 1.0, self.same[own][0]
        else:
            chars, bounds = Counter(own), []
            for n, p in self.plain.items():
                whole = len(own) + len(p)
                if 2.0 * min(len(own), len(p)) / whole < least:
                    continue
                theirs = self.chars[n]
                bound = 2.0 * sum(min(c, theirs[x]) for x, c in chars.items() if x in theirs) / whole
                if bound >= least:
                    bounds.append((-bound, self.place[n], n))
            for bound, _, n in sorted(bounds):
                if -bound < best:
                    break
                like = ratio(own, self.plain[n])
                if like > best or (at is not None and like == best and self.place[n] < self.place[at]):
                    best, at = like, n
        if at is None or best < least:
            return None
        self.same[self.plain.pop(at)].remove(at)
        return at, self.rows.pop(at)


def tokens_aligned(cluster: list[tuple[str, int, str]], how: Reading = Reading()) -> list[list[tuple[str, str]]]:
    """For each word of a cluster's first line, the words (variant, word) that its lines have in that place."""
    from difflib import SequenceMatcher

    token = re.compile(how.token)
    own = token.findall(cluster[0][2])
    places = [[(cluster[0][0], w)] for w in own]
    for v, _, line in cluster[1:]:
        theirs = token.findall(line)
        for kind, a, b, c, d in SequenceMatcher(None, own, theirs, autojunk=False).get_opcodes():
            if kind in ("equal", "replace"):
                for k in range(min(b - a, d - c)):
                    places[a + k].append((v, theirs[c + k]))
    return places


def agreed_line(cluster: list[tuple[str, int, str]], priority: dict[str, int], how: Reading = Reading()) -> str:
    """The line that a cluster's variants vote for, word by word: most votes, then the highest priority, then the larger word. Where a number is read
    and at least half the votes are numbers, in this place or next to it, only numbers are voted for."""
    if len(cluster) == 1:
        return cluster[0][2]
    number = re.compile(how.number)
    places = tokens_aligned(cluster, how)
    votes = [Counter(w for _, w in place) for place in places]
    ranks = [{w: max(priority.get(v, 0) for v, x in place if x == w) for _, w in place} for place in places]
    counts = [sum(c for w, c in v.items() if number.match(w)) for v in votes]
    numeric = [n >= 1 and 2 * n >= v.total() for n, v in zip(counts, votes, strict=True)]
    out = []
    for i, v in enumerate(votes):
        near = counts[i] and any(numeric[j] for j in (i, i - 1, i + 1) if 0 <= j < len(votes))
        choice = [w for w in v if number.match(w)] if near else list(v)
        out.append(max(choice, key=lambda w: (v[w], ranks[i][w], w)))
    return " ".join(out)


def lines_aligned(lines: DataFrame, priority: dict[str, int], how: Reading = Reading()) -> DataFrame:
    """Clusters of like lines of a document's variants (see ``clusters_of``): doc_id, cluster, variant, line_no. Blank lines don't count. One
    document is one group."""

    def align(rows: list[tuple]) -> list[tuple]:
        found = clusters_of(_by_variant(rows), priority, how)
        return [(rows[0][0], i, v, n) for i, cluster in enumerate(found) for v, n, _ in cluster]

    return streamed(lines, "doc_id", ["doc_id", "variant", "line_no", "text"], ["variant", "line_no"], align, "doc_id long, cluster int, variant string, line_no int")


def consensus(lines: DataFrame, priority: dict[str, int], how: Reading = Reading()) -> DataFrame:
    """doc_id, text and confidence (the share of clusters whose lines are the same) of the readings of a document. One document is one group."""

    def agree(rows: list[tuple]) -> list[tuple]:
        found = clusters_of(_by_variant(rows), priority, how)
        alike = sum(len({_plain(t) for _, _, t in c}) == 1 for c in found)
        return [(rows[0][0], "\n".join(filter(None, (agreed_line(c, priority, how) for c in found))), alike / len(found) if found else 0.0)]

    return streamed(lines, "doc_id", ["doc_id", "variant", "line_no", "text"], ["variant", "line_no"], agree, "doc_id long, text string, confidence double")


def _by_variant(rows: list[tuple]) -> dict[str, list[tuple[int, str]]]:
    out: dict[str, list[tuple[int, str]]] = {}
    for _, v, n, t in rows:
        if t and t.strip():
            out.setdefault(v, []).append((n, t))
    return out
