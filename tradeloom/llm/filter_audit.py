"""What each of five filters removes in every order of them: counts, overlaps and shares of the work.

1. Each task of the first stage reads whole texts, tests the four filters of a single document and keeps, for every text that it meets, the least
   id (in a chain for each XXH64, since different texts may share one). A row whose id is greater than another's of the same text is a copy; so are
   earlier ids when a smaller one comes. A group of copies of any size leaves the task as one text and narrow rows.
2. Texts are routed by XXH64 in an RDD and sorted by it; a chain holds the full texts of one hash, each with its least id. All others of that
   text are copies.
3. A document is now a mask of the filters that it fails. Masks are counted in one vector for each part (32 masks, each with all, good and toxic
   documents), merged by combineByKey. All orders follow from a part's vector.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby, permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm.common import documents, text_or_empty

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Contract's limits (fixed values): words, and distinct words and capitals in hundredths.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
MARKS = b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of texts that a task of the first stage holds before it hands them on, and what a row takes besides its text (about).
HELD_BYTES, LINK_BYTES = 64 << 20, 400
#: Bytes of texts that are routed to one partition (about): its rows are sorted there.
ROUTED_BYTES = 64 << 20

#: A row of known filters: id, part, mask, and how many such rows.
Known = tuple[int | None, str, int, int]
DDL = "doc_id long, part string, mask int, n long"
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def failures(text: str) -> int:
    """The filters but the last that a text fails, as bits."""
    raw = text.encode()
    words = raw.split()  # at the six ASCII white-space bytes
    fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text), len(raw.translate(None, MARKS)) < len(raw))
    return sum(f << i for i, f in enumerate(fails))


class Chain:
    """The texts of one hash: each in full, with its mask, its least id and the rows of that id by part."""

    def __init__(self) -> None:
        self.links: list[list] = []

    def add(self, raw: bytes, doc_id: int, rows: dict[str, int], mask) -> Iterator[Known]:
        """Takes rows of one text and id in; returns those that are copies by now. ``mask`` is called for a text that is new."""
        link = next((x for x in self.links if x[0] == raw), None)
        if link is None:
            self.links.append([raw, mask(), doc_id, dict(rows)])
            return
        if doc_id == link[2]:
            for part, n in rows.items():
                link[3][part] = link[3].get(part, 0) + n
            return
        later = (doc_id, rows) if doc_id > link[2] else (link[2], link[3])
        if doc_id < link[2]:
            link[2], link[3] = doc_id, dict(rows)
        for part, n in later[1].items():
            yield later[0], part, link[1] | COPY, n


def met(rows: Iterable[tuple[int | None, str, str]]) -> Iterator[tuple[int, tuple]]:
    """Rows (id, text, part) of a task, by the XXH64 of their text: (text, id, rows by part, mask); rows of known masks as (None, ...)."""
    chains: dict[int, Chain] = {}
    known: Counter[tuple[int | None, str, int]] = Counter()
    held = 0

    def handed_on() -> Iterator[tuple[int, tuple]]:
        for h, chain in chains.items():
            for raw, mask, doc_id, parts in chain.links:
                yield h, (raw, doc_id, parts, mask)
        for row, n in known.items():  # these need no routing: they go under a key that spreads them
            yield xxhash.xxh64_intdigest(repr(row)), (None, *row, n)

    for doc_id, text, part in rows:
        if doc_id is None:
            known[None, part, failures(text)] += 1
            continue
        raw = text.encode()
        chain = chains.setdefault(xxhash.xxh64_intdigest(raw), Chain())
        before = len(chain.links)
        for *row, n in chain.add(raw, doc_id, {part: 1}, lambda text=text: failures(text)):
            known[tuple(row)] += n
        held += (len(raw) + LINK_BYTES) * (len(chain.links) - before)
        if held + len(known) * LINK_BYTES > HELD_BYTES:
            yield from handed_on()
            chains, known, held = {}, Counter(), 0
    yield from handed_on()


def chained(routed: Iterable[tuple[int, tuple]]) -> Iterator[Known]:
    """Rows of ``met``, sorted by hash, as rows of known masks."""
    for _, group in groupby(routed, key=lambda r: r[0]):
        chain = Chain()
        for _, value in group:
            if value[0] is None:
                yield value[1:]
                continue
            raw, doc_id, parts, mask = value
            yield from chain.add(raw, doc_id, parts, lambda mask=mask: mask)
        for _, mask, doc_id, parts in chain.links:
            yield from ((doc_id, part, mask, n) for part, n in parts.items())


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask (bit i: the i-th filter fails) and n, the number of equal rows.

    A null text is empty, a null part the empty string. A null id is smaller than none and none is smaller than it. Repeated rows have no smaller id
    among themselves, so they are copies only where a smaller id has their text. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows, parts = slim.rdd, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROUTED_BYTES))
    routed = rows.mapPartitions(met).repartitionAndSortWithinPartitions(parts, partitionFunc=lambda h: h % parts)
    return spark.createDataFrame(routed.mapPartitions(chained), DDL, verifySchema=False)


def _vector(row) -> np.ndarray:
    return _added(np.zeros((MASKS, 3), dtype=np.int64), row)


def _added(vector: np.ndarray, row) -> np.ndarray:
    mask, n, quality, toxic = row
    vector[mask] += (n, n * (quality == 1), n * (toxic == 1))
    return vector


def _selectors() -> tuple[np.ndarray, ...]:
    """For each order and step, the masks that are kept, removed there, and fail its filter but went before; the masks that fail only its filter;
    and in how many orders its filter removes a mask."""
    kept, removed, redundant, only, share = (np.zeros((len(ORDERS) * len(FILTERS), MASKS), dtype=np.int64) for _ in range(5))
    for row, (order, step) in enumerate((o, s) for o in ORDERS for s in range(len(FILTERS))):
        own = 1 << FILTERS.index(order[step])
        earlier = sum(1 << FILTERS.index(f) for f in order[:step])
        for mask in range(MASKS):
            kept[row, mask] = not mask & (own | earlier)
            removed[row, mask] = bool(mask & own) and not mask & earlier
            redundant[row, mask] = bool(mask & own) and bool(mask & earlier)
            only[row, mask] = mask == own
            # of the filters that a document fails, each comes first in as many orders as any other
            share[row, mask] = len(ORDERS) // mask.bit_count() if mask & own else 0
    return kept, removed, redundant, only, share


def in_all_orders(part: str, vector: np.ndarray, selectors: tuple[np.ndarray, ...]) -> Iterator[tuple]:
    """The rows of one part."""
    kept, removed, redundant, only, share = selectors
    columns = [kept @ vector[:, 0], removed @ vector[:, 0], redundant @ vector[:, 0], only @ vector[:, 0], removed @ vector[:, 1], removed @ vector[:, 2], share @ vector[:, 0]]
    for row, values in enumerate(zip(*(c.tolist() for c in columns), strict=True)):
        order, step = divmod(row, len(FILTERS))
        yield (part, ORDERS[order], step + 1, *values)


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order and step. ``labels`` has doc_id, quality and toxic; of several rows of an id the greatest values count, and
    documents without a label are neither good nor toxic."""
    spark = docs.sparkSession
    narrow = masks(docs, id_col, text_col, part_col).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = narrow.join(known, "doc_id", "left").select("part", "mask", "n", "quality", "toxic").rdd
    vectors = rows.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_vector, _added, np.add)

    def all_rows(items: Iterable[tuple[str, np.ndarray]]) -> Iterator[tuple]:
        selectors = _selectors()
        for part, vector in items:
            yield from in_all_orders(part, vector, selectors)

    return spark.createDataFrame(vectors.mapPartitions(all_rows), OUT, verifySchema=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


OP13_SQL = r"""
with docs as (
    select doc_id, coalesce(text, '') as body, coalesce(source, '') as part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), firsts as (
    select body, min(doc_id) as first_id from docs group by body
), fails as (
    select d.doc_id, d.part, len(words) < 50 as a, 100 * len(list_distinct(words)) < 65 * len(words) as b,
        100 * length(regexp_replace(d.body, '[^A-Z]', '', 'g')) > 5 * length(d.body) as c, regexp_matches(d.body, '[#$%&*|]') as d, coalesce(d.doc_id > f.first_id, false) as e
    from docs d join firsts f using (body)
), lettered as (
    select part, (case when a then 'A' else '' end) || (case when b then 'B' else '' end) || (case when c then 'C' else '' end) || (case when d then 'D' else '' end) || (case when e then 'E' else '' end) as failed,
        coalesce(l.quality, 0) as quality, coalesce(l.toxic, 0) as toxic
    from fails left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) l using (doc_id)
), groups as (
    select part, failed, count(*) as n, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as toxic from lettered group by all
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
    select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps as (
    select filter_order, step::int as step, substr(filter_order, step, 1) as own, substr(filter_order, 1, step - 1) as earlier from orders, range(1, 6) t(step)
), judged as (
    select part, filter_order, step, own, n, good, g.toxic, failed, contains(failed, own) as hit, length(translate(failed, earlier, '')) < length(failed) as gone
    from groups g, steps
), counted as (
    select part, filter_order, step, own, coalesce(sum(n) filter (where not hit and not gone), 0)::bigint as kept, coalesce(sum(n) filter (where hit and not gone), 0)::bigint as removed,
        coalesce(sum(n) filter (where hit and gone), 0)::bigint as redundant, coalesce(sum(n) filter (where failed = own), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (where hit and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where hit and not gone), 0)::bigint as toxic_lost
    from judged group by part, filter_order, step, own
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, own)::bigint as shapley from counted
"""
