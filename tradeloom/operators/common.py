"""What operators share: broadcasts of a checked size, and single winners."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A dimension of more rows is not broadcast; its joins are left to the optimiser.
BROADCAST_ROWS = 20_000


def dimension(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; they are counted, up to the bound only."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast and compared with every row; an error if it has more than ``most`` rows, as that would be all against all."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows are to be compared with every row: index them by a word or key instead")
    return F.broadcast(df)


def streamed(rows: DataFrame, key: str, columns: list[str], order: list[str], step: Callable[[list[tuple]], Iterable[tuple]], ddl: str, grouped: bool = False, at_once: int = 5_000) -> DataFrame:
    """The rows that ``step`` makes of the rows (tuples of ``columns``, in ``order``) of each ``key``.

    Groups are read one after another from the sorted partition, so many small ones need no frame each. A group must fit a task: it should be
    one document. The number of partitions is stated, so that adaptive execution doesn't join few bytes of much work to one task. ``grouped``: the rows
    of a key follow one another in one task as they are, in any order; then nothing is shuffled or sorted. ``at_once``: rows that are handed back at once.
    """
    return streamed_together(rows, key, columns, order, lambda groups: (row for group in groups for row in step(group)), ddl, grouped, at_once)


#: Rows of whole groups that ``streamed_together`` hands over at once, about.
ROWS_TOGETHER = 8_000


def streamed_together(rows: DataFrame, key: str, columns: list[str], order: list[str], step: Callable[[list[list[tuple]]], Iterable[tuple]], ddl: str, grouped: bool = False, at_once: int = 5_000) -> DataFrame:
    """The same where ``step`` takes a list of groups, for work that is cheaper on many at once."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    part = b.slice(at, 1000)
                    yield from zip(*(part.column(c).to_pylist() for c in (key, *columns)), strict=True)

        def several() -> Iterator[list[list[tuple]]]:
            held, n = [], 0
            for _, group in groupby(read(), itemgetter(0)):
                held.append([r[1:] for r in group])
                n += len(held[-1])
                if n >= ROWS_TOGETHER:
                    yield held
                    held, n = [], 0
            if held:
                yield held

        made = (row for groups in several() for row in step(groups))
        while held := list(islice(made, at_once)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    slim = rows.select(*dict.fromkeys((key, *columns)))
    if grouped:
        return slim.mapInArrow(run, ddl)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slim.repartition(parts, key).sortWithinPartitions(key, *order).mapInArrow(run, ddl)


def grams(text: Column, size: int) -> Column:
    """Hashes of all parts of ``size`` characters."""
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.xxhash64(F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<long>"))


#: Parts of fewer characters are looked for by themselves, longer ones by one of their grams of so many.
GRAM = 4
#: So many parts are compared with every whole: that costs less than grams.
FEW = 64


def contained_in(parts: DataFrame, wholes: DataFrame, part: str, whole: str, size: int | None = None) -> DataFrame:
    """Pairs of ``parts`` and ``wholes`` where the text ``whole`` contains the text ``part`` (of ``size`` characters or more, if given). Empty and null
    parts are in nothing.

    A part is looked for by the least of its grams' hashes only, which each whole that contains it has, too; so pairs meet by a rather rare gram
    instead of all with all. Without ``size``, parts shorter than a gram meet the wholes' parts of their length, which are few.
    """
    least, own = size or GRAM, F.col(part)
    named = parts.filter(F.length(part) >= (size or 1))
    if named.limit(FEW + 1).count() <= FEW:
        return F.broadcast(named).join(wholes, F.contains(whole, own))
    right = wholes.withColumn("__gram", F.explode(F.array_distinct(grams(F.col(whole), least))))
    long = named.filter(F.length(part) >= least).withColumn("__gram", F.array_min(grams(own, least)))
    found = long.join(right, "__gram").filter(F.contains(whole, own)).drop("__gram")
    if size:
        return found
    each = F.col(whole)
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.length(each) - n + 1), lambda i: F.substr(each, i, F.lit(n)))
    cuts = F.flatten(F.array(*[F.when(F.length(each) >= n, of_length(n)).otherwise(F.array().cast("array<string>")) for n in range(1, least)]))
    short = named.filter(F.length(part) < least).withColumn("__cut", own)
    return found.unionByName(short.join(wholes.withColumn("__cut", F.explode(F.array_distinct(cuts))), "__cut").drop("__cut"))


def named_in(parts: DataFrame, wholes: DataFrame, part: str, whole: str) -> DataFrame:
    """The same for short texts such as numbers of documents, which have most of their grams in common: a whole is found by each of its parts that has a
    length of ``parts``; those lengths are few where numbers have forms, at most as many as the longest whole has characters."""
    each = F.col(whole)
    left = parts.filter(F.length(part) > 0).withColumn("__part", F.col(part))
    longest = wholes.agg(F.max(F.length(whole))).first()[0] or 0
    lengths = sorted(n for (n,) in left.select(F.length(part)).filter(F.length(part) <= longest).distinct().collect())
    cuts = lambda n: F.transform(F.sequence(F.lit(1), F.length(each) - n + 1), lambda i: F.substr(each, i, F.lit(n)))
    if len(lengths) <= FEW:
        every = F.concat(F.array().cast("array<string>"), *[F.when(F.length(each) >= n, cuts(n)).otherwise(F.array().cast("array<string>")) for n in lengths])
    else:
        n = F.length(each)
        fit = F.filter(F.lit(lengths), lambda k: k <= n)
        every = F.flatten(F.transform(fit, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(each, i, k))))
    return left.join(wholes.withColumn("__part", F.explode(F.array_distinct(every))), "__part").drop("__part")


def winners(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that should leave no ties."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def fanned_out(rows: DataFrame, key: Column, classify, name: str = "key") -> DataFrame:
    """Classifies each distinct key once and joins the results back to the rows.

    ``classify`` maps a DataFrame of one column ``name`` to one with further columns. Rows of a null key get nulls. The
    results are as many as there are distinct keys, so a frequent key can't skew their side; AQE splits the other.
    """
    keyed = rows.withColumn(name, key)
    return keyed.join(classify(keyed.select(name).filter(F.col(name).isNotNull()).distinct()), name, "left")
