"""Class-association rules by parallel frequent-pattern growth, and their pruning.

Transactions are sets of items with a class (or none). Items are ranked by how often they occur. Each transaction goes, up
to its last item of a shard, to every shard that has one; equal ones are added up before and after they are shuffled. A
shard grows the patterns whose least frequent item is its own, by projecting conditional pattern bases, so that each
pattern is found once, with its count per class.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Base = dict[tuple[int, ...], list[float]]


def grow(base: Base, suffix: tuple[int, ...], least: float, longest: int, own: set[int] | None = None) -> Iterator[tuple[tuple[int, ...], list[float]]]:
    """The patterns with a suffix that occur least times or more: (items by rank, counts by class and in all).

    base maps the items (by rank) of transactions that have the suffix, and rank before it, to counts. own: the items that
    may come next; None for all.
    """
    counts: dict[int, list[float]] = {}
    places: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for items, n in base.items():
        for at, i in enumerate(items):
            if own is None or i in own:
                if (c := counts.get(i)) is None:
                    counts[i] = list(n)
                else:
                    for k, x in enumerate(n):
                        c[k] += x
                if at:
                    places[i].append((items, at))
    for i, c in counts.items():
        if c[-1] < least:
            continue
        found = (i, *suffix)
        yield found, c
        if len(found) < longest and i in places:
            projected: Base = {}
            for items, at in places[i]:
                before = items[:at]
                if (known := projected.get(before)) is None:
                    projected[before] = list(base[items])
                else:
                    for k, x in enumerate(base[items]):
                        known[k] += x
            yield from grow(projected, found, least, longest)


def frequent(conditional: DataFrame, classes: int, shards: int, least: float, longest: int) -> DataFrame:
    """(items, counts) of the patterns of (shard, items, class, n), items being ranks in ascending order; class -1 is none.

    counts has one place per class and the number of all transactions last.
    """
    summed = conditional.groupBy("shard", "items", "class").agg(F.sum("n").alias("n"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def mined(shard: int, base: Base) -> pa.RecordBatch:
            own = {i for items in base for i in items if i % shards == shard}
            rows = list(grow(base, (), least, longest, own))
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.list_(pa.int64())), pa.array([c for _, c in rows], pa.list_(pa.float64()))], names=["items", "counts"])

        shard, base = None, {}
        for batch in batches:
            for s, items, c, n in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if s != shard:
                    if shard is not None:
                        yield mined(shard, base)
                    shard, base = s, {}
                counts = base.setdefault(tuple(items), [0.0] * (classes + 1))
                counts[-1] += n
                if c >= 0:
                    counts[c] += n
        if shard is not None:
            yield mined(shard, base)

    return summed.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "items array<bigint>, counts array<double>")


def conditional(sentences: dict[tuple[tuple[int, ...], int], float], shards: int) -> tuple[list[int], list[tuple[int, ...]], list[int], list[float]]:
    """(shard, items, class, n) of transactions (items by rank, class) with their numbers, equal ones added up."""
    out: dict[tuple[int, tuple[int, ...], int], float] = defaultdict(float)
    for (items, c), n in sentences.items():
        done = set()
        for end in range(len(items), 0, -1):
            shard = items[end - 1] % shards
            if shard not in done:
                done.add(shard)
                out[shard, items[:end], c] += n
    keys = list(out)
    return [k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], list(out.values())


def needed(rules: DataFrame, gain: float) -> DataFrame:
    """rules (items, class, confidence, …) without redundant ones: of several items, not surer by gain than each part of them."""
    if len(rules.take(1)) == 0:
        return rules
    parts = rules.where("size(items) > 1").select("items", F.explode(_proper_parts()).alias("part"))
    known = rules.groupBy(F.col("items").alias("part")).agg(F.max("confidence").alias("known"))
    bar = parts.join(known, "part").groupBy("items").agg(F.max("known").alias("known"))
    return rules.join(bar, "items", "left").where((F.size("items") == 1) | (F.coalesce("known", F.lit(0.0)) + gain <= F.col("confidence"))).drop("known")


def _proper_parts() -> Column:
    singles = F.transform("items", lambda i: F.array(i))
    without_one = F.transform("items", lambda i: F.array_remove("items", i))
    return F.array_distinct(F.concat(singles, without_one))


def most(columns: list[Column]) -> Column:
    return reduce(lambda a, b: F.greatest(a, b), columns)
