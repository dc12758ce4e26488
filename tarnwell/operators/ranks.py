"""Ranks, exact quantiles and blocked lists of large groups: values are dealt into ranges, never a group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.numbering import numbered
from . import graph


def _with(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of ``few``, which has a row for each value of ``on``, nulls among them; broadcast up to graph.SMALL counted rows."""
    right = few.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in few.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(F.broadcast(right) if few.count() <= graph.SMALL else right, same).drop(*[f"_{c}" for c in on])


def quantiles(rows: DataFrame, group: str, value: str, at: dict[str, float]) -> DataFrame:
    """(group, a column for each of ``at``): interpolated quantiles of each group, such as {"median": 0.5}; null values are left out.

    Equal values become one row with their number before anything is moved, so a value that fills a
    group is no large range. The distinct values are dealt by (group, value) into ranges; a range
    knows how many rows of its group lie below it, from the sums of all ranges, and so the rank of
    each of its values. Only the values at the wanted ranks go on.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = cut(counts.repartitionByRange(group, "_v").withColumn("_range", F.spark_partition_id()))
    below = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(group, "_range").agg(F.sum("_n").alias("_own"))  # a row for each range, and one more for each group's end
    sizes = cut(sizes.select(group, "_range", F.coalesce(F.sum("_own").over(below), F.lit(0)).alias("_below"), F.sum("_own").over(Window.partitionBy(group)).alias("_all")))
    upto = F.sum("_n").over(Window.partitionBy(group, "_range").orderBy("_v")) + F.col("_below")
    ranked = _with(dealt, sizes, [group, "_range"]).withColumn("_upto", upto).withColumn("_first", F.col("_upto") - F.col("_n"))
    place = {name: F.lit(float(q)) * (F.col("_all") - 1) for name, q in at.items()}
    holds = lambda k: (F.col("_first") <= k) & (k < F.col("_upto"))
    ends = {(name, side): f(p).cast("long") for name, p in place.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    wanted = F.lit(False)
    for k in ends.values():
        wanted = wanted | holds(k)
    met = ranked.filter(wanted).groupBy(group).agg(F.max("_all").alias("_all"), *[F.max(F.when(holds(k), F.col("_v"))).alias(f"_{name}_{side}") for (name, side), k in ends.items()])
    between = lambda name, p: F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * (p - F.floor(p))
    return met.select(group, *[between(name, p).alias(name) for name, p in place.items()])


def ranked(rows: DataFrame, group: str, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``rows`` with their number from 1 in their group, in ``order``, which must tell the rows of a group apart.

    All rows are numbered by ranges of (group, order); a group's rank is the number less the group's first.
    """
    every = cut(numbered(rows, [group, *order], "_number"))
    first = every.groupBy(group).agg(F.min("_number").alias("_first"))
    return _with(every, first, [group]).withColumn(name, (F.col("_number") - F.col("_first") + 1).cast("int")).drop("_number", "_first")


def blocked_lists(pairs: DataFrame, key: str, item: str, size: int = 1000) -> DataFrame:
    """(key, block, items, n): the distinct items of each key in order, in numbered blocks of at most ``size``; nulls are left out.

    A key with many items has many rows, so none grows with it.
    """
    known = pairs.select(key, item).filter(F.col(key).isNotNull() & F.col(item).isNotNull()).distinct()
    rows = ranked(known, key, [item], "_rank").withColumn("block", F.floor((F.col("_rank") - 1) / F.lit(size)).cast("int"))
    return rows.groupBy(key, "block").agg(F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("n"))
