"""Row numbers over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's number from 1 in ``order``, which must tell all rows apart.

    Rows are dealt into ranges and checkpointed, so that both uses see the same ranges; numbers run
    inside a range, and the one window over everything has a row a range.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_before", "_own")
