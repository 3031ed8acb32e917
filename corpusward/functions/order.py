"""Positions of rows in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusward.functions.lineage import cut


def positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their positions, from 0, in the order of ``order``, which must tell rows apart that differ.

    Rows are dealt by range and sorted there; a row's position is its number in its
    partition and the rows of the partitions before.  Only the partitions' sizes meet in one
    place, a number each.
    """
    number = F.monotonically_increasing_id()
    ordered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", number))
    part, local = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ordered.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + local).drop("_at", "_part", "_before")
