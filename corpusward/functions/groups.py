"""Naming the members of groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many members a message names; the others are counted.
MOST_NAMES = 10


def smallest_of(rows: DataFrame, keys: list[str], member: str, most: int) -> DataFrame:
    """``keys`` and ``names``, the ``most`` smallest members of each group in order.

    Every task keeps the smallest of each group before the shuffle, so a group's size does not matter.
    """
    ranked = rows.select(*keys, member, F.row_number().over(Window.partitionBy(*keys).orderBy(member)).alias("_r")).where(F.col("_r") <= most)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(member)).alias("names"))


def sharing(rows: DataFrame, keys: list[str], member: str, most: int) -> DataFrame:
    """``keys``, n and names of the groups of more than one row: one row for each, whatever its size."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sizes.join(smallest_of(rows, keys, member, most + 1), keys)


def others_named(own: Column, most: int, last: str = ", ") -> Column:
    """Up to ``most`` members of ``names`` without ``own``, and how many more of ``n`` there are; ``last`` stands before the last one."""
    others = F.slice(F.filter("names", lambda x: x != own), 1, most)
    more = F.col("n") - 1 - F.size(others)
    listed = F.when(F.size(others) < 2, F.array_join(others, "")).otherwise(F.concat(F.array_join(F.slice(others, F.lit(1), F.greatest(F.size(others) - 1, F.lit(1))), ", "), F.lit(last), F.element_at(others, -1)))
    return F.when(more > 0, F.concat(F.array_join(others, ", "), F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(listed)
