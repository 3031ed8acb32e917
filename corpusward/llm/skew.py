"""Joins whose keys may have very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions.lineage import cut

#: Rows up to this many (about 30 MB as a hash table) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """A checkpoint of ``ids``, broadcast where their number allows it."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[Column], part: int) -> DataFrame:
    """The inner join of ``rows`` with ``facts``, one row for each key with ``n``, about the key's rows.

    Keys of more than ``part`` rows are dealt over n / part parts by the hash of ``by``, and
    their facts are repeated for each part; there are few of them, at most one for each
    ``part`` rows.  Other keys meet by shuffle.  ``facts`` is read three times: give a
    checkpoint of it.
    """
    parts = F.ceil(F.col("n") / part).cast("int")
    hot = few(facts.where(F.col("n") > part).select(*keys, parts.alias("parts")))
    dealt = rows.join(hot, keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*by), "parts"), F.lit(0)).cast("int")).drop("parts")
    spread = facts.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(spread, [*keys, "part"]).drop("part")
