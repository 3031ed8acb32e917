"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.functions.lineage import cut

#: Up to this many links (16 bytes each) a round is one task without shuffles; more are dealt over tasks.
ONE_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) for every node of ``links`` (a, b).

    Each round takes the smallest label among the neighbours, then the label's own
    label, so paths shrink by doubling.  Minima are combined before the shuffle: a node
    with very many neighbours is a few rows.  The driver sees one count a round.
    """
    both = cut(links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("l")).select("l.*").where("u <> v").distinct())
    if both.limit(ONE_TASK + 1).count() <= ONE_TASK:
        both = both.coalesce(1)
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("component")))
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = lower.select(F.col("node").alias("at"), F.col("now").alias("next"))
        new = cut(lower.join(jump, lower["now"] == jump["at"]).select("node", "was", F.least("now", "next").alias("component")))
        changed = new.where("component < was").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
