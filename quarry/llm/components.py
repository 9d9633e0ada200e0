"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; component is the least node that can be reached.

    Each round, a node takes the least label among itself and its neighbours, then its label's own label, so chains
    shorten by half and stars need one round. Labels are kept by checkpoint() between rounds. Minima are pre-aggregated
    before the exchange, so a node with very many links is not one task's work. Null ends are dropped; loops and repeated
    links change nothing; no links give no rows.
    """
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL")
    both = cut(ends.union(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("mid"))
        jumped = stepped.join(labels.select(F.col("node").alias("mid"), F.col("label").alias("far")), "mid")
        after = cut(jumped.select("node", "old", F.least("mid", "far").alias("label")))
        labels = after.select("node", "label")
        if after.where("label != old").isEmpty():
            return labels.withColumnRenamed("label", "component")
