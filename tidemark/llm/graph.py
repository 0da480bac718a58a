"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest id of each id's component. links has no null ids; loops and repeated links are fine.

    Ids may be of any type that has an order. Every round each id takes the smallest label among its neighbours' and its
    own, then its label's label; so labels halve their distance to the smallest
    id. Aggregates combine before they shuffle, and joins on a hot label can be
    split, so no component has to fit in a task.
    """
    one = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = cut_lineage(one.union(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut_lineage(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("label")))
    before = None
    while True:
        state = labels.agg(F.sum(F.xxhash64("label").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return labels
        before = state
        near = (
            edges.join(labels, F.col("y") == F.col("node"))
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        low = labels.join(near, "node").select("node", F.least("label", "near").alias("label"))
        low = cut_lineage(low)
        up = low.select(F.col("node").alias("parent"), F.col("label").alias("top"))
        labels = cut_lineage(low.join(up, F.col("label") == F.col("parent")).select("node", F.least("label", "top").alias("label")))
