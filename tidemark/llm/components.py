"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import parts, stored


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of edges (a, b): the least node that a path leads to.

    Each round takes the least label among a node and its neighbours, then the label's own label, so
    the number of rounds grows as the logarithm of a component's width. Minima combine before the
    shuffle. A node or label that very many rows name (the centre of a star) is looked up by broadcast,
    at most four of them for each partition, so its rows need not come together. No edges: no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = stored(both)
    share = max(64, both.count() // (4 * parts(edges.sparkSession)))
    centres = stored(both.groupBy("b").count().filter(F.col("count") > share).select("b"))
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        of = labels.withColumnRenamed("a", "b")
        few = of.join(F.broadcast(centres), "b", "left_semi")
        seen = both.join(F.broadcast(few), "b").unionByName(both.join(F.broadcast(centres), "b", "left_anti").join(of, "b"))
        near = seen.groupBy("a").agg(F.min("label").alias("near"))
        down = stored(labels.join(near, "a").select("a", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        # the label's own label, from before this round
        common = stored(down.groupBy("label").count().filter(F.col("count") > share).select("label"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("next"))
        near = down.join(F.broadcast(jump.join(F.broadcast(common), "label", "left_semi")), "label").unionByName(down.join(F.broadcast(common), "label", "left_anti").join(jump, "label"))
        down = stored(near.select("a", "old", F.least("label", "next").alias("label")))
        labels = down.select("a", "label")
        if not down.filter("old <> label").take(1):
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
