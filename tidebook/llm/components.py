"""Connected components of a graph given as links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import durable, join_counted


def connected_components(links: DataFrame) -> DataFrame:
    """Columns node and component (smallest node reachable) for every node in links (a, b).

    Each round takes the smallest label among neighbours and then the label of that
    label, so a path shortens by about half a round. Rounds are checkpointed, as
    their number depends on the data; the loop reads back one count a round. Links
    stay as they are, so a join never sees more rows per node than it has links. Nodes of a
    large component share a label; labels are counted, and the join by label leaves the
    nodes of a common one where they are.
    """
    both = durable(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")
    )
    labels = durable(labels)
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("m"))
            .withColumnRenamed("a", "node")
        )
        pulled = durable(
            labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("to"))
        )
        jump = pulled.select(F.col("node").alias("to"), F.col("to").alias("far"))
        held = pulled.groupBy("to").agg(F.count(F.lit(1)).alias("n"))
        after = durable(
            join_counted(pulled, held.join(jump, "to"), "to").select("node", "was", F.least("to", "far").alias("label"))
        )
        changed = after.where("label <> was").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
