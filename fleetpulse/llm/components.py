"""Connected components of an edge table, with a checkpointed table for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.tables import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b): `root` is the smallest node that can be reached.

    Each round takes the smallest root among a node's neighbours and then that root's own, so chains shorten by half or
    better. Rows per round are bounded by nodes and links; a node with very many links is reduced before the exchange.
    """
    both = links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("further"))
        moved = lower.join(jump, F.col("root") == F.col("at"), "left")
        new = materialize(moved.select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "roots")
        if not new.where("root <> old").head(1):
            return new.select("node", "root")
        labels = new.select("node", "root")
