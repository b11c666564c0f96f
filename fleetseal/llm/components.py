"""Connected components of links too many for one machine: labels shrink along links and jump to their own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseal.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node. No links: no rows.

    Every round takes the smallest label around a node and then the label of that label, so the rounds grow with the logarithm
    of the longest chain. Each round is written to the shared folder; only a count reaches the driver.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("__near"))
        shrunk = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "__near").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("__next"))
        jumped = stage(shrunk.join(of, "label", "left").select("node", "old", F.least("label", F.coalesce("__next", "label")).alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
