"""Connected components of a graph of links, by label propagation over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.llm._common import forget, saved


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of links (a, b).

    Each round every node takes the least label among its neighbours and then the label of its label, so that long
    chains shorten by half; labels only fall, and the rounds end when none does. Labels are written as a table each
    round; the driver learns only how many fell.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("heard"))
        near = labels.join(heard, labels.node == heard.a, "left").select("node", "component", F.least("component", "heard").alias("low"))
        hop = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        after = near.join(hop, "low", "left").select("node", F.least("low", "further").alias("next"), (F.least("low", "further") < F.col("component")).alias("fell"))
        done = saved(after, "labels")
        fell = done.where("fell").limit(1).count()
        forget(labels)
        labels = done.select("node", F.col("next").alias("component"))
        if not fell:
            return labels
