"""Connected components of a stored set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.operators.joins import HOT_ROWS, spread_join
from rolecall.session import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node.

    Each round takes the smallest label among a node's neighbours and then the label's own
    label, which halves the distances. The links of a node with very many are cut into
    pieces before they join, and the smallest label combines within tasks. The second join
    has rows of two numbers, which Spark may split where one label is frequent. Every round's
    table is written, so that a lost executor never repeats earlier rounds.
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    degrees = staged(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS), "degrees")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        met = spread_join(both, labels.select(F.col("node").alias("b"), "component"), "b", degrees, "a")
        near = met.groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "low").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("top"))
        done = staged(lower.join(up, "low").select("node", F.col("component").alias("old"), F.least("low", "top").alias("component")), "labels")
        labels = done.select("node", "component")
        if not done.filter("old <> component").limit(1).count():
            return labels
