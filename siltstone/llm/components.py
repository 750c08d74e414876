"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, label): the smallest node reachable; nodes without a link don't appear.

    Every round takes the least label of the neighbours, then the label's own
    label, so a chain shrinks by halves. Rounds are written tables; sums stay
    on the executors and only one number, how many labels changed, is read.
    """
    both = written(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("label").alias("near"))
            .withColumnRenamed("a", "node")
        )
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("label").alias("up"))
        new = written(
            met.join(up, "mid").select("node", F.least("mid", "up").alias("label"), (F.least("mid", "up") < F.col("old")).alias("moved")),
            "labels",
        )
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels
