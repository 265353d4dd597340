"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfline.functions.lineage import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (least node of the component) for links ``a`` - ``b`` of long ids.

    Every round a node takes the least label next to it, then the label of
    that label; the number of rounds grows with the logarithm of the longest
    chain. Rounds end when no label changed. Minima are combined before the
    shuffle, so a node may have any number of links.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a != b").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        beside = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        closer = labels.join(beside, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = closer.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = cut_lineage(closer.join(jump, "root", "left").select("node", F.least("root", "above").alias("root"), "old"))
        labels = moved.select("node", "root")
        if moved.where(F.col("root") != F.col("old")).isEmpty():
            return labels
