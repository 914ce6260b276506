"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b: long), label being the least node of its
    component. In each round a node takes the least label of itself, its neighbours and the node
    that it is labelled with, until nothing changes; chains shorten by half each round. Nothing
    is gathered: minima combine on the map side, and the join on a much-linked node can be
    split. No links give no rows.
    """
    with scratch():
        both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
        labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
        both = written(both)
        while True:
            around = both.union(labels).join(labels, F.col("b") == F.col("node")).select("a", "label", F.lit(None).cast("long").alias("own"))
            after = around.union(labels.select("node", "label", "label")).groupBy("a").agg(F.min("label").alias("label"), F.max("own").alias("own"))
            after = written(after)
            labels = after.select(F.col("a").alias("node"), "label")
            if after.where("label < own").isEmpty():
                return written(labels, outer=True)
