"""Connected components of an edge table, as labels of its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.common import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, was, component), a written table: component is the least node that each node of ``edges`` is connected to.

    Every round lets each node take the least label beside it and then its label's label, so the
    rounds grow with the logarithm of a component's width. Each round is written to the shared
    folder; nothing but a count comes to the driver.
    """
    both = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct(), "edges", reduced=True)
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels", reduced=True)
    while True:
        beside = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(beside, F.col("node") == F.col("a")).select("node", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        nearer = materialise(nearer, "labels", reduced=True)
        of = nearer.select(F.col("node").alias("_of"), F.col("next").alias("_its"))
        jumped = materialise(nearer.join(of, F.col("next") == F.col("_of"), "left").select("node", "was", F.least("next", F.coalesce("_its", "next")).alias("component")), "labels", reduced=True)
        discard(nearer, labels)
        if jumped.filter(F.col("was") != F.col("component")).isEmpty():
            discard(both)
            return jumped
        labels = jumped
