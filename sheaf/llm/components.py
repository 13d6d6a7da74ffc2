"""Connected components as joins and aggregates: smallest label spreads, pointers jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of long ids -> (node, root): the smallest id reachable, for ids with an edge.

    Self-loops, repeats and either direction are fine; null ends are left out.
    Every round is written to the shared folder, so no lineage grows. A hub only meets
    a partial minimum and an equi-join, which the engine can split.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    both = written(e.select("a", "b").union(e.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = written(step.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")))
        changed = new.where("root <> was").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
