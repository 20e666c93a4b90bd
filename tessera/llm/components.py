"""Connected components by min-label propagation with pointer jumping over saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(tables: Tables, edges: DataFrame, tag: str) -> DataFrame:
    """Smallest reachable node for every node of `edges` (a, b).

    Returns (node, root). Nodes without an edge are absent; self loops and repeated edges are harmless;
    no edges give no rows. Each step is a pre-aggregated group-by and equi-joins, saved before the next.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = tables.save(both, f"{tag}-sym")
    labels = tables.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), f"{tag}-0")
    step = 0
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        new = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "m").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("above"))
        new = new.join(up, "low", "left").select("node", F.coalesce("above", "low").alias("root"), (F.coalesce("above", "low") != F.col("root")).alias("moved"))
        step += 1
        saved = tables.save(new, f"{tag}-{step}")
        done = saved.filter("moved").limit(1).count() == 0
        tables.drop(f"{tag}-{step - 1}")
        labels = saved.select("node", "root")
        if done:
            return labels
