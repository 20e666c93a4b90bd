"""Tiered name matching, support roll-ups, coverage and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tiered_match(labels: DataFrame, catalog: DataFrame, tiers: list[tuple[str, Column, Column]]) -> DataFrame:
    """Match labels(label_id, ...) with catalog(object_id, ...) by the first tier that has a candidate.

    Tiers are (reason, label key, catalog key) in falling strength and cascade: a hit in one hides the later
    ones. One candidate is a match, several are ambiguous, none is unresolved. Each tier is an equi-join.
    """
    found = None
    for i, (_, a, b) in enumerate(tiers):
        x = labels.select("label_id", a.alias("_k")).filter("_k is not null").join(catalog.select("object_id", b.alias("_k")), "_k").select("label_id", "object_id", F.lit(i).alias("tier")).distinct()
        found = x if found is None else found.union(x)
    best = Window.partitionBy("label_id")
    found = found.withColumn("best", F.min("tier").over(best)).filter("tier = best")
    by = found.groupBy("label_id").agg(F.min("tier").alias("tier"), F.count("*").alias("candidates"), F.min("object_id").alias("object_id"))
    names = F.element_at(F.array(*[F.lit(r) for r, _, _ in tiers]), F.col("tier") + 1)
    out = labels.select("label_id").join(by, "label_id", "left")
    one = F.coalesce(F.col("candidates") == 1, F.lit(False))
    reason = F.when(one, names).when(F.col("candidates") > 1, "ambiguous_scope_or_name").otherwise("no_supported_mapping")
    return out.select("label_id", F.when(one, "matched").otherwise("unresolved").alias("status"), reason.alias("reason"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(one, F.col("object_id")).alias("object_id"))


def support_rates(decisions: DataFrame, unit: str, arm: str, hit: Column) -> DataFrame:
    """Per arm: decisions, hits, pooled rate and the mean of the units' rates. Units without decisions don't count."""
    by = decisions.groupBy(arm, unit).agg(F.count("*").alias("n"), F.count_if(hit).alias("h"))
    out = by.groupBy(arm).agg(F.sum("n").alias("decisions"), F.sum("h").alias("hits"), F.avg(F.try_divide(F.col("h"), F.col("n"))).alias("macro_rate"))
    return out.select(arm, "decisions", "hits", F.try_divide(F.col("hits"), F.col("decisions")).alias("pooled_rate"), "macro_rate")


def dedup_decisions(decisions: DataFrame, keys: list[str], order: str, mention: str, evidence: str) -> DataFrame:
    """Equal decisions become one: their mentions in order and their distinct evidence in order of first sight."""
    e = decisions.groupBy(*keys, evidence).agg(F.min(order).alias("seen")).groupBy(*keys)
    ev = e.agg(F.transform(F.sort_array(F.collect_list(F.struct("seen", F.col(evidence).alias("it")))), lambda x: x["it"]).alias("evidence"))
    m = decisions.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(mention).alias("it")))), lambda x: x["it"]).alias("mentions"))
    return m.join(ev, keys)


def evidence_ids(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct evidence numbered e0001 on by first sight."""
    g = df.groupBy(*keys).agg(F.min(order).alias("first"))
    return g.withColumn("evidence_id", F.format_string("e%04d", F.row_number().over(Window.orderBy("first", *keys)))).drop("first")


def min_label_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of string or integer nodes: (node, root), smallest reachable node.

    Every round takes the least label of all neighbours and jumps once; tables are checkpointed every round, so
    lineage stays short. Stops when nothing moves.
    """
    from .tables import saved

    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = saved(spark, both.union(both.select("y", "x")).union(both.select("x", "x")).union(both.select("y", "y")).distinct())
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("root"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("above"))
        new = labels.join(near, "node").join(up, "low", "left").select("node", F.least("root", "low", F.coalesce("above", "low")).alias("new"), "root")
        new = saved(spark, new)
        labels = new.select("node", F.col("new").alias("root"))
        if not new.filter("new <> root").limit(1).count():
            return labels
