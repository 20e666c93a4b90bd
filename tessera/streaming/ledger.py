"""Event-sourced ledgers: chained appends, folds, fenced messages, recovery budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chained(events: DataFrame, key: str, order: list[str], body: list[str]) -> DataFrame:
    """events with seq (from 1), sha of their body and prev_sha of the event before."""
    w = Window.partitionBy(key).orderBy(*order)
    sha = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in body]), 256)
    return events.withColumn("seq", F.row_number().over(w)).withColumn("sha", sha).withColumn("prev_sha", F.coalesce(F.lag("sha").over(w), F.lit("start")))


def chain_errors(events: DataFrame, key: str) -> DataFrame:
    """Rows whose seq leaves a gap or whose prev_sha is not the sha before."""
    w = Window.partitionBy(key).orderBy("seq")
    bad = (F.col("seq") != F.row_number().over(w)) | (F.col("prev_sha") != F.coalesce(F.lag("sha").over(w), F.lit("start")))
    return events.withColumn("_bad", bad).filter("_bad").drop("_bad")


def folded(events: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """State of each key as a fold of its events: last kind, counts, first and last order. Pre-aggregates map-side."""
    return events.groupBy(key).agg(F.max_by(kind, order).alias("last_kind"), F.count("*").alias("events"), F.count_distinct(kind).alias("kinds"), F.min(order).alias("first"), F.max(order).alias("last"))


def latest_controls(events: DataFrame, target: str, kind: str, order: str, controls: list[str]) -> DataFrame:
    """Control in force for each target: the last of the control events."""
    return events.filter(F.col(kind).isin(*controls)).groupBy(target).agg(F.max_by(kind, order).alias("control"))


def fenced(messages: DataFrame, epochs: DataFrame, key: str) -> DataFrame:
    """Messages whose epoch and incarnation are the key's current ones; others are ignored, as late data is."""
    cur = epochs.groupBy(key).agg(F.max(F.struct("epoch", "incarnation")).alias("cur"))
    return messages.join(cur, key).filter((F.col("epoch") == F.col("cur.epoch")) & (F.col("incarnation") == F.col("cur.incarnation"))).drop("cur")


def heartbeats_merged(workers: DataFrame, beats: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Worker state overlaid with the allowed fields of the latest heartbeat."""
    last = beats.groupBy(key).agg(*[F.max_by(f, "at").alias(f"_{f}") for f in fields])
    j = workers.join(last, key, "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in workers.columns])
