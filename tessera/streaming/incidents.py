"""Health issues of worker snapshots and the incident state machine over a stream of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

# Limits in seconds.
LIMITS = {"heartbeat_s": 90, "decode_no_progress_s": 300, "load_no_progress_s": 1800, "prefill_no_progress_s": 1800, "dependency_starvation_s": 300, "validation_backlog_s": 300, "reminder_s": 1800}
RANK = {"info": 0, "warning": 1, "critical": 2}
ISSUE = "kind string, scope string, severity string, age_s double, threshold_s double"


def policy(overrides: dict | None = None) -> dict:
    """The limits with overrides; unknown names and values that are not positive numbers are errors."""
    given = overrides or {}
    for k, v in given.items():
        if k not in LIMITS or isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 < v < float("inf"):
            raise ValueError(f"invalid_threshold:{k}")
    return {**LIMITS, **given}


def issues(snapshots: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Issue rows of snapshots(at, worker_id, phase, heartbeat_at, progress_at, dependency_wait_jobs,
    dependency_idle_since, maintenance_until): at, kind, scope, severity, age_s, threshold_s.

    Times are seconds. Heartbeats and progress compare strictly; starvation is critical from twice its limit;
    confirmed maintenance before its deadline silences a worker. Stateless, so it also runs on streams.
    """
    p = policy(overrides)
    at = F.col("at")
    quiet = F.coalesce(at < F.col("maintenance_until"), F.lit(False))
    beat, moved, idle = at - F.col("heartbeat_at"), at - F.col("progress_at"), at - F.col("dependency_idle_since")
    limit = F.when(F.col("phase").isin("decode", "decoding"), p["decode_no_progress_s"]).when(F.col("phase").isin("load", "loading"), p["load_no_progress_s"]).when(F.col("phase") == "prefill", p["prefill_no_progress_s"])

    def issue(test: Column, kind: str, severity: Column, age: Column, threshold: Column) -> Column:
        row = F.struct(F.lit(kind).alias("kind"), F.col("worker_id").cast("string").alias("scope"), severity.alias("severity"), age.cast("double").alias("age_s"), threshold.cast("double").alias("threshold_s"))
        return F.when(F.coalesce(test, F.lit(False)), row)

    starving = p["dependency_starvation_s"]
    found = F.array(
        issue(F.col("maintenance_until") <= at, "reservation_expired", F.lit("critical"), at - F.col("maintenance_until"), F.lit(0)),
        issue(~quiet & (beat > p["heartbeat_s"]), "worker_heartbeat_lost", F.lit("critical"), beat, F.lit(p["heartbeat_s"])),
        issue(~quiet & (moved > limit), "worker_no_progress", F.lit("critical"), moved, limit),
        issue(~quiet & (F.col("dependency_wait_jobs") > 0) & (idle > starving), "dependency_starvation", F.when(idle >= 2 * starving, "critical").otherwise("warning"), idle, F.lit(starving)),
    )
    return snapshots.select("at", F.inline(F.filter(found, lambda x: x.isNotNull())))


def step(state: tuple | None, at: float, severity: str | None, reminder_s: float = LIMITS["reminder_s"]) -> tuple[tuple | None, tuple[str, str, int] | None]:
    """One observation of one incident key. state: (active, episode, severity, last_event_at).

    severity None means that the issue is gone. Returns the new state and (transition, severity, episode).
    """
    active, episode, rank, last = state or (False, 0, "info", at)
    if severity is None:
        return ((False, episode, rank, at), ("recovered", "info", episode)) if active else (state, None)
    if not active:
        return (True, episode + 1, severity, at), ("open", severity, episode + 1)
    if RANK[severity] > RANK[rank]:
        return (True, episode, severity, at), ("reminder", severity, episode)
    if at - last >= reminder_s:
        return (True, episode, rank, at), ("reminder", rank, episode)
    return state, None


OUT = T.StructType().add("kind", "string").add("scope", "string").add("at", "double").add("transition", "string").add("severity", "string").add("episode", "long").add("event_id", "string")


def observations(ticks: DataFrame, found: DataFrame) -> DataFrame:
    """What was found of each (kind, scope), and a row with a null severity at the tick where it is first gone again.

    Ticks at which a key stays gone change nothing, so they make no rows: at most two rows for each one found. The
    tick after a tick comes from one row a tick.
    """
    all_ticks = ticks.select("at").union(found.select("at")).distinct()
    after = all_ticks.select("at", F.lead("at").over(Window.orderBy("at")).alias("then"))
    seen = found.groupBy("kind", "scope", "at").agg(F.max_by("severity", F.when(F.col("severity") == "critical", 2).otherwise(1)).alias("severity"))
    gone = seen.join(after, "at").filter("then is not null").select("kind", "scope", F.col("then").alias("at"))
    gone = gone.join(seen.select("kind", "scope", "at"), ["kind", "scope", "at"], "left_anti")
    return seen.union(gone.select("kind", "scope", "at", F.lit(None).cast("string")))


def transitions(obs: DataFrame, reminder_s: float = LIMITS["reminder_s"]) -> DataFrame:
    """Incident events of observations(kind, scope, at, severity), as a fold of each key in order.

    Partitions are sorted and streamed, so no key is collected.
    """

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for p in parts:
            out = []
            for kind, scope, at, severity in zip(p["kind"], p["scope"], p["at"], p["severity"], strict=True):
                if (kind, scope) != key:
                    key, state = (kind, scope), None
                state, event = step(state, float(at), severity if isinstance(severity, str) else None, reminder_s)
                if event:
                    out.append((kind, scope, float(at), *event, f"{kind}:{scope}:{event[2]}:{event[0]}:{at:.0f}"))
            yield pd.DataFrame(out, columns=[f.name for f in OUT])

    return obs.select("kind", "scope", F.col("at").cast("double").alias("at"), "severity").repartition("kind", "scope").sortWithinPartitions("kind", "scope", "at").mapInPandas(fold, OUT)


class IncidentProcessor(StatefulProcessor):
    """The same machine as a stateful streaming operator, keyed by (kind, scope); late observations are fenced off."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("incident", T.StructType().add("active", "boolean").add("episode", "long").add("severity", "string").add("last", "double").add("seen", "double"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self.state.get() if self.state.exists() else None
        state, seen = (tuple(s[:4]), s[4]) if s else (None, float("-inf"))
        out = []
        for at, severity in sorted((float(a), v if isinstance(v, str) else None) for p in rows for a, v in zip(p["at"], p["severity"], strict=True)):
            if at <= seen:
                continue
            seen = at
            state, event = step(state, at, severity)
            if event:
                out.append((*key, at, *event, f"{key[0]}:{key[1]}:{event[2]}:{event[0]}:{at:.0f}"))
        if state is not None:
            self.state.update((*state, seen))
        yield pd.DataFrame(out, columns=[f.name for f in OUT])

    def close(self) -> None:
        pass


def stream_transitions(obs: DataFrame) -> DataFrame:
    """Incident events of a stream of observations(kind, scope, at, severity)."""
    return obs.groupBy("kind", "scope").transformWithStateInPandas(IncidentProcessor(), OUT, outputMode="append", timeMode="none")


def active_episode(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows since the last `open` of each key and the highest severity delivered in it."""
    w = Window.partitionBy(*key)
    x = events.withColumn("_from", F.max(F.when(F.col("transition") == "open", F.col(order))).over(w)).filter(F.col(order) >= F.col("_from"))
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return x.groupBy(*key).agg(F.count("*").alias("events"), F.max_by("severity", F.struct(rank, order)).alias("highest"), F.max_by("transition", order).alias("last_transition"))


def backoff(attempt: Column) -> Column:
    """Seconds to wait before delivery attempt n of an outbox row: min(300, 5 * 2 ** min(n, 6))."""
    return F.least(F.lit(300), 5 * F.pow(F.lit(2), F.least(attempt, F.lit(6)))).cast("long")


def outbox_sink(path: str):
    """foreachBatch writer that appends only events whose event_id is not there yet; replays change nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["event_id"])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            new = new.join(spark.read.schema(batch.schema).parquet(path).select("event_id"), "event_id", "left_anti")
        new.write.mode("append").parquet(path)

    return write
