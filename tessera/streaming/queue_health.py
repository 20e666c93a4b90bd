"""Watchdog of a queue: observations of snapshots, and incidents with debounce, cooldown and recovery hysteresis."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .incidents import OUT

# Limits in seconds, per cent and shares.
LIMITS = {
    "scheduler_heartbeat_s": 90,
    "worker_heartbeat_s": 90,
    "load_no_progress_s": 1800,
    "prefill_no_progress_s": 1800,
    "decode_no_progress_s": 300,
    "other_no_progress_s": 1800,
    "imbalance_hold_s": 300,
    "ready_wait_s": 1800,
    "queue_hold_s": 120,
    "recovery_hold_s": 60,
    "cooldown_s": 1800,
    "snapshot_stale_s": 90,
    "utilization_gap_pct": 60,
    "utilization_skew_hold_s": 600,
    "headroom_hold_s": 60,
}


def observations(snapshots: DataFrame, workers: DataFrame, overrides: dict | None = None) -> DataFrame:
    """(at, kind, scope, severity, hold_s) of snapshots(at, time, terminal, coordinator_failed, ready_jobs,
    oldest_ready_wait_s) and their workers(at, worker_id, job_id, phase, heartbeat_at, progress_at,
    compatible_ready_jobs, dependency_wait_jobs, reserve_bytes, gpus (utilization_pct, total_bytes, used_bytes),
    eligible_idle).

    One snapshot a time, small enough to be broadcast, and one row a worker: a snapshot's workers are never gathered.
    A terminal snapshot has no issue. Waiting for dependencies is not being ready, and what a stale snapshot says of
    the queue counts for nothing.
    """
    given = overrides or {}
    if any(k not in LIMITS or isinstance(v, bool) or not 0 < v < float("inf") for k, v in given.items()):
        raise ValueError("unknown or invalid limit")
    p = {**LIMITS, **given}
    at, job = F.col("at"), F.col("job_id")
    row = "struct<kind:string,scope:string,severity:string,hold_s:int>"

    def issue(test: Column, kind: str, scope: Column, severity: str, hold: int = 0) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("kind"), scope.cast("string").alias("scope"), F.lit(severity).alias("severity"), F.lit(hold).alias("hold_s")))

    def told(df: DataFrame, *issues: Column) -> DataFrame:
        return df.select("at", F.inline(F.filter(F.array(*issues).cast(f"array<{row}>"), lambda x: x.isNotNull())))

    live = snapshots.filter(~F.coalesce("terminal", F.lit(False))).withColumn("fresh", at - F.col("time") <= p["snapshot_stale_s"])
    w = workers.join(F.broadcast(live.select("at", "fresh")), "at")
    waits = F.coalesce((F.col("compatible_ready_jobs") == 0) & (F.coalesce("dependency_wait_jobs", F.lit(0)) > 0), F.lit(False))
    watched = (F.size("gpus") > 0) & (at - F.col("heartbeat_at") <= p["worker_heartbeat_s"])
    limit = F.when(F.col("phase") == "loading", p["load_no_progress_s"]).when(F.col("phase") == "prefill", p["prefill_no_progress_s"]).when(F.col("phase") == "decoding", p["decode_no_progress_s"]).otherwise(p["other_no_progress_s"])
    lost = at - F.col("heartbeat_at") > p["worker_heartbeat_s"]
    tight = watched & (F.col("reserve_bytes") > 0) & F.exists("gpus", lambda g: g["total_bytes"] - g["used_bytes"] < F.col("reserve_bytes"))
    worker = F.col("worker_id")
    of_workers = told(
        w,
        issue(tight, "gpu_headroom_low", worker, "warning", p["headroom_hold_s"]),
        issue(job.isNotNull() & lost, "worker_heartbeat_lost", worker, "critical"),
        issue(job.isNotNull() & ~lost & (at - F.col("progress_at") > limit), "worker_no_progress", worker, "critical"),
    )

    busy = watched & ~(F.col("fresh") & job.isNull() & waits)
    use = F.when(busy, F.aggregate("gpus", F.lit(0.0), lambda a, g: a + g["utilization_pct"]) / F.size("gpus"))
    sums = w.groupBy("at").agg(F.count_if(busy).alias("busy"), (F.max(use) - F.min(use)).alias("spread"), F.bool_or(F.col("eligible_idle") & ~waits).alias("idle"), F.bool_or(job.isNotNull()).alias("working"))
    queue, ready = F.lit("queue"), F.col("fresh") & (F.col("ready_jobs") > 0)
    of_queues = told(
        live.join(F.broadcast(sums), "at", "left"),
        issue(F.col("coordinator_failed"), "coordinator_failed", F.lit("scheduler"), "critical"),
        issue(~F.coalesce("coordinator_failed", F.lit(False)) & (at - F.col("time") > p["scheduler_heartbeat_s"]), "scheduler_heartbeat_lost", F.lit("scheduler"), "critical"),
        issue(ready & (F.col("busy") >= 2) & (F.col("spread") >= p["utilization_gap_pct"]), "sustained_utilization_skew", queue, "warning", p["utilization_skew_hold_s"]),
        issue(ready & F.col("idle") & F.col("working"), "allocation_imbalance", queue, "warning", p["imbalance_hold_s"]),
        issue(ready & (F.col("oldest_ready_wait_s") > p["ready_wait_s"]), "ready_queue_overdue", queue, "warning", p["queue_hold_s"]),
    )
    return of_queues.union(of_workers)


def step(state: tuple | None, at: float, severity: str | None, hold: float, cooldown: float = LIMITS["cooldown_s"], recovery: float = LIMITS["recovery_hold_s"]) -> tuple[tuple | None, tuple[str, str, int] | None]:
    """One look at one incident key. state: (since, active, last_sent, episode, clear_since), none without an incident.

    An issue opens an incident once it has been there for `hold`, is told again after `cooldown`, and the incident is
    over, and forgotten, when the issue has been away for `recovery`.
    """
    if severity is None:
        if state is None or not state[1]:
            return None, None
        since, active, sent, episode, clear = state
        clear = at if clear is None else clear
        return ((since, active, sent, episode, clear), None) if at - clear < recovery else (None, ("recovered", "info", episode))
    since, active, sent, episode, _ = state or (at, False, None, 0, None)
    if at - since < hold or (active and at - sent < cooldown):
        return (since, active, sent, episode, None), None
    episode += not active
    return (since, True, at, episode, None), ("reminder" if active else "open", severity, episode)


def incidents(ticks: DataFrame, found: DataFrame, recovery: float = LIMITS["recovery_hold_s"]) -> DataFrame:
    """Incident events of found(kind, scope, at, severity, hold_s) over all looks ticks(at), as a fold of each key.

    A key is looked at when it is found, at the first look without it and at the first look `recovery` later; other
    looks change nothing. Looks are one row each, small enough to be broadcast, and only they are put in one order;
    what is found is dealt to tasks by key once and streamed in order, not collected.
    """
    looks = ticks.select("at").union(found.select("at")).distinct()
    # the first look at or after each look + recovery: looks and wishes in one order, read backwards
    wish = looks.select((F.col("at") + recovery).alias("at"), F.col("at").alias("from"), F.lit(0).alias("look"))
    both = wish.unionByName(looks.select("at", F.lit(1).alias("look")), allowMissingColumns=True)
    later = both.withColumn("over", F.min(F.when(F.col("look") == 1, F.col("at"))).over(Window.orderBy(F.desc("at"), F.desc("look")).rowsBetween(Window.unboundedPreceding, 0)))
    ahead = later.filter("look = 0").select(F.col("from").alias("at"), "over").withColumn("then", F.lead("at").over(Window.orderBy("at"))).withColumn("over", F.lead("over").over(Window.orderBy("at")))
    order = Window.partitionBy("kind", "scope").orderBy("at")
    seen = found.repartition("kind", "scope").groupBy("kind", "scope", "at").agg(F.max("severity").alias("severity"), F.max("hold_s").alias("hold_s")).withColumn("next", F.lead("at").over(order))
    seen = seen.join(F.broadcast(ahead), "at", "left")
    before = lambda t: F.coalesce(F.col("next").isNull() | (t < F.col("next")), F.lit(False))
    then, over = F.col("then"), F.col("over")
    gone = F.when(before(then), then).cast("double").alias("gone")
    later = F.when(before(then) & before(over) & (over > then), over).cast("double").alias("later")
    rows = seen.select("kind", "scope", F.col("at").cast("double").alias("at"), "severity", F.col("hold_s").cast("double").alias("hold_s"), gone, later)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for p in parts:
            out = []
            for kind, scope, found_at, severity, hold, gone, later in zip(*(p[c].tolist() for c in p), strict=True):
                if (kind, scope) != key:
                    key, state = (kind, scope), None
                for at, what in ((found_at, severity), (gone, None), (later, None)):
                    if at != at:  # no such look
                        continue
                    state, event = step(state, at, what, hold if what else 0.0, recovery=recovery)
                    if event:
                        out.append((kind, scope, at, *event, f"{kind}:{scope}:{event[2]}:{event[0]}:{at:.0f}"))
            yield pd.DataFrame(out, columns=[f.name for f in OUT])

    return rows.sortWithinPartitions("kind", "scope", "at").mapInPandas(fold, OUT)
