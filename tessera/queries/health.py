"""Ledger folds, health issues and incident transitions over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming import incidents, ledger, queue_health
from .base import read


def _sec(c):
    return (F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000).cast("long")


def event_fold(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    x = ledger.folded(e.select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")
    c = ledger.latest_controls(e, "user_id", "event_type", "event_id", ["signup", "error"])
    return x.join(c, "user_id", "left").select("user_id", "last_kind", "events", "kinds", "control")


def chain_audit(spark, sf_dir):
    e = ledger.chained(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])
    bad = e.withColumn("prev_sha", F.when(F.col("event_id") % 101 == 0, F.lit("x")).otherwise(F.col("prev_sha")))
    return ledger.chain_errors(bad, "user_id").select("user_id", "event_id")


def fenced_messages(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    epochs = e.filter("event_type = 'signup'").select("user_id", F.to_date("ts").alias("epoch"), F.lit(1).alias("incarnation"))
    m = e.filter("event_type = 'click'").select("user_id", "event_id", F.to_date("ts").alias("epoch"), F.when(F.col("event_id") % 4 == 0, 2).otherwise(1).alias("incarnation"))
    return ledger.fenced(m, epochs, "user_id").select("user_id", "event_id")


def heartbeat_merge(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("idle").alias("phase"), F.col("c_nationkey").cast("long").alias("place"))
    b = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), F.col("event_type").alias("phase"))
    return ledger.heartbeats_merged(c, b, "user_id", ["phase"])


def _snapshots(spark, sf_dir):
    """Each event as a snapshot of its user's worker: progress is the event before, a third wait for others."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = _sec("ts")
    return e.select(t.alias("at"), F.col("user_id").alias("worker_id"), F.when(F.col("event_type") == "view", "decode").when(F.col("event_type") == "click", "load").otherwise("idle").alias("phase"), F.lag(t).over(w).alias("heartbeat_at"), F.lag(t).over(w).alias("progress_at"), (F.col("event_id") % 3).alias("dependency_wait_jobs"), F.lag(t, 2).over(w).alias("dependency_idle_since"), F.when(F.col("event_id") % 7 == 0, t + 60).when(F.col("event_id") % 7 == 1, t - 60).alias("maintenance_until"))


def issue_rows(spark, sf_dir):
    i = incidents.issues(_snapshots(spark, sf_dir))
    return i.groupBy("kind", "severity").agg(F.count("*").alias("n"), F.sum("age_s").cast("long").alias("age"))


def _observations(spark, sf_dir):
    """Daily ticks of users: an error makes a warning, several on a day a critical issue."""
    e = read(spark, sf_dir, "events")
    day = (F.floor(_sec("ts") / 86400) * 86400).cast("long")
    found = e.filter("event_type = 'error'").groupBy(F.lit("errors").alias("kind"), F.col("user_id").cast("string").alias("scope"), day.alias("at")).agg(F.when(F.count("*") > 1, "critical").otherwise("warning").alias("severity"))
    return incidents.observations(e.select(day.alias("at")), found)


def incident_transitions(spark, sf_dir):
    return incidents.transitions(_observations(spark, sf_dir), reminder_s=86400).select("kind", "scope", F.col("at").cast("long").alias("at"), "transition", "severity", "episode")


def active_episodes(spark, sf_dir):
    return incidents.active_episode(incidents.transitions(_observations(spark, sf_dir), reminder_s=86400), ["kind", "scope"], "at")


def _queue(spark, sf_dir):
    """Each hour of events as a snapshot of a queue, and its workers: users, whose last event of the hour is their state."""
    e = read(spark, sf_dir, "events")
    t, k = _sec("ts"), F.col("event_id")
    hour = (F.floor(t / 3600) * 3600 + 3600).cast("long")
    last = e.groupBy(hour.alias("at"), "user_id").agg(F.max_by(F.struct(t.alias("t"), k.alias("k"), "event_type"), F.struct(t, k)).alias("x")).select("at", "user_id", "x.*")
    gpu = F.struct((F.col("k") % 100).cast("double").alias("utilization_pct"), F.lit(100).alias("total_bytes"), (F.col("k") % 97).cast("int").alias("used_bytes"))
    workers = last.select("at", F.col("user_id").cast("string").alias("worker_id"), F.when(F.col("k") % 3 > 0, F.col("k")).alias("job_id"), F.when(F.col("event_type") == "view", "decoding").when(F.col("event_type") == "click", "loading").otherwise("other").alias("phase"), (F.col("t") + F.when(F.col("k") % 4 == 0, 0).otherwise(3500)).alias("heartbeat_at"), F.col("t").alias("progress_at"), (F.col("k") % 2).alias("compatible_ready_jobs"), (F.col("k") % 5).alias("dependency_wait_jobs"), F.lit(10).alias("reserve_bytes"), F.array(gpu).alias("gpus"), (F.col("k") % 3 == 0).alias("eligible_idle"))
    s = last.groupBy("at").agg(F.max("t").alias("newest"), F.max("k").alias("top"))
    return s.select("at", (F.col("newest") + F.when(F.col("top") % 2 == 0, 3550).otherwise(0)).alias("time"), (F.col("top") % 29 == 0).alias("terminal"), (F.col("top") % 13 == 0).alias("coordinator_failed"), (F.col("top") % 3).alias("ready_jobs"), ((F.col("top") % 40) * 100).alias("oldest_ready_wait_s")), workers


def queue_issues(spark, sf_dir):
    return queue_health.observations(*_queue(spark, sf_dir)).groupBy("kind", "severity", "hold_s").agg(F.count("*").alias("n"), F.count_distinct("scope").alias("scopes"))


def queue_incidents(spark, sf_dir):
    """Incidents of the hourly snapshots: held, told again after a cooldown, over after an hour without."""
    q, workers = _queue(spark, sf_dir)
    return queue_health.incidents(q.select("at"), queue_health.observations(q, workers), recovery=3600).select("kind", "scope", F.col("at").cast("long").alias("at"), "transition", "severity", "episode")


def outbox_backoff(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", incidents.backoff(F.col("n_nationkey")).alias("wait_s"))


QUERIES = {f.__name__: f for f in (event_fold, chain_audit, fenced_messages, heartbeat_merge, issue_rows, incident_transitions, active_episodes, queue_issues, queue_incidents, outbox_backoff)}

_OBS = """
    d AS (SELECT CAST(user_id AS VARCHAR) AS scope, CAST(floor(epoch_us(ts) / 1000000 / 86400) * 86400 AS BIGINT) AS "at", event_type FROM events),
    f AS (SELECT scope, "at", CASE WHEN count(*) > 1 THEN 2 ELSE 1 END AS s FROM d WHERE event_type = 'error' GROUP BY ALL),
    k AS (SELECT scope, min("at") AS since FROM f GROUP BY scope),
    o AS (SELECT k.scope, t."at", f.s FROM k JOIN (SELECT DISTINCT "at" FROM d) t ON t."at" >= k.since LEFT JOIN f ON f.scope = k.scope AND f."at" = t."at"),
    n AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY "at") AS i FROM o),
    r AS (SELECT scope, "at", i, s, true AS active, 1::BIGINT AS episode, s AS sev, "at" AS last, 'open' AS tr FROM n WHERE i = 1
        UNION ALL SELECT n.scope, n."at", n.i, n.s, n.s IS NOT NULL, CASE WHEN n.s IS NOT NULL AND NOT r.active THEN r.episode + 1 ELSE r.episode END,
            CASE WHEN n.s IS NULL THEN r.sev WHEN NOT r.active THEN n.s ELSE greatest(r.sev, n.s) END,
            CASE WHEN (n.s IS NULL AND r.active) OR (n.s IS NOT NULL AND (NOT r.active OR n.s > r.sev OR n."at" - r.last >= 86400)) THEN n."at" ELSE r.last END,
            CASE WHEN n.s IS NULL THEN CASE WHEN r.active THEN 'recovered' END WHEN NOT r.active THEN 'open' WHEN n.s > r.sev OR n."at" - r.last >= 86400 THEN 'reminder' END
        FROM r JOIN n ON n.scope = r.scope AND n.i = r.i + 1),
    v AS (SELECT 'errors' AS kind, scope, "at", tr AS transition, CASE WHEN tr = 'recovered' THEN 'info' WHEN sev = 2 THEN 'critical' ELSE 'warning' END AS severity, episode FROM r WHERE tr IS NOT NULL)"""

_QUEUE = """
    e AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t FROM events),
    h AS (SELECT CAST(floor(t / 3600) * 3600 + 3600 AS BIGINT) AS tick, user_id AS u, max(struct_pack(t := t, k := event_id, y := event_type)) AS x FROM e GROUP BY 1, 2),
    w AS (SELECT tick, CAST(u AS VARCHAR) AS id, x.t AS t, x.k AS k, x.y AS y, x.k % 3 > 0 AS job, tick - x.t - CASE WHEN x.k % 4 = 0 THEN 0 ELSE 3500 END AS beat, x.k % 2 = 0 AND x.k % 5 > 0 AS dep FROM h),
    s AS (SELECT tick, max(k) AS top, tick - max(t) - CASE WHEN max(k) % 2 = 0 THEN 3550 ELSE 0 END AS age FROM w GROUP BY tick),
    l AS (SELECT w.*, top, age, age <= 90 AS fresh FROM w JOIN s USING (tick) WHERE top % 29 <> 0),
    q AS (SELECT tick, any_value(top) AS top, any_value(age) AS age, any_value(fresh) AS fresh, bool_or(job) AS busy, count(*) FILTER (WHERE NOT job AND NOT dep) AS idle,
        count(*) FILTER (WHERE beat <= 90 AND NOT (fresh AND NOT job AND dep)) AS watched, max(k % 100) FILTER (WHERE beat <= 90 AND NOT (fresh AND NOT job AND dep)) - min(k % 100) FILTER (WHERE beat <= 90 AND NOT (fresh AND NOT job AND dep)) AS gap FROM l GROUP BY tick),
    o AS (SELECT tick, 'coordinator_failed' AS kind, 'scheduler' AS scope, 'critical' AS severity, 0 AS hold FROM q WHERE top % 13 = 0
        UNION ALL SELECT tick, 'scheduler_heartbeat_lost', 'scheduler', 'critical', 0 FROM q WHERE top % 13 <> 0 AND age > 90
        UNION ALL SELECT tick, 'sustained_utilization_skew', 'queue', 'warning', 600 FROM q WHERE fresh AND top % 3 > 0 AND watched >= 2 AND gap >= 60
        UNION ALL SELECT tick, 'allocation_imbalance', 'queue', 'warning', 300 FROM q WHERE fresh AND top % 3 > 0 AND idle > 0 AND busy
        UNION ALL SELECT tick, 'ready_queue_overdue', 'queue', 'warning', 120 FROM q WHERE fresh AND top % 3 > 0 AND (top % 40) * 100 > 1800
        UNION ALL SELECT tick, 'gpu_headroom_low', id, 'warning', 60 FROM l WHERE beat <= 90 AND 100 - k % 97 < 10
        UNION ALL SELECT tick, 'worker_heartbeat_lost', id, 'critical', 0 FROM l WHERE job AND beat > 90
        UNION ALL SELECT tick, 'worker_no_progress', id, 'critical', 0 FROM l WHERE job AND beat <= 90 AND tick - t > CASE y WHEN 'view' THEN 300 ELSE 1800 END)"""

ORACLES = {
    "queue_issues": f"WITH {_QUEUE} SELECT kind, severity, hold AS hold_s, count(*) AS n, count(DISTINCT scope) AS scopes FROM o GROUP BY ALL",
    "queue_incidents": f"""WITH RECURSIVE {_QUEUE}, c AS (SELECT DISTINCT kind, scope FROM o), a AS (SELECT tick, row_number() OVER (ORDER BY tick) AS i FROM s),
        g AS (SELECT a.tick, a.i, c.kind, c.scope, o.severity, o.hold FROM a CROSS JOIN c LEFT JOIN o ON o.tick = a.tick AND o.kind = c.kind AND o.scope = c.scope),
        r AS (SELECT kind, scope, 0::BIGINT AS i, NULL::BIGINT AS tick, NULL::BIGINT AS since, false AS active, NULL::BIGINT AS sent, 0::BIGINT AS episode, NULL::BIGINT AS clr, NULL::VARCHAR AS transition, NULL::VARCHAR AS severity FROM c
            UNION ALL SELECT n.kind, n.scope, n.i, n.tick,
                CASE WHEN n.severity IS NOT NULL THEN n.since WHEN n.active AND NOT n.over THEN n.since END, CASE WHEN n.severity IS NOT NULL THEN n.active OR n.tells ELSE n.active AND NOT n.over END,
                CASE WHEN n.severity IS NOT NULL AND n.tells THEN n.tick WHEN n.severity IS NULL AND (NOT n.active OR n.over) THEN NULL ELSE n.sent END,
                CASE WHEN n.severity IS NOT NULL THEN n.episode + CASE WHEN n.tells AND NOT n.active THEN 1 ELSE 0 END WHEN n.active AND NOT n.over THEN n.episode ELSE 0 END,
                CASE WHEN n.severity IS NULL AND n.active AND NOT n.over THEN n.clr END,
                CASE WHEN n.severity IS NOT NULL THEN CASE WHEN n.tells THEN CASE WHEN n.active THEN 'reminder' ELSE 'open' END END WHEN n.active AND n.over THEN 'recovered' END || ':' || CASE WHEN n.severity IS NULL THEN n.episode ELSE n.episode + CASE WHEN n.active THEN 0 ELSE 1 END END,
                CASE WHEN n.severity IS NULL THEN 'info' ELSE n.severity END
            FROM (SELECT m.*, m.severity IS NOT NULL AND m.tick - m.since >= m.hold AND (NOT m.active OR m.tick - m.sent >= 1800) AS tells, m.severity IS NULL AND m.active AND m.tick - m.clr >= 3600 AS over
                FROM (SELECT g.kind, g.scope, g.i, g.tick, g.severity, g.hold, coalesce(r.since, g.tick) AS since, r.active, r.sent, r.episode, coalesce(r.clr, g.tick) AS clr FROM r JOIN g ON g.kind = r.kind AND g.scope = r.scope AND g.i = r.i + 1) m) n)
        SELECT kind, scope, tick AS "at", split_part(transition, ':', 1) AS transition, severity, CAST(split_part(transition, ':', 2) AS BIGINT) AS episode FROM r WHERE transition IS NOT NULL""",
    "event_fold": """
        SELECT user_id, arg_max(event_type, event_id) AS last_kind, count(*) AS events, count(DISTINCT event_type) AS kinds, arg_max(event_type, event_id) FILTER (WHERE event_type IN ('signup', 'error')) AS control FROM events GROUP BY user_id""",
    "chain_audit": "SELECT user_id, event_id FROM events WHERE event_id % 101 = 0",
    "fenced_messages": """
        WITH p AS (SELECT user_id, max(CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'signup' GROUP BY 1)
        SELECT e.user_id, event_id FROM events e JOIN p ON p.user_id = e.user_id AND CAST(ts AS DATE) = d WHERE event_type = 'click' AND event_id % 4 <> 0""",
    "heartbeat_merge": """
        WITH b AS (SELECT user_id, arg_max(event_type, event_id) AS phase FROM events GROUP BY 1)
        SELECT c_custkey AS user_id, coalesce(phase, 'idle') AS phase, CAST(c_nationkey AS BIGINT) AS place FROM customer LEFT JOIN b ON user_id = c_custkey""",
    "issue_rows": """
        WITH t AS (SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS "at" FROM events),
        s AS (SELECT "at", event_id, CASE event_type WHEN 'view' THEN 300 WHEN 'click' THEN 1800 END AS lim, "at" - lag("at") OVER w AS beat, "at" - lag("at", 2) OVER w AS idle, event_id % 7 AS m FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT 'reservation_expired' AS kind, 'critical' AS severity, 60 AS age FROM s WHERE m = 1
            UNION ALL SELECT 'worker_heartbeat_lost', 'critical', beat FROM s WHERE m <> 0 AND beat > 90
            UNION ALL SELECT 'worker_no_progress', 'critical', beat FROM s WHERE m <> 0 AND beat > lim
            UNION ALL SELECT 'dependency_starvation', CASE WHEN idle >= 600 THEN 'critical' ELSE 'warning' END, idle FROM s WHERE m <> 0 AND event_id % 3 > 0 AND idle > 300)
        SELECT kind, severity, count(*) AS n, CAST(sum(age) AS BIGINT) AS age FROM i GROUP BY ALL""",
    "incident_transitions": f"WITH RECURSIVE {_OBS} SELECT * FROM v",
    "active_episodes": f"""WITH RECURSIVE {_OBS}, l AS (SELECT scope, max("at") FILTER (WHERE transition = 'open') AS a FROM v GROUP BY scope)
        SELECT kind, v.scope, count(*) AS events, arg_max(severity, (CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) * 1e12 + "at") AS highest, arg_max(transition, "at") AS last_transition FROM v JOIN l ON l.scope = v.scope AND "at" >= a GROUP BY kind, v.scope""",
    "outbox_backoff": "SELECT n_nationkey, CAST(least(300, 5 * pow(2, least(n_nationkey, 6))) AS BIGINT) AS wait_s FROM nation",
}
