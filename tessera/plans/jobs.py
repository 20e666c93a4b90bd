"""Job graphs: content-addressed plans, waves, blocked closures, splits, dispatch."""

from __future__ import annotations

import itertools
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.tables import saved

#: Rounds after which the tables of single rounds become one, so that plans of deep graphs stay short.
MERGE = 16


def job_id(*parts: Column) -> Column:
    """Digest of the parts as a JSON array, so that a null is not the same as no part and no separator clashes."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def factorial(*dims: DataFrame) -> DataFrame:
    """All combinations of small dimension tables."""
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(F.broadcast(d))
    return out


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of every job: 0 without dependencies, else one above its deepest; -1 on or behind a cycle.

    nodes(job), edges(job, needs). Every round settles the jobs whose needs are all settled,
    until none is left or those left wait for a cycle.
    """
    spark = nodes.sparkSession
    waiting = edges.groupBy("job").agg(F.count_distinct("needs").alias("open"))
    level = saved(spark, nodes.join(waiting, "job", "left_anti").select("job", F.lit(0).alias("level")))
    done = level
    for i in itertools.count(1):
        ready = edges.distinct().join(done.select(F.col("job").alias("needs")), "needs").groupBy("job").agg(F.count("*").alias("met"))
        new = waiting.join(ready, "job").filter("met = open").join(done, "job", "left_anti").select("job", F.lit(i).alias("level"))
        new = saved(spark, new)
        if not new.limit(1).count():
            break
        done = done.unionByName(new)
        if i % MERGE == 0:
            done = saved(spark, done)
    return nodes.join(done, "job", "left").select("job", F.coalesce("level", F.lit(-1)).alias("level"))


def blocked(failed: DataFrame, edges: DataFrame) -> DataFrame:
    """All jobs that need a failed job, directly or not."""
    spark = failed.sparkSession
    seen = edges.join(failed.select(F.col("job").alias("needs")), "needs").select("job").distinct()
    front = seen = saved(spark, seen)
    for i in itertools.count(1):
        new = edges.join(front.select(F.col("job").alias("needs")), "needs").select("job").distinct().join(seen, "job", "left_anti")
        new = saved(spark, new)
        if not new.limit(1).count():
            break
        front, seen = new, seen.unionByName(new)
        if i % MERGE == 0:
            seen = saved(spark, seen)
    return seen


def readiness(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """jobs(job, status) with state: blocked if a need failed or is blocked, ready if all needs are done, else waiting."""
    need = edges.join(jobs.select(F.col("job").alias("needs"), F.col("status").alias("s")), "needs", "left").groupBy("job").agg(F.bool_and(F.coalesce(F.col("s") == "done", F.lit(False))).alias("all_done"), F.bool_or(F.coalesce(F.col("s").isin("failed", "blocked"), F.lit(True))).alias("any_bad"))
    j = jobs.join(need, "job", "left")
    state = F.when(F.col("status") != "pending", F.col("status")).when(F.coalesce("any_bad", F.lit(False)), "blocked").when(F.coalesce("all_done", F.lit(True)), "ready").otherwise("waiting")
    return j.select("job", "status", state.alias("state"))


def parent_errors(claims: DataFrame) -> DataFrame:
    """claims(claim, parent): missing parents and cycles."""
    known = claims.select(F.col("claim").alias("parent"), F.lit(True).alias("known"))
    missing = claims.filter("parent is not null").join(known, "parent", "left").filter("known is null").select("claim", F.lit("missing_parent").alias("code"))
    level = waves(claims.select(F.col("claim").alias("job")), claims.filter("parent is not null").join(known, "parent").select(F.col("claim").alias("job"), F.col("parent").alias("needs")))
    return missing.union(level.filter("level = -1").select("job", F.lit("cycle")))


def audited_split(members: DataFrame, root: str, seed: str, share: float) -> DataFrame:
    """Whole components into audit and open parts: ordered by seeded hash, the first max(1, round(n * share)).

    One single component stays open, as an audit would leave nothing. One row a component is ranked.
    """
    c = members.select(root).distinct()
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(root).cast("string")), 256)
    # rank by hash range first, so that no task orders all components
    part = F.substring(h, 1, 2)
    c = c.withColumn("h", h).withColumn("part", part)
    sizes = c.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(every).alias("total"))
    c = c.join(F.broadcast(sizes), "part").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("h")))
    take = F.when(F.col("total") == 1, 0).otherwise(F.greatest(F.lit(1), F.round(F.col("total") * share).cast("int")))
    return members.join(c.select(root, F.when(F.col("rank") <= take, "audit").otherwise("open").alias("split")), root)


def first_jobs(jobs: DataFrame, by: str) -> DataFrame:
    """Of jobs(by, job, model, ready_at, wait_s) those that can be first for a worker: the longest ready of every
    model, aged or not, in each part."""
    aged = F.col("wait_s") >= 1800
    return jobs.groupBy(by, "model", aged.alias("aged")).agg(F.min(F.struct("ready_at", "job", "wait_s")).alias("x")).select(by, "model", "x.*")


def dispatch_v1(ready: DataFrame) -> DataFrame:
    """Job of each worker: aged ones first, then of the worker's model, then the longest ready.

    ready(worker_id, worker_model, job, model, ready_at, wait_s); a job may be first for several workers.
    """
    w = Window.partitionBy("worker_id").orderBy(F.col("wait_s") < 1800, F.col("model") != F.col("worker_model"), "ready_at", "job")
    return ready.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def lane_choice(state: dict, classification: list[dict], extraction: list[dict], now: float) -> str | None:
    """Lane of the next dispatch. Urgent work alternates two classifications and one extraction, else one and three."""
    if not classification or not extraction:
        return "classification" if classification else "extraction" if extraction else None
    urgent = any(now - c["ready_at"] >= 1800 or c.get("downstream_idle_s", 0) >= 300 for c in classification)
    most = {"classification": 2 if urgent else 1, "extraction": 1 if urgent else 3}
    last = state.get("last_lane")
    if last not in most:
        return "classification" if urgent else "extraction"
    other = "extraction" if last == "classification" else "classification"
    return other if state.get("lane_streak", 0) >= most[last] else last


def dispatch_v2(candidates: list[dict], state: dict, now: float) -> dict | None:
    """Next (job, group) for a worker; the state carries lane, streak and last papers. Inherently sequential.

    candidates: job, group, lane, paper, ready_at, order, and for classifications started, unblocks.
    """
    by: dict[str, list[dict]] = defaultdict(list)
    papers: set = set()
    for c in sorted(candidates, key=lambda c: c["order"]):
        if c["lane"] == "classification":
            if c["paper"] in papers or len(papers) == 8:
                continue
            papers.add(c["paper"])
        by[c["lane"]].append(c)
    if by["dataset"]:
        return by["dataset"][0]
    lane = lane_choice(state, by["classification"], by["extraction"], now)
    if lane == "classification":
        own = [c for c in by[lane] if c["paper"] == state.get("current_classifier_paper")] or by[lane]
        return min(own, key=lambda c: (not c.get("started"), -c.get("unblocks", 0), c["ready_at"], c["order"]))
    if lane == "extraction":
        seen = list(dict.fromkeys(c["paper"] for c in by[lane]))
        last = state.get("last_extraction_paper")
        paper = seen[(seen.index(last) + 1) % len(seen)] if last in seen else seen[0]
        return next(c for c in by[lane] if c["paper"] == paper)
    return None


def round_robin(df: DataFrame, paper: str, last: Column, order: str) -> DataFrame:
    """Turn of each row when papers take turns after the last used one: rotated rank of the paper."""
    p = df.select(paper).distinct()
    ranked = p.withColumn("rank", F.dense_rank().over(Window.orderBy(paper)) - 1).withColumn("papers", F.count("*").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    start = ranked.filter(F.col(paper) == last).select((F.col("rank") + 1).alias("start"))
    ranked = ranked.join(F.broadcast(start), how="left").withColumn("turn", F.pmod(F.col("rank") - F.coalesce("start", F.lit(0)), F.col("papers")))
    return df.join(F.broadcast(ranked.select(paper, "turn")), paper)


def oversubscribed(reservations: DataFrame) -> DataFrame:
    """Resources that several holders reserve: reservations(holder, resource)."""
    return reservations.groupBy("resource").agg(F.count_distinct("holder").alias("holders")).filter("holders > 1")
