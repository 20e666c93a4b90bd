"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Documents get rates r that stay as close to 1 as possible (Kullback-Leibler divergence weighted by words) while the
words sum(r * size) of every value of every constraint column (the source, and others if wanted, such as language or
length class) meet that value's target. The optimum is an exponential tilt: r = exp(sum of the duals of the document's
values). The dual is convex and is solved by damped Newton iterations. The documents' words, pre-aggregated by the
combination of values, stay a distributed table; each iteration aggregates gradient (target minus tilted words) and
Hessian (tilted words: values of one column exclude each other, so a column's block is diagonal) of one column after
the other, and ends when the largest gradient is a small share of all words. Rates are rounded into whole copies by
systematic rounding over the documents of a combination in falling order of size, so its words miss what its rate
gives by about one document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables

SALTS = 64
#: Newton iterations end when no gradient is above this share of all words; more sweeps than this are an error.
TOLERANCE, SWEEPS = 1e-9, 400


def targets(totals: DataFrame, cap: float = 3.0) -> DataFrame:
    """totals(source, source_size) and target, weight: weights 1, 2, 3 repeating by source, null last.

    All words are shared by weight; a target stops at cap * source_size and the excess is reshared by weight
    until none is above. The fixed point is found from the sources sorted by cap * source_size / weight: a
    source is capped if the level left for it is above its own. As many rows as sources, in one task.
    """
    # UTF-8 order is code point order
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    x = totals.withColumn("weight", F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1)
    x = x.withColumn("limit", F.lit(cap) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    behind = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("limit").over(behind), F.lit(0.0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(behind), F.lit(0))
    x = x.withColumn("level", left / weights).withColumn("capped", F.col("limit") / F.col("weight") <= F.col("level"))
    # the first source that is not capped sets the level of all after it
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(every)
    return x.withColumn("target", F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))).select("source", "source_size", "weight", "target")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def balanced(spark: SparkSession, cells: DataFrame, wanted: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """cells(..., words) and tilt, the sum of the duals of a cell's values; null where its rate is 0.

    wanted: for a column of cells the targets (value, target) of its values. Values without a target, a target of 0
    and values without words have rate 0. Targets that no tilt meets (they contradict each other) raise an error.
    """
    t = Tables(spark, "balance")
    x = cells.withColumn("tilt", F.when(F.col("words") > 0, F.lit(0.0)))
    goals = {}
    for c, goal in wanted.items():
        goals[c] = t.save(goal.filter("target > 0").select(F.col("value").alias("v"), F.col("target").cast("double").alias("goal")), f"goal-{c}")
        x = x.join(goals[c], _same(c, "v"), "left").withColumn("tilt", F.when(F.col("goal").isNotNull(), F.col("tilt"))).drop("v", "goal")
    x = t.save(x, "tilt-0")
    for sweep in range(1, SWEEPS + 1):
        worst = []
        for c, goal in goals.items():
            now = x.filter("tilt is not null").groupBy(F.col(c).alias("u")).agg(F.sum(F.col("words") * F.exp("tilt")).alias("now"))
            step = now.join(goal, _same("u", "v")).select("u", F.least(F.greatest(F.col("goal") / F.col("now") - 1, F.lit(-1.0)), F.lit(1.0)).alias("step"), (F.abs(F.col("goal") - F.col("now"))).alias("miss"), "goal")
            step = t.save(step, f"step-{sweep}-{c}")
            worst.append(step.agg(F.max("miss") / F.sum("goal")).first()[0] or 0.0)
            x = x.join(step.select("u", "step"), _same(c, "u"), "left").withColumn("tilt", F.col("tilt") + F.col("step")).drop("u", "step")
        if max(worst, default=0.0) <= tolerance:
            return t.save(x, "tilt")
        x = t.save(x, f"tilt-{sweep}")
        t.drop(f"tilt-{sweep - 1}")
        for c in goals:
            t.drop(f"step-{sweep}-{c}")
    raise ValueError(f"targets can't be met together: a value still misses {max(worst):.3g} of all words")


def extra_copies(sizes: DataFrame, by: list[str], cap: float, rounds: int = 4) -> DataFrame:
    """sizes(*by, size, n, aim, rate) with base (whole copies of each) and extra (documents that get one more).

    The share of extra documents is first spread evenly over the sizes, largest first. What the words of a group
    then miss of its aim is made up in a few rounds by more or fewer extras of sizes below the miss, largest first.
    A window holds one row for each size of a group.
    """
    falling = Window.partitionBy(*by).orderBy(F.desc("size"))
    behind, whole = falling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    base = F.least(F.floor(F.col("rate") + 1e-6), F.lit(int(cap))).cast("long")
    x = sizes.withColumn("base", base).withColumn("share", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    x = x.withColumn("before", F.coalesce(F.sum("n").over(behind), F.lit(0)))
    even = F.floor(F.col("share") * (F.col("before") + F.col("n")) + 0.5) - F.floor(F.col("share") * F.col("before") + 0.5)
    x = x.withColumn("extra", F.when((F.col("size") > 0) & (F.col("base") < cap), even).otherwise(0).cast("long"))
    for _ in range(rounds):
        x = x.withColumn("miss", F.col("aim") - F.sum(F.col("size") * (F.col("base") * F.col("n") + F.col("extra"))).over(whole))
        room = F.when(F.col("miss") > 0, F.col("n") - F.col("extra")).otherwise(F.col("extra"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("miss")) & (F.col("base") < cap)
        x = x.withColumn("room", F.when(fits, room).otherwise(0))
        used = F.coalesce(F.sum(F.col("size") * F.col("room")).over(behind), F.lit(0))
        more = F.greatest(F.least(F.floor((F.abs("miss") - used) / F.greatest("size", F.lit(1))), F.col("room")), F.lit(0))
        x = x.withColumn("extra", (F.col("extra") + F.when(F.col("miss") > 0, more).otherwise(-more)).cast("long"))
    return x.drop("share", "before", "miss", "room")


def mixed(spark: SparkSession, docs: DataFrame, cap: float = 3.0, others: dict[str, tuple[Column, DataFrame]] | None = None) -> DataFrame:
    """(row, size, source_size, target, rate, copies, taken) for every row of docs(doc_id, source, text, ...).

    `row` is the whole input row as one struct, so no column of it can clash. size counts the runs of
    [^\\x20\\x09-\\x0D] in the text (null: 0). Sources are mixed to targets(); others names further constraints: a
    column of docs' columns and its targets (value, target). Documents without words get 0 copies. The null source
    is a source of its own. copies is at most cap. Equal sizes are ordered by doc_id and text hash, so reruns agree;
    repeated rows share their copies in any order. An empty table gives no rows.
    """
    others = others or {}
    by = ["source", *(f"by_{name}" for name in others)]
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("[^ \\x09-\\x0D]+")).cast("long")
    tie = F.xxhash64(F.col("text").cast("string"))
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source"), *[c.alias(f"by_{name}") for name, (c, _) in others.items()], size.alias("size"), tie.alias("tie"), F.pmod(F.xxhash64("doc_id", tie), F.lit(SALTS)).alias("salt"))
    t = Tables(spark, "mixing")
    cells = t.save(x.groupBy(*by, "size", "salt").agg(F.count("*").alias("n")), "cells")
    words = cells.groupBy(*by).agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    goal = targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), cap)
    goal = t.save(goal, "targets")
    wanted = {"source": goal.select(F.col("source").alias("value"), "target"), **{f"by_{name}": w for name, (_, w) in others.items()}}
    rates = balanced(spark, words, wanted).withColumn("rate", F.coalesce(F.least(F.exp("tilt"), F.lit(cap)), F.lit(0.0)))
    rates = rates.join(goal.select(F.col("source").alias("s"), "source_size", "target"), _same("source", "s")).drop("s").withColumn("aim", F.col("rate") * F.col("words"))
    renamed = rates.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], "source_size", "target", "rate", "aim")
    on = [_same(c, f"k{i}") for i, c in enumerate(by)]
    shares = extra_copies(cells.groupBy(*by, "size").agg(F.sum("n").alias("n")).join(renamed, on).drop(*[f"k{i}" for i in range(len(by))]), by, cap)
    # rank of a document among those of its cell and size: counts of the salted parts before its own, then inside
    parts = Window.partitionBy(*by, "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    places = cells.withColumn("before", F.coalesce(F.sum("n").over(parts), F.lit(0))).drop("n")
    shares = shares.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.col("size").alias("z"), "source_size", "target", "rate", "base", "extra")
    places = places.join(shares, [*on, F.col("size") == F.col("z")])
    inside = Window.partitionBy(*by, "size", "salt").orderBy("id", "tie")
    ranked = x.withColumn("r", F.row_number().over(inside))
    p = places.select(*[F.col(c).alias(f"q{i}") for i, c in enumerate(by)], F.col("size").alias("y"), F.col("salt").alias("p"), "before", "source_size", "target", "rate", "base", "extra")
    out = ranked.join(p, [*[_same(c, f"q{i}") for i, c in enumerate(by)], F.col("size") == F.col("y"), F.col("salt") == F.col("p")])
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("before") + F.col("r") <= F.col("extra")).cast("long")).otherwise(0).cast("long")
    return out.select("row", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
