"""Cadence of time series, time-axis candidates, time zones, CF time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import is_time_name
from ..functions.typing import is_datetime

# Names of steps in seconds.
STEPS = {1: "1 second", 60: "1 minute", 300: "5 minutes", 360: "6 minutes", 600: "10 minutes", 900: "15 minutes", 1200: "20 minutes", 1800: "30 minutes", 3600: "1 hour", 86400: "1 day"}


def _us(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def deltas(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Whole seconds between consecutive times of each key, with their place in time."""
    w = Window.partitionBy(key).orderBy(ts)
    d = F.floor((_us(ts) - F.lag(_us(ts)).over(w)) / 1_000_000).cast("long")
    return df.select(key, ts, d.alias("delta"), F.row_number().over(w).alias("place")).filter("delta is not null")


def cadence(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Per key: dominant step (first seen of equals), its share, frequency, regularity, missing intervals."""
    counted = deltas(df, key, ts).groupBy(key, "delta").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    best = counted.groupBy(key).agg(F.sum("n").alias("gaps"), F.max("n").alias("top"), F.min_by("delta", F.struct(-F.col("n"), F.col("first"))).alias("dominant"))
    span = df.groupBy(key).agg(F.count("*").alias("points"), F.floor((_us(F.max(ts)) - _us(F.min(ts))) / 1_000_000).cast("long").alias("span"))
    out = span.join(best, key, "left")
    share = F.col("top") / F.col("gaps")
    names = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])
    # a dominant step of 0 has no cadence: several observations at one time and no key that tells them apart
    frequency = F.when(F.col("gaps").isNull(), "unknown").when(share < 0.75, "mixed").when(F.col("dominant") == 0, "unknown").otherwise(F.coalesce(F.try_element_at(names, F.col("dominant").cast("int")), F.concat(F.col("dominant").cast("string"), F.lit(" seconds"))))
    regular = F.when(F.col("gaps").isNull(), "unknown").when(share < 0.75, "irregular").when(F.col("dominant") == 0, "unknown").when(share >= 0.95, "regular").otherwise("mostly_regular")
    missing = F.when((share >= 0.75) & (F.col("dominant") > 0), F.greatest(F.floor(F.col("span") / F.col("dominant")) + 1 - F.col("points"), F.lit(0)).cast("long"))
    return out.select(key, "points", F.col("dominant").alias("dominant_delta"), F.round(share, 4).alias("share"), frequency.alias("frequency"), regular.alias("regularity"), missing.alias("missing_intervals"))


def timezone_claim(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per key: time zone that the texts state, its state and reason. Mixed or conflicting offsets make no claim."""
    t = F.trim(F.col(text))
    some = F.coalesce(t, F.lit("")) != ""
    sign = F.regexp_extract(t, r"([+-])(\d{2}):?(\d{2})$", 1)
    offset = F.when(F.lower(t).endswith("z"), "+00:00").when(sign != "", F.concat(sign, F.regexp_extract(t, r"([+-])(\d{2}):?(\d{2})$", 2), F.lit(":"), F.regexp_extract(t, r"([+-])(\d{2}):?(\d{2})$", 3)))
    g = df.groupBy(key).agg(F.count_if(some).alias("n"), F.count_if(some & offset.isNull()).alias("naive"), F.count_if(some & offset.isNotNull()).alias("aware"), F.min(F.when(some, offset)).alias("lo"), F.max(F.when(some, offset)).alias("hi"))
    reason = F.when(F.col("n") == 0, "sampling_insufficient").when((F.col("aware") > 0) & (F.col("naive") > 0), "mixed_naive_and_aware_datetimes").when(F.col("aware") == 0, "timezone_not_encoded_in_values").when(F.col("lo") != F.col("hi"), "conflicting_timezone_offsets").otherwise("explicit_timezone_offset")
    g = g.withColumn("reason", reason)
    state = F.when(F.col("reason") == "explicit_timezone_offset", "supported").when(F.col("reason").isin("mixed_naive_and_aware_datetimes", "conflicting_timezone_offsets"), "conflicted").otherwise("unknown")
    zone = F.when(F.col("reason") == "explicit_timezone_offset", F.when(F.col("lo") == "+00:00", "UTC").otherwise(F.col("lo"))).otherwise("unknown")
    return g.select(key, zone.alias("timezone"), state.alias("state"), "reason")


def time_candidates(cells: DataFrame, group: str) -> DataFrame:
    """Time-axis candidates of cells(group, column_name, value): score, rank and whether the first two tie.

    0.4 for a datetime column or 0.35 for a parse rate of 0.8, 0.4 for a telling name, 0.15 where the name means
    an observation time; candidates of 0.7 or more rank, two within 0.05 of each other are ambiguous.
    """
    some = F.trim(F.coalesce(F.col("value"), F.lit(""))) != ""
    g = cells.groupBy(group, "column_name", "value").agg(F.count("*").alias("n")).groupBy(group, "column_name")
    g = g.agg(F.sum(F.when(some, F.col("n")).otherwise(0)).alias("present"), F.sum(F.when(some & is_datetime(F.col("value")), F.col("n")).otherwise(0)).alias("parsed"))
    rate = F.when(F.col("present") > 0, F.round(F.col("parsed") / F.col("present"), 4)).otherwise(0.0)
    g = g.withColumn("parse_rate", rate).filter("parse_rate >= 0.8")
    low = F.lower("column_name")
    observed = low.contains("timestamp") | low.startswith("time") | low.endswith("date") | low.isin("ts_utc", "dt_obs", "event_time")
    score = F.when(F.col("parse_rate") == 1.0, 0.4).otherwise(0.35) + F.when(is_time_name(F.col("column_name")), 0.4).otherwise(0.0) + F.when(observed, 0.15).otherwise(0.0)
    g = g.withColumn("score", F.round(F.least(score, F.lit(1.0)), 4))
    w = Window.partitionBy(group).orderBy(F.desc("score"), "column_name")
    near = F.col("score") - F.lead("score").over(w) <= 0.05
    return g.select(group, "column_name", "parse_rate", "score", F.row_number().over(w).alias("rank"), F.coalesce((F.row_number().over(w) == 1) & (F.col("score") >= 0.7) & (F.lead("score").over(w) >= 0.7) & near, F.lit(False)).alias("ambiguous"))


def cf_time(value: Column, units: Column) -> Column:
    """Time of a CF coordinate `<n> seconds|minutes|hours|days since <origin>` in the standard calendar."""
    unit = F.regexp_extract(units, r"(?i)^\s*(second|minute|hour|day)s?\s+since\s+(.+?)\s*$", 1)
    origin = F.try_to_timestamp(F.regexp_extract(units, r"(?i)^\s*(second|minute|hour|day)s?\s+since\s+(.+?)\s*$", 2))
    per = F.when(F.lower(unit) == "second", 1).when(F.lower(unit) == "minute", 60).when(F.lower(unit) == "hour", 3600).when(F.lower(unit) == "day", 86400)
    return F.timestamp_micros((F.unix_micros(origin) + value.cast("double") * per * 1_000_000).cast("long"))


def assembled(year: Column, month: Column, day: Column, hour: Column | None = None, minute: Column | None = None, second: Column | None = None) -> Column:
    """Timestamp of its parts; null where they name no time. A series with a bad row is none: see assembled_series."""
    zero = F.lit(0)
    return F.try_make_timestamp(year, month, day, hour if hour is not None else zero, minute if minute is not None else zero, second if second is not None else zero)


def assembled_series(df: DataFrame, key: str, time: Column) -> DataFrame:
    """Times of df as `time`, all rows of a key or none: one row whose parts name no time ends its whole series."""
    x = df.withColumn("time", time)
    bad = x.groupBy(key).agg(F.bool_or(F.col("time").isNull()).alias("bad")).filter("bad").select(key)
    return x.join(bad, x[key].eqNullSafe(bad[key]), "left_anti")
