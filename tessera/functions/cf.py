"""Meaning of array-store variables from their attributes: CF semantics, coordinate roles, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Axes of standard names and of units.
STANDARD_AXES = {"latitude": "Y", "longitude": "X", "time": "T", "height": "Z", "altitude": "Z", "depth": "Z"}
EAST = ("degrees_east", "degree_east", "degrees_e", "degree_e")
NORTH = ("degrees_north", "degree_north", "degrees_n", "degree_n")
TIME_UNITS = r"^\s*(second|minute|hour|day)s?\s+since\s+"


def _low(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def cf_semantic(standard_name: Column, axis: Column, units: Column, positive: Column) -> Column:
    """Semantic type: the standard name where it is one, else the axis or the units."""
    name, a, u = _low(standard_name), F.upper(_low(axis)), _low(units)
    known = F.when(name == "time", "observation_time").when(name.isin("latitude", "longitude", "depth"), name).when(name.isin("height", "altitude"), "elevation").when(name == "air_temperature", "air_temperature").when(name == "sea_water_temperature", "water_temperature").when(name == "relative_humidity", "relative_humidity").when(name == "wind_speed", "wind_speed")
    return known.when((a == "T") | u.rlike(TIME_UNITS), "observation_time").when((a == "X") | u.isin(*EAST), "longitude").when((a == "Y") | u.isin(*NORTH), "latitude").when(a == "Z", F.when(_low(positive) == "down", "depth").otherwise("elevation")).otherwise("unknown")


def cf_logical(semantic: Column, is_dimension: Column) -> Column:
    return F.when(semantic == "observation_time", "temporal_coordinate").when(semantic.isin("latitude", "longitude", "depth", "elevation"), "coordinate").when(semantic.endswith("_identifier"), "identifier").when(semantic != "unknown", "measurement").when(is_dimension, "coordinate").otherwise("unknown")


def coordinate_roles(name: Column, dimensions: Column, axis: Column, standard_name: Column, units: Column, dimension_names: Column, auxiliary: Column) -> Column:
    """struct(roles, state, reason_code): hints of different axes conflict and are not resolved by preference."""
    a, s, u = F.upper(_low(axis)), _low(standard_name), _low(units)
    own = F.array_contains(dimension_names, name) & (F.size(dimensions) == 1) & (F.get(dimensions, F.lit(0)) == name)
    north = u.isin("degrees_north", "degree_north")
    geo = north | u.isin("degrees_east", "degree_east")
    standard_axis = F.lit(None).cast("string")
    for word, letter in STANDARD_AXES.items():
        standard_axis = F.when(s == word, letter).otherwise(standard_axis)
    roles = F.array(F.when(own, "dimension_coordinate"), F.when(F.array_contains(auxiliary, name), "auxiliary_coordinate"), F.when(a.isin("X", "Y", "Z", "T"), F.concat(F.lit("axis_"), F.lower(a))), F.when(standard_axis.isNotNull(), F.concat(F.lit("standard_"), s)), F.when(geo, "geospatial_coordinate"))
    hints = F.array(F.when(a.isin("X", "Y", "Z", "T"), a), standard_axis, F.when(geo, F.when(north, "Y").otherwise("X")))
    roles = F.array_distinct(F.array_compact(roles))
    clash = F.size(F.array_distinct(F.array_compact(hints))) > 1
    state = F.when(clash, "conflicted").when(F.size(roles) > 0, "supported").otherwise("unknown")
    reason = F.when(clash, "conflicting_cf_coordinate_evidence").when(F.size(roles) > 0, "explicit_cf_coordinate_evidence").otherwise("no_coordinate_evidence")
    return F.struct(roles.alias("roles"), state.alias("state"), reason.alias("reason_code"))


def dimension_claim(names: Column, rank: Column) -> Column:
    """struct(state, reason_code) of an array's dimension names (array of text, null if not given)."""
    bad = F.exists(names, lambda x: x.isNull() | (x == ""))
    reason = F.when(names.isNull(), "array_dimensions_missing").when(bad, "array_dimensions_invalid").when(F.size(names) != rank, "array_dimensions_rank_conflict").otherwise("explicit_xarray_dimensions")
    state = F.when(names.isNull(), "unknown").when(bad | (F.size(names) != rank), "conflicted").otherwise("supported")
    return F.struct(state.alias("state"), reason.alias("reason_code"))


def dimension_sizes(arrays: DataFrame) -> DataFrame:
    """arrays(array, dimensions, shape): size of every dimension over all arrays; different sizes conflict."""
    x = arrays.filter(F.size("dimensions") == F.size("shape")).select(F.explode(F.arrays_zip("dimensions", "shape")).alias("d"))
    g = x.groupBy(F.col("d.dimensions").alias("dimension")).agg(F.array_sort(F.collect_set(F.col("d.shape"))).alias("sizes"))
    return g.withColumn("state", F.when(F.size("sizes") > 1, "conflicted").otherwise("supported"))


def auxiliary_coordinates(arrays: DataFrame) -> DataFrame:
    """arrays(array, coordinates): auxiliary names resolved next to their owner; unknown ones are gaps."""
    want = arrays.select("array", F.explode(F.split("coordinates", " +")).alias("name")).filter("name <> ''")
    path = F.concat(F.regexp_replace("array", "[^/]*$", ""), F.col("name"))
    known = arrays.select(F.col("array").alias("path"), F.lit(True).alias("found"))
    return want.withColumn("path", path).join(known, "path", "left").select("array", "name", "path", F.coalesce("found", F.lit(False)).alias("found"))


def seconds_of(c: Column) -> Column:
    """Seconds of a number or of ISO text (UTC where it has no zone); null for other text."""
    return F.coalesce(c.try_cast("double"), F.unix_micros(F.try_to_timestamp(F.regexp_replace(c, "[Zz]$", "+00:00"))) / 1_000_000)


def alert_text(kind: Column, scope: Column, severity: Column, age_s: Column, threshold_s: Column) -> Column:
    """One line for people about an incident event."""
    return F.concat(F.lit("["), F.upper(severity), F.lit("] "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" on "), scope, F.when(age_s.isNotNull(), F.format_string(": %.0f s, limit %.0f s", age_s, threshold_s)).otherwise(""))
