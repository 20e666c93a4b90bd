"""Profiles of columns, identifiers, names, JSON paths, footers and time axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import profile, temporal
from .base import read

_ORDERS = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", "o_orderpriority": "o_orderpriority"}


def _orders_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    cols = {c: F.col(c) for c in _ORDERS} | {"o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")}
    return profile.unpivot(o, cols)


_PROFILE_SQL = """
    SELECT column_name, count(*) AS rows,
        count(*) FILTER (WHERE trim(coalesce(value, '')) = '') AS missing,
        count(DISTINCT value) FILTER (WHERE trim(coalesce(value, '')) <> '') AS distinct_values,
        round(count(DISTINCT value) FILTER (WHERE trim(coalesce(value, '')) <> '') / nullif(count(*) FILTER (WHERE trim(coalesce(value, '')) <> ''), 0), 4) AS unique_ratio,
        CASE WHEN bool_and(regexp_full_match(value, '[+-]?[0-9]+')) AND NOT bool_or(regexp_full_match(value, '[+-]?0[0-9]+')) THEN min(try_cast(value AS DOUBLE)) END AS low,
        CASE WHEN bool_and(regexp_full_match(value, '[+-]?[0-9]+')) AND NOT bool_or(regexp_full_match(value, '[+-]?0[0-9]+')) THEN max(try_cast(value AS DOUBLE)) END AS high,
        CASE WHEN bool_or(regexp_full_match(value, '[+-]?0[0-9]+')) THEN 'string'
             WHEN bool_and(regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]{8}')) THEN 'datetime'
             WHEN bool_and(regexp_full_match(value, '[+-]?[0-9]+')) THEN 'int' ELSE 'string' END AS physical_type,
        count(*) FILTER (WHERE trim(coalesce(value, '')) = '') > 0 AS nullable
    FROM cells GROUP BY column_name"""


def column_profile(spark, sf_dir):
    return profile.column_profile(_orders_cells(spark, sf_dir))


def missingness_profile(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    cells = profile.unpivot(e, {"event_id": F.col("event_id"), "event_type": F.nullif(F.col("event_type"), F.lit("view")), "user_id": F.when(F.col("user_id") % 7 != 0, F.col("user_id")), "props": F.col("props")})
    cells = cells.withColumn("table_name", F.lit("events"))
    return profile.missingness(profile.column_profile(cells, ("table_name", "column_name")), "table_name")


_KEYS = {"orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "events": ["event_id", "user_id"], "documents": ["doc_id"]}


def identifier_quality(spark, sf_dir):
    cells = None
    for table, columns in _KEYS.items():
        x = profile.unpivot(read(spark, sf_dir, table).select(*columns), {c: F.col(c) for c in columns}).withColumn("table_name", F.lit(table))
        cells = x if cells is None else cells.union(x)
    p = profile.identifier_quality(profile.column_profile(cells, ("table_name", "column_name")))
    return p.select("table_name", "column_name", "rows", "distinct_values", "unique_ratio", "quality", "duplicate_count")


_IDENTIFIER_SQL = "WITH c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS rows, count(DISTINCT {c}) AS distinct_values, count({c}) AS present FROM {t}" for t, cs in _KEYS.items() for c in cs) + """)
    SELECT table_name, column_name, rows, distinct_values, round(distinct_values / present, 4) AS unique_ratio,
        CASE WHEN present < rows THEN 'incomplete_identifier' WHEN round(distinct_values / present, 4) >= 0.98 THEN 'unique_identifier'
             WHEN round(distinct_values / present, 4) >= 0.5 THEN 'group_identifier' ELSE 'low_cardinality_identifier' END AS quality,
        CAST(greatest(present - round(round(distinct_values / present, 4) * present), 0) AS BIGINT) AS duplicate_count
    FROM c"""

#: Names that exercise the rules, beside the driver tables' own.
NAMES = [("weather", n) for n in "station_id air_temp_c humidity_pct wind_speed_m_s time lat lon precip_mm pressure value_kg".split()] + [("buoy", n) for n in "buoy_id water_temp_f salinity_psu ts_utc depth_m qc_flag".split()] + [("lab", n) for n in "sample_id ph do_mg_l turbidity_ntu collection_date temp_k notes rest_k".split()] + [(t, c) for t, cs in _KEYS.items() for c in cs]


def _fields(spark):
    f = spark.createDataFrame(NAMES, "table_name string, column_name string")
    s = f.groupBy("table_name").agg(F.collect_list("column_name").alias("siblings"))
    f = f.join(F.broadcast(s), "table_name").withColumn("semantic", names.semantic_type(F.col("column_name"), F.col("siblings")))
    return f.withColumn("logical", names.logical_type(F.col("column_name"), F.lit("float"), F.col("semantic"))).withColumn("unit", names.unit_of_name(F.col("column_name"), F.col("semantic")))


def semantic_columns(spark, sf_dir):
    return names.normalize_units(spark, _fields(spark)).select("table_name", "column_name", "semantic", "logical", "unit", "ucum_code")


_VALUES = ", ".join(f"('{t}', '{c}')" for t, c in NAMES)
_SEMANTIC_SQL = f"""
    WITH n(table_name, column_name) AS (VALUES {_VALUES}),
    c AS (SELECT *, string_split_regex(column_name, '[^a-z0-9]+') AS tok, list(column_name) OVER (PARTITION BY table_name) AS near,
            bool_or(len(list_intersect(string_split_regex(column_name, '[^a-z0-9]+'), ['weather','meteorology','meteo','humidity','precip','rain','wind'])) > 0) OVER (PARTITION BY table_name) AS outdoor FROM n),
    s AS (SELECT *, CASE
        WHEN column_name IN ('station_id','sample_id','buoy_id') THEN replace(column_name, '_id', '_identifier')
        WHEN column_name = 'collection_date' THEN 'collection_date' WHEN column_name = 'ts_utc' THEN 'observation_time'
        WHEN column_name = 'ph' THEN 'acidity_ph' WHEN column_name = 'do_mg_l' THEN 'dissolved_oxygen' WHEN column_name = 'turbidity_ntu' THEN 'turbidity'
        WHEN column_name = 'notes' THEN 'free_text_note' WHEN column_name = 'qc_flag' THEN 'quality_flag' WHEN column_name = 'salinity_psu' THEN 'salinity'
        WHEN column_name LIKE '%\\_id' ESCAPE '\\' THEN replace(column_name, '_id', '_identifier')
        WHEN column_name LIKE 'time%' OR column_name LIKE '%date' THEN 'observation_time'
        WHEN column_name = 'lat' THEN 'latitude' WHEN column_name = 'lon' THEN 'longitude'
        WHEN column_name LIKE '%precip%' THEN 'precipitation' WHEN column_name LIKE '%humidity%' THEN 'relative_humidity'
        WHEN column_name LIKE '%pressure%' THEN 'surface_pressure' WHEN column_name LIKE '%wind_speed%' THEN 'wind_speed'
        WHEN list_contains(tok, 'temp') AND (list_contains(near, 'salinity_psu') OR list_contains(near, 'buoy_id') OR column_name LIKE '%water%') THEN 'water_temperature'
        WHEN list_contains(tok, 'temp') AND (list_contains(tok, 'air') OR outdoor) THEN 'air_temperature'
        ELSE 'unknown' END AS semantic FROM c),
    u AS (SELECT *, CASE WHEN column_name LIKE '%\\_c' ESCAPE '\\' THEN CASE WHEN list_contains(tok, 'temp') THEN 'Celsius' END
        WHEN column_name LIKE '%\\_f' ESCAPE '\\' THEN CASE WHEN list_contains(tok, 'temp') THEN 'Fahrenheit' END
        WHEN column_name LIKE '%\\_k' ESCAPE '\\' THEN CASE WHEN list_contains(tok, 'temp') THEN 'Kelvin' END
        WHEN column_name LIKE '%\\_mm' ESCAPE '\\' THEN 'millimeter' WHEN column_name LIKE '%\\_m' ESCAPE '\\' THEN 'meter' WHEN column_name LIKE '%\\_kg' ESCAPE '\\' THEN 'kilogram'
        WHEN column_name LIKE '%\\_pct' ESCAPE '\\' THEN 'percent' WHEN column_name LIKE '%\\_ntu' ESCAPE '\\' THEN 'NTU' WHEN column_name LIKE '%\\_psu' ESCAPE '\\' THEN 'PSU'
        WHEN column_name LIKE '%\\_mg\\_l' ESCAPE '\\' THEN 'milligram_per_liter' WHEN column_name LIKE '%\\_m\\_s' ESCAPE '\\' THEN 'meter_per_second' END AS unit FROM s),
    l AS (SELECT *, CASE WHEN semantic LIKE '%\\_identifier' ESCAPE '\\' THEN 'identifier' WHEN semantic IN ('latitude','longitude') THEN 'coordinate'
        WHEN semantic IN ('precipitation','relative_humidity','surface_pressure','wind_speed','air_temperature','water_temperature','acidity_ph','dissolved_oxygen','turbidity','salinity') THEN 'measurement'
        WHEN semantic IN ('quality_flag','free_text_note') THEN 'label' WHEN semantic IN ('collection_date','observation_time') THEN 'attribute'
        WHEN column_name LIKE '%temp%' THEN 'measurement' ELSE 'unknown' END AS logical FROM u)"""
_UCUM = "CASE unit WHEN 'Celsius' THEN 'Cel' WHEN 'Fahrenheit' THEN '[degF]' WHEN 'Kelvin' THEN 'K' WHEN 'millimeter' THEN 'mm' WHEN 'meter' THEN 'm' WHEN 'kilogram' THEN 'kg' WHEN 'percent' THEN '%' WHEN 'NTU' THEN '{NTU}' WHEN 'PSU' THEN '{PSU}' WHEN 'milligram_per_liter' THEN 'mg/L' WHEN 'meter_per_second' THEN 'm/s' END"


def shared_semantics(spark, sf_dir):
    return profile.shared_semantics(_fields(spark))


def unit_normalization(spark, sf_dir):
    given = [x.split()[0] for x in names.UNITS.strip().splitlines()] + [" Meter Per Second ", "KG", "furlong"]
    return names.normalize_units(spark, spark.createDataFrame([(g,) for g in given], "unit string")).select("unit", "canonical_unit", "ucum_code")


def json_path_profile(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("j", F.concat(F.lit('{"p":'), "props", F.lit(',"t":["'), "event_type", F.when(F.col("event_id") % 3 == 0, '",null]}').otherwise('"]}')))
    return profile.path_stats(profile.json_paths(e, "event_id", "j")).filter("path <> '$'")


def cadence_orders(spark, sf_dir):
    days = read(spark, sf_dir, "orders").select(F.lit("orders").alias("series"), "o_orderdate").distinct()
    return temporal.cadence(days, "series", "o_orderdate")


def cadence_events(spark, sf_dir):
    return temporal.cadence(read(spark, sf_dir, "events").select("event_type", "ts"), "event_type", "ts")


def cadence_lines(spark, sf_dir):
    """Ship dates of each order's lines, repeated ones included: steps of 0 among them."""
    return temporal.cadence(read(spark, sf_dir, "lineitem").select("l_orderkey", F.date_trunc("month", "l_shipdate").alias("month")), "l_orderkey", "month")


def _cadence_sql(key, ts, table):
    return f"""
    WITH p AS ({table}),
    d AS (SELECT {key} AS k, CAST(floor((epoch_us({ts}) - lag(epoch_us({ts})) OVER w) / 1000000) AS BIGINT) AS delta, row_number() OVER w AS place FROM p WINDOW w AS (PARTITION BY {key} ORDER BY {ts})),
    c AS (SELECT k, delta, count(*) AS n, min(place) AS f FROM d WHERE delta IS NOT NULL GROUP BY k, delta),
    b AS (SELECT k, sum(n) AS gaps, max(n) AS top, first(delta ORDER BY n DESC, f) AS dominant FROM c GROUP BY k),
    s AS (SELECT {key} AS k, count(*) AS points, CAST(floor((epoch_us(max({ts})) - epoch_us(min({ts}))) / 1000000) AS BIGINT) AS span FROM p GROUP BY {key})
    SELECT s.k AS {key}, points, dominant AS dominant_delta, round(top / gaps, 4) AS share,
        CASE WHEN gaps IS NULL THEN 'unknown' WHEN top / gaps < 0.75 THEN 'mixed' WHEN dominant = 0 THEN 'unknown' WHEN dominant = 86400 THEN '1 day' WHEN dominant = 3600 THEN '1 hour' ELSE dominant || ' seconds' END AS frequency,
        CASE WHEN gaps IS NULL THEN 'unknown' WHEN top / gaps < 0.75 THEN 'irregular' WHEN dominant = 0 THEN 'unknown' WHEN top / gaps >= 0.95 THEN 'regular' ELSE 'mostly_regular' END AS regularity,
        CASE WHEN top / gaps >= 0.75 AND dominant > 0 THEN CAST(greatest(floor(span / dominant) + 1 - points, 0) AS BIGINT) END AS missing_intervals
    FROM s LEFT JOIN b USING (k)"""


def temporal_candidates(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    cells = profile.unpivot(e, {"event_time": iso, "created_date": iso, "stamp": F.when(F.col("event_id") % 10 != 0, iso).otherwise("soon"), "event_type": F.col("event_type"), "user_id": F.col("user_id")})
    return temporal.time_candidates(cells.withColumn("table_name", F.lit("events")), "table_name")


_CANDIDATES_SQL = """
    WITH r AS (SELECT count(*) FILTER (WHERE event_id % 10 <> 0) / count(*) AS rate FROM events),
    c AS (SELECT 'event_time' AS column_name, 1.0::DOUBLE AS parse_rate, 0.95::DOUBLE AS score
        UNION ALL SELECT 'created_date', 1.0, 0.55 UNION ALL SELECT 'stamp', round(rate, 4), 0.35 FROM r WHERE rate >= 0.8)
    SELECT 'events' AS table_name, column_name, parse_rate, score, CAST(row_number() OVER (ORDER BY score DESC, column_name) AS INTEGER) AS rank, false AS ambiguous FROM c"""


def timezone_claims(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    suffix = F.when(F.col("event_type") == "click", "Z").when(F.col("event_type") == "view", F.when(F.col("event_id") % 2 == 0, "+02:00").otherwise("Z")).when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "+0530").otherwise("")).when(F.col("event_type") == "signup", "-03:00").otherwise("")
    return temporal.timezone_claim(e.select("event_type", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), suffix).alias("t")), "event_type", "t")


_ZONES_SQL = """
    WITH k AS (SELECT event_type, count(*) FILTER (WHERE event_id % 2 = 0) AS even, count(*) FILTER (WHERE event_id % 2 = 1) AS odd FROM events GROUP BY event_type),
    r AS (SELECT event_type, CASE event_type WHEN 'click' THEN 'explicit_timezone_offset' WHEN 'signup' THEN 'explicit_timezone_offset'
        WHEN 'view' THEN CASE WHEN even > 0 AND odd > 0 THEN 'conflicting_timezone_offsets' ELSE 'explicit_timezone_offset' END
        WHEN 'error' THEN CASE WHEN even > 0 AND odd > 0 THEN 'mixed_naive_and_aware_datetimes' WHEN even > 0 THEN 'explicit_timezone_offset' ELSE 'timezone_not_encoded_in_values' END
        ELSE 'timezone_not_encoded_in_values' END AS reason FROM k)
    SELECT event_type, CASE WHEN reason = 'explicit_timezone_offset' THEN CASE event_type WHEN 'click' THEN 'UTC' WHEN 'signup' THEN '-03:00' WHEN 'error' THEN '+05:30' END ELSE 'unknown' END AS timezone,
        CASE WHEN reason = 'explicit_timezone_offset' THEN 'supported' WHEN reason LIKE 'mixed%' OR reason LIKE 'conflicting%' THEN 'conflicted' ELSE 'unknown' END AS state, reason FROM r"""


def cf_time_decode(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    units = F.when(F.col("event_id") % 3 == 0, "days since 2000-01-01 00:00:00").when(F.col("event_id") % 3 == 1, "hours since 2000-01-01 12:00:00").otherwise("fortnights since 2000-01-01 00:00:00")
    return e.select("event_id", temporal.cf_time(F.col("event_id") % 1000, units).cast("timestamp_ntz").alias("decoded"))


def assembled_dates(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    t = temporal.assembled(F.lit(2024), (F.col("event_id") % 14).cast("int"), (F.col("event_id") % 33).cast("int"))
    return e.select("event_id", t.cast("timestamp_ntz").alias("made"))


QUERIES = {f.__name__: f for f in (column_profile, missingness_profile, identifier_quality, semantic_columns, shared_semantics, unit_normalization, json_path_profile, cadence_orders, cadence_events, cadence_lines, temporal_candidates, timezone_claims, cf_time_decode, assembled_dates)}

ORACLES = {
    "column_profile": "WITH cells AS (" + " UNION ALL ".join(f"SELECT '{k}' AS column_name, CAST({v} AS VARCHAR) AS value FROM orders" for k, v in _ORDERS.items()) + ")" + _PROFILE_SQL,
    "missingness_profile": """
        WITH m AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS a, count(*) FILTER (WHERE user_id % 7 = 0) AS b,
            count(*) FILTER (WHERE trim(coalesce(props, '')) = '') AS c FROM events)
        SELECT 'events' AS table_name, 4::BIGINT AS fields, CAST((a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS BIGINT) AS fields_with_missing,
            4 * n AS cells, a + b + c AS missing_cells, round((a + b + c) / (4 * n), 4) AS missing_ratio FROM m""",
    "identifier_quality": _IDENTIFIER_SQL,
    "semantic_columns": _SEMANTIC_SQL + f" SELECT table_name, column_name, semantic, logical, unit, {_UCUM} AS ucum_code FROM l",
    "shared_semantics": _SEMANTIC_SQL + """, g AS (SELECT semantic, table_name, min(logical) AS lo, max(logical) AS hi FROM l WHERE semantic NOT IN ('unknown','quality_flag','free_text_note') GROUP BY ALL),
        r AS (SELECT a.table_name AS left_table, b.table_name AS right_table, a.semantic AS semantic, CASE WHEN a.lo = 'identifier' AND a.hi = 'identifier' AND b.lo = 'identifier' AND b.hi = 'identifier' THEN 'shared_identifier_semantic'
            WHEN a.semantic = 'observation_time' THEN 'shared_temporal_semantic' WHEN a.lo = 'measurement' AND b.lo = 'measurement' AND a.hi = 'measurement' AND b.hi = 'measurement' THEN 'shared_measurement_semantic' ELSE 'shared_field_semantic' END AS relation
            FROM g a JOIN g b ON a.semantic = b.semantic AND a.table_name < b.table_name)
        SELECT *, CAST(CASE relation WHEN 'shared_identifier_semantic' THEN 0.75 WHEN 'shared_temporal_semantic' THEN 0.55 WHEN 'shared_measurement_semantic' THEN 0.55 ELSE 0.45 END AS DOUBLE) AS confidence FROM r""",
    "unit_normalization": "SELECT * FROM (VALUES " + ", ".join("('{}', '{}', '{}')".format(*x.split()) for x in names.UNITS.strip().splitlines()) + ", (' Meter Per Second ', 'meter_per_second', 'm/s'), ('KG', 'kilogram', 'kg'), ('furlong', NULL, NULL)) AS t(unit, canonical_unit, ucum_code)",
    "json_path_profile": """
        WITH n AS (SELECT count(DISTINCT event_id) AS n, count(DISTINCT event_id) FILTER (WHERE event_id % 3 = 0) AS z FROM events)
        SELECT path, types, presence, nulls, missing FROM (
            SELECT '$.p' AS path, 'object' AS types, n AS presence, 0::BIGINT AS nulls, 0::BIGINT AS missing FROM n
            UNION ALL SELECT '$.p.k', 'integer', count(DISTINCT event_id) FILTER (WHERE json_extract(props, '$.k') IS NOT NULL), 0, count(DISTINCT event_id) FILTER (WHERE json_extract(props, '$.k') IS NULL) FROM events
            UNION ALL SELECT '$.t', 'array', n, 0, 0 FROM n
            UNION ALL SELECT '$.t[]', CASE WHEN z > 0 THEN 'null | string' ELSE 'string' END, n, z, 0 FROM n)""",
    "cadence_orders": _cadence_sql("series", "o_orderdate", "SELECT DISTINCT 'orders' AS series, o_orderdate FROM orders"),
    "cadence_lines": _cadence_sql("l_orderkey", "month", "SELECT l_orderkey, date_trunc('month', l_shipdate) AS month FROM lineitem"),
    "cadence_events": _cadence_sql("event_type", "ts", "SELECT event_type, ts FROM events"),
    "temporal_candidates": _CANDIDATES_SQL,
    "timezone_claims": _ZONES_SQL,
    "cf_time_decode": """
        SELECT event_id, CASE event_id % 3 WHEN 0 THEN TIMESTAMP '2000-01-01 00:00:00' + to_days(CAST(event_id % 1000 AS INTEGER))
            WHEN 1 THEN TIMESTAMP '2000-01-01 12:00:00' + to_hours(CAST(event_id % 1000 AS INTEGER)) END AS decoded FROM events""",
    "assembled_dates": """
        SELECT event_id, CASE WHEN event_id % 14 BETWEEN 1 AND 12 AND event_id % 33 BETWEEN 1 AND 31
            THEN try_cast('2024-' || lpad(CAST(event_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(event_id % 33 AS VARCHAR), 2, '0') AS TIMESTAMP) END AS made FROM events""",
}
