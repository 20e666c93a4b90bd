"""Meaning of column names: tokens, semantic and logical types, units; lexical forms of labels."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit spellings, their canonical unit and UCUM code.
UNITS = """
c Celsius Cel
celsius Celsius Cel
fahrenheit Fahrenheit [degF]
f Fahrenheit [degF]
kelvin Kelvin K
k Kelvin K
millimeter millimeter mm
mm millimeter mm
meter meter m
m meter m
kilogram kilogram kg
kg kilogram kg
degree degree deg
deg degree deg
percent percent %
% percent %
kilowatt kilowatt kW
kw kilowatt kW
volt volt V
v volt V
ntu NTU {NTU}
psu PSU {PSU}
milligram_per_liter milligram_per_liter mg/L
mg/l milligram_per_liter mg/L
mg_l milligram_per_liter mg/L
meter_per_second meter_per_second m/s
m/s meter_per_second m/s
"""
# Name suffixes that say a unit, in the order in which they are tried.
SUFFIX_UNITS = "_mm millimeter _m meter _kg kilogram _deg degree _pct percent _kw kilowatt _v volt _ntu NTU _psu PSU _mg_l milligram_per_liter _m_s meter_per_second".split()
# Semantic types of whole names.
SEMANTICS = """
station_id station_identifier
station_name station_name
sample_id sample_identifier
sensor_id sensor_identifier
buoy_id buoy_identifier
site_code site_identifier
collection_date collection_date
ts_utc observation_time
event_time observation_time
dt_obs observation_time
power_kw power
voltage_v voltage
status operational_status
ph acidity_ph
do_mg_l dissolved_oxygen
turbidity_ntu turbidity
notes free_text_note
qc_flag quality_flag
flag quality_flag
rec record_identifier
zc postal_zone_code
device device_identifier
salinity_psu salinity
"""
# Semantic types by logical type.
COORDINATES = "latitude longitude elevation depth".split()
MEASUREMENTS = "precipitation relative_humidity surface_pressure wind_speed air_temperature water_temperature gpu_temperature power voltage acidity_ph dissolved_oxygen turbidity salinity".split()
LABELS = "station_name operational_status quality_flag free_text_note".split()
ATTRIBUTES = "collection_date observation_time".split()


def units_table(spark: SparkSession) -> DataFrame:
    """The unit dimension: alias, canonical_unit, ucum_code (27 rows)."""
    return spark.createDataFrame([x.split() for x in UNITS.strip().splitlines()], "alias string, canonical_unit string, ucum_code string")


def normalize_units(spark: SparkSession, df: DataFrame, unit: str = "unit") -> DataFrame:
    """df with canonical_unit and ucum_code; unknown spellings give nulls."""
    key = F.replace(F.lower(F.trim(F.col(unit))), F.lit(" "), F.lit("_"))
    return df.join(F.broadcast(units_table(spark)), key == F.col("alias"), "left").drop("alias")


def tokens(name: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t != ""))


def is_time_name(name: Column) -> Column:
    low = F.lower(name)
    return low.rlike("timestamp|event_time|datetime|time_|_time|ts_|_ts") | low.isin("time", "timestamp", "event_time", "ts", "ts_utc", "date")


def _has(name: Column, *words: str) -> Column:
    return F.arrays_overlap(tokens(name), F.array(*[F.lit(w) for w in words]))


def semantic_type(name: Column, siblings: Column) -> Column:
    """Semantic type of a column from its name and the array of all names of its table."""
    low = F.lower(name)
    near = F.transform(siblings, lambda s: F.lower(s))
    some = lambda *ws: F.arrays_overlap(near, F.array(*[F.lit(w) for w in ws]))
    context = F.flatten(F.transform(siblings, lambda s: tokens(s)))
    weather = F.arrays_overlap(context, F.array(*[F.lit(w) for w in "weather meteorology meteo humidity precip rain wind".split()]))
    outdoor = _has(name, "air", "ambient", "weather", "surface") | low.contains("air_temp") | low.contains("temperature_air") | weather | some("station_id", "station_name")
    hot = _has(name, "temp", "temperature")
    out = F.when(F.lit(False), "")
    for line in SEMANTICS.strip().splitlines():
        word, kind = line.split()
        out = out.when(low == word, kind)
    rules = (
        (low == "id", F.lit("identifier")),
        (low.endswith("_id"), F.concat(F.regexp_replace(low, "_id$", ""), F.lit("_identifier"))),
        (low.contains("identifier"), F.lit("identifier")),
        (low.contains("timestamp") | low.startswith("time") | low.endswith("date"), F.lit("observation_time")),
        (low.isin("lat", "latitude", "latitude_deg"), F.lit("latitude")),
        (low.isin("lon", "longitude", "longitude_deg"), F.lit("longitude")),
        (low.contains("elevation"), F.lit("elevation")),
        (low.contains("precip"), F.lit("precipitation")),
        (low.contains("humidity"), F.lit("relative_humidity")),
        (low.contains("pressure"), F.lit("surface_pressure")),
        (low.contains("wind_speed"), F.lit("wind_speed")),
        (hot & _has(name, "gpu"), F.lit("gpu_temperature")),
        (hot & (some("salinity_psu", "buoy_id") | low.contains("water")), F.lit("water_temperature")),
        (hot & outdoor, F.lit("air_temperature")),
    )
    for test, kind in rules:
        out = out.when(test, kind)
    return out.otherwise("unknown")


def unit_of_name(name: Column, semantic: Column) -> Column:
    """Unit that a name's suffix says; _c, _f and _k only where the column is a temperature."""
    low = F.lower(name)
    hot = semantic.isin("air_temperature", "water_temperature", "gpu_temperature") | _has(name, "temp", "temperature")
    out = F.when(low.endswith("_c"), F.when(hot, "Celsius")).when(low.endswith("_f"), F.when(hot, "Fahrenheit")).when(low.endswith("_k"), F.when(hot, "Kelvin"))
    for suffix, unit in zip(SUFFIX_UNITS[::2], SUFFIX_UNITS[1::2], strict=True):
        out = out.when(low.endswith(suffix), unit)
    return out


def logical_type(name: Column, physical: Column, semantic: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(semantic.endswith("_identifier") | (semantic == "identifier"), "identifier")
        .when(semantic.isin(*COORDINATES), "coordinate")
        .when(semantic.isin(*MEASUREMENTS), "measurement")
        .when(semantic.isin(*LABELS), "label")
        .when(semantic.isin(*ATTRIBUTES), "attribute")
        .when(low.rlike("flag|status|note") | low.endswith("_name"), "label")
        .when(physical.isin("int", "float") & low.rlike("temp|precip|pressure|power|voltage|humidity|wind|rain|ph|turbidity"), "measurement")
        .otherwise("unknown")
    )


def lexical_text(s: str) -> str:
    """NFKC, a space at lower-to-upper case changes, separators to one space, trimmed, case-folded."""
    s = re.sub(r"([a-z])([A-Z])", r"\1 \2", unicodedata.normalize("NFKC", s))
    return re.sub(r"[\s_\-]+", " ", s).strip().casefold()


@F.pandas_udf(T.StringType())
def _lexical_any(s: pd.Series) -> pd.Series:
    return s.map(lexical_text, na_action="ignore")


def lexical(c: Column) -> Column:
    """Lexical form of a label. ASCII labels stay in the JVM; NFKC and case folding of others need Python."""
    return _lexical_any(c)


def lexical_ascii(c: Column) -> Column:
    """lexical() for ASCII labels, without Python."""
    spaced = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(spaced, "[\\s_\\-]+", " ")))


def squeezed(c: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.lower(F.regexp_replace(c, "[\\W_]+", ""))


def contains_label(text: Column, label: Column) -> Column:
    """Whether the label's lexical form stands in the text's, not inside a longer word (both lexical already)."""
    quoted = F.concat(F.lit("\\Q"), F.replace(label, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return (label != "") & F.regexp_like(text, F.concat(F.lit("(?U)(?<!\\w)"), quoted, F.lit("(?!\\w)")))
