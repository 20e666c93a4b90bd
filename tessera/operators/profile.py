"""Column profiles, identifier quality, missingness and relations between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.typing import is_float, is_int, physical_type
from .tables import saved


def unpivot(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column_name, value) rows of the named text expressions."""
    pairs = F.array(*[F.struct(F.lit(k).alias("column_name"), v.cast("string").alias("value")) for k, v in columns.items()])
    return df.select(F.inline(pairs))


def column_profile(cells: DataFrame, keys: tuple[str, ...] = ("column_name",)) -> DataFrame:
    """Profile of each column of cells(*keys, value): rows, missing, distinct, unique_ratio, min, max, physical_type.

    Values are counted first, so that predicates run once for each distinct value and not for each row.
    """
    counted = cells.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    some = F.trim(F.coalesce(F.col("value"), F.lit(""))) != ""
    number = F.when(is_int(F.col("value")) | is_float(F.col("value")), F.expr("try_cast(replace(value, '_', '') as double)"))
    out = counted.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).cast("long").alias("missing"),
        F.count_if(some).alias("distinct_values"),
        F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("_present"),
        F.min(number).alias("_low"),
        F.max(number).alias("_high"),
        physical_type(F.col("value")).alias("physical_type"),
    )
    numeric = F.col("physical_type").isin("int", "float")
    ratio = F.when(F.col("_present") > 0, F.round(F.col("distinct_values") / F.col("_present"), 4))
    return out.select(*keys, "rows", "missing", "distinct_values", ratio.alias("unique_ratio"), F.when(numeric, F.col("_low")).alias("low"), F.when(numeric, F.col("_high")).alias("high"), "physical_type", (F.col("missing") > 0).alias("nullable"))


def identifier_quality(profile: DataFrame) -> DataFrame:
    """Quality class and duplicates of profiled identifier columns."""
    present = F.col("rows") - F.col("missing")
    quality = (
        F.when(F.col("unique_ratio").isNull(), "not_profiled")
        .when(F.col("missing") > 0, "incomplete_identifier")
        .when(F.col("unique_ratio") >= 0.98, "unique_identifier")
        .when(F.col("unique_ratio") >= 0.5, "group_identifier")
        .otherwise("low_cardinality_identifier")
    )
    return profile.withColumn("quality", quality).withColumn("duplicate_count", F.greatest(present - F.round(F.col("unique_ratio") * present), F.lit(0)).cast("long"))


def missingness(profile: DataFrame, key: str) -> DataFrame:
    """Per table: columns, columns with missing values, cells, missing cells and their share."""
    out = profile.groupBy(key).agg(F.count("*").alias("fields"), F.count_if(F.col("missing") > 0).alias("fields_with_missing"), F.sum("rows").alias("cells"), F.sum("missing").alias("missing_cells"))
    return out.withColumn("missing_ratio", F.round(F.try_divide(F.col("missing_cells"), F.col("cells")), 4))


# Semantic types that say too little to relate tables.
GENERIC = ("unknown", "quality_flag", "free_text_note")


def shared_semantics(fields: DataFrame) -> DataFrame:
    """Pairs of tables that share a semantic type: kind and confidence, from fields(table_name, semantic, logical)."""
    by = fields.filter(~F.col("semantic").isin(*GENERIC)).groupBy("semantic", "table_name").agg(F.min("logical").alias("lo"), F.max("logical").alias("hi"), F.bool_or(F.col("logical") == "time_axis").alias("axis"))
    a, b = by.alias("a"), by.alias("b")
    both = lambda kind: F.least(F.col("a.lo"), F.col("b.lo")).eqNullSafe(F.lit(kind)) & F.greatest(F.col("a.hi"), F.col("b.hi")).eqNullSafe(F.lit(kind))
    relation = (
        F.when(both("identifier"), "shared_identifier_semantic")
        .when(both("time_axis"), "shared_time_axis_semantic")
        .when(F.col("a.axis") | F.col("b.axis") | (F.col("semantic") == "observation_time"), "shared_temporal_semantic")
        .when(both("coordinate"), "shared_coordinate_semantic")
        .when(both("measurement"), "shared_measurement_semantic")
        .otherwise("shared_field_semantic")
    )
    joined = a.join(b, "semantic").filter(F.col("a.table_name") < F.col("b.table_name"))
    out = joined.select(F.col("a.table_name").alias("left_table"), F.col("b.table_name").alias("right_table"), "semantic", relation.alias("relation"))
    confidence = F.when(F.col("relation") == "shared_identifier_semantic", 0.75).when(F.col("relation").isin("shared_time_axis_semantic", "shared_coordinate_semantic"), 0.65).when(F.col("relation").isin("shared_temporal_semantic", "shared_measurement_semantic"), 0.55).otherwise(0.45)
    return out.withColumn("confidence", confidence)


def json_paths(df: DataFrame, record: str, text: str) -> DataFrame:
    """Every path of JSON text values: (record, path, type, is_null). Arrays give path[]; numbers keep int and number apart."""
    v = df.select(F.col(record).alias("record"), F.lit("$").alias("path"), F.try_parse_json(F.col(text)).alias("v"))
    levels = []
    # four levels of nesting are unrolled at a time, as long as values are left
    while not levels or v.limit(1).count():
        for _ in range(4):
            kind = F.regexp_extract(F.schema_of_variant("v"), r"^(\w+)", 1)
            levels.append(v.select("record", "path", kind.alias("kind")))
            inner = v.filter(kind.isin("OBJECT", "ARRAY")).withColumn("arr", kind == "ARRAY")
            v = _explode_variant(inner)
        v = saved(df.sparkSession, v)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    name = F.when(F.col("kind") == "VOID", "null").when(F.col("kind") == "BOOLEAN", "boolean").when(F.col("kind").isin("BIGINT", "INT"), "integer").when(F.col("kind").isin("DECIMAL", "DOUBLE", "FLOAT"), "number").when(F.col("kind") == "STRING", "string").when(F.col("kind") == "ARRAY", "array").otherwise("object")
    return out.select("record", "path", name.alias("type"))


def _explode_variant(v: DataFrame) -> DataFrame:
    v.createOrReplaceTempView("_tessera_variants")
    return v.sparkSession.sql("select record, case when arr then concat(path, '[]') else concat(path, '.', e.key) end as path, e.value as v from _tessera_variants, lateral variant_explode(v) as e")


def path_stats(paths: DataFrame) -> DataFrame:
    """Per path: joined type names, presence as distinct records, null occurrences, missing records."""
    total = paths.agg(F.count_distinct("record").alias("total"))
    stats = paths.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("type")), " | ").alias("types"), F.count_distinct("record").alias("presence"), F.count_if(F.col("type") == "null").alias("nulls"))
    return stats.join(F.broadcast(total)).select("path", "types", "presence", "nulls", (F.col("total") - F.col("presence")).alias("missing"))
