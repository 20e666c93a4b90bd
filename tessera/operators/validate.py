"""Contract checks as violation rows, admission, packets and budgets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, subject: Column, rules: Iterable[tuple[str, Column]]) -> DataFrame:
    """(subject, code) of every rule that a row breaks, in one pass. A rule that is null is broken too."""
    found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]), lambda c: c.isNotNull())
    return df.select(subject.alias("subject"), F.explode(found).alias("code"))


def unknown_references(rows: DataFrame, ref: str, known: DataFrame, key: str, code: str) -> DataFrame:
    """References that name nothing known."""
    return rows.join(known.select(F.col(key).alias(ref)), ref, "left_anti").select(F.col(ref).cast("string").alias("subject"), F.lit(code).alias("code"))


def duplicates(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    return rows.groupBy(*keys).count().filter("count > 1").select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("subject"), F.lit(code).alias("code"))


def admitted(groups: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """All or nothing: a group with any violation is excluded with its codes, the others are admitted."""
    bad = found.groupBy(F.col("subject").alias(group)).agg(F.array_sort(F.collect_set("code")).alias("codes"))
    j = groups.join(bad, group, "left")
    return j.withColumn("admission", F.when(F.col("codes").isNull(), "admitted").otherwise("excluded"))


def answer_checks(answers: DataFrame, units: DataFrame, quotes: DataFrame) -> DataFrame:
    """Violations of answers(group_id, unit_id, state, categories, quote_id) against units(group_id, unit_id) and quotes(unit_id, quote_id).

    Every unit is answered exactly once, present needs categories and a known quote, absent has neither.
    """
    g = F.col("group_id")
    rules = violations(answers, g, (
        ("invalid_state", F.col("state").isin("present", "absent", "uncertain")),
        ("present_without_category", (F.col("state") != "present") | (F.size("categories") > 0)),
        ("absent_with_category", (F.col("state") != "absent") | (F.size("categories") == 0)),
        ("present_without_quote", (F.col("state") != "present") | F.col("quote_id").isNotNull()),
    ))
    quoted = answers.filter("quote_id is not null").join(quotes, ["unit_id", "quote_id"], "left_anti").select(g.alias("subject"), F.lit("unknown_quote").alias("code"))
    extra = answers.join(units, ["group_id", "unit_id"], "left_anti").select(g.alias("subject"), F.lit("unit_outside_group").alias("code"))
    open_units = units.join(answers, ["group_id", "unit_id"], "left_anti").select(g.alias("subject"), F.lit("unit_not_covered").alias("code"))
    twice = answers.groupBy("group_id", "unit_id").count().filter("count > 1").select(g.alias("subject"), F.lit("unit_repeated").alias("code"))
    return rules.union(quoted).union(extra).union(open_units).union(twice)


def replay(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that a recomputation lacks or adds: (side, rows); both 0 when it replays."""
    return a.exceptAll(b).agg(F.lit("missing").alias("side"), F.count("*").alias("rows")).union(b.exceptAll(a).agg(F.lit("extra"), F.count("*")))


def inventory(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of files(path, content)."""
    return files.select("path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def packet_errors(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """Planned against actual inventories: missing, unexpected and changed members."""
    j = planned.alias("p").join(actual.alias("a"), F.col("p.path") == F.col("a.path"), "full_outer")
    code = F.when(F.col("a.path").isNull(), "missing_member").when(F.col("p.path").isNull(), "unexpected_member").when(F.col("p.sha256") != F.col("a.sha256"), "changed_member")
    return j.select(F.coalesce("p.path", "a.path").alias("subject"), code.alias("code")).filter("code is not null")


def budget(requests: DataFrame, context: int, allowance: int) -> DataFrame:
    """requests(request_id, input_tokens): admitted only if input and allowance fit; an unknown count blocks."""
    state = F.when(F.col("input_tokens").isNull(), "blocked_unknown_count").when(F.col("input_tokens") + allowance > context, "blocked_over_context").otherwise("admitted")
    return requests.withColumn("state", state)


def qualification(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Per run: qualified only if every expected request is there once, with parity, and none is extra."""
    j = expected.alias("e").join(results.alias("r"), (F.col("e.run") == F.col("r.run")) & (F.col("e.request") == F.col("r.request")), "full_outer")
    x = j.select(F.coalesce("e.run", "r.run").alias("run"), F.col("r.request").isNull().alias("missing"), F.col("e.request").isNull().alias("extra"), F.coalesce(F.col("r.parity"), F.lit(False)).alias("parity"))
    g = x.groupBy("run").agg(F.count_if("missing").alias("missing"), F.count_if("extra").alias("extra"), F.count_if(~F.col("parity")).alias("without_parity"))
    return g.withColumn("status", F.when((F.col("missing") + F.col("extra") + F.col("without_parity")) == 0, "qualified").otherwise("unqualified"))


def error_prefixes(errors: DataFrame, column: str) -> DataFrame:
    """Counts of error texts by what stands before the first colon."""
    return errors.groupBy(F.split(column, ":")[0].alias("prefix")).agg(F.count("*").alias("n"))


def checklist(checks: DataFrame) -> DataFrame:
    """checks(name, state pass|blocked|unknown): overall state, blockers and warnings."""
    return checks.agg(F.when(F.bool_or(F.col("state") == "blocked"), "blocked").when(F.bool_or(F.col("state") == "unknown"), "unknown").otherwise("pass").alias("state"), F.array_sort(F.collect_list(F.when(F.col("state") == "blocked", F.col("name")))).alias("blockers"), F.array_sort(F.collect_list(F.when(F.col("state") == "unknown", F.col("name")))).alias("warnings"))


def compact_rows(rows: DataFrame, row: str, columns: int) -> DataFrame:
    """Rows whose width differs from the declared columns."""
    return rows.filter(F.size(row) != columns)


def navigation(units: DataFrame, entries: DataFrame) -> DataFrame:
    """One entry a unit: available with its categories, or unavailable with the reason."""
    j = units.join(entries, "unit_id", "left")
    return j.select("unit_id", F.when(F.col("categories").isNull(), "unavailable").otherwise("available").alias("availability"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), F.when(F.col("categories").isNull(), "no_admitted_annotation").alias("reason"))


def fact_view(**payloads: DataFrame) -> DataFrame:
    """Fact tables of several payload versions as one, with the version of each row."""
    out = None
    for version, df in payloads.items():
        x = df.withColumn("version", F.lit(version))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def envelope(fields: DataFrame) -> DataFrame:
    """Unified projection of profiled fields: identity, claims with state and reason, abstentions."""
    claim = lambda c: F.struct(F.col(c).alias("value"), F.when(F.col(c).isNull() | (F.col(c) == "unknown"), "unknown").otherwise("derived").alias("state"), F.when(F.col(c).isNull() | (F.col(c) == "unknown"), "no_supporting_evidence").otherwise("name_rule").alias("reason_code"))
    return fields.select("table_name", "column_name", F.struct(claim("semantic").alias("semantic_type"), claim("logical").alias("logical_type"), claim("unit").alias("unit")).alias("claims"))
