"""Checks of extraction and structure answers as violation rows, admission by group, and what admitted answers become.

Answers are nested rows, one a group; every check is an expression over the row's own arrays, so a check never
shuffles. A group is admitted whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _each(array: str, test) -> Column:
    """How many elements of an array fail a test (element, index); a null test fails."""
    pairs = F.transform(F.col(array), lambda x, i: F.coalesce(test(x, i), F.lit(False)))
    return F.size(F.filter(pairs, lambda ok: ~ok))


def _repeats(array: Column) -> Column:
    """How many elements equal an earlier one."""
    return F.size(array) - F.size(F.array_distinct(array))


def _coded(df: DataFrame, group: str, counts: dict[str, Column]) -> DataFrame:
    """(subject, code, n) for every count above 0."""
    rows = F.array(*[F.struct(F.lit(code).alias("code"), n.cast("long").alias("n")) for code, n in counts.items()])
    return df.select(F.col(group).alias("subject"), F.inline(F.filter(rows, lambda r: r["n"] > 0)))


def extraction_checks(answers: DataFrame, group: str) -> DataFrame:
    """Violations of answers(group, window_ids, coverage, mentions, facts).

    coverage: (window_id, state); mentions: any; facts: (subject_mention, primary_window, predicate, target, status,
    value, basis). Coverage names every window in order. A fact has a subject among the mentions, a primary window of
    the group that did not overflow, a target just when its predicate links two things, no value just when its status
    is unknown, a basis when inferred, and no twin.
    """
    windows, states = F.col("window_ids"), F.map_from_entries(F.col("coverage"))
    return _coded(answers, group, {
        "target_order_or_coverage_mismatch": (~F.col("coverage.window_id").eqNullSafe(windows)).cast("int"),
        "fact_subject_missing": _each("facts", lambda f, _: f["subject_mention"].between(0, F.size("mentions") - 1)),
        "fact_primary_window_foreign": _each("facts", lambda f, _: F.array_contains(windows, f["primary_window"])),
        "fact_on_overflow_window": _each("facts", lambda f, _: ~F.array_contains(windows, f["primary_window"]) | (F.coalesce(F.try_element_at(states, f["primary_window"]), F.lit("")) != "overflow")),
        "fact_target_shape_invalid": _each("facts", lambda f, _: f["predicate"].isin("relationship", "same_as") == f["target"].isNotNull()),
        "fact_status_value_conflict": _each("facts", lambda f, _: (f["status"] == "unknown") == f["value"].isNull()),
        "fact_inference_basis_required": _each("facts", lambda f, _: (f["status"] != "inferred") | (F.coalesce(f["basis"], F.lit("")) != "")),
        "duplicate_fact": _repeats(F.col("facts")),
    })


def completion(answers: DataFrame, group: str, max_mentions: int, max_facts: int) -> DataFrame:
    """(group, completion): incomplete where a window overflowed or a cap was reached, else success."""
    full = F.exists("coverage", lambda c: c["state"] == "overflow") | (F.size("mentions") >= max_mentions) | (F.size("facts") >= max_facts)
    return answers.select(group, F.when(full, "incomplete").otherwise("success").alias("completion"))


def feature_checks(answers: DataFrame, group: str) -> DataFrame:
    """Violations of answers(group, mentions, feature_coverage).

    mentions: (kind, units); feature_coverage: (unit_id, row_unit_id, decision, mention_index). An emitted cell has a
    mention, of a field or variable, whose units hold the cell or its row; no other cell has one.
    """
    mention = lambda c: F.get(F.col("mentions"), c["mention_index"])
    there = lambda c: c["mention_index"].isNotNull() & c["mention_index"].between(0, F.size("mentions") - 1)
    bound = lambda c: mention(c)["kind"].isin("field", "variable") & (F.array_contains(mention(c)["units"], c["unit_id"]) | F.array_contains(mention(c)["units"], c["row_unit_id"]))
    return _coded(answers, group, {
        "feature_coverage_missing_mention": _each("feature_coverage", lambda c, _: (c["decision"] != "emitted") | there(c)),
        "feature_coverage_mention_not_bound_to_cell": _each("feature_coverage", lambda c, _: (c["decision"] != "emitted") | ~there(c) | bound(c)),
        "nonemitted_cell_has_mention": _each("feature_coverage", lambda c, _: (c["decision"] == "emitted") | c["mention_index"].isNull()),
    })


def structure_checks(answers: DataFrame, group: str) -> DataFrame:
    """Violations of answers(group, unit_ids, reviews, mentions, links).

    reviews: (unit_id, state); mentions: (mention_id, label, unit_id); links: (source, target, unit_id). Reviews name
    every unit in order, mention ids count from 0, nothing is said twice, links join two known mentions, and nothing
    stands on a unit reviewed as none.
    """
    ids, none = F.col("mentions.mention_id"), F.transform(F.filter("reviews", lambda r: r["state"] == "none"), lambda r: r["unit_id"])
    return _coded(answers, group, {
        "unit_coverage_mismatch": (~F.col("reviews.unit_id").eqNullSafe(F.col("unit_ids"))).cast("int"),
        "mention_ids_not_contiguous": F.exists(F.transform(ids, lambda m, i: m.eqNullSafe(i.cast("long"))), lambda ok: ~ok).cast("int"),
        "duplicate_mention": _repeats(F.transform("mentions", lambda m: F.struct(m["label"], m["unit_id"]))),
        "link_endpoint_invalid": _each("links", lambda l, _: F.array_contains(ids, l["source"]) & F.array_contains(ids, l["target"]) & (l["source"] != l["target"])),
        "duplicate_link": _repeats(F.col("links")),
        "evidence_on_none_review": _each("mentions", lambda m, _: ~F.array_contains(none, m["unit_id"])) + _each("links", lambda l, _: ~F.array_contains(none, l["unit_id"])),
        "evidence_outside_group": _each("mentions", lambda m, _: F.array_contains(F.col("unit_ids"), m["unit_id"])) + _each("links", lambda l, _: F.array_contains(F.col("unit_ids"), l["unit_id"])),
    })


def answer_pointers(claims: DataFrame) -> DataFrame:
    """Violations of claims(claim, parent, relations, evidence, state, basis); evidence: (evidence_id, unit_id, quote, text).

    Legacy claims: known parents and targets, evidence ids once, quotes that stand in their unit, a basis for what is
    inferred. Cycles of parents are found by parent_errors.
    """
    known = claims.select(F.col("claim").alias("known"))
    base = _coded(claims, "claim", {
        "duplicate_evidence_id": _repeats(F.col("evidence.evidence_id")),
        "invalid_evidence_identity": _each("evidence", lambda e, _: e["text"].isNotNull()),
        "quote_not_found": _each("evidence", lambda e, _: e["text"].isNull() | e["text"].contains(e["quote"])),
        "inference_basis_required": ((F.col("state") == "inferred") & (F.coalesce("basis", F.lit("")) == "")).cast("int"),
    })
    parent = claims.filter("parent is not null").join(known, F.col("parent") == F.col("known"), "left_anti").select(F.col("claim").alias("subject"), F.lit("invalid_parent").alias("code"), F.lit(1).cast("long").alias("n"))
    target = claims.select("claim", F.explode("relations").alias("to")).join(known, F.col("to") == F.col("known"), "left_anti").groupBy(F.col("claim").alias("subject")).agg(F.lit("invalid_relationship_target").alias("code"), F.count("*").alias("n"))
    return base.union(parent).union(target)


def materialized(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """Facts(group_id, fact_id, window_id, quote) of admitted groups with exact spans, from windows(window_id, unit_id,
    unit_start, document_start, text).

    A quote stands at its first exact occurrence in its primary window. All or nothing: a group with a blank quote, or
    one that is not in its window, has no row.
    """
    j = facts.join(windows, "window_id", "left")
    at = F.when((F.trim("quote") != "") & F.col("text").isNotNull(), F.position(F.col("quote"), F.col("text")) - 1)
    j = j.withColumn("at", F.when(at >= 0, at)).withColumn("failed", F.count_if(F.col("at").isNull()).over(Window.partitionBy("group_id")))
    n = F.char_length("quote")
    spans = {"window": F.col("at"), "unit": F.col("at") + F.col("unit_start"), "document": F.col("at") + F.col("document_start")}
    return j.filter("failed = 0").select("group_id", "fact_id", "window_id", "unit_id", *[c for name, a in spans.items() for c in (a.alias(f"{name}_start"), (a + n).alias(f"{name}_end"))])


def partial_observations(groups: DataFrame, job: str) -> DataFrame:
    """Per job of groups(job, group_id, windows, status): what whole groups are admitted and which are left out.

    Only groups with status success are admitted; the others are listed with their status.
    """
    ok = F.col("status") == "success"
    left_out = F.array_sort(F.collect_list(F.when(~ok, F.concat_ws(":", F.col("group_id").cast("string"), "status"))))
    out = groups.groupBy(job).agg(F.count("*").alias("planned_groups"), F.count_if(ok).alias("admitted_groups"), F.sum("windows").cast("long").alias("planned_windows"), F.sum(F.when(ok, F.col("windows")).otherwise(0)).cast("long").alias("admitted_windows"), left_out.alias("excluded"))
    status = F.when(F.col("admitted_groups") == F.col("planned_groups"), "full").when(F.col("admitted_groups") > 0, "partial").otherwise("none")
    return out.withColumn("admission_status", status)


def group_outcomes(groups: DataFrame, job: str) -> DataFrame:
    """Per job of groups(job, status, returned), accounted where status is not null: counts, status and admission.

    generation_incomplete while a planned group has no generation, else success only if every group is admitted.
    """
    g = groups.groupBy(job).agg(F.count("*").alias("planned_groups"), F.count("status").alias("accounted_groups"), F.count_if("returned").alias("returned_groups"), F.count_if(F.col("status") == "success").alias("admitted_groups"))
    g = g.withColumn("missing_generation_groups", F.col("planned_groups") - F.col("returned_groups"))
    whole = F.col("admitted_groups") == F.col("planned_groups")
    status = F.when(F.col("missing_generation_groups") > 0, "generation_incomplete").when(whole, "success").otherwise("completed_with_rejections")
    return g.withColumn("status", status).withColumn("admission", F.when(whole, "full").when(F.col("admitted_groups") > 0, "partial").otherwise("none"))


def matrix_summary(jobs: DataFrame, terminal: tuple[str, ...] = ("success", "failed", "refused", "unavailable")) -> DataFrame:
    """Per paper of jobs(paper, kind, model, replicate, status): its extraction cells, whether all jobs ended, successes."""
    cell = F.when(F.col("kind") == "extraction", F.concat_ws("/", "model", F.col("replicate").cast("string"), "status"))
    return jobs.groupBy("paper").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.bool_and(F.col("status").isin(*terminal)).alias("terminal"), F.count_if((F.col("kind") == "extraction") & (F.col("status") == "success")).alias("successful_cells"))


# Statuses of a classification that ended, and the limits of its gate.
ENDED = ("success", "contract_invalid", "invalid_request", "truncated", "transport_error", "infrastructure_failed", "refused", "unavailable", "completed_with_rejections", "generation_incomplete")
LEAST_COMPLETED, FAILURE_FRACTION = 2, 0.5


def rejection_gate(counts: DataFrame, scope: str, least: int = LEAST_COMPLETED, fraction: float = FAILURE_FRACTION) -> DataFrame:
    """Per scope of counts(scope, status, n): completed, failures and whether failures are systemic."""
    done, bad = F.col("status").isin(*ENDED), F.col("status").isin(*ENDED[1:])
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    g = counts.groupBy(scope).agg(total(done).alias("completed"), total(bad).alias("failures"))
    return g.withColumn("systemic", (F.col("completed") >= least) & (F.col("failures") >= fraction * F.greatest("completed", F.lit(1))))


def merged_pages(mentions: DataFrame, facts: DataFrame, targets: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payloads of split pages as one: mentions(page, payload, old, refs) and facts(page, payload, fact, subject, window).

    Facts whose primary window is known but not of the page go. Mentions go whose windows are all known and none of
    the page, unless a fact that stays has them as subject. Those left are numbered on through the payloads of a page,
    and facts follow (a subject that is no mention becomes null). targets(page, window), windows(window).
    """
    known = windows.select(F.col("window"), F.lit(True).alias("known"))
    inside = targets.select("page", "window", F.lit(True).alias("inside"))
    f = facts.join(known, "window", "left").join(inside, ["page", "window"], "left").filter("known is null or inside is not null").select("page", "payload", "fact", "subject")
    subjects = f.select("page", "payload", F.col("subject").alias("old"), F.lit(True).alias("used")).distinct()
    refs = mentions.select("page", "payload", "old", F.explode("refs").alias("window")).join(known, "window", "left").join(inside, ["page", "window"], "left")
    outside = refs.groupBy("page", "payload", "old").agg(F.bool_and(F.col("known").isNotNull() & F.col("inside").isNull()).alias("outside"))
    m = mentions.join(outside, ["page", "payload", "old"], "left").join(subjects, ["page", "payload", "old"], "left").filter("used is not null or not coalesce(outside, false)")
    m = m.withColumn("new", F.row_number().over(Window.partitionBy("page").orderBy("payload", "old")) - 1).select("page", "payload", "old", "new")
    moved = f.join(m.withColumnRenamed("old", "subject"), ["page", "payload", "subject"], "left").select("page", "payload", "fact", F.col("new").alias("subject"))
    return m, moved


def selected_jobs(jobs: DataFrame, matches: DataFrame, paper) -> DataFrame:
    """Jobs(job, kind, paper, dataset) of one paper and the dataset jobs that matches(paper, dataset) lead to."""
    own = jobs.filter(F.col("paper") == F.lit(paper))
    data = jobs.filter("kind = 'dataset'").join(matches.filter(F.col("paper") == F.lit(paper)).select("dataset"), "dataset", "left_semi")
    return own.select("job").union(data.select("job")).distinct()


def declared_aliases(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """Entries(object_id, alias, pointer, document) whose JSON declares just the object's name, alias and scope.

    objects(object_id, name, scope_id). The pointer's value must equal {"name", "alias", "scope_id"}, nothing more.
    status is declared, alias_declaration_mismatch, alias_pointer_required or unknown_object.
    """
    j = entries.join(objects, "object_id", "left")
    step = F.regexp_replace(F.regexp_replace(F.regexp_replace("pointer", "^/", ""), "~1", "/"), "~0", "~")
    j = j.withColumn("step", step)
    value = F.from_json(F.expr("get_json_object(document, concat('$[\\'', step, '\\']'))"), "map<string,string>")
    want = F.create_map(F.lit("name"), F.col("name"), F.lit("alias"), F.col("alias"), F.lit("scope_id"), F.col("scope_id"))
    same = F.array_sort(F.map_entries(value)) == F.array_sort(F.map_entries(want))
    status = F.when(F.col("name").isNull(), "unknown_object").when(~F.coalesce(F.col("pointer").startswith("/"), F.lit(False)), "alias_pointer_required").when(F.coalesce(same, F.lit(False)) & (F.trim("alias") != ""), "declared").otherwise("alias_declaration_mismatch")
    return j.select("object_id", "alias", status.alias("status"))


# A declaration line, the noun phrase it must begin with, and words that a phrase may not hold.
DECLARATION = r"(?m)^[ \t]*[-+]\s*([A-Za-z][A-Za-z0-9_]*)\s*:\s*([^\r\n]+)"
PHRASE = r"^[A-Za-z]+(?:[ -][A-Za-z]+){0,7}$"
NOT_A_NAME = r"(?i)\b(?:if|is|are|or|and|not|including|extracted)\b"


def codebook_names(codebooks: DataFrame, objects: DataFrame) -> DataFrame:
    """Aliases that codebooks(scope_id, text) declare for objects(object_id, scope_id, name): object_id, alias, rule.

    A line `- name: phrase. more` names an object by its phrase and, without a representation at either end
    (Normalized ..., ... in Celsius), by the concept. Only noun-like phrases count.
    """
    names, texts = F.regexp_extract_all("text", F.lit(DECLARATION), F.lit(1)), F.regexp_extract_all("text", F.lit(DECLARATION), F.lit(2))
    d = codebooks.select("scope_id", F.explode(F.arrays_zip(names.alias("name"), texts.alias("about"))).alias("d")).select("scope_id", F.col("d.name").alias("name"), F.trim(F.split(F.trim("d.about"), "[.(]")[0]).alias("phrase"))
    d = d.filter(F.col("phrase").rlike(PHRASE) & ~F.col("phrase").rlike(NOT_A_NAME)).distinct()
    concept = F.regexp_replace(F.regexp_replace("phrase", r"(?i)^Normalized\s+", ""), r"(?i)\s+in\s+(?:Celsius|Fahrenheit|Kelvin)$", "")
    variants = F.array(F.struct(F.col("phrase").alias("alias"), F.lit("description_head").alias("rule")), F.when(concept != F.col("phrase"), F.struct(concept.alias("alias"), F.lit("strip_representation_qualifier").alias("rule"))))
    return objects.join(d, ["scope_id", "name"]).select("object_id", F.inline(F.filter(variants, lambda v: v.isNotNull())))


def united_claims(fields: DataFrame, metadata: DataFrame, dataset: str) -> DataFrame:
    """Claims of fields(dataset, ordinal, path, physical_type, logical_type, semantic_type, unit, state) and of
    metadata(dataset, ordinal, subject, property, value, state): numbered claims with equal metadata claims once.

    Every field claims its physical type; other properties only if known, as supported. Field claims come first.
    """
    props = ("physical_type", "logical_type", "semantic_type", "unit")
    claims = F.array(*[F.when(F.lit(i == 0) | (F.col(p).isNotNull() & (F.col(p) != "unknown")), F.struct(F.lit(i).alias("place"), F.lit(p).alias("property"), F.col(p).alias("value"), (F.col("state") if i == 0 else F.lit("supported")).alias("state"))) for i, p in enumerate(props)])
    a = fields.select(dataset, F.lit(0).alias("part"), "ordinal", F.col("path").alias("subject"), F.inline(F.filter(claims, lambda c: c.isNotNull())))
    b = metadata.groupBy(dataset, "subject", "property", "value", "state").agg(F.min("ordinal").alias("ordinal"))
    b = b.select(dataset, F.lit(1).alias("part"), "ordinal", F.coalesce("subject", F.lit("dataset")).alias("subject"), F.lit(0).alias("place"), F.coalesce("property", F.lit("format_specific_claim")).alias("property"), "value", "state")
    u = a.select(*b.columns).unionByName(b)
    order = Window.partitionBy(dataset).orderBy("part", "ordinal", "place", "subject", "property")
    return u.withColumn("claim_id", F.format_string("c%04d", F.row_number().over(order))).select(dataset, "claim_id", "subject", "property", "value", "state")
