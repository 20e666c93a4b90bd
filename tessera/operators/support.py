"""Evidence for names in text: scoped catalogs, visibility, prose definitions, field support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import contains_label

DEFINITION = r"\s*:\s*(?:it\s+)?(?:gives?|measures?|represents?|denotes?)\b"
INTRODUCTION = r"\bfeatures?\b.{0,100}\b(?:descriptions?|definitions?|given below|extracted)\b"
#: An introduction counts up to so many windows before the definition.
REACH = 6


def scoped_catalog(facts: DataFrame, scopes: DataFrame) -> DataFrame:
    """Objects of facts(dataset_id, fact_id, subject, predicate, value) in scopes(scope_id, dataset_id, sheet, roles map).

    A subject is an object if a name is declared for it; with a sheet only subjects of that sheet count. Property
    facts stay attached by id; facts of subjects without a name are left out of the catalog, not lost.
    """
    j = facts.join(F.broadcast(scopes), "dataset_id").filter(F.col("sheet").isNull() | F.col("subject").startswith(F.concat("sheet", F.lit("."))))
    g = j.groupBy("scope_id", "subject").agg(
        F.min(F.when(F.col("predicate") == "name", F.col("value"))).alias("name"),
        F.array_sort(F.collect_set(F.when(F.col("predicate") != "name", F.col("fact_id")))).alias("property_facts"),
        F.first("roles").alias("roles"),
    )
    g = g.filter("name is not null")
    role = F.coalesce(F.try_element_at("roles", F.col("name")), F.lit("unspecified"))
    return g.select("scope_id", F.concat("scope_id", F.lit("::"), "subject").alias("object_id"), "name", role.alias("role"), "property_facts")


def visible_names(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(object_id, page_id) where a page's lexical text has the name's lexical form as words of its own.

    pages(page_id, lexical) and names(object_id, lexical). Candidates share the name's first word, so this is an
    equi-join and not all names on all pages. A miss says nothing about absence.
    """
    first = lambda c: F.regexp_extract(c, r"(?U)(\w+)", 1)
    tokens = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("lexical", F.lit(r"(?U)(\w+)"), 1))).alias("_w"))
    n = names.select("object_id", F.col("lexical").alias("_name"), first(F.col("lexical")).alias("_w")).filter("_w <> ''")
    pairs = tokens.join(n, "_w").select("page_id", "object_id", "_name")
    return pairs.join(pages, "page_id").filter(contains_label(F.col("lexical"), F.col("_name"))).select("object_id", "page_id")


def defined_names(windows: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions that a window defines (`name: measures ...`) after an introduction at most REACH windows before.

    windows(paper_id, page, window_index, lexical), mentions(paper_id, mention_id, lexical, window_index).
    """
    w = windows.select("paper_id", "page", "window_index", F.col("lexical").alias("_t"))
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("lexical"), F.lit(r"\E" + DEFINITION))
    defined = mentions.join(w, ["paper_id", "window_index"]).filter(F.regexp_like("_t", quoted)).select("paper_id", "page", "mention_id", "window_index")
    intro = w.filter(F.col("_t").rlike(INTRODUCTION)).select("paper_id", "page", F.col("window_index").alias("_at"))
    near = defined.withColumn("_at", F.explode(F.sequence(F.greatest(F.col("window_index") - REACH, F.lit(0)), F.col("window_index"))))
    return near.join(intro, ["paper_id", "page", "_at"]).groupBy("paper_id", "mention_id").agg(F.min("_at").alias("introduced_at"))


def field_support(mentions: DataFrame, cells: DataFrame, descriptors: DataFrame, defined: DataFrame) -> DataFrame:
    """Conservative status of mentions(mention_id, lexical, unit_id).

    supported by a feature cell of the cited unit or by a definition, rejected as a statistic that heads a cited
    table, unresolved when both or none hold. cells(unit_id, lexical), descriptors(unit_id, lexical).
    """
    yes = mentions.join(cells.select("unit_id", "lexical").distinct(), ["unit_id", "lexical"], "left_semi").select("mention_id").distinct().withColumn("yes", F.lit(True))
    no = mentions.join(descriptors.select("unit_id", "lexical").distinct(), ["unit_id", "lexical"], "left_semi").select("mention_id").distinct().withColumn("no", F.lit(True))
    said = defined.select("mention_id").distinct().withColumn("said", F.lit(True))
    j = mentions.select("mention_id").distinct().join(yes, "mention_id", "left").join(no, "mention_id", "left").join(said, "mention_id", "left")
    reason = F.when(F.col("yes") & F.col("no"), "conflicting_source_roles").when(F.col("yes"), "feature_axis_cell_rule").when(F.col("no"), "statistic_descriptor_as_field").when(F.col("said"), "named_measurement_definition_with_feature_context_rule").otherwise("name_present_but_object_role_unverified")
    status = F.when(reason.isin("feature_axis_cell_rule", "named_measurement_definition_with_feature_context_rule"), "supported").when(reason == "statistic_descriptor_as_field", "rejected").otherwise("unresolved")
    return j.select("mention_id", status.alias("status"), reason.alias("reason"))


def published(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Accepted objects of decisions(run_id, object_id, status): only of runs(run_id, admission, errors) that
    succeeded without an error; other runs publish nothing."""
    good = runs.filter((F.col("admission") == "success") & (F.col("errors") == 0)).select("run_id")
    return decisions.filter("status = 'supported'").join(good, "run_id", "left_semi").select("run_id", "object_id").distinct()
