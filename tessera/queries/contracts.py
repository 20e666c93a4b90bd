"""Contract checks, admission, roll-ups and declared names over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import contracts
from .base import read


def _answers(spark, sf_dir):
    """Each conversation as an answer: its turns are windows, user turns mentions, assistant turns facts."""
    c = read(spark, sf_dir, "conversations")
    t, k, n = F.col("turn").cast("int"), F.col("conv_id"), F.char_length("text")
    state = F.when(t % 7 == 3, "overflow").when(F.col("role") == "user", "reviewed").otherwise("uncertain")
    fact = F.struct((t % 4).alias("subject_mention"), (t + F.when(k % 9 == 0, 100).otherwise(0)).alias("primary_window"), F.when(t % 5 == 0, "relationship").otherwise("unit").alias("predicate"), F.when(t % 10 == 0, "x").alias("target"), F.when(t % 3 == 0, "unknown").when(t % 3 == 1, "inferred").otherwise("observed").alias("status"), F.when(n % 2 == 0, "v").alias("value"), F.when(t % 6 == 1, "b").alias("basis"))
    by_turn = lambda x: F.transform(F.sort_array(F.collect_list(F.struct(t.alias("turn"), x.alias("it")))), lambda s: s["it"])
    x = c.select("*", F.when(k % 10 == 4, t - 1).otherwise(t).alias("covered"))
    out = x.groupBy(k).agg(by_turn(t).alias("window_ids"), by_turn(F.struct(F.col("covered").alias("window_id"), state.alias("state"))).alias("coverage"), by_turn(F.when(F.col("role") == "user", F.struct(F.lit("field").alias("kind"), F.col("text").alias("label")))).alias("mentions"), by_turn(F.when(F.col("role") != "user", fact)).alias("facts"))
    some = lambda a: F.filter(a, lambda y: y.isNotNull())
    facts = F.when(F.col("conv_id") % 6 == 0, F.concat(some("facts"), some("facts"))).otherwise(some("facts"))
    return out.select("conv_id", "window_ids", "coverage", some("mentions").alias("mentions"), facts.alias("facts"))


def extraction_violations(spark, sf_dir):
    v = contracts.extraction_checks(_answers(spark, sf_dir), "conv_id")
    return v.groupBy("code").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))


def extraction_completion(spark, sf_dir):
    return contracts.completion(_answers(spark, sf_dir), "conv_id", 3, 4)


def _lines(spark, sf_dir):
    """Lines of orders with their place in the order (line numbers repeat)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return read(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(w))


_LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS i FROM lineitem)"


def feature_violations(spark, sf_dir):
    """Orders as answers: lines are cells, parts of even supplier keys mentions."""
    l = _lines(spark, sf_dir)
    i = F.col("i")
    cell = F.struct(F.col("l_partkey").alias("unit_id"), (F.col("l_partkey") % 100).alias("row_unit_id"), F.when(i % 3 == 0, "absent").otherwise("emitted").alias("decision"), F.when(F.col("l_suppkey") % 4 < 3, i - 1).alias("mention_index"))
    mention = F.struct(F.when(F.col("l_returnflag") == "R", "table").otherwise("field").alias("kind"), F.array(F.when(F.col("l_suppkey") % 5 == 0, F.lit(-1).cast("long")).otherwise(F.col("l_partkey"))).alias("units"))
    ordered = lambda x: F.transform(F.sort_array(F.collect_list(F.struct(i.alias("i"), x.alias("it")))), lambda s: s["it"])
    a = l.groupBy("l_orderkey").agg(ordered(mention).alias("mentions"), ordered(cell).alias("feature_coverage"))
    return contracts.feature_checks(a, "l_orderkey").groupBy("code").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))


def structure_violations(spark, sf_dir):
    """Orders as answers: lines are units and mentions, links lead from line to line."""
    l = _lines(spark, sf_dir)
    i, unit = F.col("i"), F.col("i").cast("long")
    ordered = lambda x: F.transform(F.sort_array(F.collect_list(F.struct(i.alias("i"), x.alias("it")))), lambda s: s["it"])
    review = F.struct(F.when((F.col("l_orderkey") % 50 == 0) & (i == 1), unit + 1).otherwise(unit).alias("unit_id"), F.when(F.col("l_returnflag") == "R", "none").otherwise("some").alias("state"))
    mention = F.struct(F.when(F.col("l_orderkey") % 40 == 0, unit).otherwise(unit - 1).alias("mention_id"), F.col("l_linestatus").alias("label"), F.when(F.col("l_linestatus") == "F", F.lit(1).cast("long")).otherwise(unit).alias("unit_id"))
    link = F.struct((unit - 1).alias("source"), (F.col("l_suppkey") % 3).alias("target"), unit.alias("unit_id"))
    a = l.groupBy("l_orderkey").agg(ordered(unit).alias("unit_ids"), ordered(review).alias("reviews"), ordered(mention).alias("mentions"), ordered(link).alias("links"))
    return contracts.structure_checks(a, "l_orderkey").groupBy("code").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))


def claim_pointers(spark, sf_dir):
    """Orders as claims whose parent is the order before, with words of their priority as evidence."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    word = F.struct(F.lit("e1").alias("evidence_id"), k.alias("unit_id"), F.when(k % 8 == 0, "nothing").otherwise(F.substring("o_orderpriority", 1, 1)).alias("quote"), F.when(k % 25 != 0, F.col("o_orderpriority")).alias("text"))
    claims = o.select(k.alias("claim"), (k - 1).alias("parent"), F.array(k + 1).alias("relations"), F.when(k % 12 == 0, F.array(word, word)).otherwise(F.array(word)).alias("evidence"), F.when(F.col("o_orderstatus") == "F", "inferred").otherwise("observed").alias("state"), F.when(F.col("o_custkey") % 2 == 0, "b").alias("basis"))
    return contracts.answer_pointers(claims).groupBy("code").agg(F.count("*").alias("claims"), F.sum("n").alias("n"))


def materialized_facts(spark, sf_dir):
    """Words of user turns as facts of their conversation; turns are windows of one document."""
    c = read(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    w = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("window_id"), F.col("conv_id").alias("unit_id"), F.coalesce(F.sum(F.char_length("text") + 1).over(before), F.lit(0)).alias("unit_start"), "text")
    w = w.withColumn("document_start", F.col("unit_start") + 1000)
    f = c.filter("role = 'user'").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("fact_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("window_id"), F.when((F.col("conv_id") + F.col("turn")) % 11 == 5, "nowhere to be found").otherwise(F.substring("text", 5, 10)).alias("quote"))
    m = contracts.materialized(f, w)
    return m.select("group_id", "fact_id", "window_start", "unit_start", "document_start", "document_end")


def _groups(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", "contract_invalid")).otherwise("success")
    return l.select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("group_id"), F.col("l_quantity").cast("long").alias("windows"), status.alias("status"), (F.col("l_discount") < 0.09).alias("returned"))


def partial_observations(spark, sf_dir):
    g = _groups(spark, sf_dir).na.fill({"status": "pending"})
    p = contracts.partial_observations(g, "job")
    return p.select("job", "planned_groups", "admitted_groups", "planned_windows", "admitted_windows", F.array_join("excluded", "|").alias("excluded"), "admission_status")


def group_outcomes(spark, sf_dir):
    return contracts.group_outcomes(_groups(spark, sf_dir), "job")


def matrix_summary(spark, sf_dir):
    """Customers as papers; their orders are jobs."""
    o = read(spark, sf_dir, "orders")
    j = o.select(F.col("o_custkey").alias("paper"), F.when(F.col("o_orderpriority") == "5-LOW", "classification").otherwise("extraction").alias("kind"), F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 3).alias("replicate"), F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("running").alias("status"))
    m = contracts.matrix_summary(j)
    return m.select("paper", F.array_join("cells", "|").alias("cells"), "terminal", "successful_cells")


def rejection_gate(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "running").otherwise("contract_invalid")
    return contracts.rejection_gate(o.groupBy("o_custkey", status.alias("status")).agg(F.count("*").alias("n")), "o_custkey")


def merged_pages(spark, sf_dir):
    """Orders as pages whose lines come in two payloads; parts are windows, and some lie on other pages."""
    l = _lines(spark, sf_dir)
    page, payload = F.col("l_orderkey").alias("page"), (F.col("i") % 2).alias("payload")
    w = F.when(F.col("l_suppkey") % 3 == 0, -F.col("l_orderkey") - 1).when(F.col("l_suppkey") % 3 == 1, F.lit(-999_999_999).cast("long")).otherwise(F.col("l_orderkey"))
    mentions = l.select(page, payload, F.col("i").alias("old"), F.array(w).alias("refs"))
    facts = l.select(page, payload, F.col("i").alias("fact"), (F.col("i") + F.col("l_partkey") % 3).cast("int").alias("subject"), F.when(F.col("l_partkey") % 4 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")).alias("window"))
    pages = l.select(page).distinct()
    targets = pages.select("page", F.col("page").alias("window"))
    windows = pages.select(F.col("page").alias("window")).union(pages.select(-F.col("page") - 1))
    m, f = contracts.merged_pages(mentions, facts, targets, windows)
    a = m.select("page", "payload", F.lit("mention").alias("kind"), F.col("old").cast("long").alias("old"), F.col("new").cast("long").alias("new"))
    return a.union(f.select("page", "payload", F.lit("fact"), F.col("fact").cast("long"), F.col("subject").cast("long")))


def packet_selection(spark, sf_dir):
    """Jobs of customer 7's nation: its own orders, and parts its suppliers' lines lead to."""
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("job"), F.lit("extraction").alias("kind"), F.col("o_custkey").alias("paper"), F.lit(None).cast("long").alias("dataset"))
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("job"), F.lit("dataset").alias("kind"), F.lit(None).cast("long").alias("paper"), F.col("p_partkey").alias("dataset"))
    m = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("paper"), F.col("l_partkey").alias("dataset"))
    return contracts.selected_jobs(o.union(p), m, 7)


def declared_aliases(spark, sf_dir):
    """Parts as objects; a JSON document declares an alias of each, some for another scope or without a pointer."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    objects = p.select(k.alias("object_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("scope_id"))
    said = F.to_json(F.struct(F.struct(F.when(k % 7 == 0, "other").otherwise(F.col("p_name")).alias("name"), F.concat(F.lit("a"), k.cast("string")).alias("alias"), F.col("p_brand").alias("scope_id"), F.when(k % 11 == 0, "more").alias("note")).alias("x")))
    entries = p.select(F.when(k % 13 == 0, -k - 1).otherwise(k).alias("object_id"), F.concat(F.lit("a"), k.cast("string")).alias("alias"), F.when(k % 5 == 0, "x").otherwise("/x").alias("pointer"), said.alias("document"))
    return contracts.declared_aliases(entries, objects)


def codebook_names(spark, sf_dir):
    """A codebook for each brand that describes its parts; some lines are sentences, some name a representation."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    about = F.when(k % 4 == 0, F.concat(F.lit("Normalized "), F.translate("p_type", "0123456789", ""), F.lit(" in Celsius. See notes"))).when(k % 4 == 1, F.concat(F.col("p_type"), F.lit(" or other"))).when(k % 4 == 2, F.concat(F.col("p_type"), F.lit("(a note)"))).otherwise(F.lit("9 lives"))
    line = F.concat(F.lit(" - f"), k.cast("string"), F.lit(": "), about)
    books = p.groupBy(F.col("p_brand").alias("scope_id")).agg(F.concat(F.lit("Codebook\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("text"))
    objects = p.select(k.alias("object_id"), F.col("p_brand").alias("scope_id"), F.when(k % 9 == 0, "none").otherwise(F.concat(F.lit("f"), k.cast("string"))).alias("name"))
    return contracts.codebook_names(books, objects)


def united_claims(spark, sf_dir):
    """Suppliers as fields of their nation, claims of regions as metadata that repeats."""
    s = read(spark, sf_dir, "supplier")
    fields = s.select(F.col("s_nationkey").alias("dataset"), F.col("s_suppkey").alias("ordinal"), F.col("s_name").alias("path"), F.when(F.col("s_acctbal") < 0, "unknown").otherwise("double").alias("physical_type"), F.when(F.col("s_suppkey") % 3 == 0, "measurement").otherwise("unknown").alias("logical_type"), F.when(F.col("s_suppkey") % 4 == 0, "balance").alias("semantic_type"), F.lit(None).cast("string").alias("unit"), F.when(F.col("s_acctbal") < 0, "unknown").otherwise("observed").alias("state"))
    c = read(spark, sf_dir, "customer")
    meta = c.select(F.col("c_nationkey").alias("dataset"), F.col("c_custkey").alias("ordinal"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("subject"), F.when(F.col("c_acctbal") > 0, "segment").alias("property"), F.lit("v").alias("value"), F.lit("supported").alias("state"))
    return contracts.united_claims(fields, meta, "dataset")


QUERIES = {f.__name__: f for f in (extraction_violations, extraction_completion, feature_violations, structure_violations, claim_pointers, materialized_facts, partial_observations, group_outcomes, matrix_summary, rejection_gate, merged_pages, packet_selection, declared_aliases, codebook_names, united_claims)}

_CODES = "SELECT code, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n FROM (SELECT g, code, count(*) AS n FROM v GROUP BY g, code) GROUP BY code"

ORACLES = {
    "extraction_violations": f"""
        WITH w AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), m AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS mentions FROM w GROUP BY conv_id),
        f AS (SELECT w.conv_id AS g, w.turn, n, turn + CASE WHEN w.conv_id % 9 = 0 THEN 100 ELSE 0 END AS win, mentions, generate_series AS copy FROM w JOIN m USING (conv_id), generate_series(1, 2) WHERE role <> 'user' AND (generate_series = 1 OR w.conv_id % 6 = 0)),
        s AS (SELECT conv_id AS g, turn AS win, CASE WHEN conv_id % 10 = 4 THEN turn - 1 ELSE turn END AS covered, turn % 7 = 3 AS overflow FROM w),
        v AS (SELECT DISTINCT conv_id AS g, 'target_order_or_coverage_mismatch' AS code FROM w WHERE conv_id % 10 = 4
            UNION ALL SELECT g, 'fact_subject_missing' FROM f WHERE turn % 4 >= mentions
            UNION ALL SELECT f.g, 'fact_primary_window_foreign' FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.g = f.g AND s.win = f.win)
            UNION ALL SELECT f.g, 'fact_on_overflow_window' FROM f WHERE EXISTS (SELECT 1 FROM s WHERE s.g = f.g AND s.win = f.win) AND EXISTS (SELECT 1 FROM s WHERE s.g = f.g AND s.covered = f.win AND overflow)
            UNION ALL SELECT g, 'fact_target_shape_invalid' FROM f WHERE (turn % 5 = 0) <> (turn % 10 = 0)
            UNION ALL SELECT g, 'fact_status_value_conflict' FROM f WHERE (turn % 3 = 0) <> (n % 2 <> 0)
            UNION ALL SELECT g, 'fact_inference_basis_required' FROM f WHERE turn % 3 = 1 AND turn % 6 <> 1
            UNION ALL SELECT g, 'duplicate_fact' FROM (SELECT g, row_number() OVER (PARTITION BY g, turn % 4, win, turn % 5 = 0, turn % 10 = 0, turn % 3, n % 2, turn % 6 = 1) AS r FROM f) WHERE r > 1)
        {_CODES}""",
    "extraction_completion": """SELECT conv_id, CASE WHEN count(*) FILTER (WHERE turn % 7 = 3) > 0 OR count(*) FILTER (WHERE role = 'user') >= 3 OR count(*) FILTER (WHERE role <> 'user') * CASE WHEN conv_id % 6 = 0 THEN 2 ELSE 1 END >= 4 THEN 'incomplete' ELSE 'success' END AS completion FROM conversations GROUP BY conv_id""",
    "feature_violations": f"""
        WITH {_LINES}, r AS (SELECT l_orderkey AS g, *, i - 1 AS place, count(*) OVER (PARTITION BY l_orderkey) AS mentions FROM lines),
        c AS (SELECT *, CASE WHEN i % 3 = 0 THEN 'absent' ELSE 'emitted' END AS decision, CASE WHEN l_suppkey % 4 < 3 THEN i - 1 END AS named FROM r),
        j AS (SELECT c.g, c.decision, c.named, c.mentions, m.l_returnflag <> 'R' AND (CASE WHEN m.l_suppkey % 5 = 0 THEN -1 ELSE m.l_partkey END) IN (c.l_partkey, c.l_partkey % 100) AS bound FROM c LEFT JOIN r m ON m.g = c.g AND m.place = c.named),
        v AS (SELECT g, 'feature_coverage_missing_mention' AS code FROM j WHERE decision = 'emitted' AND (named IS NULL OR named NOT BETWEEN 0 AND mentions - 1)
            UNION ALL SELECT g, 'feature_coverage_mention_not_bound_to_cell' FROM j WHERE decision = 'emitted' AND named BETWEEN 0 AND mentions - 1 AND NOT bound
            UNION ALL SELECT g, 'nonemitted_cell_has_mention' FROM j WHERE decision <> 'emitted' AND named IS NOT NULL)
        {_CODES}""",
    "structure_violations": f"""
        WITH {_LINES}, r AS (SELECT l_orderkey AS g, i, CASE WHEN l_orderkey % 50 = 0 AND i = 1 THEN 2 ELSE i END AS reviewed, l_returnflag = 'R' AS none, CASE WHEN l_orderkey % 40 = 0 THEN i ELSE i - 1 END AS mention,
            l_linestatus AS label, CASE WHEN l_linestatus = 'F' THEN 1 ELSE i END AS munit, i - 1 AS source, l_suppkey % 3 AS target, i - 1 AS place FROM lines),
        n AS (SELECT DISTINCT g, reviewed AS unit FROM r WHERE none), m AS (SELECT DISTINCT g, mention FROM r),
        v AS (SELECT DISTINCT g, 'unit_coverage_mismatch' AS code FROM r WHERE reviewed <> i
            UNION ALL SELECT DISTINCT g, 'mention_ids_not_contiguous' FROM r WHERE mention <> place
            UNION ALL SELECT g, 'duplicate_mention' FROM (SELECT g, row_number() OVER (PARTITION BY g, label, munit) AS k FROM r) WHERE k > 1
            UNION ALL SELECT g, 'link_endpoint_invalid' FROM r WHERE source = target OR NOT EXISTS (SELECT 1 FROM m WHERE m.g = r.g AND m.mention = r.source) OR NOT EXISTS (SELECT 1 FROM m WHERE m.g = r.g AND m.mention = r.target)
            UNION ALL SELECT g, 'evidence_on_none_review' FROM r WHERE EXISTS (SELECT 1 FROM n WHERE n.g = r.g AND n.unit = r.munit)
            UNION ALL SELECT g, 'evidence_on_none_review' FROM r WHERE EXISTS (SELECT 1 FROM n WHERE n.g = r.g AND n.unit = r.i)
            UNION ALL SELECT g, 'evidence_outside_group' FROM r WHERE NOT EXISTS (SELECT 1 FROM r u WHERE u.g = r.g AND u.i = r.munit))
        {_CODES}""",
    "claim_pointers": """
        WITH o AS (SELECT *, CASE WHEN o_orderkey % 12 = 0 THEN 2 ELSE 1 END AS times FROM orders),
        v AS (SELECT 'duplicate_evidence_id' AS code, 1 AS n FROM o WHERE times = 2 UNION ALL SELECT 'invalid_evidence_identity', times FROM o WHERE o_orderkey % 25 = 0
            UNION ALL SELECT 'quote_not_found', times FROM o WHERE o_orderkey % 8 = 0 AND o_orderkey % 25 <> 0 UNION ALL SELECT 'inference_basis_required', 1 FROM o WHERE o_orderstatus = 'F' AND o_custkey % 2 <> 0
            UNION ALL SELECT 'invalid_parent', 1 FROM o WHERE o_orderkey - 1 NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'invalid_relationship_target', 1 FROM o WHERE o_orderkey + 1 NOT IN (SELECT o_orderkey FROM orders))
        SELECT code, count(*) AS claims, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY code""",
    "materialized_facts": """
        WITH w AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations),
        f AS (SELECT *, CASE WHEN (conv_id + turn) % 11 = 5 THEN 'nowhere to be found' ELSE substr(text, 5, 10) END AS q FROM w WHERE role = 'user'),
        p AS (SELECT *, CASE WHEN trim(q) <> '' AND strpos(text, q) > 0 THEN strpos(text, q) - 1 END AS place FROM f)
        SELECT conv_id AS group_id, turn AS fact_id, CAST(place AS INTEGER) AS window_start, CAST(place + s AS BIGINT) AS unit_start, CAST(place + s + 1000 AS BIGINT) AS document_start, CAST(place + s + 1000 + length(q) AS BIGINT) AS document_end
        FROM p WHERE conv_id NOT IN (SELECT conv_id FROM p WHERE place IS NULL)""",
    "partial_observations": """
        WITH g AS (SELECT l_orderkey AS job, l_linenumber AS i, CAST(l_quantity AS BIGINT) AS w, CASE WHEN l_returnflag <> 'R' THEN 'success' WHEN l_linestatus = 'F' THEN 'contract_invalid' ELSE 'pending' END AS s FROM lineitem)
        SELECT job, count(*) AS planned_groups, count(*) FILTER (WHERE s = 'success') AS admitted_groups, CAST(sum(w) AS BIGINT) AS planned_windows, CAST(coalesce(sum(w) FILTER (WHERE s = 'success'), 0) AS BIGINT) AS admitted_windows,
            coalesce(string_agg(i || ':' || s, '|' ORDER BY i || ':' || s) FILTER (WHERE s <> 'success'), '') AS excluded,
            CASE WHEN count(*) FILTER (WHERE s = 'success') = count(*) THEN 'full' WHEN count(*) FILTER (WHERE s = 'success') > 0 THEN 'partial' ELSE 'none' END AS admission_status FROM g GROUP BY job""",
    "group_outcomes": """
        WITH g AS (SELECT l_orderkey AS job, CASE WHEN l_returnflag <> 'R' THEN 'success' WHEN l_linestatus = 'F' THEN 'contract_invalid' END AS s, l_discount < 0.09 AS r FROM lineitem),
        t AS (SELECT job, count(*) AS p, count(s) AS a, count(*) FILTER (WHERE r) AS r, count(*) FILTER (WHERE s = 'success') AS k FROM g GROUP BY job)
        SELECT job, p AS planned_groups, a AS accounted_groups, r AS returned_groups, k AS admitted_groups, p - r AS missing_generation_groups,
            CASE WHEN r < p THEN 'generation_incomplete' WHEN k = p THEN 'success' ELSE 'completed_with_rejections' END AS status, CASE WHEN k = p THEN 'full' WHEN k > 0 THEN 'partial' ELSE 'none' END AS admission FROM t""",
    "matrix_summary": """
        WITH j AS (SELECT o_custkey AS paper, o_orderpriority <> '5-LOW' AS e, o_orderpriority || '/' || o_orderkey % 3 || '/' || CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'running' END AS cell, o_orderstatus AS s FROM orders)
        SELECT paper, coalesce(string_agg(cell, '|' ORDER BY cell) FILTER (WHERE e), '') AS cells, bool_and(s <> 'P') AS terminal, count(*) FILTER (WHERE e AND s = 'F') AS successful_cells FROM j GROUP BY paper""",
    "rejection_gate": """
        WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'P') AS d, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'P')) AS f FROM orders GROUP BY 1)
        SELECT o_custkey, d AS completed, f AS failures, d >= 2 AND f / greatest(d, 1) >= 0.5 AS systemic FROM c""",
    "merged_pages": f"""
        WITH {_LINES}, x AS (SELECT l_orderkey AS page, i % 2 AS payload, i, CASE l_suppkey % 3 WHEN 0 THEN -l_orderkey - 1 WHEN 1 THEN -999999999 ELSE l_orderkey END AS ref, i + l_partkey % 3 AS subject, l_partkey % 4 = 0 AS away FROM lines),
        f AS (SELECT * FROM x WHERE NOT away), u AS (SELECT DISTINCT page, payload, subject FROM f),
        m AS (SELECT page, payload, i, row_number() OVER (PARTITION BY page ORDER BY payload, i) - 1 AS n FROM x WHERE NOT (ref < 0 AND ref <> -999999999) OR EXISTS (SELECT 1 FROM u WHERE u.page = x.page AND u.payload = x.payload AND u.subject = x.i))
        SELECT page, payload, 'mention' AS kind, CAST(i AS BIGINT) AS old, CAST(n AS BIGINT) AS new FROM m
        UNION ALL SELECT f.page, f.payload, 'fact', CAST(f.i AS BIGINT), CAST(m.n AS BIGINT) FROM f LEFT JOIN m ON m.page = f.page AND m.payload = f.payload AND m.i = f.subject""",
    "packet_selection": "SELECT 'o' || o_orderkey AS job FROM orders WHERE o_custkey = 7 UNION SELECT 'p' || l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7 AND l_partkey IN (SELECT p_partkey FROM part)",
    "declared_aliases": """
        SELECT CASE WHEN p_partkey % 13 = 0 THEN -p_partkey - 1 ELSE p_partkey END AS object_id, 'a' || p_partkey AS alias,
            CASE WHEN p_partkey % 13 = 0 THEN 'unknown_object' WHEN p_partkey % 5 = 0 THEN 'alias_pointer_required' WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN 'alias_declaration_mismatch' ELSE 'declared' END AS status FROM part""",
    "codebook_names": r"""
        WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Normalized ' || regexp_replace(p_type, '[0-9]', '', 'g') || ' in Celsius' WHEN 2 THEN trim(split_part(p_type, '(', 1)) END AS phrase FROM part WHERE p_partkey % 4 IN (0, 2) AND p_partkey % 9 <> 0),
        q AS (SELECT * FROM p WHERE regexp_full_match(phrase, '[A-Za-z]+(?:[ -][A-Za-z]+){0,7}'))
        SELECT k AS object_id, phrase AS alias, 'description_head' AS rule FROM q
        UNION ALL SELECT k, regexp_replace(regexp_replace(phrase, '^Normalized ', ''), ' in Celsius$', ''), 'strip_representation_qualifier' FROM q WHERE k % 4 = 0""",
    "united_claims": """
        WITH f AS (SELECT s_nationkey AS dataset, 0 AS part, s_suppkey AS ordinal, s_name AS subject, unnest([0, 1, 2]) AS place, unnest(['physical_type', 'logical_type', 'semantic_type']) AS property,
                unnest([CASE WHEN s_acctbal < 0 THEN 'unknown' ELSE 'double' END, CASE WHEN s_suppkey % 3 = 0 THEN 'measurement' END, CASE WHEN s_suppkey % 4 = 0 THEN 'balance' END]) AS value, unnest([CASE WHEN s_acctbal < 0 THEN 'unknown' ELSE 'observed' END, 'supported', 'supported']) AS state FROM supplier),
        m AS (SELECT c_nationkey AS dataset, 1 AS part, min(c_custkey) AS ordinal, coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END, 'dataset') AS subject, 0 AS place, CASE WHEN c_acctbal > 0 THEN 'segment' ELSE 'format_specific_claim' END AS property, 'v' AS value, 'supported' AS state FROM customer GROUP BY ALL),
        u AS (SELECT * FROM f WHERE value IS NOT NULL UNION ALL SELECT * FROM m)
        SELECT dataset, printf('c%04d', row_number() OVER (PARTITION BY dataset ORDER BY part, ordinal, place, subject, property)) AS claim_id, subject, property, value, state FROM u""",
}
