"""Matching, coverage, job graphs and roll-ups over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..operators import matching
from ..plans import jobs
from .base import read


def tiered_match(spark, sf_dir):
    """Nation names in several spellings against the nation catalog; aliases are the last tier."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("object_id"), "n_name")
    spelled = F.when(F.col("object_id") % 5 == 0, F.col("n_name")).when(F.col("object_id") % 5 == 1, F.concat(F.lit(" "), F.lower("n_name"), F.lit("_"))).when(F.col("object_id") % 5 == 2, F.concat(F.lit("alias"), F.col("object_id").cast("string"))).when(F.col("object_id") % 5 == 3, F.lit("nowhere")).otherwise(F.substring("n_name", 1, 1))
    labels = n.select(F.col("object_id").alias("label_id"), spelled.alias("label"))
    catalog = n.withColumn("alias", F.concat(F.lit("alias"), (F.col("object_id") - F.col("object_id") % 10).cast("string")))
    return matching.tiered_match(labels, catalog, [("exact_unique_name", F.col("label"), F.col("n_name")), ("conservative_lexical_name", names.lexical_ascii(F.col("label")), names.lexical_ascii(F.col("n_name"))), ("initial", F.col("label"), F.substring("n_name", 1, 1))])


_MATCH = """
    WITH n AS (SELECT n_nationkey AS k, n_name, CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN ' ' || lower(n_name) || '_' WHEN 2 THEN 'alias' || n_nationkey WHEN 3 THEN 'nowhere' ELSE substr(n_name, 1, 1) END AS label FROM nation),
    t AS (SELECT a.k AS label_id, b.k AS o, 0 AS tier FROM n a JOIN nation x ON a.label = x.n_name JOIN n b ON b.k = x.n_nationkey
        UNION SELECT a.k, b.k, 1 FROM n a JOIN n b ON lower(trim(regexp_replace(a.label, '[\\s_\\-]+', ' ', 'g'))) = lower(trim(regexp_replace(b.n_name, '[\\s_\\-]+', ' ', 'g')))
        UNION SELECT a.k, b.k, 2 FROM n a JOIN n b ON a.label = substr(b.n_name, 1, 1)),
    m AS (SELECT label_id, tier, count(*) AS c, min(o) AS o FROM t WHERE tier = (SELECT min(tier) FROM t u WHERE u.label_id = t.label_id) GROUP BY label_id, tier)
    SELECT n.k AS label_id, CASE WHEN c = 1 THEN 'matched' ELSE 'unresolved' END AS status,
        CASE WHEN c = 1 THEN ['exact_unique_name', 'conservative_lexical_name', 'initial'][tier + 1] WHEN c > 1 THEN 'ambiguous_scope_or_name' ELSE 'no_supported_mapping' END AS reason,
        coalesce(c, 0) AS candidates, CASE WHEN c = 1 THEN o END AS object_id FROM n LEFT JOIN m ON m.label_id = n.k"""


def uncovered_docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter("lang = 'de'").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def support_rollup(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    r = matching.support_rates(d, "source", "lang", F.col("quality") == 1)
    return r.select("lang", "decisions", "hits", F.round("pooled_rate", 6).alias("pooled_rate"), F.round("macro_rate", 6).alias("macro_rate"))


def decision_dedup(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    d = matching.dedup_decisions(o.withColumn("ev", F.col("o_custkey") % 5), ["o_orderstatus", "o_orderpriority"], "o_orderkey", "o_orderkey", "ev")
    return d.select("o_orderstatus", "o_orderpriority", F.array_join(F.transform("mentions", lambda x: x.cast("string")), ",").alias("mentions"), F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


def evidence_ids(spark, sf_dir):
    return matching.evidence_ids(read(spark, sf_dir, "events"), ["event_type"], "event_id")


def grouped_availability(spark, sf_dir):
    """Counts at several grains at once (grouping sets)."""
    o = read(spark, sf_dir, "orders")
    c = o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("grain"))
    return c


def stage_status_pivot(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


def job_plan(spark, sf_dir):
    """A classifier a nation, and an extractor for each market segment and replicate that needs it."""
    n = read(spark, sf_dir, "nation").select("n_nationkey")
    seg = read(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    rep = spark.range(1, 3).select(F.col("id").alias("replicate"))
    first = n.select("n_nationkey", F.lit("classification").alias("kind"), F.lit(None).cast("string").alias("segment"), F.lit(0).cast("long").alias("replicate"), jobs.job_id(F.lit("c"), F.col("n_nationkey")).alias("job"), F.lit(None).cast("string").alias("needs"))
    second = jobs.factorial(n, seg, rep).select("n_nationkey", F.lit("extraction").alias("kind"), F.col("c_mktsegment").alias("segment"), "replicate", jobs.job_id(F.lit("e"), F.col("n_nationkey"), F.col("c_mktsegment"), F.col("replicate")).alias("job"), jobs.job_id(F.lit("c"), F.col("n_nationkey")).alias("needs"))
    return first.union(second)


def job_readiness(spark, sf_dir):
    p = job_plan(spark, sf_dir)
    status = F.when(F.col("kind") == "extraction", "pending").when(F.col("n_nationkey") % 4 == 0, "done").when(F.col("n_nationkey") % 4 == 1, "failed").otherwise("pending")
    j = p.select("job", status.alias("status"))
    r = jobs.readiness(j, p.filter("needs is not null").select("job", "needs"))
    return r.groupBy("status", "state").agg(F.count("*").alias("jobs"))


def _edges(spark, sf_dir):
    """region <- nation <- customer <- order as a graph of needs, for customers below 300."""
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("job"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("needs"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("job"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("needs"))
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("job"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("needs"))
    return n.union(c).union(o)


_EDGES = """e AS (SELECT 'n' || n_nationkey AS job, 'r' || n_regionkey AS needs FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


def dag_waves(spark, sf_dir):
    e = _edges(spark, sf_dir)
    nodes = e.select("job").union(e.select("needs")).distinct()
    return jobs.waves(nodes, e).groupBy("level").agg(F.count("*").alias("jobs"))


def blocked_closure(spark, sf_dir):
    failed = spark.createDataFrame([("r1",), ("n3",)], "job string")
    return jobs.blocked(failed, _edges(spark, sf_dir)).select("job")


def leakage_components(spark, sf_dir):
    """Documents linked by equal texts or equal long first lines: component of each linked document."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    line = F.substring_index("text", "\n", 1)
    keys = d.select("doc_id", F.md5("text").alias("k")).union(d.filter(F.length(line) >= 40).select("doc_id", F.md5(line)))
    hub = keys.groupBy("k").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    edges = keys.join(hub, "k").select("doc_id", "hub").filter("doc_id <> hub")
    return matching.min_label_components(edges, "doc_id", "hub").select(F.col("node").alias("doc_id"), F.col("root").alias("component"))


_COMPONENTS = """
    WITH RECURSIVE d AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS line FROM documents),
    k AS (SELECT doc_id, md5(text) AS k FROM d UNION ALL SELECT doc_id, md5(line) FROM d WHERE length(line) >= 40),
    h AS (SELECT k, min(doc_id) AS hub FROM k GROUP BY k HAVING count(*) > 1),
    e AS (SELECT DISTINCT doc_id AS a, hub AS b FROM k JOIN h USING (k) WHERE doc_id <> hub),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a, a AS b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)
    SELECT a AS doc_id, min(b) AS component FROM r GROUP BY a"""


def leakage_split(spark, sf_dir):
    c = leakage_components(spark, sf_dir)
    return jobs.audited_split(c, "component", "seed7", 0.2).select("doc_id", "component", "split")


def round_robin_turns(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return jobs.round_robin(o, "o_orderpriority", F.lit("3-MEDIUM"), "o_orderkey").select("o_orderkey", F.col("turn").cast("long").alias("turn"))


def admission_window(spark, sf_dir):
    """Rows of the first eight customers by their first order."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first")).orderBy("first").limit(8)
    return o.join(F.broadcast(first), "o_custkey").select("o_custkey", "o_orderkey")


def dispatch_choice(spark, sf_dir):
    """Supplier (worker) takes the order (job) that aged, else of its nation, else the longest ready."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker_id"), (F.col("s_nationkey") % 5).alias("worker_model"), (F.col("s_suppkey") % 8).alias("queue"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 5).alias("model"), F.col("o_orderkey").alias("ready_at"), (F.col("o_totalprice") / 100).alias("wait_s"), (F.col("o_orderkey") % 8).alias("queue"))
    return jobs.dispatch_v1(s.join(jobs.first_jobs(o, "queue"), "queue")).select("worker_id", "job")


def qualification_matrix(spark, sf_dir):
    """Every model, concurrency, cache and device count; cells that can't run stay with their reason."""
    m = spark.createDataFrame([("small", 1), ("large", 4)], "model string, least int")
    c = spark.createDataFrame([(1,), (4,)], "concurrency int")
    p = spark.createDataFrame([(True,), (False,)], "prefix_cache boolean")
    g = spark.createDataFrame([(1,), (2,), (4,)], "devices int")
    reason = F.when(F.col("devices") < F.col("least"), "too_few_devices").when(F.col("prefix_cache") & (F.col("concurrency") == 1), "cache_needs_concurrency")
    return jobs.factorial(m, c, p, g).select("model", "concurrency", "prefix_cache", "devices", F.when(reason.isNull(), "planned").otherwise("blocked").alias("status"), reason.alias("reason"))


def oversubscription(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("resource"), F.col("l_orderkey").alias("holder"))
    return jobs.oversubscribed(l)


def claim_parents(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("claim"), F.when(F.col("event_id") % 50 == 0, F.lit(None)).when(F.col("event_id") % 60 == 7, F.col("event_id") + 1).when(F.col("event_id") % 60 == 8, F.col("event_id") - 1).when(F.col("event_id") == 33, F.lit(-33)).otherwise(F.col("event_id") - F.col("event_id") % 50).alias("parent"))
    return jobs.parent_errors(e).select("claim", "code")


def hash_shuffle(spark, sf_dir):
    """Rank of nations under a deterministic hash order."""
    n = read(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.row_number().over(Window.orderBy(F.sha2("n_name", 256))).alias("place"))


def performance_report(spark, sf_dir):
    """Operational report of events since a time: dispatched, returned and admitted, and rates an hour."""
    e = read(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    hours = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3_600_000_000
    r = e.agg(F.count_if(F.col("event_type") == "view").alias("dispatched"), F.count_if(F.col("event_type") == "click").alias("returned"), F.count_if(F.col("event_type") == "purchase").alias("admitted"), hours.alias("h"))
    return r.select("dispatched", "returned", "admitted", F.round(F.try_divide(F.col("admitted"), F.col("h")), 4).alias("admitted_per_hour"))


def page_context(spark, sf_dir):
    """Turns next to each user turn (one before to one after) in a conversation."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    a, b = c.filter("role = 'user'").alias("a"), c.alias("b")
    near = a.withColumn("near", F.explode(F.sequence(F.col("a.turn") - 1, F.col("a.turn") + 1)))
    return near.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("near") == F.col("b.turn"))).groupBy(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn")).agg(F.count("*").alias("context"))


QUERIES = {f.__name__: f for f in (tiered_match, uncovered_docs, support_rollup, decision_dedup, evidence_ids, grouped_availability, stage_status_pivot, job_plan, job_readiness, dag_waves, blocked_closure, leakage_components, leakage_split, round_robin_turns, admission_window, dispatch_choice, qualification_matrix, oversubscription, claim_parents, hash_shuffle, performance_report, page_context)}

_PLAN = """
    p AS (SELECT n_nationkey, 'classification' AS kind, NULL::VARCHAR AS segment, 0::BIGINT AS replicate, sha256('["c","' || n_nationkey || '"]') AS job, NULL::VARCHAR AS needs FROM nation
        UNION ALL SELECT n_nationkey, 'extraction', s, r, sha256('["e","' || n_nationkey || '","' || s || '","' || r || '"]'), sha256('["c","' || n_nationkey || '"]') FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer), (VALUES (1::BIGINT), (2::BIGINT)) AS v(r))"""

ORACLES = {
    "tiered_match": _MATCH,
    "uncovered_docs": "SELECT doc_id, source FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "support_rollup": """
        WITH u AS (SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS h FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
        SELECT lang, CAST(sum(n) AS BIGINT) AS decisions, CAST(sum(h) AS BIGINT) AS hits, round(sum(h) / sum(n), 6) AS pooled_rate, round(avg(h / n), 6) AS macro_rate FROM u GROUP BY lang""",
    "decision_dedup": """
        WITH o AS (SELECT *, o_custkey % 5 AS ev FROM orders),
        e AS (SELECT o_orderstatus, o_orderpriority, ev, min(o_orderkey) AS s FROM o GROUP BY ALL)
        SELECT m.o_orderstatus, m.o_orderpriority, m.mentions, x.evidence FROM (SELECT o_orderstatus, o_orderpriority, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS mentions FROM o GROUP BY ALL) m
        JOIN (SELECT o_orderstatus, o_orderpriority, string_agg(ev, ',' ORDER BY s) AS evidence FROM e GROUP BY ALL) x USING (o_orderstatus, o_orderpriority)""",
    "evidence_ids": "SELECT event_type, printf('e%04d', row_number() OVER (ORDER BY min(event_id))) AS evidence_id FROM events GROUP BY event_type",
    "grouped_availability": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS grain FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "stage_status_pivot": """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
    "job_plan": f"WITH {_PLAN} SELECT * FROM p",
    "job_readiness": f"""WITH {_PLAN}, s AS (SELECT *, CASE WHEN kind = 'extraction' THEN 'pending' WHEN n_nationkey % 4 = 0 THEN 'done' WHEN n_nationkey % 4 = 1 THEN 'failed' ELSE 'pending' END AS status FROM p)
        SELECT status, CASE WHEN status <> 'pending' THEN status WHEN kind = 'classification' THEN 'ready' WHEN n_nationkey % 4 = 1 THEN 'blocked' WHEN n_nationkey % 4 = 0 THEN 'ready' ELSE 'waiting' END AS state, count(*) AS jobs FROM s GROUP BY ALL""",
    "dag_waves": f"""WITH RECURSIVE {_EDGES}, v AS (SELECT job FROM e UNION SELECT needs FROM e),
        l AS (SELECT job, 0 AS level FROM v WHERE job NOT IN (SELECT job FROM e) UNION SELECT e.job, level + 1 FROM l JOIN e ON e.needs = l.job)
        SELECT level, count(*) AS jobs FROM (SELECT v.job, coalesce(max(level), -1) AS level FROM v LEFT JOIN l ON l.job = v.job GROUP BY v.job) GROUP BY level""",
    "blocked_closure": f"WITH RECURSIVE {_EDGES}, b AS (SELECT job FROM e WHERE needs IN ('r1', 'n3') UNION SELECT e.job FROM b JOIN e ON e.needs = b.job) SELECT job FROM b",
    "leakage_components": _COMPONENTS,
    "leakage_split": f"""WITH m AS ({_COMPONENTS}), c AS (SELECT component, row_number() OVER (ORDER BY sha256('seed7|' || component)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT component FROM m))
        SELECT doc_id, component, CASE WHEN n > 1 AND r <= greatest(1, round(n * 0.2)) THEN 'audit' ELSE 'open' END AS split FROM m JOIN c USING (component)""",
    "round_robin_turns": """
        WITH o AS (SELECT o_orderkey, o_orderpriority FROM orders), p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderpriority FROM o)),
        s AS (SELECT coalesce(max(r) + 1, 0) AS s FROM p WHERE o_orderpriority = '3-MEDIUM')
        SELECT o_orderkey, CAST((r - s + n) % n AS BIGINT) AS turn FROM o JOIN p USING (o_orderpriority), s""",
    "admission_window": "WITH f AS (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY 1 ORDER BY f LIMIT 8) SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM f)",
    "dispatch_choice": """
        SELECT s_suppkey AS worker_id, o_orderkey AS job FROM supplier JOIN orders ON s_suppkey % 8 = o_orderkey % 8
        QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY o_totalprice / 100 < 1800, o_custkey % 5 <> s_nationkey % 5, o_orderkey) = 1""",
    "qualification_matrix": """
        WITH x AS (SELECT model, concurrency, prefix_cache, devices, CASE WHEN devices < least THEN 'too_few_devices' WHEN prefix_cache AND concurrency = 1 THEN 'cache_needs_concurrency' END AS reason
            FROM (VALUES ('small', 1), ('large', 4)) AS m(model, least), (VALUES (1), (4)) AS c(concurrency), (VALUES (true), (false)) AS p(prefix_cache), (VALUES (1), (2), (4)) AS g(devices))
        SELECT model, concurrency, prefix_cache, devices, CASE WHEN reason IS NULL THEN 'planned' ELSE 'blocked' END AS status, reason FROM x""",
    "oversubscription": "SELECT l_suppkey AS resource, count(DISTINCT l_orderkey) AS holders FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1",
    "claim_parents": "SELECT event_id AS claim, 'cycle' AS code FROM events WHERE event_id % 60 IN (7, 8) AND event_id % 50 <> 0 UNION ALL SELECT event_id, 'missing_parent' FROM events WHERE event_id = 33",
    "hash_shuffle": "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY sha256(n_name)) AS INTEGER) AS place FROM nation",
    "performance_report": """
        WITH r AS (SELECT count(*) FILTER (WHERE event_type = 'view') AS dispatched, count(*) FILTER (WHERE event_type = 'click') AS returned, count(*) FILTER (WHERE event_type = 'purchase') AS admitted, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000 AS h FROM events WHERE ts >= TIMESTAMP '2024-01-10')
        SELECT dispatched, returned, admitted, round(admitted / h, 4) AS admitted_per_hour FROM r""",
    "page_context": "SELECT a.conv_id, a.turn, count(*) AS context FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 1 WHERE a.role = 'user' GROUP BY ALL",
}
