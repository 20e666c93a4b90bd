"""Facts, digests, windows, quotes, spans and ordered operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import canon, names, text
from ..operators import ordered
from .base import read


def facts_eav(spark, sf_dir):
    """First 200 nations by key as facts: one row a cell, with its categories, basis and coverage."""
    n = read(spark, sf_dir, "nation").withColumn("row", F.row_number().over(Window.orderBy("n_nationkey"))).filter("row <= 200")
    cells = n.select("row", F.inline(F.array(*[F.struct(F.lit(i).alias("col"), F.lit(c).alias("subject"), F.col(c).cast("string").alias("value")) for i, c in enumerate(("n_nationkey", "n_name", "n_regionkey"))])))
    ordinal = F.row_number().over(Window.orderBy("row", "col"))
    return cells.select(F.format_string("nation:f%05d", ordinal).alias("fact_id"), F.concat("subject", F.lit("["), F.col("row").cast("string"), F.lit("]")).alias("subject_id"), F.lit("observed_value").alias("predicate"), "value", F.when(F.col("subject") == "n_name", "value|syntax").otherwise("value|encoding").alias("categories"), F.lit("observed").alias("basis"))


_FACTS = """
    SELECT printf('nation:f%05d', row_number() OVER (ORDER BY r, c)) AS fact_id, s || '[' || r || ']' AS subject_id, 'observed_value' AS predicate, v AS value,
        CASE WHEN s = 'n_name' THEN 'value|syntax' ELSE 'value|encoding' END AS categories, 'observed' AS basis
    FROM (SELECT r, 0 AS c, 'n_nationkey' AS s, CAST(n_nationkey AS VARCHAR) AS v FROM n UNION ALL SELECT r, 1, 'n_name', n_name FROM n UNION ALL SELECT r, 2, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM n)"""
_FACTS = "WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation)" + _FACTS


def category_counts(spark, sf_dir):
    f = facts_eav(spark, sf_dir).select("fact_id", F.explode(F.split("categories", "\\|")).alias("category"))
    by = f.groupBy("category").agg(F.count("*").alias("facts"))
    return by.unionByName(f.agg(F.lit("all").alias("category"), F.count_distinct("fact_id").alias("facts")))


def evidence_join(spark, sf_dir):
    """Facts and their evidence; evidence that is missing is reported, not dropped."""
    facts = read(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.col("doc_id"), F.col("doc_id") + 1)).alias("evidence_id"))
    evidence = read(spark, sf_dir, "documents").filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("evidence_id"), "source")
    return facts.join(evidence, "evidence_id", "left").select("doc_id", "evidence_id", "source", F.col("source").isNull().alias("missing_evidence"))


def row_digest(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", canon.row_digest({c: F.col(c) for c in ("n_nationkey", "n_name", "n_regionkey")}).alias("sha256"))


def hash_chain(spark, sf_dir):
    """Each user's events as a chain: the digest an event stores of its predecessor must be that event's own."""
    e = read(spark, sf_dir, "events")
    sha = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    stored = F.when(F.col("event_id") % 97 == 0, F.lit("broken")).otherwise(F.coalesce(F.lag(sha).over(w), F.lit("start")))
    x = e.select("user_id", "ts", "event_id", sha.alias("sha"), stored.alias("prev_sha"))
    ok = F.col("prev_sha") == F.coalesce(F.lag("sha").over(w), F.lit("start"))
    return x.withColumn("ok", ok).groupBy("user_id").agg(F.count("*").alias("links"), F.count_if(~F.col("ok")).alias("broken"))


def duplicate_texts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return d.filter("copies > 1")


def replay_diff(spark, sf_dir):
    """Profile of orders by status twice; nothing may differ either way."""
    o = read(spark, sf_dir, "orders")
    a = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("m"))
    b = o.repartition(7, "o_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("m"))
    return a.exceptAll(b).agg(F.lit("missing").alias("side"), F.count("*").alias("rows")).union(b.exceptAll(a).agg(F.lit("extra"), F.count("*")))


def set_reconciliation(spark, sf_dir):
    """Planned members (documents) against actual ones (labels and strays): missing, extra, duplicate."""
    planned = read(spark, sf_dir, "documents").select("doc_id").filter("doc_id % 2 = 0")
    actual = read(spark, sf_dir, "labels").select("doc_id").union(read(spark, sf_dir, "labels").filter("doc_id % 10 = 0").select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("times"))
    j = planned.withColumn("p", F.lit(True)).join(actual, "doc_id", "full_outer")
    status = F.when(F.col("times").isNull(), "missing").when(F.col("p").isNull(), "extra").when(F.col("times") > 1, "duplicate").otherwise("matched")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("members"))


def text_windows(spark, sf_dir):
    w = text.windows(read(spark, sf_dir, "documents"), "doc_id", "text")
    return w.select("doc_id", "window", "start", "end", F.sha2("text", 256).alias("sha256"))


_WINDOWS = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, 0 AS "window", 0 AS "start", text AS rest FROM documents WHERE length(text) > 0
        UNION ALL
        SELECT doc_id, "window" + 1, "start" + n, substr(rest, n + 1) FROM (
            SELECT doc_id, "window", "start", rest, CASE WHEN length(rest) <= 240 THEN length(rest)
                WHEN strpos(substr(rest, 121, 120), chr(10)) > 0 THEN 240 - strpos(reverse(substr(rest, 121, 120)), chr(10)) + 1
                WHEN regexp_matches(substr(rest, 121, 120), '\s') THEN 240 - length(regexp_extract(substr(rest, 121, 120), '[^\s]*$'))
                ELSE 240 END AS n FROM w)
        WHERE length(rest) > n
    )
    SELECT doc_id, "window", "start", "start" + n AS "end", sha256(substr(rest, 1, n)) AS sha256 FROM (
        SELECT *, CASE WHEN length(rest) <= 240 THEN length(rest)
                WHEN strpos(substr(rest, 121, 120), chr(10)) > 0 THEN 240 - strpos(reverse(substr(rest, 121, 120)), chr(10)) + 1
                WHEN regexp_matches(substr(rest, 121, 120), '\s') THEN 240 - length(regexp_extract(substr(rest, 121, 120), '[^\s]*$'))
                ELSE 240 END AS n FROM w)"""


def quote_options(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(text.quote_options(F.col("text"))).alias("place", "quote")).select("conv_id", "turn", "place", F.md5("quote").alias("quote_md5"))


def quote_spans(spark, sf_dir):
    """First words of each document as quotes of its own text."""
    d = read(spark, sf_dir, "documents")
    quotes = d.select(F.col("doc_id").alias("quote_id"), F.when(F.col("doc_id") % 50 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("unit_id"), F.when(F.col("doc_id") % 11 == 0, "no such words").otherwise(F.substring("text", 1, 12)).alias("quote"))
    return text.quote_status(d.select(F.col("doc_id").alias("unit_id"), "text"), quotes)


_QUOTES = """
    WITH q AS (SELECT doc_id AS quote_id, CASE WHEN doc_id % 50 = 0 THEN -doc_id - 1 ELSE doc_id END AS unit_id, CASE WHEN doc_id % 11 = 0 THEN 'no such words' ELSE substr(text, 1, 12) END AS quote FROM documents),
    j AS (SELECT q.*, d.text, d.doc_id AS u, (strpos(d.text, quote) > 0)::INT + (strpos(d.text, quote) > 0 AND strpos(substr(d.text, CAST(strpos(d.text, quote) + 1 AS INTEGER)), quote) > 0)::INT AS n FROM q LEFT JOIN documents d ON d.doc_id = q.unit_id)
    SELECT quote_id, unit_id, CASE WHEN u IS NULL THEN 'unit_not_found' WHEN n = 0 THEN 'quote_not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status,
        CASE WHEN n = 1 THEN CAST(strpos(text, quote) - 1 AS INTEGER) END AS "start", CASE WHEN n = 1 THEN CAST(strpos(text, quote) - 1 + length(quote) AS INTEGER) END AS "end" FROM j"""


def reading_spans(spark, sf_dir):
    return text.reading_spans(read(spark, sf_dir, "documents"), "source", "doc_id", "text")


def lexical_names(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", names.lexical(F.concat(F.lit("  "), F.col("p_name"), F.lit("_X-yZ"))).alias("lexical"), names.squeezed(F.col("p_name")).alias("squeezed"), F.array_join(F.array_sort(names.tokens(F.col("p_name"))), " ").alias("tokens"))


def greedy_groups(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").alias("chars"))
    g = ordered.greedy_groups(d, "source", "doc_id", "chars", 8, 12000)
    return g.groupBy("source", "group").agg(F.count("*").alias("members"), F.sum("chars").alias("chars"), F.min("doc_id").alias("first_doc"))


_GREEDY = """
    WITH RECURSIVE d AS (SELECT source, doc_id, n_chars AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE n_chars <= 12000),
    f AS (SELECT source, doc_id, c, r, 0::BIGINT AS g, 1 AS n, c AS t FROM d WHERE r = 1
        UNION ALL SELECT d.source, d.doc_id, d.c, d.r, CASE WHEN n >= 8 OR t + d.c > 12000 THEN g + 1 ELSE g END, CASE WHEN n >= 8 OR t + d.c > 12000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 8 OR t + d.c > 12000 THEN d.c ELSE t + d.c END
        FROM f JOIN d ON d.source = f.source AND d.r = f.r + 1)
    SELECT source, g AS "group", count(*) AS members, CAST(sum(c) AS BIGINT) AS chars, min(doc_id) AS first_doc FROM f GROUP BY source, g
    UNION ALL SELECT source, -1, count(*), CAST(sum(n_chars) AS BIGINT), min(doc_id) FROM documents WHERE n_chars > 12000 GROUP BY source"""


def asof_events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    buys = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    joined = e.filter("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("signup_id"))
    return ordered.as_of(buys, joined, ["user_id"], "ts", "signup_id").select("event_id", "user_id", "matched_signup_id")


def interval_overlap(spark, sf_dir):
    """Spans of orders' lines by ship week against spans by quantity, of one supplier: overlapping pairs."""
    l = read(spark, sf_dir, "lineitem")
    a = l.filter("l_linenumber = 1").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("a_id"), (F.col("l_orderkey") % 1000).alias("start"), (F.col("l_orderkey") % 1000 + F.col("l_quantity").cast("long")).alias("end"))
    b = l.filter("l_linenumber = 2").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("b_id"), (F.col("l_orderkey") % 900).alias("start"), (F.col("l_orderkey") % 900 + F.col("l_quantity").cast("long")).alias("end"))
    return ordered.overlaps(a, b, "key", 64).select(F.col("l.key").alias("key"), "a_id", "b_id")


_OVERLAP = """
    WITH l AS (SELECT * FROM lineitem),
    a AS (SELECT l_suppkey AS key, l_orderkey AS a_id, l_orderkey % 1000 AS s, l_orderkey % 1000 + CAST(l_quantity AS BIGINT) AS e FROM l WHERE l_linenumber = 1),
    b AS (SELECT l_suppkey AS key, l_orderkey AS b_id, l_orderkey % 900 AS s, l_orderkey % 900 + CAST(l_quantity AS BIGINT) AS e FROM l WHERE l_linenumber = 2)
    SELECT a.key, a_id, b_id FROM a JOIN b ON a.key = b.key AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e"""


def alignment_topk(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    n = ordered.nearest(s, s, "s_nationkey", "s_acctbal", "s_suppkey")
    return n.select("s_suppkey", "rank", F.col("near").alias("near_suppkey"))


def lane_streaks(spark, sf_dir):
    s = ordered.streaks(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return s.groupBy("user_id").agg(F.max("streak").alias("streaks"), F.max("place").cast("long").alias("longest"))


def session_pairs(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    s = ordered.sessions(e, ["user_id"], ["ts", "event_id"], "event_type", "signup", ["purchase", "error"], "ts")
    return s.select("user_id", "event_id", "ended_by", F.round("duration_s", 3).alias("duration_s"))


def rolling_budget(spark, sf_dir):
    e = read(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "ts", "event_id")
    r = ordered.trailing_count(e, ["user_id"], "ts", 3600)
    return r.select("user_id", "event_id", "in_window", (F.col("in_window") <= 2).alias("within_budget"))


def wait_percentiles(spark, sf_dir):
    return ordered.index_percentile(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


def line_islands(spark, sf_dir):
    """Runs of a user's events without a gap of more than six hours (recovered paragraphs, word segments)."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = ordered.seconds("ts") - F.lag(ordered.seconds("ts")).over(w) > 21600
    x = ordered.islands(e, ["user_id"], ["ts", "event_id"], gap)
    return x.groupBy("user_id", "island").agg(F.count("*").alias("events"), F.min("event_id").alias("least_id"))


def memory_sizes(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " GiB").when(F.col("p_partkey") % 3 == 1, " MB").otherwise(" lines")).alias("s"))
    return p.select("p_partkey", canon.memory_bytes(F.col("s")).alias("bytes"))


def json_pointers(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"a/b":['), "props", F.lit(',7],"m~n":"x"}')).alias("j"))
    get = lambda p: F.get_json_object("j", p)
    paths = [F.lit(p) for p in ("/a~1b/0/k", "/a~1b/1", "/m~0n", "/none")]
    made = e.select("event_id", *[F.expr("1").alias("one")], "j", *[canon.pointer_path(p).alias(f"p{i}") for i, p in enumerate(paths)])
    return made.select("event_id", F.col("p0").alias("path0"), get("$['a/b'][0]['k']").alias("v0"), get("$['a/b'][1]").alias("v1"), get("$['m~n']").alias("v2"), canon.pointer_escape(F.lit("a/b~c")).alias("escaped"))


def renamed_ids(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("v4-"), F.col("o_orderpriority")).alias("id"))
    return o.select("o_orderkey", F.when(F.col("id").startswith("v4-"), F.concat(F.lit("v5-"), F.substring("id", 4, 1000))).otherwise(F.concat(F.lit("v5-"), "id")).alias("id"))


def dictionary_roundtrip(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows, entries = text.dictionary_encode(d, "doc_id", "text")
    back = text.dictionary_decode(rows, entries, "doc_id", "text")
    same = back.join(d.withColumnRenamed("text", "want"), "doc_id").filter("text = want").agg(F.count("*").alias("restored"))
    return same.join(rows.agg(F.count("ref").alias("references"))).join(entries.agg(F.count("*").alias("entries")))


def similarity_pairs(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    j = b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1)
    return j.select(F.col("a.item_id").alias("left_id"), F.col("b.item_id").alias("right_id"), text.similarity(F.col("a.text"), F.col("b.text")).alias("ratio"))


QUERIES = {f.__name__: f for f in (facts_eav, category_counts, evidence_join, row_digest, hash_chain, duplicate_texts, replay_diff, set_reconciliation, text_windows, quote_options, quote_spans, reading_spans, lexical_names, greedy_groups, asof_events, interval_overlap, alignment_topk, lane_streaks, session_pairs, rolling_budget, wait_percentiles, line_islands, memory_sizes, json_pointers, renamed_ids, dictionary_roundtrip, similarity_pairs)}

_US = "epoch_us(ts)"
ORACLES = {
    "facts_eav": _FACTS,
    "category_counts": f"WITH f AS ({_FACTS}) SELECT category, facts FROM (SELECT unnest(string_split(categories, '|')) AS category, count(*) AS facts FROM f GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT fact_id) FROM f)",
    "evidence_join": "WITH f AS (SELECT doc_id, unnest([doc_id, doc_id + 1]) AS evidence_id FROM labels) SELECT f.doc_id, f.evidence_id, d.source, d.source IS NULL AS missing_evidence FROM f LEFT JOIN documents d ON d.doc_id = f.evidence_id AND d.doc_id % 7 <> 0",
    "row_digest": """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS sha256 FROM nation""",
    "hash_chain": "SELECT user_id, count(*) AS links, count(*) FILTER (WHERE event_id % 97 = 0) AS broken FROM events GROUP BY user_id",
    "duplicate_texts": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1",
    "replay_diff": "SELECT * FROM (VALUES ('missing', 0::BIGINT), ('extra', 0::BIGINT)) AS t(side, rows)",
    "set_reconciliation": """
        WITH p AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), a AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS t FROM labels)
        SELECT CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN p.doc_id IS NULL THEN 'extra' WHEN t > 1 THEN 'duplicate' ELSE 'matched' END AS status, count(*) AS members FROM p FULL JOIN a ON p.doc_id = a.doc_id GROUP BY 1""",
    "text_windows": _WINDOWS,
    "quote_options": """
        WITH o AS (SELECT conv_id, turn, [text, regexp_replace(text, '^\\s+|\\s+$', '', 'g')] || flatten(list_transform(string_split_regex(text, '[\\n\\t]'), lambda p: [p, regexp_replace(p, '^\\s+|\\s+$', '', 'g')])) AS l FROM conversations),
        u AS (SELECT conv_id, turn, unnest(l) AS q, generate_subscripts(l, 1) AS i FROM o),
        f AS (SELECT conv_id, turn, q, min(i) AS i FROM u WHERE regexp_replace(q, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY ALL)
        SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS place, md5(q) AS quote_md5 FROM f""",
    "quote_spans": _QUOTES,
    "reading_spans": "SELECT source, doc_id, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS char_end FROM documents",
    "lexical_names": r"""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace('  ' || p_name || '_X-yZ', '([a-z])([A-Z])', '\1 \2', 'g'), '[\s_\-]+', ' ', 'g'))) AS lexical,
        lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) AS squeezed, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: t <> ''))), ' ') AS tokens FROM part""",
    "greedy_groups": _GREEDY,
    "asof_events": """
        WITH s AS (SELECT user_id, ts, max(event_id) AS signup_id FROM events WHERE event_type = 'signup' GROUP BY ALL)
        SELECT p.event_id, p.user_id, s.signup_id AS matched_signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts""",
    "interval_overlap": _OVERLAP,
    "alignment_topk": """
        SELECT a.s_suppkey, CAST(row_number() OVER w AS INTEGER) AS rank, b.s_suppkey AS near_suppkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey
        WINDOW w AS (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) QUALIFY row_number() OVER w <= 2""",
    "lane_streaks": """
        WITH n AS (SELECT user_id, ts, event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM n), c AS (SELECT user_id, s, count(*) AS c FROM s GROUP BY ALL)
        SELECT user_id, CAST(max(s) AS BIGINT) AS streaks, max(c) AS longest FROM c GROUP BY user_id""",
    "session_pairs": """
        WITH x AS (SELECT user_id, ts, event_id, event_type, lead(event_type) OVER w AS k, lead(ts) OVER w AS t FROM events WHERE event_type IN ('signup','purchase','error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, event_id, CASE WHEN k <> 'signup' THEN k END AS ended_by, CASE WHEN k <> 'signup' THEN round((epoch_us(t) - epoch_us(ts)) / 1000000, 3) END AS duration_s FROM x WHERE event_type = 'signup'""",
    "rolling_budget": f"""
        WITH e AS (SELECT user_id, event_id, {_US} AS u FROM events WHERE event_type = 'error'),
        c AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY u RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM e)
        SELECT *, in_window <= 2 AS within_budget FROM c""",
    "wait_percentiles": """
        WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n, max(l_extendedprice) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)
        SELECT l_returnflag, v AS p95, m AS maximum, n AS count FROM r WHERE i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))""",
    "line_islands": f"""
        WITH n AS (SELECT user_id, ts, event_id, CASE WHEN lag({_US}) OVER w IS NULL OR ({_US} - lag({_US}) OVER w) / 1000000 > 21600 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM n)
        SELECT user_id, island, count(*) AS events, min(event_id) AS least_id FROM s GROUP BY ALL""",
    "memory_sizes": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::BIGINT * 1073741824 WHEN 1 THEN p_size::BIGINT * 1000000 END AS bytes FROM part",
    "json_pointers": """SELECT event_id, '$[''a/b''][0][''k'']' AS path0, CAST(json_extract(props, '$.k') AS VARCHAR) AS v0, '7' AS v1, 'x' AS v2, 'a~1b~0c' AS escaped FROM events""",
    "renamed_ids": "SELECT o_orderkey, 'v5-' || o_orderpriority AS id FROM orders",
    "dictionary_roundtrip": """
        WITH a AS (SELECT text, count(*) AS n FROM documents WHERE length(text) >= 20 GROUP BY text HAVING count(*) > 1)
        SELECT (SELECT count(*) FROM documents) AS restored, (SELECT CAST(sum(n) AS BIGINT) FROM a) AS "references", (SELECT count(*) FROM a) AS entries""",
}
