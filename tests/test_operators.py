"""Operators on small fixtures: types, text, layout, graphs, streams, validators, tampering."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import canon, text, typing
from tessera.operators import layout, matching, ordered, profile, temporal, validate
from tessera.plans import jobs
from tessera.queries import documents, health
from tessera.streaming import incidents, ledger, queue_health


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ([], "string"),
        (["", " "], "string"),
        (["007", "8"], "string"),
        (["-05"], "string"),
        (["20240101"], "datetime"),
        (["2024-01-01", "2024-01-02T03:04:05Z"], "datetime"),
        (["2024"], "int"),
        (["1", "-2"], "int"),
        (["1", "2.5", "1e3", "1_000.5"], "float"),
        (["nan"], "string"),
        (["2024-02-30"], "string"),
        (["a", "1"], "string"),
    ],
)
def test_physical_type(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert df.agg(typing.physical_type(F.col("v")).alias("t")).first().t == want


def test_profile_of_blanks(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "1"), ("a", "1")], "column_name string, value string")
    r = profile.column_profile(df).first()
    assert (r.rows, r.missing, r.distinct_values, r.unique_ratio, r.physical_type) == (4, 2, 1, 0.5, "int")


def test_segments_cover_every_code_point():
    for t in ("", "a" * 241, "x" * 119 + "\n" + "y" * 300, ("word " * 100), "😀" * 500, "a" * 120 + " " + "b" * 400):
        spans = text.segments(t)
        assert "".join(t[a:b] for a, b in spans) == t and all(b - a <= 240 for a, b in spans)
    assert text.segments("a" * 130 + "\n" + "b" * 200)[0] == (0, 131)


def test_text_helpers():
    assert text.collapse("  a \n b ") == ("a b", [2, 3, 6])
    assert text.surface_span("a b  ab", "ab", 2) == (5, 7)
    assert text.uncovered(["a", "b", "a"], [["a"]]) == [["b", "a"]]
    assert text.channels("<|channel|>final<|message|>hi<|end|>") == [("final", 27, 29)]
    assert text.render("x {{A}}", {"A": "1"}) == "x 1"
    with pytest.raises(ValueError):
        text.render("{{A}}{{A}}", {"A": "1"})
    assert text.parse_response('```json\n{"a":1}\n```') == {"a": 1}
    with pytest.raises(ValueError):
        text.parse_response('{"a":1,"a":2}')


def test_seal_detects_tampering():
    s = canon.seal({"b": 1, "a": "ä"})
    assert canon.seal_errors(s) == [] and canon.seal_errors({**s, "b": 2}) == ["sha256_mismatch"]
    assert canon.canonical({"b": 1, "a": None}) == '{"a":null,"b":1}'


def test_row_canonical_is_python_json(spark):
    df = spark.createDataFrame([(1, 'q"\\\n', None)], "b long, a string, c string")
    r = df.select(canon.row_canonical({c: F.col(c) for c in df.columns}).alias("j")).first().j
    assert r == canon.canonical({"a": 'q"\\\n', "b": 1, "c": None})


def words(lines, x=50.0, step=60.0):
    rows, i = [], 0
    for top, ws in lines:
        for k, w in enumerate(ws):
            rows.append(("p", 1, i, w, x + k * step, float(top), x + k * step + 40, top + 10.0))
            i += 1
    return rows


def test_layout_table_and_partition(spark):
    lines = [(20, ["Head"]), (100, "some body text here".split()), (130, "Table 1. Values".split()), (145, ["Name", "Min", "Max"]), (160, ["Area", "1", "2"]), (175, ["Len", "3", "4"]), (230, "after the table".split()), (770, ["9"])]
    df = spark.createDataFrame(words(lines), "paper_id string, page long, word_index long, text string, x0 double, top double, x1 double, bottom double")
    r = layout.regions(df)
    kinds = [x.region_kind for x in r.orderBy("reading_order").collect()]
    assert kinds == ["header", "text", "caption", "table", "text", "footer"]
    assert layout.partition_audit(df, r).count() == 0
    lost = r.filter("region_kind <> 'table'")
    assert layout.partition_audit(df, lost).count() == 9 and "Area" in layout.recovered(df, lost).first().text
    u = layout.units(r).orderBy("unit_ordinal").collect()
    assert u[1].char_start == u[0].char_end + 2
    assert layout.table_rows([[dict(text=w, x0=50.0 + 60 * k, x1=90.0 + 60 * k) for k, w in enumerate(ws)] for ws in (["Name", "Min"], ["Area", "1"])])[1] == [["Name", "Min"], ["Area", "1"]]
    assert layout.region_mapping(r, r).filter("left_id <> right_id").count() == 0 and layout.box_overlaps(r, r).count() >= 6


def test_pages_at_once_are_pages_word_by_word(spark):
    r = random.Random(5)
    made = []
    for p in range(60):
        two, step, y, own = p % 2, r.choice([0.3, 2.4, 2.5, 5, 15]), r.uniform(0, 200), []
        for i in range(r.choice([1, 30, 100, 320])):
            y += step * r.choice([0, 0, 0, 0, 0, 0, 1, 2])
            x = r.choice([50, 330]) + i % 8 * 30 if two else r.uniform(0, 600)
            top = y + r.choice([0, 0, 0.5, -0.7, 1.25]) if p % 5 else r.uniform(0, 792)
            own.append((f"d{p}", p, i, "Table 1" if p % 7 == 0 and i % 50 == 0 else f"w{i}", float(x), float(top), float(x + r.choice([20, 25, 60])), float(top + r.choice([3, 10, 40]))))
        made.append(own)
    names = "paper_id page word_index text x0 top x1 bottom".split()
    df = spark.createDataFrame([w for own in made for w in own], "paper_id string, page long, word_index long, text string, x0 double, top double, x1 double, bottom double")
    want = {(f"d{p}", i): (kind, lane, [w["word_index"] for w in ws], " ".join(w["text"] for w in ws), min(w["x0"] for w in ws), max(w["bottom"] for w in ws)) for p, own in enumerate(made) for i, (kind, lane, ws) in enumerate(layout.page_regions([dict(zip(names, w, strict=True)) for w in own], 612.0, 792.0))}
    got = {(x.paper_id, x.reading_order): (x.region_kind, x.lane, x.word_indexes, x.text, x.x0, x.bottom) for x in layout.regions(df).collect()}
    assert got == want and {k[0] for k in want.values()} >= {"header", "text", "footer"}
    laid = layout.laid_out(layout.paged(df))
    audit = layout.page_audit(laid)
    found = laid.select("paper_id", "page", F.inline("regions"))
    rejected = {x.paper_id: x.n for x in layout.partition_audit(df, found).groupBy("paper_id").agg(F.count("*").alias("n")).collect()}
    assert {x.paper_id: x.violations for x in audit.collect() if x.violations} == rejected and rejected
    lost = laid.withColumn("regions", F.slice("regions", 1, F.greatest(F.size("regions") - 1, F.lit(0))))
    n = layout.partition_audit(df, lost.select("paper_id", "page", F.inline("regions"))).count()
    assert layout.page_audit(lost).agg(F.sum("violations")).first()[0] == n > len(rejected)


def test_layout_reads_documents_once_and_keeps_words_in_their_task(spark):
    q = documents.layout_partition(spark, "/root/testdata/sf0.001")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "FlatMapGroups" not in plan and "Join" not in plan
    assert q.first().violations == 0


def test_nearest_is_every_pair_ranked(spark):
    r, nan, inf = random.Random(3), float("nan"), float("inf")
    odd = [None, nan, inf, -inf, 1e17, 1e-9, 2e-9, 0.0]
    a, b = ([(i + start, r.choice("xy"), r.choice(odd) if r.random() < 0.2 else round(r.uniform(0, 9), 1)) for i in range(90)] for start in (0, 45))

    def gap(v, w):
        if v is None or w is None:
            return (2, 0.0)
        return (1, 0.0) if abs(v - w) != abs(v - w) else (0, abs(v - w))

    df = [spark.createDataFrame(x, "id long, k string, v double") for x in (a, b)]
    for n in (1, 3):
        want = sorted((k, i, q + 1, o) for i, k, v in a for q, (_, o) in enumerate(sorted((gap(v, w), o) for o, kk, w in b if kk == k and o != i)[:n]))
        assert sorted(map(tuple, ordered.nearest(*df, "k", "v", "id", n).collect())) == want


def test_nearest_of_one_key_makes_no_pairs(spark):
    df = spark.range(60000).select("id", F.lit(1).alias("k"), (F.col("id") % 50000 * 0.5).alias("v"))
    x = ordered.nearest(df, df, "k", "v", "id")
    assert x.count() == 120000
    assert x.filter("id = 7").orderBy("rank").select("near").collect() == [(50007,), (6,)]


def test_watchdog_looks_only_are_in_one_order(spark):
    r = random.Random(9)
    looks = sorted(r.sample(range(400), 60))
    rows = [(at, kind, scope, "warning", hold) for kind, hold in (("slow", 0), ("low", 20)) for scope in "abc" for at in looks if r.random() < 0.4]
    found = spark.createDataFrame(rows, "at long, kind string, scope string, severity string, hold_s int")
    ticks = spark.createDataFrame([(t,) for t in looks], "at long")
    for recovery in (1, 25):
        want = []
        for key in sorted({x[1:3] for x in rows}):
            state, own = None, {x[0]: x for x in rows if x[1:3] == key}
            for at in looks:
                x = own.get(at)
                state, event = queue_health.step(state, float(at), x and x[3], float(x[4]) if x else 0.0, recovery=recovery)
                want += [(*key, float(at), *event)] if event else []
        got = queue_health.incidents(ticks, found, recovery)
        assert sorted(tuple(x)[:6] for x in got.collect()) == sorted(want) and want
        plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
        one = [i for i, line in enumerate(plan) if "SinglePartition" in line]
        assert one and not any("scope" in line for i in one for line in plan[i : i + 4])


def test_watchdog_gathers_no_workers(spark):
    w = "at long, worker_id string, job_id long, phase string, heartbeat_at long, progress_at long, compatible_ready_jobs long, dependency_wait_jobs long, reserve_bytes int, gpus array<struct<utilization_pct:double,total_bytes:int,used_bytes:int>>, eligible_idle boolean"
    gpu = lambda use, used=0: [(float(use), 100, used)]
    workers = [
        # fresh: a's GPU is busy and full, b waits for others and counts for nothing, c is idle, d is lost
        (1000, "a", 1, "decoding", 990, 990, 0, 0, 10, gpu(90, 95), False),
        (1000, "b", None, "other", 990, 990, 0, 2, 10, gpu(0), True),
        (1000, "c", None, "other", 990, 990, 1, 2, 10, gpu(20), True),
        (1000, "d", 2, "loading", 900, 900, 0, 0, 10, gpu(0), False),
        # stale: nothing of the queue counts, but of its workers
        (2000, "a", 1, "decoding", 1990, 1600, 0, 0, 10, gpu(90), False),
        (2000, "b", None, "other", 1990, 1990, 0, 2, 10, gpu(0), True),
        # only one that waits is idle; none is far from another without it
        (3000, "a", 1, "prefill", 2990, 2990, 0, 0, 10, gpu(90), False),
        (3000, "b", None, "other", 2990, 2990, 0, 2, 10, gpu(0), True),
        # over
        (4000, "d", 2, "loading", 900, 900, 0, 0, 10, gpu(0), False),
    ]
    snapshots = [(1000, 1000, False, False, 1, 1801), (2000, 1000, False, None, 1, 5000), (3000, 3000, False, True, 1, 0), (4000, 0, True, True, 1, 5000), (5000, 5000, False, False, 1, 1801)]
    q = queue_health.observations(spark.createDataFrame(snapshots, "at long, time long, terminal boolean, coordinator_failed boolean, ready_jobs int, oldest_ready_wait_s int"), spark.createDataFrame(workers, w))
    assert sorted((x.at, x.kind, x.scope) for x in q.collect()) == [
        (1000, "allocation_imbalance", "queue"),
        (1000, "gpu_headroom_low", "a"),
        (1000, "ready_queue_overdue", "queue"),
        (1000, "sustained_utilization_skew", "queue"),
        (1000, "worker_heartbeat_lost", "d"),
        (2000, "scheduler_heartbeat_lost", "scheduler"),
        (2000, "worker_no_progress", "a"),
        (3000, "coordinator_failed", "scheduler"),
        (5000, "ready_queue_overdue", "queue"),
    ]
    assert "collect_list" not in health.queue_incidents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_captions_rules_gutter():
    for text in ("Table 2. Values", "Table 2a. Features", "Table3 Sensors", "Table 1. In situ sensors", "TABLE 7", "Table 4: of interest"):
        assert layout.is_caption(text), text
    for text in ("Table 2 shows values", "Table 2 and Table 3", "Table 1 provides values", "Table 1 describes", "Table 2. Values.", "Table 3) is", "A Table 1", "Table 1 also here", "Tables 3"):
        assert not layout.is_caption(text), text
    assert layout.merge_rules([(1.0, 0.0, 5.0), (1.5, 6.0, 9.0), (9.0, 0.0, 1.0)]) == [(1.0, 0.0, 9.0), (9.0, 0.0, 1.0)]
    ws = [dict(x0=50.0, x1=250.0)] * 12 + [dict(x0=330.0, x1=550.0)] * 12
    assert 250 <= layout.gutter(ws, 612.0) <= 330 and layout.gutter(ws[:12], 612.0) is None


def test_html_grid():
    assert layout.html_grid("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == ("", [(0, 0, "a"), (0, 1, "b"), (1, 1, "c")])
    assert layout.html_grid("<table><tr><td><table></table></td></tr></table>")[0] == "nested_table"
    assert layout.html_grid("<table><tr><td rowspan=0>a</td></tr></table>")[0] == "invalid_span"


def test_waves_cycles_and_blocked(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "job string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "d")], "job string, needs string")
    got = {r.job: r.level for r in jobs.waves(nodes, edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": -1, "e": -1, "f": -1}
    assert {r.job for r in jobs.blocked(nodes.filter("job = 'a'"), edges).collect()} == {"b", "c"}


def test_deep_graphs_are_settled(spark):
    n = 104
    nodes = spark.createDataFrame([(i,) for i in range(n)], "job int")
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, n)], "job int, needs int")
    assert {r.job: r.level for r in jobs.waves(nodes, edges).collect()} == {i: i for i in range(n)}
    assert {r.job for r in jobs.blocked(nodes.filter("job = 0"), edges).collect()} == set(range(1, n))


def test_long_claim_chain_is_no_cycle(spark):
    claims = spark.createDataFrame([(i, i - 1 if i else None) for i in range(68)] + [(100, 101), (101, 100), (200, 999)], "claim int, parent int")
    assert sorted(map(tuple, jobs.parent_errors(claims).collect())) == [(100, "cycle"), (101, "cycle"), (200, "missing_parent")]


def test_components_of_a_long_path(spark):
    # numbers fall along the path, so that labels take one step a round
    ids = [0, *range(60, 0, -1)]
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a int, b int")
    assert {(r.node, r.root) for r in matching.min_label_components(edges, "a", "b").collect()} == {(i, 0) for i in ids}



def test_json_paths_of_any_depth(spark):
    deep = '{"a":' * 9 + "[1]" + "}" * 9
    got = profile.json_paths(spark.createDataFrame([(1, deep), (2, "[null]")], "r int, t string"), "r", "t").collect()
    want = [(1, "$" + ".a" * i, "object" if i < 9 else "array") for i in range(10)] + [(1, "$" + ".a" * 9 + "[]", "integer"), (2, "$", "array"), (2, "$[]", "null")]
    assert sorted(map(tuple, got)) == sorted(want)


def test_dispatch_lanes():
    c, e = [{"ready_at": 0}], [{"ready_at": 0}]
    assert jobs.lane_choice({}, c, e, 10) == "extraction" and jobs.lane_choice({}, c, e, 1800) == "classification"
    assert jobs.lane_choice({"last_lane": "extraction", "lane_streak": 3}, c, e, 10) == "classification"
    assert jobs.lane_choice({"last_lane": "classification", "lane_streak": 2}, c, e, 1800) == "extraction"
    pick = jobs.dispatch_v2([{"job": 1, "group": 1, "lane": "extraction", "paper": "p", "ready_at": 0, "order": 0}, {"job": 2, "group": 1, "lane": "extraction", "paper": "q", "ready_at": 0, "order": 1}], {"last_extraction_paper": "p"}, 5)
    assert pick["job"] == 2


def test_tiers_cascade(spark):
    labels = spark.createDataFrame([(1, "Area"), (2, "area"), (3, "x")], "label_id int, label string")
    cat = spark.createDataFrame([(10, "Area"), (11, "area_"), (12, "AREA")], "object_id int, name string")
    got = {r.label_id: r for r in matching.tiered_match(labels, cat, [("exact", F.col("label"), F.col("name")), ("lexical", F.lower("label"), F.lower("name"))]).collect()}
    assert got[1].object_id == 10 and got[2].reason == "ambiguous_scope_or_name" and got[3].reason == "no_supported_mapping"


def test_greedy_groups_oversize(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate([5, 6, 99, 4, 4, 4])], "k string, o int, s int")
    got = [r.group for r in ordered.greedy_groups(df, "k", "o", "s", 2, 10).orderBy("o").collect()]
    assert got == [0, 1, -1, 1, 2, 2]


def test_overlaps_report_each_pair_once(spark):
    a = spark.createDataFrame([("k", 0, 300, "a")], "key string, start long, end long, a string")
    b = spark.createDataFrame([("k", 10, 290, "b"), ("k", 300, 310, "c")], "key string, start long, end long, b string")
    assert ordered.overlaps(a, b, "key", 16).count() == 1


def test_incident_machine():
    s, e = incidents.step(None, 0, "warning")
    assert e == ("open", "warning", 1)
    s, e = incidents.step(s, 10, "critical")
    assert e == ("reminder", "critical", 1)
    s, e = incidents.step(s, 20, "critical")
    assert e is None
    s, e = incidents.step(s, 1810, "critical")
    assert e == ("reminder", "critical", 1)
    s, e = incidents.step(s, 1900, None)
    assert e == ("recovered", "info", 1)
    s, e = incidents.step(s, 2000, "warning")
    assert e == ("open", "warning", 2)
    with pytest.raises(ValueError):
        incidents.policy({"heartbeat_s": -1})


def test_stream_equals_batch(spark, tmp_path):
    rows = [("k", "s", float(t), v) for t, v in ((0, "warning"), (10, "critical"), (20, None), (30, "warning"))]
    schema = "kind string, scope string, at double, severity string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    want = sorted(r.event_id for r in incidents.transitions(spark.createDataFrame(rows, schema)).collect())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = incidents.stream_transitions(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(incidents.outbox_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want
    incidents.outbox_sink(str(tmp_path / "out"))(spark.createDataFrame(spark.read.parquet(str(tmp_path / "out")).toPandas(), incidents.OUT), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)


def test_chain_detects_tampering(spark):
    e = spark.createDataFrame([("u", i, f"k{i}") for i in range(5)], "u string, i int, k string")
    c = ledger.chained(e, "u", ["i"], ["i", "k"])
    assert ledger.chain_errors(c, "u").count() == 0
    bad = c.withColumn("sha", F.when(F.col("i") == 2, F.lit("x")).otherwise(F.col("sha")))
    assert [r.i for r in ledger.chain_errors(bad, "u").collect()] == [3]


def test_all_or_nothing_admission(spark):
    groups = spark.createDataFrame([("a",), ("b",)], "group_id string")
    v = spark.createDataFrame([("a", "x"), ("a", "y")], "subject string, code string")
    got = {r.group_id: r.admission for r in validate.admitted(groups, v, "group_id").collect()}
    assert got == {"a": "excluded", "b": "admitted"}


def test_timezone_abstains(spark):
    df = spark.createDataFrame([("a", "2024-01-01T00:00:00Z"), ("a", "2024-01-01T00:00:00"), ("b", None)], "k string, t string")
    got = {r.k: (r.timezone, r.state) for r in temporal.timezone_claim(df, "k", "t").collect()}
    assert got == {"a": ("unknown", "conflicted"), "b": ("unknown", "unknown")}


def test_budget_blocks_unknown(spark):
    df = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "request_id int, input_tokens int")
    assert [r.state for r in validate.budget(df, 100, 5).orderBy("request_id").collect()] == ["admitted", "blocked_over_context", "blocked_unknown_count"]


def test_cf_roles_and_dimensions(spark):
    from tessera.functions import cf

    df = spark.createDataFrame([("lat", ["lat"], "Y", "latitude", "degrees_north"), ("lon", ["lat"], "Y", "longitude", ""), ("v", ["lat"], None, None, None)], "name string, dims array<string>, axis string, standard string, units string")
    got = {r.name: r for r in df.select("name", cf.coordinate_roles(F.col("name"), F.col("dims"), F.col("axis"), F.col("standard"), F.col("units"), F.array(F.lit("lat")), F.array(F.lit("v"))).alias("r"), cf.cf_semantic(F.col("standard"), F.col("axis"), F.col("units"), F.lit(None)).alias("s")).collect()}
    assert got["lat"].r.roles == ["dimension_coordinate", "axis_y", "standard_latitude", "geospatial_coordinate"] and got["lat"].r.state == "supported"
    assert got["lon"].r.state == "conflicted" and got["v"].r.roles == ["auxiliary_coordinate"] and got["lat"].s == "latitude"
    a = spark.createDataFrame([("g/a", ["x", "y"], [2, 3], "lon q"), ("g/lon", ["x"], [4], None), ("g/b", None, [1], None)], "array string, dimensions array<string>, shape array<long>, coordinates string")
    states = {r["array"]: r.c.state for r in a.select("array", cf.dimension_claim(F.col("dimensions"), F.size("shape")).alias("c")).collect()}
    assert states == {"g/a": "supported", "g/lon": "supported", "g/b": "unknown"}
    assert {r.dimension: r.state for r in cf.dimension_sizes(a).collect()} == {"x": "conflicted", "y": "supported"}
    assert {r.name: r.found for r in cf.auxiliary_coordinates(a).collect()} == {"lon": True, "q": False}
    assert spark.range(1).select(cf.seconds_of(F.lit("1970-01-01T00:01:00Z")).alias("s")).first().s == 60.0


def test_alignment_uses_each_unit_once():
    units = [{"id": "u1", "text": "Mean value", "role": "text", "box": (0, 0, 10, 10)}]
    block = {"id": "b", "text": "Mean  value.", "box": (1, 1, 9, 9)}
    assert layout.aligned([block, block], units) == [("b", "normalized_native_text", "u1"), ("b", "recognized_unaligned", None)]


def test_support_rules(spark):
    from tessera.operators import support

    facts = spark.createDataFrame([("d", "f1", "s.a", "name", "Area"), ("d", "f2", "s.a", "value", "1"), ("d", "f3", "s.b", "value", "2")], "dataset_id string, fact_id string, subject string, predicate string, value string")
    scopes = spark.createDataFrame([("sc", "d", "s", {"Area": "predictor"})], "scope_id string, dataset_id string, sheet string, roles map<string,string>")
    got = support.scoped_catalog(facts, scopes).collect()
    assert [(r.object_id, r.role, r.property_facts) for r in got] == [("sc::s.a", "predictor", ["f2"])]
    pages = spark.createDataFrame([(1, "the mean area is"), (2, "areas only")], "page_id int, lexical string")
    names = spark.createDataFrame([("o", "mean area"), ("p", "area")], "object_id string, lexical string")
    assert sorted(map(tuple, support.visible_names(pages, names).collect())) == [("o", 1), ("p", 1)]
    w = spark.createDataFrame([("x", 1, 0, "the features have these definitions"), ("x", 1, 5, "area: it measures size"), ("x", 1, 9, "area: measures again"), ("x", 2, 10, "width: gives w")], "paper_id string, page int, window_index int, lexical string")
    m = spark.createDataFrame([("x", 1, "area", 5), ("x", 2, "area", 9), ("x", 3, "width", 10)], "paper_id string, mention_id int, lexical string, window_index int")
    d = support.defined_names(w, m)
    assert [(r.mention_id, r.introduced_at) for r in d.collect()] == [(1, 0)]
    mm = spark.createDataFrame([(1, "area", "u9"), (2, "min", "u1"), (3, "len", "u2"), (4, "both", "u3")], "mention_id int, lexical string, unit_id string")
    cells = spark.createDataFrame([("u2", "len"), ("u3", "both")], "unit_id string, lexical string")
    heads = spark.createDataFrame([("u1", "min"), ("u3", "both")], "unit_id string, lexical string")
    assert {r.mention_id: r.status for r in support.field_support(mm, cells, heads, d).collect()} == {1: "supported", 2: "rejected", 3: "supported", 4: "unresolved"}
    runs = spark.createDataFrame([("a", "success", 0), ("b", "success", 1)], "run_id string, admission string, errors int")
    dec = spark.createDataFrame([("a", "o", "supported"), ("b", "o", "supported"), ("a", "q", "rejected")], "run_id string, object_id string, status string")
    assert [tuple(r) for r in support.published(dec, runs).collect()] == [("a", "o")]
