import json
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import assembly, differences, hierarchy, integrity, policies, reads, retention, rollups
from tallyloom.plans import evaluate, fold
from tallyloom.plans.definition import parse, problems
from tallyloom.sources import facts
from tallyloom.streaming import folds


def graph(nodes, edges, **more):
    return parse({"nodes": [{"id": n[0], "type": n[1], "params": n[2] if len(n) > 2 else {}} for n in nodes], "edges": [{"from": e[0], "to": e[1], "port": e[2] if len(e) > 2 else None} for e in edges], **more})


START_END = [("s", "start"), ("e", "end")]


@pytest.mark.parametrize(("rule", "nodes", "edges"), [
    ("one_start", [("e", "end")], []), ("has_end", [("s", "start")], []), ("unique_id", [*START_END, ("e", "end")], [("s", "e")]), ("reserved_id", [*START_END, ("run-input", "end")], [("s", "e"), ("s", "run-input")]),
    ("node_id", [*START_END, (" ", "end")], [("s", "e"), ("s", " ")]), ("node_type", [*START_END, ("x", "odd")], [("s", "e"), ("s", "x")]), ("edge_end", START_END, [("s", "e"), ("s", "q")]),
    ("self_loop", [*START_END, ("x", "script", {"code": "1"})], [("s", "x"), ("x", "x"), ("x", "e")]), ("edge_twice", START_END, [("s", "e"), ("s", "e")]), ("port", START_END, [("s", "e", "true")]),
    ("cycle", [*START_END, ("x", "script", {"code": "1"}), ("y", "script", {"code": "1"})], [("s", "x"), ("x", "y"), ("y", "x"), ("y", "e")]), ("unreachable", [*START_END, ("x", "end")], [("s", "e")]),
    ("param", [*START_END, ("x", "script")], [("s", "x"), ("x", "e")]), ("into_start", [*START_END, ("x", "script", {"code": "1"})], [("s", "x"), ("x", "s"), ("x", "e")]), ("out_of_end", [*START_END, ("f", "end")], [("s", "e"), ("e", "f")]),
])
def test_rules_of_definitions(rule, nodes, edges):
    assert rule in {r for r, _ in problems(graph(nodes, edges))}


def test_a_sound_definition_breaks_nothing():
    assert problems(graph(START_END, [("s", "e")])) == []
    wide = [("s", "start"), *[(f"n{i}", "script", {"code": "1"}) for i in range(2000)], ("e", "end")]
    assert problems(graph(wide, [("s", "n0"), *[(f"n{i}", f"n{i + 1}") for i in range(1999)], ("n1999", "e")])) == []


def runs(spark, n=2, **maps):
    df = spark.range(n).select(F.col("id").alias("run_id"), F.struct("id", (F.col("id") * 10).alias("x"), F.when(F.col("id") == 1, "one").alias("name")).alias("input"), F.lit(1000).cast("long").alias("started_ms"))
    for name in ("signals", "recorded"):
        df = df.withColumn(name, F.create_map(*[F.lit(v) for pair in maps.get(name, {"none": "0"}).items() for v in pair]))
    return df


def results(definition, df, *columns, **options):
    out = evaluate.run_batch(definition, df, **options).orderBy("run_id")
    return [tuple(r) for r in out.select("run_status", "run_output", "run_error", *columns).collect()]


def test_waits(spark):
    d = graph([("s", "start"), ("w", "delay", {"ms": 500}), ("h", "human_task"), ("e", "end")], [("s", "w"), ("w", "h"), ("h", "e")])
    assert results(d, runs(spark, 1), "node_w.status", "node_h.status", now_ms=1400) == [("running", None, None, "waiting", "pending")]
    assert results(d, runs(spark, 1), "node_w.output", "node_h.status", now_ms=1500) == [("running", None, None, '{"slept_ms":500}', "waiting")]
    assert results(d, runs(spark, 1, signals={"h": '{"ok":true}'}), now_ms=1500) == [("succeeded", '{"ok":true}', None)]


def test_outside_nodes_play_recorded_outcomes(spark):
    d = graph([("s", "start"), ("c", "http_call", {"url": "u"}), ("e", "end")], [("s", "c"), ("c", "e")])
    assert results(d, runs(spark, 1, recorded={"c": '{"a": 1}'})) == [("succeeded", '{"a":1}', None)]
    assert results(d, runs(spark, 1, recorded={"c": "not json"})) == [("succeeded", '"not json"', None)]
    assert results(d, runs(spark, 1)) == [("failed", None, "no recorded outcome")]


def test_contracts_of_definitions(spark):
    d = graph(START_END, [("s", "e")], input_schema={"type": "object", "properties": {"x": {"type": "integer", "maximum": 5}}}, output_schema={"type": "object", "properties": {"id": {"enum": [0]}}})
    assert [r[0] for r in results(d, runs(spark))] == ["succeeded", "failed"]
    assert results(d, runs(spark))[1][2] == "input contract: $.x: number outside bounds"
    d = graph(START_END, [("s", "e")], output_schema={"type": "string"})
    assert results(d, runs(spark, 1))[0][2] == "output contract: $: expected string"


@pytest.mark.parametrize(("semantics", "want"), [(2, '"t"'), (1, '{"end_f":null,"end_t":"t"}')])
def test_ends_of_untaken_branches(spark, semantics, want):
    d = graph([("s", "start"), ("c", "condition", {"expr": "input.id = 0"}), ("t", "script", {"code": "'t'"}), ("f", "script", {"code": "'f'"}), ("end_t", "end"), ("end_f", "end")], [("s", "c"), ("c", "t", "true"), ("c", "f", "false"), ("t", "end_t"), ("f", "end_f")], semantics=semantics)
    assert results(d, runs(spark, 1)) == [("succeeded", want, None)]


def test_a_skip_by_an_and_join_counts_as_failure_downstream(spark):
    d = graph(
        [("s", "start"), ("c", "condition", {"expr": "true"}), ("t", "script", {"code": "1"}), ("f", "script", {"code": "2"}), ("both", "script", {"code": "3", "join": "all"}), ("after", "script", {"code": "4"}), ("e", "end")],
        [("s", "c"), ("c", "t", "true"), ("c", "f", "false"), ("t", "both"), ("f", "both"), ("both", "after"), ("after", "e")],
    )
    assert results(d, runs(spark, 1), "node_both.skip_reason", "node_after.skip_reason") == [("failed", None, "no active end node completed", "upstream_skipped", "upstream_failed")]


def test_children_take_the_parents_input_unless_mapped(spark):
    child = graph([("s", "start"), ("v", "script", {"code": "input.x + 1"}), ("e", "end")], [("s", "v"), ("v", "e")])
    for mapping, want in ((None, ["1", "11"]), ({"x": "input.id"}, ["1", "2"])):
        d = graph([("s", "start"), ("sub", "sub_workflow", {"workflow_id": "w"} | ({"input_mapping": mapping} if mapping else {})), ("e", "end")], [("s", "sub"), ("sub", "e")])
        assert [r[1] for r in results(d, runs(spark), children={"w": child})] == want


def test_scripts_see_direct_predecessors_only(spark):
    d = graph([("s", "start"), ("a", "script", {"code": "1"}), ("b", "script", {"code": "2"}), ("c", "script", {"code": "nodes.a"}), ("e", "end")], [("s", "a"), ("a", "b"), ("b", "c"), ("c", "e")])
    with pytest.raises(ValueError, match="no direct predecessor"):
        evaluate.run_batch(d, runs(spark))


#: The state a node has after some facts, and what each further fact does to it: a new state, or '-' for a rejected one.
SHAPES = {
    "absent": [], "running": ["dispatched"], "delay": ["dispatched", "wait_delay"], "signal": ["dispatched", "wait_signal"], "child": ["dispatched", "wait_child"], "retry": ["dispatched", "failed_retry"],
    "uncertain": ["dispatched", "wait_uncertain"], "pending": ["dispatched", "wait_uncertain", "adjudged_retry"], "succeeded": ["dispatched", "completed"], "failed": ["dispatched", "failed"], "skipped": ["skipped"],
}
ALLOWED = {
    "absent": {"dispatched": "running", "skipped": "skipped"}, "pending": {"dispatched": "running"}, "retry": {"dispatched": "running"},
    "running": {"dispatched": "running", "completed": "succeeded", "failed": "failed", **{k: "waiting" for k in ("failed_retry", "wait_delay", "wait_signal", "wait_child", "wait_uncertain")}},
    "delay": {"resolved": "succeeded"}, "signal": {"resolved": "succeeded"}, "child": {"resolved": "succeeded", "failed": "failed", "failed_retry": "waiting"},
    "uncertain": {"adjudged_accept": "succeeded", "adjudged_retry": "pending", "adjudged_fail": "failed"}, "succeeded": {}, "failed": {}, "skipped": {},
}
PROBES = ["dispatched", "completed", "failed", "failed_retry", "skipped", "wait_delay", "resolved", "adjudged_accept", "adjudged_retry", "adjudged_fail", "wait_uncertain"]


def test_every_fact_in_every_state(spark):
    rows = [(shape, probe, n, kind) for shape, before in SHAPES.items() for probe in PROBES for n, kind in enumerate([*before, probe])]
    got = {(r["run_id"], r["node_id"]): r for r in fold.fold_nodes(spark.createDataFrame(rows, "run_id string, node_id string, lsn long, kind string")).collect()}
    base = {s: {"absent": "absent", "delay": "waiting", "signal": "waiting", "child": "waiting", "retry": "waiting", "uncertain": "waiting"}.get(s, s) for s in SHAPES}
    for (shape, probe), r in got.items():
        want = ALLOWED[shape].get(probe)
        assert r["status"] == (want or base[shape]), (shape, probe)
        assert r["rejected"] == ([] if want else [len(SHAPES[shape])]), (shape, probe)


def test_keyset_pages(spark):
    rows = [("a", 0, "w", "succeeded"), ("b", 1, "w", "succeeded"), ("c", 1, "w", "succeeded"), ("d", 2, "x", "succeeded"), ("e", 3, "w", "failed")]
    df = spark.createDataFrame([(*r, "manual") for r in rows], "run_id string, created long, workflow_id string, status string, source string")
    mine = reads.filter_runs(df, workflow_id="w", status="succeeded")
    page = lambda **k: [r["run_id"] for r in reads.keyset_page(mine, "created", "run_id", 2, **k).collect()]
    assert page() == ["c", "b"] and page(before="b") == ["a"] and page(before="unknown") == ["c", "b"]
    with pytest.raises(ValueError):
        reads.filter_runs(df, status="done")


def test_byte_budgets(spark):
    df = spark.createDataFrame([(k, 1_100_000) for k in "abcde"], "key string, n long")
    page = lambda *a, **k: [r["key"] for r in reads.byte_budget_page(df, "key", F.col("n"), *a, **k).collect()]
    assert page(256) == ["a", "b", "c"] and page(256, after="c") == ["d", "e"] and page(0) == [] and page(256, budget=10) == ["a"]


def test_pages_push_their_filters_down(spark, sf_dir):
    df = reads.event_page(facts.table(spark, sf_dir, "events").select(F.col("event_id").alias("lsn"), F.col("event_type").alias("kind")), 50, kinds=("error",))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan" in plan and "TakeOrderedAndProject" in plan


def test_stats_by_cube(spark):
    df = spark.createDataFrame([("w", "succeeded"), ("w", "failed"), ("x", "succeeded")], "workflow_id string, status string")
    got = {(r["workflow_id"], r["status"], r["level"]): r["n_runs"] for r in rollups.run_stats(df).collect()}
    assert got[(None, None, 3)] == 3 and got[("w", None, 1)] == 2 and got[(None, "succeeded", 2)] == 2 and len(got) == 8


def test_cache_stats_begin_after_the_last_clearing(spark):
    log = [("s", 0, "assistant", 5, 1, None), ("s", 1, "cleared", None, None, None), ("s", 2, "assistant", 10, 4, 2), ("s", 3, "assistant", 10, None, None), ("t", 0, "user", None, None, None)]
    got = rollups.cache_stats(spark.createDataFrame(log, "id string, pos long, kind string, input_tokens long, cache_read_tokens long, cache_write_tokens long"), "id", "pos").collect()
    assert [tuple(r) for r in got] == [("s", 20, 4, 2, 2, 1, 0.2)]


def test_chains_tell_what_was_changed(spark):
    base = spark.createDataFrame([(1, n, f"d{n}") for n in range(5)], "run_id long, lsn long, body string")
    chain = integrity.chain_links(base, ["run_id"], "lsn", F.sha2("body", 256))
    assert integrity.broken_links(chain, ["run_id"], "lsn").count() == 0
    spoilt = chain.withColumn("digest", F.when(F.col("lsn") == 2, F.sha2(F.lit("x"), 256)).otherwise(F.col("digest")))
    assert sorted(r["lsn"] for r in integrity.broken_links(spoilt, ["run_id"], "lsn").collect()) == [2, 3]
    assert integrity.watermark(base.withColumn("lsn", F.col("lsn") + 1)).first()["whole"]


def test_policies(spark):
    cap = policies.Capability
    request = {k: F.col(k) for k in ("action", "method", "url", "path")} | {"recipients": F.split("to", ",")}
    df = spark.createDataFrame([("net", "get", "https://h/a/b", None, None), ("net", "POST", "https://h/a", None, None), ("email", None, None, None, "a@x,b@x"), ("file", None, None, "docs/x", None)], "action string, method string, url string, path string, to string")
    ask = lambda *layers: [r[0] for r in df.select(policies.decide(request, list(layers), F.lit("2026-01-01").cast("timestamp"))).collect()]
    net, mail, files = cap("n", "net", methods=("GET",), url_prefix="https://h/a"), cap("m", "email", names=("a@x", "b@x")), cap("f", "file", subtree="docs", ask=True)
    assert ask() == ["deny"] * 4
    assert ask(policies.Layer("p", (net, mail, files))) == ["allow", "deny", "allow", "ask"]
    assert ask(policies.Layer("p", (net, mail, files)), policies.Layer("w", (cap("any", "net", anything=True),))) == ["allow", "deny", "deny", "deny"]
    assert ask(policies.Layer("p", (cap("old", "net", anything=True, expires_at="2025-01-01"),)))[0] == "deny"


def test_closure_keeps_the_shortest_way(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1)], "parent long, child long")
    got = {(r["node"], r["depth"]) for r in hierarchy.closure(edges, spark.createDataFrame([(1,)], "root long")).collect()}
    assert got == {(1, 0), (2, 1), (3, 1)}


def test_edge_changes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "`from` string, `to` string, port string")
    got = {(r["from"], r["port"], r["verdict"]) for r in differences.edge_changes(frame([("a", "b", None), ("c", "d", "true")]), frame([("a", "b", None), ("c", "d", "false")])).collect()}
    assert got == {("c", "true", "removed"), ("c", "false", "added")}


def test_observations_leave_torn_lines_out(spark, tmp_path):
    good = {"seq": 1, "run_id": "r", "dispatch_id": "d", "ts": "2026-01-01T00:00:00Z", "line": {"level": "info", "message": "m"}}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\nnot json\n" + json.dumps(good)[:20])
    assert [r["seq"] for r in facts.read_observations(spark, str(tmp_path)).collect()] == [1]


def test_values_survive_chunking(spark):
    df = spark.createDataFrame([("a", ""), ("b", "é" * 1000), ("c", "x" * 64)], "key string, body string")
    chunks = facts.split_value(df, "key", "body", 64)
    got = {r["key"]: (r["chunk_count"], r["total_bytes"], r["whole"]) for r in facts.join_value(chunks, "key").collect()}
    assert got == {"a": (1, 0, True), "b": (32, 2000, True), "c": (1, 64, True)}
    assert not facts.join_value(chunks.filter("key = 'b' and chunk_index <> 3"), "key").first()["whole"]


def test_bundles_and_listings(spark, tmp_path):
    log = spark.createDataFrame([(n, 0, "k", "r" if n % 2 else "q", n, None, None, 0, "{}") for n in range(10)], facts.FACTS)
    facts.write_run_bundle(log, "r", str(tmp_path / "bundle"))
    assert sorted(r["lsn"] for r in facts.read_facts(spark, str(tmp_path / "bundle")).collect()) == [1, 3, 5, 7, 9]
    assert facts.list_files(spark, str(tmp_path), "*.json").count() >= 1


def test_joins_of_signals_children_and_pages(spark):
    signals = spark.createDataFrame([("r", "n", 2, "b"), ("r", "n", 1, "a"), ("r", "x", 3, "c")], "run_id string, node_id string, lsn long, payload string")
    waits = spark.createDataFrame([("r", "n")], "run_id string, node_id string")
    assert [tuple(r) for r in assembly.signals_to_waits(signals, waits).collect()] == [("r", "n", 1, "a", True)]
    parents = spark.createDataFrame([("p", "c1"), ("p", "c2")], "run_id string, child_run_id string")
    ended = spark.createDataFrame([("c1", "succeeded"), ("c2", "running")], "run_id string, status string")
    assert [r["child_run_id"] for r in assembly.children_of(parents, ended).collect()] == ["c1"]
    have, page = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,), (3,)], "id long")
    assert sorted(r[0] for r in reads.merge_page(have, page, "id").collect()) == [1, 2, 3]
    executors = spark.createDataFrame([("a", 1, 4, True), ("b", 2, 4, False), ("c", 2, 4, False), ("d", 0, 0, False)], "executor_id string, used int, slots int, draining boolean")
    assert reads.least_loaded(executors).first()["executor_id"] == "b"


def test_newest_rows(spark):
    df = spark.createDataFrame([("k", n) for n in range(10)], "key string, n long")
    assert sorted(r["n"] for r in retention.newest_rows(df, ["key"], "n", 3).collect()) == [7, 8, 9]


def test_delays_fire_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", folds.ROCKS)
    soon = int(time.time() * 1000) + 8000
    rows = spark.createDataFrame([("r", "past", 1000), ("q", "soon", soon), ("q", "later", 9_999_999_999_999)], "run_id string, node_id string, wake_ms long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = folds.fire_delays(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))).start()
    try:
        query.awaitTermination(30)
    finally:
        query.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("run_id", "node_id", "woke_ms").collect()) == [("q", "soon", soon), ("r", "past", 1000)]
