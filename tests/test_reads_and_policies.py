"""Pages with cursors and limits, assemblies, rules as tables, and nodes that act on the outside."""

import time

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import assembly, differences, integrity, policies, reads, rollups
from tallyloom.plans import evaluate, fold
from tallyloom.plans.definition import parse
from tallyloom.streaming import folds


def log(spark):
    rows = [(n, n % 2, "r" if n % 3 else None, ("permission_decided", "click", "node_completed")[n % 3], n % 4, n % 5, '{"decision":"%s"}' % ("allow" if n % 2 else "deny")) for n in range(1, 40)]
    return spark.createDataFrame(rows, "lsn long, event_index int, run_id string, kind string, run_seq long, audit_seq long, payload string")


def test_pages_end_at_their_bytes_and_go_on_from_their_cursor(spark):
    df, after, seen = log(spark), (0, 0), []
    for _ in range(20):
        page = reads.event_page(df, 30, after=after, rows=10, size=F.lit(100), budget=350)
        got = [r["lsn"] for r in page.collect()]
        place = reads.next_cursor(page, df, 30, "r/all").first()
        assert len(got) <= 3 and place["bound"] == "r/all" and place["upper_lsn"] == 30
        seen += got
        if not place["more"]:
            break
        after = (place["lsn"], place["event_index"])
    assert seen == list(range(1, 31))
    assert len(reads.event_page(df, 30, size=F.lit(10**9), budget=5).collect()) == 1
    assert reads.next_cursor(reads.event_page(df, 0), df, 0, "x").first()["more"] is False


def test_classes_of_facts(spark):
    df = log(spark)
    n = lambda name: reads.of_class(df, name).count()
    assert (n("all"), n("events"), n("audit"), n("permission")) == (39, df.filter("run_seq > 0").count(), df.filter("audit_seq > 0").count(), 13)
    with pytest.raises(ValueError):
        reads.of_class(df, "other")


def test_audit_pages_go_run_by_run_then_the_rest(spark):
    df = log(spark)
    want = sorted(((r["run_id"] is None, r["run_id"] or "", r["lsn"]) for r in df.collect() if r["audit_seq"] > 0 or r["kind"] == "permission_decided"))
    seen, after = [], None
    while page := reads.audit_page(df, 100, rows=7, after=after).collect():
        seen += [(r["run_id"] is None, r["run_id"] or "", r["lsn"]) for r in page]
        after = (page[-1]["run_id"], page[-1]["lsn"])
    assert seen == want
    assert {r["lsn"] % 2 for r in reads.audit_page(df, 100, decision="deny").collect()} == {0}


def test_lists_refuse_what_they_would_cut(spark):
    df = spark.createDataFrame([(i, f"n{i % 3}", i) for i in range(12)], "key long, name string, created_order long")
    assert [r["key"] for r in reads.ordered_list(df, "key", "name").collect()][:5] == [0, 3, 6, 9, 1]
    assert [r["key"] for r in reads.ordered_list(df, "key").collect()][:2] == [11, 10]
    with pytest.raises(ValueError, match="more than 11"):
        reads.ordered_list(df, "key", most=11)
    versions = spark.createDataFrame([("w", 1), ("w", 3), ("w", 2)], "workflow_id string, version int")
    assert [r["version"] for r in reads.versions_newest_first(versions, "w").collect()] == [3, 2, 1]
    with pytest.raises(LookupError):
        reads.versions_newest_first(versions, "x")
    with pytest.raises(Exception, match="newer than 10"):
        reads.at_point(df.withColumn("last_lsn", F.col("key")), 10).collect()
    assert reads.at_point(df.withColumn("last_lsn", F.col("key")), 11).count() == 12
    started = spark.createDataFrame([("a", None, 0), ("b", 5, 1), ("c", 3, 2), ("d", None, 3)], "id string, at long, n int")
    assert [r["id"] for r in reads.by_activity(started, "at", "n").collect()] == ["c", "b", "a", "d"]


def test_ranks_run_over_all_ranges(spark):
    df = spark.createDataFrame([(f"n{i}", i * 7 % 101) for i in range(101)], "name string, v int").repartition(5)
    gone = spark.createDataFrame([("N3",), ("n50",)], "name string")
    got = assembly.exclude_and_rank(df, gone, "name", [F.desc("v")]).collect()
    assert [(r["rank"], r["v"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i + 1, v) for i, v in enumerate(sorted((i * 7 % 101 for i in range(101) if i not in (3, 50)), reverse=True))]


def test_cascades_of_cancelling(spark):
    runs = spark.createDataFrame([("a", None, "running"), ("b", "a", "running"), ("c", "b", "running"), ("d", "a", "succeeded"), ("e", "d", "running"), ("x", None, "running")], "run_id string, parent_id string, status string")
    got = assembly.cancel_cascade(spark.createDataFrame([("a",)], "run_id string"), runs)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "b", 1), ("a", "c", 2)]


def test_small_joins_and_sums(spark):
    losses = spark.createDataFrame([("r", 1, 5, False), ("r", 3, 2, True), ("q", 0, 0, False)], "run_id string, dropped long, torn long, gap boolean")
    assert sorted(tuple(r) for r in rollups.merge_losses(losses, ["run_id"], ["dropped", "torn"], "gap").collect()) == [("q", 0, 0, False), ("r", 3, 5, True)]
    asked, recorded = spark.createDataFrame([("p/a", "f1"), ("p/b", "f2"), ("p/c", None)], "path string, fingerprint string"), spark.createDataFrame([("p/a", "f1", "x"), ("p/b", "other", "y")], "path string, fingerprint string, outcome string")
    assert sorted((r["path"], r["outcome"], r["matches"]) for r in assembly.fixtures_by_fingerprint(asked, recorded).collect()) == [("p/a", "x", True), ("p/b", "y", False), ("p/c", None, True)]
    value = spark.createDataFrame([("a", None), ("a", "d")], "inline string, digest string").select(differences.comparable_value("inline", "digest").alias("d"))
    assert [r["d"] for r in value.collect()] == ["ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb", "d"]
    facts = spark.createDataFrame([("k", 1, "x"), ("k", 2, None), ("j", 1, "y")], "key string, lsn long, body string")
    assert [tuple(r) for r in integrity.live_state(facts, ["key"], "lsn", "body").collect()] == [("j", 1, "y")]
    sealed = spark.createDataFrame([("d1", 3), ("d2", 3), ("d3", 0)], "dispatch_id string, sealed_through long")
    audits = spark.createDataFrame([("d1", 1), ("d1", 3), ("d2", 1), ("d2", 2)], "dispatch_id string, audit_seq long")
    whole, short = fold.split_sealed(sealed, audits, ["dispatch_id"])
    assert sorted(r["dispatch_id"] for r in whole.collect()) == ["d1", "d3"] and [r["dispatch_id"] for r in short.collect()] == ["d2"]


def test_elapsed_time_of_open_runs_goes_on(spark):
    times = spark.createDataFrame([("a", 10, 30), ("a", 20, None), ("b", 10, 30)], "id string, s long, e long").select("id", F.timestamp_micros("s").alias("s"), F.timestamp_micros("e").alias("e"))
    assert {r["id"]: r["elapsed_us"] for r in rollups.run_elapsed(times, ["id"], "s", "e", F.timestamp_micros(F.lit(100))).collect()} == {"a": 90, "b": 20}


def rule(**k):
    return tuple((dict.fromkeys(x.split()[0] for x in policies.RULE.split(", ")) | k).values())


def spec(**k):
    return tuple((dict.fromkeys(x.split()[0] for x in policies.SPEC.split(", ")) | k).values())


def test_requests_against_tables_of_rules(spark):
    rules = spark.createDataFrame([
        rule(layer="p", id="s", action="secret", ask=False, family="secret", names=["k1"]), rule(layer="p", id="x", action="exec", ask=False, family="exec", executable="git", argv=["status"]),
        rule(layer="p", id="sh", action="shell", ask=True, family="shell", script_digest="d"), rule(layer="p", id="l", action="llm", ask=False, family="llm", providers=["a"], models=["m"]), rule(layer="p", id="f", action="file", ask=False, family="file", subtree="docs"),
    ], policies.RULE)
    wanted = {
        "secret": [spec(action="secret", name="k1")], "other secret": [spec(action="secret", name="k2")], "git": [spec(action="exec", executable="/usr/bin/git", argv=["status"])], "git push": [spec(action="exec", executable="git", argv=["push"])],
        "shell": [spec(action="shell", executable="sh", script_digest="d")], "model": [spec(action="llm", provider="a", model="m")], "file": [spec(action="file", path="docs/a", mutating=True)], "beside": [spec(action="file", path="docsa")],
        "two": [spec(action="secret", name="k1"), spec(action="file", path="etc")], "none": [],
    }
    specs = spark.createDataFrame([(name, i, *s[2:3], bool(s[3]), *s[4:]) for name, held in wanted.items() for i, s in enumerate(held)], policies.SPEC)
    requests = spark.createDataFrame([(name,) for name in wanted], "request_id string")
    ask = lambda **k: {r["request_id"]: r["decision"] for r in policies.check_requests(requests, specs, rules, ["p"], **k).collect()}
    want = {"secret": "allow", "other secret": "deny", "git": "allow", "git push": "deny", "shell": "ask", "model": "allow", "file": "allow", "beside": "deny", "two": "deny", "none": "deny"}
    assert ask() == want
    assert ask(mode="plan") == want | {"file": "deny"}
    assert set(ask(mode="bypass").values()) == {"allow"} and set(ask(legacy=True).values()) == {"deny"}
    assert ask(approved=spark.createDataFrame([("shell",)], "request_id string")) == want | {"shell": "allow"}


def test_rules_that_cover_rules(spark):
    pairs = [
        (dict(action="a", family="any"), dict(action="a", family="net", methods=["GET"], url_prefix="https://h/x"), True), (dict(action="a", family="any"), dict(action="b", family="any"), False),
        (dict(action="n", family="net", methods=["get", "POST"], url_prefix="https://h/a"), dict(action="n", family="net", methods=["GET"], url_prefix="https://h:443/a/b"), True),
        (dict(action="n", family="net", methods=["GET"], url_prefix="https://h/a"), dict(action="n", family="net", methods=["GET", "PUT"], url_prefix="https://h/a"), False),
        (dict(action="f", family="file", subtree="d"), dict(action="f", family="file", path="d/x"), True), (dict(action="f", family="file", subtree="d"), dict(action="f", family="file", subtree="da"), False), (dict(action="f", family="file", path="d"), dict(action="f", family="file", subtree="d"), False),
        (dict(action="s", family="secret", names=["a", "b"]), dict(action="s", family="secret", names=["a"]), True), (dict(action="x", family="exec", executable="git", argv=["s"]), dict(action="x", family="exec", executable="/bin/git", argv=["s"]), True),
        (dict(action="n", family="net", methods=["GET"], url_prefix="https://h"), dict(action="n", family="any"), False),
    ]
    rules = spark.createDataFrame([(i, rule(**a), rule(**b)) for i, (a, b, _) in enumerate(pairs)], f"i int, a struct<{policies.RULE.replace(' ', ':').replace(',:', ',')}>, b struct<{policies.RULE.replace(' ', ':').replace(',:', ',')}>")
    names = [x.split()[0] for x in policies.RULE.split(", ")]
    covers = policies.rule_covers({n: F.col(f"a.{n}") for n in names}, {n: F.col(f"b.{n}") for n in names})
    assert [r[1] for r in rules.select("i", covers).orderBy("i").collect()] == [want for *_, want in pairs]
    needs = spark.createDataFrame([("plug", *rule(id="n1", action="n", family="net", methods=["GET"], url_prefix="https://h/a")[1:]), ("plug", *rule(id="n2", action="s", family="secret", names=["z"])[1:])], "plugin_id string, " + policies.RULE.split(", ", 1)[1])
    held = spark.createDataFrame([rule(layer="grant", id="g", action="n", family="any"), rule(layer="workflow", id="w", action="s", family="any"), rule(layer="grant", id="g2", action="s", family="any")], policies.RULE)
    assert sorted(tuple(r) for r in policies.uncovered_needs(needs, held, ["grant", "workflow"]).collect()) == [("plug", "n1", "workflow")]
    own = spark.createDataFrame([("parent", *rule(id="p", action="n", family="any")[1:]), ("child", *rule(id="c", action="n", family="any")[1:])], "run_id string, " + policies.RULE.split(", ", 1)[1])
    frozen = policies.freeze_ceilings(own, spark.createDataFrame([("child", "parent", 1)], "run_id string, ancestor string, depth int"))
    assert sorted((r["run_id"], r["layer"], r["id"]) for r in frozen.collect()) == [("child", "ceiling:1", "p"), ("child", "own", "c"), ("parent", "own", "p")]


def graph(nodes, edges):
    return parse({"nodes": [{"id": n[0], "type": n[1], "params": n[2] if len(n) > 2 else {}} for n in nodes], "edges": [{"from": a, "to": b} for a, b in edges]})


def played(spark, kind, params, reply, status=200, **options):
    d = graph([("s", "start"), ("x", kind, params), ("e", "end")], [("s", "x"), ("x", "e")])
    df = spark.range(1).select(F.struct("id").alias("input"), F.create_map(F.lit("x"), F.lit(reply)).alias("recorded"), F.create_map(F.lit("x"), F.lit(status)).alias("statuses"))
    return tuple(evaluate.run_batch(d, df, **options).select("run_status", "run_output", "run_error").first())


def test_nodes_that_act_on_the_outside(spark):
    mail = {"api_key": "k", "from": "a", "to": "b", "subject": "s", "body": "t"}
    assert played(spark, "http_call", {"url": "u"}, '{"a": 1}') == ("succeeded", '{"status":200,"headers":{},"body":{"a":1}}', None)
    assert played(spark, "http_call", {"url": "u"}, '{"a": 1}', 503) == ("failed", None, "HTTP status 503")
    assert played(spark, "harness", {"prompt": "p"}, '{"exit_code": 0, "stdout": " {\\"a\\": [1]}\\n", "stderr": ""}') == ("succeeded", '{"exit_code":0,"stdout":" {\\"a\\": [1]}\\n","stderr":"","result":{"a":[1]}}', None)
    assert played(spark, "harness", {"prompt": "p"}, '{"exit_code": 0, "stdout": "5", "stderr": "w"}') == ("succeeded", '{"exit_code":0,"stdout":"5","stderr":"w"}', None)
    assert played(spark, "harness", {"prompt": "p"}, '{"exit_code": 2, "stdout": "", "stderr": "no"}') == ("failed", None, "exit code 2")
    assert played(spark, "email", mail, '{"id": "m1", "more": 2}') == ("succeeded", '{"status":200,"id":"m1"}', None)
    assert played(spark, "email", mail, "sent") == ("failed", None, "the reply is no JSON")
    assert played(spark, "llm", {"url": "u", "body": "b", "response_schema": {"type": "string"}}, '{"a":1}') == ("failed", None, "response contract: $: expected string")

    def upper(params, before):
        return F.upper(before["s"]), F.when(F.lit(params.get("broken", False)), "broken")

    assert played(spark, "own.upper", {}, "", plugins={"own.upper": upper}) == ("succeeded", '{"ID":0}', None)
    assert played(spark, "own.upper", {"broken": True}, "", plugins={"own.upper": upper}) == ("failed", None, "broken")


def test_repeatable_effects_wait_for_another_attempt(spark):
    d = graph([("s", "start"), ("x", "http_call", {"url": "u", "effect_policy": "repeatable", "retry": {"max_attempts": 3}}), ("e", "end")], [("s", "x"), ("x", "e")])
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, made int").select(F.struct("id").alias("input"), F.create_map(F.lit("y"), F.lit("1")).alias("recorded"), F.create_map(F.lit("x"), F.col("made")).alias("attempts"))
    assert [r[0] for r in evaluate.run_batch(d, df).orderBy("input.id").select("node_x.status").collect()] == ["waiting", "waiting", "failed"]


def test_two_nodes_of_one_run_wake_at_one_time(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", folds.ROCKS)
    soon = int(time.time() * 1000) + 8000
    rows = spark.createDataFrame([("r", "a", soon), ("r", "b", soon), ("r", "c", soon + 1), ("r", "d", 9_999_999_999_999)], "run_id string, node_id string, wake_ms long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = folds.fire_delays(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))).start()
    try:
        query.awaitTermination(25)
    finally:
        query.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(r["node_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        folds.expire_approvals(rows.withColumnRenamed("wake_ms", "asked_ms"), ttl_ms=1000)


def test_subscriptions(spark):
    df = log(spark)
    control = folds.subscribe_control(df, ("node_completed",), "r", 1)
    assert {r["run_id"] for r in control.collect()} == {"r"} and control.filter("run_seq <= 1").count() == 0 and control.filter("ends").count() > 0
    assert folds.subscribe_audit(df, 20).count() == df.filter("lsn > 20 and audit_seq > 0").count()


def test_workflows_with_their_versions(spark):
    versions = spark.createDataFrame([("w", 2, "b2", False), ("w", 1, "b1", True)], "workflow_id string, version int, body string, published boolean")
    out = assembly.assemble_workflows(spark.createDataFrame([("w",), ("v",)], "workflow_id string"), versions).orderBy("workflow_id").collect()
    assert [(r["workflow_id"], r["versions"], r["latest"], r["published_version"]) for r in out] == [("v", None, None, None), ("w", {1: "b1", 2: "b2"}, 2, 1)]
